import random

import pytest

PIECES = ["the", "an", "er", "ion", "st", "re", "on", "and", "of", "in", "ble", "ti", "ou"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _kept string, _lang string, _spans string, row long, core long"


def prose(seed, n):
    """``n`` invented words."""
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(PIECES) for _ in range(rng.randint(1, 3))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def messy_rows():
    """Nulls, empty and long texts, repeated rows, copies, near copies, shared passages, other columns of clashing names."""
    base, shared = prose(1, 120), prose(2, 40)
    near = base.split()
    near[60] = "otherword"
    texts = [
        base, base, " ".join(near), None, "", "   ", "...", "...", "one two", "one two", "One, two", prose(3, 50) + " " + shared, shared + " " + prose(4, 50),
        prose(5, 30000), "x" * 5000, "é" * 300, "é" * 301, "12 34 56", "日本語のテキスト" * 30, "a\x00b " * 60, prose(6, 5), prose(6, 5) + " more",
    ]
    rows = [(k, t, ["en", "fr", None][k % 3], None if k % 4 else "s", None, "kept", "lang", "spans", k, k) for k, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], rows[13], (None, base, "en", None, 3, None, None, None, None, None)]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
