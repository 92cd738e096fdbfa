"""The manifest, fingerprint and search operators against plain versions."""

import random

import numpy as np
import pytest

from codelattice.llm import merkle, simhash, sliced
from codelattice.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect
from tests.llm import brute
from tests.llm.conftest import messy_rows, prose

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_manifest", "op13_search"])
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name, QUERIES, ORACLES) == "ok"


def test_manifest(messy, nothing):
    want = brute.manifest([(r[0], r[3], r[2], r[4], r[1]) for r in messy_rows()])
    got = [tuple(r) for r in merkle.manifest_report(messy).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert merkle.manifest_report(nothing).count() == 0


def test_manifest_of_several_rounds(spark, monkeypatch):
    """Blocks of 8 leaves: up to four rounds, many groups, one with half of the rows, runs of one."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(k, f"s{k % 3}", "hot" if k < 600 else f"l{k % 70}" if k % 9 else None, k, f"Text {k}") for k in range(1100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(tuple(r) for r in merkle.manifest_report(docs).collect()) == sorted(brute.manifest(rows))


def test_a_row_that_repeats_over_many_ranges(spark):
    rows = [(7, "s", "hot", 4, "Same")] * 900 + [(k, None, "hot", None, f"x{k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = sorted((tuple(r) for r in merkle.manifest_report(docs).collect()), key=repr)
    assert got == sorted(brute.manifest(rows), key=repr)


def test_golay_cover():
    code = simhash.cover()
    words = np.random.default_rng(1).integers(0, 1 << 23, 5000)
    home = words ^ code.leaders[code.rest(words)]
    assert (np.bitwise_count(words ^ home) <= 3).all() and (code.rest(home) == 0).all()
    assert len(np.unique(code.leaders)) == 2048  # perfect: each error of up to three bits has its rest


def _clusters(seed, centres, members, flips):
    rng = np.random.default_rng(seed)
    out = []
    for centre in rng.integers(0, 1 << 63, centres).tolist():
        for _ in range(members):
            x = centre
            for k in rng.integers(0, 64, rng.integers(0, flips + 1)).tolist():
                x ^= 1 << k
            out.append(x)
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("crowd", [16384, 1])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    monkeypatch.setattr(simhash, "TILE", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        fps = np.concatenate([_clusters(1, 12, 30, 5), _clusters(2, 1, 300, 3)])
        links = simhash.links_of(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs = {(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in links}
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    want = brute.parts(fps.tolist(), [(a, b) for k, a in enumerate(fps.tolist()) for b in fps.tolist()[:k] if (a ^ b).bit_count() <= 2])
    assert brute.parts(fps.tolist(), pairs) == want and len(set(want.values())) < len(fps)


def test_simhash(messy, nothing):
    got = [tuple(r) for r in simhash.near_duplicates(messy).collect()]
    assert sorted(got, key=repr) == sorted(brute.simhash([(r[0], r[1]) for r in messy_rows()]), key=repr)
    assert simhash.near_duplicates(nothing).count() == 0


def test_long_texts_are_fingerprinted_in_parts(monkeypatch):
    texts = [prose(8, 3000), "a" * 500 + " b", "x\n" * 400, " " * 900, "é" * 300 + "  " + "Z " * 200]
    whole = [brute.fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "LONG", 64)
    for text, want in zip(texts, whole, strict=True):
        data = np.frombuffer(text.encode(), np.uint8)
        assert int(simhash.fingerprints_of(data, np.array([0, len(data)]))[0]) == want


def test_simhash_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_simhash"](spark, FOLDER).collect())) == sorted(brute.simhash(rows))


ITEMS = [(1, prose(1, 60)), (2, prose(2, 40) + " unheard"), (3, None), (4, ""), (4, "One two two"), (None, "12 34"), (6, "nowhere at all xyzzy"), (7, "é" * 300)]


@pytest.mark.parametrize(("items", "chunk"), [(1024, 1 << 22), (2, 256)])
def test_search(spark, messy, nothing, monkeypatch, items, chunk):
    monkeypatch.setattr(sliced, "ITEMS", items)
    monkeypatch.setattr(sliced, "CHUNK", chunk)
    asked = spark.createDataFrame([(a, b, "x") for a, b in ITEMS], "item_id long, text string, score string")
    got = sorted((tuple(r) for r in sliced.search(messy, asked).collect()), key=repr)
    assert got == sorted(brute.search([(r[0], r[1]) for r in messy_rows()], ITEMS), key=repr)
    assert sliced.search(nothing, asked).count() == 0 and sliced.search(messy, asked.limit(0)).count() == 0


def test_copies_of_the_best_text(spark):
    """Many copies and near copies: each matrix sends on the least ids only, and ties go to the least."""
    base = prose(3, 50)
    rows = [(5000 - k, base) for k in range(3000)] + [(k, base + f" w{k}") for k in range(6000, 6200)] + [(9000, prose(3, 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, base), (2, prose(3, 10) + " w6100")], "item_id long, text string")
    assert sorted(map(tuple, sliced.search(docs, asked).collect())) == sorted(brute.search(rows, [tuple(r) for r in asked.collect()]))


def test_bounds_are_never_below_scores_and_exclude_most():
    rng = random.Random(5)
    texts = [prose(1000 + k, rng.choice([3, 30, 200])) for k in range(300)]
    queries = sliced.Queries([prose(1000 + k, 30) for k in range(0, 60, 3)])
    import pyarrow as pa

    ids = pa.array(range(300), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, pa.array(texts)], ["doc_id", "key_a", "key_b", "text"])
    tally = dict(zip(*(c.to_pylist() for c in next(sliced._tally(queries)([batch.select(["text"])])).columns), strict=True))
    scoring = sliced.Scoring(queries, np.array([tally[k] for k in range(queries.n_terms)]), tally[-1], tally[-2])
    wanted = pa.array([list(range(20))] * 300, pa.list_(pa.int32()))
    exact = np.zeros((20, 300), np.int64)
    for part in sliced._rescore(scoring)([pa.RecordBatch.from_arrays([ids, ids, wanted, pa.array(texts)], ["a", "b", "q", "text"])]):
        exact[part.column(0).to_numpy(), part.column(1).to_numpy()] = part.column(3).to_numpy()
    bounds = np.zeros((20, 300), np.int64)
    for part in sliced._index([batch]):
        for doc, _, terms, width, bits in sliced._matrices(part):
            for lo, b in scoring.bounds(terms, width, bits):
                bounds[:, doc[lo : lo + b.shape[1]]] = b
    assert (bounds >= exact).all()
    assert (bounds >= np.sort(exact, axis=1)[:, -10:-9]).mean() < 0.1


def test_levels():
    levels = sliced.tf_levels()
    assert [next(levels) for _ in range(9)] == [1, 2, 3, 4, 6, 8, 12, 16, 24]
