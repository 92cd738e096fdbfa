"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit, a classifier over byte n-grams of the lower-cased letters
says how strongly a text argues for 1 or 0; the language whose codeword has the least loss against these
margins is chosen, and a text whose two best codewords are too close is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import LOWER, fresh, text_chunks

BUCKETS = 1 << 16
BLOCK = 1 << 10  # buckets whose counts go in one row from a task to where they are summed
HELD = 32  # languages whose counts a task holds before it hands them on
TALLIES = "lang string, block int, counts binary"
ORDERS = (1, 2, 3)
EXHAUSTIVE = 7  # languages up to which all ways to split them in two are bits
MARGIN = 0.02  # least gap between the two best codewords, as probability
FLOOR = 0.25  # a text is noise below this part of the share of letters among letters and signs that 99 in 100 fitted texts reach
PREDICTED = "doc_id long, lang_pred string, score double, ambiguous boolean"

_LETTER = regex.compile(r"\p{L}")
_SIGN = np.array([0x20 < b < 0x80 and not chr(b).isalnum() for b in range(256)])
_FOLD = np.where((np.arange(256) < 0x80) & ~((LOWER >= 0x61) & (LOWER <= 0x7A)), 0x20, LOWER).astype(np.uint8)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each of ``n`` classes: all splits for few classes, well separated random rows for many."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        splits = [bits for bits in product((1, -1), repeat=n) if bits[0] == 1 and -1 in bits]
        return np.array(splits, float).T
    rng = np.random.default_rng(seed)
    width = 8 * int(np.ceil(np.log2(n))) + 8
    drawn = [rng.choice([-1.0, 1.0], (n, width)) for _ in range(50)]
    return max(drawn, key=lambda c: min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i)))


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram at each byte, and whether it stays in its text and holds a letter."""
    folded = _FOLD[data].astype(np.uint32)
    blank = folded == 0x20
    for n in ORDERS:
        if len(folded) < n:
            return
        h = np.full(len(folded) - n + 1, n, np.uint32)
        empty = np.ones(len(h), bool)
        for k in range(n):
            h = h * np.uint32(0x01000193) ^ folded[k : k + len(h)]
            empty &= blank[k : k + len(h)]
        h = (h * np.uint32(0x9E3779B1)) >> np.uint32(16)
        ok = ~empty
        for back in range(1, n):
            at = offsets[1:-1] - back
            ok[at[(at >= 0) & (at < len(ok))]] = False
        yield h, ok


def lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of letters among the letters and signs of each text; digits and blanks do not count."""
    letters, signs = (np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (_FOLD[data] != 0x20, _SIGN[data]))
    return letters / np.maximum(letters + signs, 1)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray  # bucket x bit
    scale: float
    margin: float
    floor: float = 0.0  # least share of letters among letters and signs, for a text to be in a language

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean weight per n-gram, one row per text and one column per bit."""
        total = np.zeros((len(offsets) - 1, self.weights.shape[1]))
        n = np.zeros(len(offsets) - 1)
        for h, ok in grams(data, offsets):
            lo = np.minimum(offsets[:-1], len(h))
            some = np.flatnonzero(np.minimum(offsets[1:], len(h)) > lo)
            if not len(some):
                continue
            values = self.weights[h]
            values[~ok] = 0
            total[some] += np.add.reduceat(values, lo[some], axis=0)
            n[some] += np.add.reduceat(ok.astype(np.int64), lo[some])
        return total / np.maximum(n, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its probability, and whether the second is too close."""
        z = np.clip(self.scale * margins, -30, 30)
        loss = np.stack([np.logaddexp(0, -code * z).mean(axis=1) for code in self.codes], axis=1)
        likely = np.exp(-self.codes.shape[1] * (loss - loss.min(axis=1, keepdims=True)))
        likely /= likely.sum(axis=1, keepdims=True)
        order = np.argsort(-likely, axis=1, kind="stable")
        best = order[:, 0]
        top = likely[np.arange(len(best)), best]
        second = likely[np.arange(len(best)), order[:, 1]] if likely.shape[1] > 1 else np.zeros(len(best))
        return best, top, top - second < self.margin


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many n-grams of ``texts`` each bucket has, and how many texts each share of letters, in steps of 1 / 65,535."""
    hits, shares = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for _, _, data, offsets in text_chunks(texts, 1 << 17):
        for h, ok in grams(data, offsets):
            hits += np.bincount(h[ok], minlength=BUCKETS)
        shares += np.bincount(np.rint(lettered(data, offsets) * (BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return hits, shares


def fitted(hits: dict[str, np.ndarray], shares: np.ndarray, margin: float = MARGIN) -> Model:
    """Classifiers of all bits from the counts of each language: smoothed log ratios of n-gram frequencies."""
    languages = sorted(hits)
    codes = codewords(len(languages))
    counts = np.array([hits[lang] for lang in languages], float).reshape(len(languages), BUCKETS)
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)  # each language weighs the same
    weights = np.zeros((BUCKETS, codes.shape[1]), np.float32)
    for b in range(codes.shape[1]):
        one, zero = codes[:, b] > 0, codes[:, b] < 0
        p = share[one].mean(axis=0) if one.any() else np.zeros(BUCKETS)
        q = share[zero].mean(axis=0) if zero.any() else np.zeros(BUCKETS)
        weights[:, b] = np.log((p + 1e-6) / (q + 1e-6))
    model = Model(languages, codes, weights, 4.0, margin)
    if shares.any():
        up_to, at = np.cumsum(shares), 0.01 * (shares.sum() - 1)
        low, high = np.searchsorted(up_to, [np.floor(at), np.ceil(at)], side="right") / (BUCKETS - 1)
        model.floor = FLOOR * float(low + (high - low) * (at - np.floor(at)))
    return model


def fit(rows: list[tuple[str, str]], margin: float = MARGIN) -> Model:
    """A model from ``(text, language)`` rows."""
    hits, shares = {}, np.zeros(BUCKETS, np.int64)
    for lang in {lang for _, lang in rows}:
        hits[lang], of_lang = counted(pa.array([t for t, x in rows if x == lang], pa.string()))
        shares += of_lang
    return fitted(hits, shares, margin)


def _tallies(named: DataFrame) -> DataFrame:
    """Counts of all ``text`` by ``lang``, in blocks of buckets and as int64; those of the shares of letters have no ``lang``."""
    def cut(counts: dict[str | None, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, all_counts in counts.items():
            blocks = all_counts.reshape(-1, BLOCK)
            some = np.flatnonzero(blocks.any(axis=1))
            if not len(some) and lang is not None:
                some = np.zeros(1, np.int64)  # a language is known even if its texts have no n-gram
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array([blocks[k].tobytes() for k in some], pa.binary())],
                ["lang", "block", "counts"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, all_shares = {}, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts, langs = batch.column(0), batch.column(1)
            for lang in langs.unique():
                hits, shares = counted(texts.filter(pc.equal(langs, lang)))
                name = lang.as_py()
                held[name] = held[name] + hits if name in held else hits
                all_shares += shares
                if len(held) >= HELD:
                    yield from cut(held)
                    held = {}
        yield from cut({**held, None: all_shares})

    def summed(rows: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for counts in rows["counts"]:
            total += np.frombuffer(counts.as_buffer(), np.int64)
        return pa.table({"lang": rows["lang"].slice(0, 1), "block": rows["block"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    return named.select("text", "lang").mapInArrow(tally, TALLIES).groupBy("lang", "block").applyInArrow(summed, TALLIES)


def train(docs: DataFrame, margin: float = MARGIN) -> Model | None:
    """A model from all labelled ``docs`` (``text``, ``lang``), whole texts; none if no row is labelled.

    Each task counts its texts; the driver gets the sums, 512 KB a language.
    """
    named = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = named.where("text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    hits, shares = {}, np.zeros(BUCKETS, np.int64)
    for r in _tallies(usable).collect():
        of = shares if r.lang is None else hits.setdefault(r.lang, np.zeros(BUCKETS, np.int64))
        of[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.int64)
    return fitted(hits, shares, margin) if hits else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Language of every text, whole: ``doc_id``, ``lang_pred``, ``score`` and ``ambiguous``.

    A text that is null or has no letter is ``und`` with score 0, as is every text if there is no model. Text
    and id are the only columns that are looked at. Repeated rows are answered each.
    """
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi, data, offsets in text_chunks(texts, 1 << 17):
                part = texts.slice(lo, hi - lo).to_pylist()
                known = np.array([t is not None and model is not None and _LETTER.search(t) is not None for t in part], bool)
                if model is None:
                    langs, score, close = ["und"] * len(part), np.zeros(len(part)), np.zeros(len(part), bool)
                else:
                    best, score, close = model.decode(model.margins(data, offsets))
                    langs = [model.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64()), pa.array(close & known)],
                    ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(predict, PREDICTED)


def in_a_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in a learned language.

    A text that is null or has no letter goes, with or without a model. With one, a text goes too if its share of letters
    among letters and signs is below the model's floor, which the fitted texts give: symbol noise with stray letters;
    one that the codewords leave ambiguous must reach twice the floor. Numbers do not count against a text.
    Other ambiguous texts stay: they are in one language or another, or in one that was not learned.
    """
    name, floor = fresh("_lang", docs), model.floor if model else 0.0

    @F.arrow_udf("boolean")
    def fits(texts: pa.Array) -> pa.Array:
        out = []
        for _, _, data, offsets in text_chunks(texts, 1 << 17):
            share, (_, _, close) = lettered(data, offsets), model.decode(model.margins(data, offsets))
            out.append(share >= np.where(close, 2 * floor, floor))
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    text = F.col("text").cast("string")
    spelt = docs.where(text.isNotNull() & text.rlike(r"\p{L}"))
    return spelt if model is None else spelt.withColumn(name, fits(text)).where(F.col(name)).drop(name)
