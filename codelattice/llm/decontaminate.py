"""Benchmark decontamination: test n-grams as a broadcast set, scanned over the word windows of every text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import LOWER, SMALL_CHUNK, fresh, span_hashes, text_chunks, window_hashes, window_ok, word_spans

WINDOW = 13
BLOCK_BYTES = 32_000_000  # benchmark text that one broadcast holds; larger benchmarks go in several passes
HITS = "row_a long, row_b long, doc_id long, n_words long, spans array<struct<first:int,last:int,from:int,to:int>>, items array<string>"


class Windows:
    """The windows of benchmark texts: their bytes once, and by size the hash and first word of each distinct window.

    A block of 32 MB takes some 200 MB: bytes, bounds of words, and for each window a hash, a word and an item as numbers.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        texts = [(text or "").encode() for _, text in items]
        self.items = [item for item, _ in items]
        self.data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        starts, ends, first = word_spans(self.data, np.cumsum([0, *map(len, texts)]))
        hashes = _word_hashes(self.data, starts, ends)
        number = np.min_scalar_type(len(self.data))
        self.starts, self.ends = starts.astype(number), ends.astype(number)
        text_of = np.repeat(np.arange(len(texts)), np.diff(first))
        sizes = np.minimum(window, np.diff(first))
        self.by_size = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            n = len(starts) - size + 1
            at = np.flatnonzero((sizes[text_of[:n]] == size) & (text_of[:n] == text_of[size - 1 :]))
            h = window_hashes(hashes, size)[at]
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            item = text_of[at]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            for k in np.flatnonzero(~new).tolist():
                new[k] = self._words(at[k], size) != self._words(at[k - 1], size)
            keep = new.copy()
            keep[1:] |= item[1:] != item[:-1]  # an item counts once for a window
            bounds = np.append(np.flatnonzero(new[keep]), np.count_nonzero(keep))
            seen = np.zeros(1 << 20, bool)
            seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.by_size[size] = (h[new], seen, at[new].astype(number), bounds.astype(number), item[keep].astype(number))

    def _words(self, k: int, size: int) -> list[bytes]:
        k = int(k)
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[k : k + size].tolist(), self.ends[k : k + size].tolist(), strict=True)]

    def scan(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, list]]:
        """``(first word, size, items)`` of each true occurrence; a hash hit counts only if its words agree."""
        hashes = span_hashes(data, starts, ends)
        for size, (keys, seen, at, bounds, item) in self.by_size.items():
            h = window_hashes(hashes, size)
            if not len(h):
                continue
            maybe = np.flatnonzero(seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            maybe = maybe[window_ok(first, len(starts), size)[maybe]]
            lo, hi = np.searchsorted(keys, h[maybe], "left"), np.searchsorted(keys, h[maybe], "right")
            for k, a, b in zip(maybe[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                words = [data[x:y].tobytes() for x, y in zip(starts[k : k + size], ends[k : k + size], strict=True)]
                for c in range(a, b):
                    if self._words(at[c], size) == words:
                        yield k, size, [self.items[i] for i in item[int(bounds[c]) : int(bounds[c + 1])].tolist()]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """:func:`span_hashes` of many words, a run of ``step`` words at a time."""
    parts = [np.zeros(0, np.uint64)]
    for k in range(0, len(starts), step):
        a, b = starts[k : k + step], ends[k : k + step]
        parts.append(span_hashes(data[a[0] : b[-1]], a - a[0], b - a[0]))
    return np.concatenate(parts)


def _scan_batches(windows: Windows):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, raw, offsets in text_chunks(batch.column(1), SMALL_CHUNK):
                data = LOWER[raw]
                starts, ends, first = word_spans(data, offsets)
                hit = np.zeros(len(starts) + 1, np.int64)
                items: dict[int, set] = {}
                for k, size, names in windows.scan(data, starts, ends, first):
                    hit[k] += 1
                    hit[min(k + size, len(starts))] -= 1
                    row = int(np.searchsorted(first, k, side="right")) - 1
                    items.setdefault(row, set()).update(names)
                covered = np.cumsum(hit[:-1]) > 0 if len(starts) else np.zeros(0, bool)
                found = [[] for _ in range(hi - lo)]
                for row in items:
                    a, b = int(first[row]), int(first[row + 1])
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered[a:b].view(np.int8), [0]])))
                    base = int(offsets[row])
                    for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                        found[row].append({"first": x, "last": y - 1, "from": int(starts[a + x]) - base, "to": int(ends[a + y - 1]) - base})
                names = [sorted(x for x in items.get(row, ()) if x is not None) for row in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo), ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(np.diff(first), pa.int64()),
                     pa.array(found, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("from", pa.int32()), ("to", pa.int32())]))),
                     pa.array(names, pa.list_(pa.string()))],
                    ["row_a", "row_b", "doc_id", "n_words", "spans", "items"])

    return scan


def row_key() -> list[Column]:
    """Two hashes of a row's id and text, null or not; rows that agree in both have the same hits."""
    row = [F.col("doc_id").cast("long"), F.col("text").cast("string")]
    marks = F.concat(*[x.isNull().cast("string") for x in row])
    return [F.xxhash64(F.lit(seed), marks, *row) for seed in (1, 2)]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: words, maximal runs of hit words (also as byte ranges of the text), and the items found.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` has ``item_id`` and ``text``; further columns are
    ignored. The benchmark is brought in blocks of about ``block_bytes`` of text (one item at least), so no
    broadcast grows with it; each block is one pass over the documents. Texts of null have no words and are
    returned with none. An item without words has no window; an item whose id is null marks words, and is not
    listed. Every row is answered, whatever it repeats and however many blocks there are.
    """
    return _hits(docs, benchmark, window, block_bytes).drop("row_a", "row_b")


def _hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """:func:`benchmark_hits` with the :func:`row_key` of each row."""
    a, b = row_key()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), a.alias("row_a"), b.alias("row_b"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // block_bytes) + 1
    items = items if blocks == 1 else items.distinct()
    parts = []
    for k in range(blocks):
        # one block of the test set, of about block_bytes; items that share a text are spread over the blocks
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        parts.append(texts.mapInArrow(_scan_batches(Windows([tuple(r) for r in mine.collect()], window)), HITS))
    if blocks == 1:
        return parts[0]
    key, rows = ["row_a", "row_b"], None
    for part in parts:
        # equal rows are counted once for each block, before those of all blocks meet
        once = part.groupBy(*key).agg(*[F.first(c).alias(c) for c in ("doc_id", "n_words", "spans", "items")], F.count(F.lit(1)).alias("copies"))
        rows = once if rows is None else rows.unionByName(once)
    merged = rows.groupBy(*key).agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("copies").alias("copies"))
    each = merged.withColumn("spans", joined_spans(F.col("spans"))).withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.drop("copies")


def joined_spans(spans):
    """Overlapping or touching runs as one, in order."""
    empty = F.array().cast("array<struct<first:int,last:int,from:int,to:int>>")

    def add(done, x):
        last = F.element_at(done, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"), last["from"].alias("from"), F.greatest(last["to"], x["to"]).alias("to"))
        meets = (F.size(done) > 0) & (x["first"] <= F.try_element_at(done, F.lit(-1))["last"] + 1)
        return F.when(meets, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), empty, add)


def n_hit():
    """Hit words of a row of :func:`benchmark_hits`."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)


def contaminated():
    """At least one hit word, and at least one in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The digest per document: hit words, number and hash of the items found, and the verdict."""
    hits = benchmark_hits(docs, benchmark, window).withColumn("n_hit", n_hit())
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with its :func:`row_key` in two more columns, and their names."""
    names = [fresh("_row_a", docs), fresh("_row_b", docs)]
    return docs.withColumns(dict(zip(names, row_key(), strict=True))), names


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the hit byte ranges cut out of ``text``; other columns stay. Each row loses its own, whatever its id."""
    keyed, key = _keyed(docs)
    name = fresh("_spans", docs)
    hits = _hits(docs, benchmark, window).where(F.size("spans") > 0).select(F.col("row_a").alias(key[0]), F.col("row_b").alias(key[1]), F.col("spans").alias(name)).dropDuplicates(key)

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        out = []
        for text, ranges in zip(texts, spans, strict=True):
            if text is None or ranges is None:
                out.append(text)
                continue
            raw, kept, at = text.encode(), [], 0
            for x in ranges:
                kept.append(raw[at : x["from"]])
                at = x["to"]
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pd.Series(out)

    return keyed.join(hits, key, "left").withColumn("text", cut("text", name)).select(*docs.columns)


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, unnamed: bool = False) -> DataFrame:
    """``docs`` without the contaminated rows; a clean row stays even if it shares its id with one.

    Contaminated rows whose id is null stay unless ``unnamed`` is set.
    """
    keyed, key = _keyed(docs)
    bad = _hits(docs, benchmark, window).withColumn("n_hit", n_hit()).where(contaminated())
    if not unnamed:
        bad = bad.where("doc_id is not null")
    bad = bad.select(F.col("row_a").alias(key[0]), F.col("row_b").alias(key[1])).distinct()
    return keyed.join(bad, key, "left_anti").select(*docs.columns)
