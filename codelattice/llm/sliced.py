"""Ranked lexical search over bit-sliced Bloom signatures.

Documents of a like number of distinct terms share a matrix: a column per document, and a row (slice) per bit of the
signatures, stored as a bitmap over the documents. A term's slices, taken together, show every document that holds
it and some that don't; further elements say that it occurs twice, three times and so on, so the sum of weights by
slices is never below a document's score. The best by these bounds are scored exactly, which gives each query a score
that its results must reach; all documents whose bound reaches it are scored exactly, and no others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.llm.common import IS_WORD, LOWER, mixed, span_hashes, text_chunks, word_spans, written

K = 10
PILOTS = 8  # documents scored to set the mark, for each result
BITS = 16  # of a signature, for each distinct element of the longest document of its matrix
SLICES = 6  # per element
CHUNK = 1 << 22  # bytes of text whose documents are put into matrices together; longer texts have their own
ITEMS = 1024  # queries that are sent out at once
ITEM_BYTES = 1 << 20  # of their text
TILE = 1 << 21  # pairs of a term and a document that are summed at once
SHORT = np.uint64((1 << 48) - 1)
NO_ID = (1 << 63) - 1  # stands for a null id: last among equals
INDEX = "ids array<long>, key_a array<long>, key_b array<long>, terms array<long>, width int, slices binary"


def tf_levels() -> Iterator[int]:
    """1, 2, 3, 4, 6, 8, 12, ...: numbers of occurrences that are elements of their own."""
    yield 1
    n = 2
    while True:
        yield n
        yield n + n // 2
        n *= 2


def _slices(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that end between words."""
    at = 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data):
            gap = np.flatnonzero(~IS_WORD[data[end : end + CHUNK]])
            if len(gap):
                end += int(gap[0])
                break
            end += CHUNK
        yield data[at:end]
        at = end


def _words(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lower-cased bytes, start, end, hash and text of all words of a chunk; a long text comes in parts."""
    parts = _slices(data) if len(offsets) == 2 and len(data) > CHUNK else [data]
    for part in parts:
        low = LOWER[part]
        starts, ends, first = word_spans(low, offsets if part is data else np.array([0, len(part)]))
        yield low, starts, ends, span_hashes(low, starts, ends), np.repeat(np.arange(len(first) - 1), np.diff(first))


def places(terms: np.ndarray, level: int | np.ndarray, width: int) -> np.ndarray:
    """The slices of each element, a term and a level: a row of ``SLICES`` for each."""
    mix = mixed(terms + np.asarray(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    step = (mix & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return (((mix >> np.uint64(32))[:, None] + np.arange(SLICES, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(width)).astype(np.int64)


def signatures(owner: np.ndarray, terms: np.ndarray, counts: np.ndarray, docs: int) -> Iterator[tuple[np.ndarray, int, bytes]]:
    """Which documents, width and slices of each matrix, from the distinct ``terms`` of each ``owner`` and their ``counts``."""
    levels, at = [], np.arange(len(terms))
    for n in tf_levels():
        at = at[counts[at] >= n]
        if not len(at):
            break
        levels.append(at)
    level = np.repeat(np.arange(len(levels)), [len(x) for x in levels])
    at = np.concatenate([at, *levels])
    elements = np.bincount(owner[at], minlength=docs)
    size = np.ceil(2 * np.log2(np.maximum(elements, 1))).astype(np.int64)  # a class for each factor of the root of 2
    order = np.argsort(size[owner[at]], kind="stable")
    at, level = at[order], level[order]
    classes, members = np.unique(size, return_inverse=True)
    ends = np.searchsorted(size[owner[at]], classes, "right")
    for k, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
        mine = np.flatnonzero(members == k)
        width = max(8, BITS * int(elements[mine].max()))
        column = np.zeros(docs, np.int64)
        column[mine] = np.arange(len(mine))
        bits = np.zeros(width * len(mine), bool)
        bits[(places(terms[at[lo:hi]], level[lo:hi], width) * len(mine) + column[owner[at[lo:hi]]][:, None]).ravel()] = True
        yield mine, width, np.packbits(bits.reshape(width, -1), axis=1).tobytes()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: doc_id, two hashes of the text, text."""
    schema = pa.schema([(n, pa.list_(pa.int64())) for n in ("ids", "key_a", "key_b", "terms")] + [("width", pa.int32()), ("slices", pa.binary())])
    for batch in batches:
        ids, key_a, key_b = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        for lo, hi, data, offsets in text_chunks(batch.column(3), CHUNK):
            total, found = np.zeros(hi - lo, np.int64), []
            for _, _, _, hashes, text in _words(data, offsets):
                total += np.bincount(text, minlength=hi - lo)
                for part in range(0, hi - lo, 1 << 16):  # the text's number stands above 48 bits of the hash
                    mine = (text >= part) & (text < part + (1 << 16)) if hi - lo > 1 << 16 else slice(None)
                    keys, counts = np.unique((text[mine] - part).astype(np.uint64) << np.uint64(48) | (hashes[mine] & SHORT), return_counts=True)
                    found.append((part + (keys >> np.uint64(48)).astype(np.int64), keys & SHORT, counts))
            owner, terms, counts = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(found) > 1 and hi - lo == 1:  # parts of a long text
                terms, at = np.unique(terms, return_inverse=True)
                counts, owner = np.bincount(at, counts).astype(np.int64), np.zeros(len(terms), np.int64)
            for mine, width, bits in signatures(owner, terms, counts, hi - lo):
                rows = {"ids": ids, "key_a": key_a, "key_b": key_b}
                yield pa.RecordBatch.from_pylist(
                    [{k: v[lo + mine].tolist() for k, v in rows.items()} | {"terms": total[mine].tolist(), "width": width, "slices": bits}], schema)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id`` (``NO_ID`` for null), two hashes of the text, and the text, of rows that have one."""
    text = F.col("text").cast("string")
    return docs.where("text is not null").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.lit(1), text).alias("key_a"), F.xxhash64(F.lit(2), text).alias("key_b"), text.alias("text"))


def build_index(docs: DataFrame) -> DataFrame:
    """Matrices of the documents' signatures; it serves any queries. Texts of null are left out, having no terms."""
    return written(keyed(docs).mapInArrow(_index, INDEX))


class Queries:
    """The distinct terms of some queries, and which of them each query has."""

    def __init__(self, texts: list[str | None]):
        number: dict[bytes, int] = {}
        of_item = []
        for text in texts:
            data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            starts, ends, _ = word_spans(data, np.array([0, len(data)]))
            raw = data.tobytes()
            of_item.append(sorted({number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}))
        self.n_items, self.n_terms = len(texts), len(number)
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in of_item])]).astype(np.int64)
        self.terms = np.array([t for x in of_item for t in x], np.int64)
        self.blob = np.frombuffer(b"".join(number), np.uint8)
        self.ends = np.cumsum([len(t) for t in number]).astype(np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.hashes = span_hashes(self.blob, self.starts, self.ends) if number else np.zeros(0, np.uint64)
        self.order = np.argsort(self.hashes)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def match(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that are terms, and which: found by hash, and compared byte by byte."""
        at = np.flatnonzero(self.seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        known = self.hashes[self.order]
        place = np.minimum(np.searchsorted(known, hashes[at]), max(len(known) - 1, 0))
        same = known[place] == hashes[at] if len(known) else np.zeros(len(at), bool)
        at, term = at[same], self.order[place[same]]
        size = ends[at] - starts[at]
        same = size == self.ends[term] - self.starts[term]
        k, open_ = 0, np.flatnonzero(same)
        while len(open_):
            open_ = open_[size[open_] > k]
            differ = data[starts[at[open_]] + k] != self.blob[self.starts[term[open_]] + k]
            same[open_[differ]] = False
            open_ = open_[~differ]
            k += 1
        return at[same], term[same]


class Scoring:
    """Weights of the terms, and what a document's length counts."""

    def __init__(self, queries: Queries, df: np.ndarray, n_docs: int, n_terms: int):
        self.queries, self.n_docs, self.n_terms = queries, n_docs, n_terms
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)

    def length_factor(self, n: np.ndarray) -> np.ndarray:
        return 100 - 90 + (90 * n.astype(np.int64) * self.n_docs) // max(self.n_terms, 1)

    @staticmethod
    def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)

    def sums(self, per_term: np.ndarray) -> np.ndarray:
        """For each query, the sum of the rows of its terms."""
        q = self.queries
        out = np.zeros((q.n_items, per_term.shape[1]), np.int64)
        some = np.flatnonzero(np.diff(q.first))
        if len(some):
            out[some] = np.add.reduceat(per_term[q.terms], q.first[some], axis=0)
        return out

    def bounds(self, terms: np.ndarray, width: int, slices: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """First document, and what each query's score is at most for it and those behind it."""
        q, docs = self.queries, len(terms)
        bits = np.frombuffer(slices, np.uint8).reshape(width, -1)
        elements = q.hashes & SHORT
        step = max(8, TILE // max(len(q.terms), 1) // 8 * 8)
        for lo in range(0, docs, step):
            hi = min(docs, lo + step)
            part = bits[:, lo // 8 : -(-hi // 8)]
            most = np.zeros((q.n_terms, hi - lo), np.int64)  # occurrences
            there, levels = np.arange(q.n_terms), tf_levels()
            level, low, high = 0, next(levels), next(levels)
            maybe = None
            while len(there):
                both = np.bitwise_and.reduce(part[places(elements[there], level, width)], axis=1)
                maybe = both if maybe is None else both & maybe  # no more often, if not as often
                some = maybe.any(axis=1)
                there, maybe = there[some], maybe[some]
                if level and low > int(terms[lo:hi].max()):
                    break
                rows, columns = np.nonzero(np.unpackbits(maybe, axis=1, count=hi - lo))
                most[there[rows], columns] = high - 1
                level, low, high = level + 1, high, next(levels)
            rows, columns = np.nonzero(most)
            tf = np.minimum(most[rows, columns], terms[lo:hi][columns])
            most[rows, columns] = self.weights[rows] * self.share(tf, self.length_factor(terms[lo:hi])[columns])
            yield lo, self.sums(most)


def _tally(queries: Queries):
    """Documents with each term (by number), with any term (-1), and all terms (-2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_terms = np.zeros(queries.n_terms, np.int64), 0, 0
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(0), CHUNK):
                found, some = [], np.zeros(hi - lo, bool)
                for low, starts, ends, hashes, text in _words(data, offsets):
                    n_terms += len(starts)
                    some[text] = True
                    at, term = queries.match(low, starts, ends, hashes)
                    found.append(np.unique(text[at] * max(queries.n_terms, 1) + term))
                n_docs += int(some.sum())
                if queries.n_terms:
                    df += np.bincount(np.unique(np.concatenate(found)) % queries.n_terms, minlength=queries.n_terms)
        yield pa.RecordBatch.from_arrays([pa.array([*range(queries.n_terms), -1, -2], pa.int64()), pa.array([*df.tolist(), n_docs, n_terms], pa.int64())], ["term", "n"])

    return run


def scoring_of(docs: DataFrame, queries: Queries) -> Scoring:
    tallies = docs.where("text is not null").select(F.col("text").cast("string")).mapInArrow(_tally(queries), "term long, n long")
    found = {r.term: r.n for r in tallies.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each term of these queries
    return Scoring(queries, np.array([found.get(k, 0) for k in range(queries.n_terms)], np.int64), found.get(-1, 0), found.get(-2, 0))


FOUND = "query int, key_a long, key_b long, doc_id long, bound long"


def _found(ids: np.ndarray, keys: tuple[np.ndarray, np.ndarray], query: np.ndarray, at: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query.astype(np.int32)), pa.array(keys[0][at]), pa.array(keys[1][at]), pa.array(ids[at]), pa.array(bound)], ["query", "key_a", "key_b", "doc_id", "bound"])


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray, int, bytes]]:
    for k in range(batch.num_rows):
        ids, key_a, key_b, terms = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in range(4))
        yield ids, (key_a, key_b), terms, batch.column(4)[k].as_py(), batch.column(5)[k].as_py()


def _best_bounds(scoring: Scoring, k: int):
    """The ``k`` documents of highest bound for each query, per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = scoring.queries.n_items
        best = [np.zeros((n, 0), np.int64) for _ in range(4)]  # bound, id, keys
        for batch in batches:
            for ids, keys, terms, width, slices in _matrices(batch):
                for lo, bounds in scoring.bounds(terms, width, slices):
                    here = slice(lo, lo + bounds.shape[1])
                    both = [np.concatenate([old, np.broadcast_to(new, bounds.shape)], axis=1) for old, new in zip(best, (bounds, ids[here], keys[0][here], keys[1][here]), strict=True)]
                    order = np.lexsort((both[1], -both[0]), axis=1)[:, :k]
                    best = [np.take_along_axis(x, order, axis=1) for x in both]
        query, column = np.nonzero(best[0] > 0)
        if len(query):
            bound, ids, key_a, key_b = (x[query, column] for x in best)
            yield _found(ids, (key_a, key_b), query, np.arange(len(query)), bound)

    return run


def _reaching(scoring: Scoring, score: np.ndarray, last: np.ndarray, k: int):
    """Documents whose bound is over ``score``, or equal to it with an id not over ``last``; of a text, the ``k`` least ids per matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, keys, terms, width, slices in _matrices(batch):
                for lo, bounds in scoring.bounds(terms, width, slices):
                    mine = ids[lo : lo + bounds.shape[1]]
                    query, at = np.nonzero((bounds > score[:, None]) | (bounds > 0) & (bounds == score[:, None]) & (mine[None, :] <= last[:, None]))
                    if not len(query):
                        continue
                    bound, at = bounds[query, at], at + lo
                    order = np.lexsort((ids[at], keys[1][at], keys[0][at], query))
                    query, at, bound = query[order], at[order], bound[order]
                    new = np.concatenate([[True], (query[1:] != query[:-1]) | (keys[0][at[1:]] != keys[0][at[:-1]]) | (keys[1][at[1:]] != keys[1][at[:-1]])])
                    rank = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]
                    yield _found(ids, keys, query[rank < k], at[rank < k], bound[rank < k])

    return run


def _rescore(scoring: Scoring):
    """Columns: two hashes of the text, the queries to score it for, the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = scoring.queries
        for batch in batches:
            wanted = batch.column(2).to_pylist()
            for lo, hi, data, offsets in text_chunks(batch.column(3)):
                total, rows, terms = np.zeros(hi - lo, np.int64), [], []
                for low, starts, ends, hashes, text in _words(data, offsets):
                    total += np.bincount(text, minlength=hi - lo)
                    at, term = q.match(low, starts, ends, hashes)
                    rows.append(text[at])
                    terms.append(term)
                pairs, tf = np.unique(np.concatenate(rows) * max(q.n_terms, 1) + np.concatenate(terms), return_counts=True)
                row, term = pairs // max(q.n_terms, 1), pairs % max(q.n_terms, 1)
                part = scoring.weights[term] * scoring.share(tf, scoring.length_factor(total)[row])
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                out = []
                for k in range(hi - lo):
                    per_term = np.zeros(q.n_terms, np.int64)
                    per_term[term[first[k] : first[k + 1]]] = part[first[k] : first[k + 1]]
                    out += [(lo + k, x, int(per_term[q.terms[q.first[x] : q.first[x + 1]]].sum())) for x in wanted[lo + k]]
                at, query, score = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query.astype(np.int32)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(score)], ["query", "key_a", "key_b", "score"])

    return run


def exact_scores(docs: DataFrame, found: DataFrame, scoring: Scoring) -> DataFrame:
    """``found`` (``query``, ``key_a``, ``key_b``, ``doc_id``) with ``score``; a text is scored once, for its least id."""
    key = ["key_a", "key_b"]
    wanted = found.groupBy("query", *key).agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id", *key).agg(F.collect_list("query").alias("queries"))
    texts = keyed(docs).join(wanted, ["doc_id", *key]).select(*key, "queries", "text")
    scores = texts.mapInArrow(_rescore(scoring), "query int, key_a long, key_b long, score long").groupBy("query", *key).agg(F.first("score").alias("score"))
    return found.join(scores, ["query", *key])


def _first(rows: DataFrame, k: int, by: list[str], *order) -> DataFrame:
    """The ``k`` first rows of each group, with their ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def search_block(index: DataFrame, docs: DataFrame, queries: Queries, k: int = K) -> DataFrame:
    """``query`` (by number), ``rank``, ``doc_id`` and ``score`` for the queries of one block."""
    scoring = scoring_of(docs, queries)
    pilots = _first(index.mapInArrow(_best_bounds(scoring, PILOTS * k), FOUND), PILOTS * k, ["query"], F.desc("bound"), "doc_id")
    scored = _first(exact_scores(docs, written(pilots.drop("rank")), scoring), k, ["query"], F.desc("score"), "doc_id")
    reached = scored.where((F.col("rank") == k) & (F.col("score") > 0)).select("query", "score", "doc_id").collect()  # a row for each query at most
    score, last = np.zeros(queries.n_items, np.int64), np.full(queries.n_items, NO_ID, np.int64)
    for r in reached:
        score[r["query"]], last[r["query"]] = r["score"], r["doc_id"]
    candidates = _first(index.mapInArrow(_reaching(scoring, score, last, k), FOUND), k, ["query", "key_a", "key_b"], "doc_id")
    ranked = exact_scores(docs, written(candidates.drop("rank")), scoring).where("score > 0")
    return _first(ranked, k, ["query"], F.desc("score"), "doc_id").select("query", "rank", "doc_id", "score")


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"].encode())
        if len(block) == ITEMS or size >= ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` highest-scoring rows of ``docs`` for each row of ``items``: ``item_id``, ``rank``, ``doc_id``, ``score``.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; further columns are ignored. Rows that
    share no term are not listed; ties go to the smaller ``doc_id``, a null id comes last. Rows that repeat are ranked
    each, items that repeat are answered each. Null texts have no terms: such items have no rows. Items are sent out in
    blocks of bounded size, each compared with the whole index.
    """
    index, out = build_index(docs), None
    spark = docs.sparkSession
    for block in _item_blocks(items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))):
        names = spark.createDataFrame([(n, item) for n, (item, _) in enumerate(block)], "query int, item_id long")
        found = search_block(index, docs, Queries([text for _, text in block]), k)
        part = written(found.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
