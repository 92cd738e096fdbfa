"""N-gram Jaccard join by chosen paths.

Sets of word shingles are split on sampled tokens: in a run, a set goes to the bucket of every token whose hash
is low for a set of its size, so sets that share most tokens choose a common one. The runs that the target recall
asks for are taken at once. Buckets that are still large are split again on a further sampled token, round after
round; those that no split makes smaller are dealt to pairs of blocks. Buckets are compared by brute force, on
sketches of one bit per min-hash. What they connect is then checked exactly, set against set, inside each
connected part, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import LOWER, SMALL_CHUNK, mixed, rows_or_empty, span_hashes, text_chunks, window_hashes, word_spans, written

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999999
BUCKET = 8192  # sets that a bucket may hold before it is split once more; brute force takes a second at most there, and misses none
LOST = 0.07  # share of a pair's common paths that all splits together may end; the first sample is larger for it
BLOCK = 512  # sets on each side of an exact check
BITS = 128
DEVIATIONS = 5  # by which a pair's sketches may differ more than is expected at the similarity sought
_ODD = mixed(np.arange(1, BITS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)
_ADD = mixed(np.arange(1, BITS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).astype(np.uint32)
_SETS = "doc_id long, size int, low long, high long, sketch binary, paths array<long>"
_PATHS = "root long, key long, rep long, size int, sketch binary"


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted hashes of each text's word runs; a text of fewer words has one shingle, one without words none."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    full = window_hashes(hashes, words)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(full[a : b - words + 1]))
        else:
            out.append(window_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """One bit of each of ``BITS`` min-hashes, as words of 64."""
    least = np.full(BITS, np.iinfo(np.uint32).max, np.uint32)
    short = (tokens >> np.uint64(20)).astype(np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(least, (short[at : at + 512, None] * _ODD + _ADD).min(axis=0), out=least)
    return np.packbits((mixed(least.astype(np.uint64)) & np.uint64(1)).astype(bool)).view(np.uint64)


def runs_for(recall: float) -> int:
    """Runs after which a pair at the similarity sought shares a bucket with this probability.

    In one run such a pair expects at least one common token, of which splits end ``LOST`` at most, so all of n runs
    miss with probability exp(-n (1 - LOST)) at most.
    """
    return math.ceil(-math.log(1 - recall) / (1 - LOST))


def chosen(tokens: np.ndarray, mean: float) -> np.ndarray:
    """The tokens whose hash is low: ``mean`` of them on average, all where there are fewer."""
    h = mixed(tokens)
    limit = min(1.0, mean / max(1, len(tokens)))
    return tokens[h <= np.uint64(min(2**64 - 1, int(limit * 2.0**64)))] if limit < 1 else tokens


def children_for(level: int, similarity: float) -> float:
    """Tokens that the split of this level (from 1) goes on with on average.

    A pair's common path ends there with probability ``LOST`` / 2**level at most, which adds up to ``LOST`` over all levels.
    """
    return math.log(2**level / LOST) / similarity


def children_of(key: int, tokens: np.ndarray, mean: float) -> np.ndarray:
    """The paths that go on from path ``key`` to sampled tokens of a set."""
    paths = mixed(np.uint64(key & (2**64 - 1)) * np.ones(1, np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ tokens)
    return chosen(paths, mean)


def _sets_of(words: int, similarity: float, runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1), SMALL_CHUNK):
                size, low, high, sketch, paths = [], [], [], [], []
                for k, tokens in enumerate(shingles(data, offsets, words)):
                    size.append(len(tokens))
                    if not len(tokens):  # texts without words are equal if their bytes are
                        raw = data[offsets[k] : offsets[k + 1]]
                        h = span_hashes(raw, np.array([0]), np.array([len(raw)])) if len(raw) else np.zeros(1, np.uint64)
                        low.append(int(h[0]) - (1 << 63))
                        high.append(-1)
                        sketch.append(b"")
                        paths.append([])
                        continue
                    low.append(int(np.bitwise_xor.reduce(mixed(tokens + np.uint64(1)))) - (1 << 63))
                    high.append(int(np.sum(mixed(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)))) - (1 << 63))
                    sketch.append(sketch_of(tokens).tobytes())
                    paths.append(chosen(tokens, runs / similarity).view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(size, pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
                     pa.array(sketch, pa.binary()), pa.array(paths, pa.list_(pa.int64()))],
                    ["doc_id", "size", "low", "high", "sketch", "paths"])

    return run


def _go_on(words: int, mean: float):
    """Columns: text, rep, size, sketch, and the paths to go on from with their roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(0), SMALL_CHUNK):
                row, roots, keys = [], [], []
                for k, (tokens, open_paths) in enumerate(zip(shingles(data, offsets, words), batch.column(4).slice(lo, hi - lo).to_pylist(), strict=True)):
                    for path in open_paths:
                        found = children_of(path["key"], tokens, mean).view(np.int64).tolist()
                        row += [lo + k] * len(found)
                        roots += [path["root"]] * len(found)
                        keys += found
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(roots, pa.int64()), pa.array(keys, pa.int64()), *(batch.column(c).take(at) for c in (1, 2, 3))], ["root", "key", "rep", "size", "sketch"])

    return run


def buckets_of(firsts: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """``key``, ``rep``, ``size``, ``sketch``: what is to be compared by key, about ``BUCKET`` sets at most for each.

    ``firsts`` has ``rep``, ``size``, ``sketch`` and ``paths``; ``texts`` the texts by ``doc_id``. Each round splits the
    buckets that are over the limit. A first bucket's splits may hold twice its pairs after the first round and half
    as many after each further one; where they hold more, as among near copies, which share their tokens, it is
    dealt to blocks instead, and each two blocks are a bucket.
    """
    columns = ["key", "rep", "size", "sketch"]
    grown = firsts.select(F.explode("paths").alias("key"), "rep", "size", "sketch").withColumn("root", F.col("key"))
    found, stuck, first, tops, level = [], [], None, None, 0
    while True:
        counts = written(grown.groupBy("root", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        # at most one key for each BUCKET rows
        over = F.broadcast(counts.where(F.col("n") > BUCKET).select("root", "key"))
        small = grown.join(over.select("key"), "key", "left_anti").join(counts.where(F.col("n") <= BUCKET).select("key"), "key")
        if level:
            cost = counts.where(F.col("n") > BUCKET).groupBy("root").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("cost"))
            ends = written(cost.join(tops, "root").where(F.col("cost") > 2.0 ** (2 - level) * F.col("top") * F.col("top")).select("root", "top"))
            stuck.append(ends)
            over, small = (x.join(F.broadcast(ends.select("root")), "root", "left_anti") for x in (over, small))
        found.append(small.select(columns))
        rows = written(grown.join(F.broadcast(over.select("key")), "key").select("root", *columns))
        if rows.isEmpty():
            break
        if not level:
            first, tops = rows, counts.where(F.col("n") > BUCKET).select("root", F.col("n").alias("top"))
        level += 1
        open_paths = rows.groupBy("rep", "size", "sketch").agg(F.collect_list(F.struct("root", "key")).alias("open"))
        named = texts.where("text is not null").withColumnRenamed("doc_id", "rep").join(open_paths.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])
        grown = written(named.join(open_paths, "rep").select("text", "rep", "size", "sketch", "open").mapInArrow(_go_on(words, children_for(level, similarity)), _PATHS))
    for ends in stuck:
        blocks = F.ceil(F.col("top") / (BUCKET // 2)).cast("int")
        dealt = first.join(F.broadcast(ends), "root").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("root", "rep"), F.col("blocks")).cast("int"))
        others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("block"))
        other = dealt.withColumn("other", F.explode(others))
        found.append(other.withColumn("key", F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"))).select(columns))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def bit_limit(similarity: float) -> float:
    """Differing bits up to which sketches may belong to a pair; each bit agrees with probability (1 + J) / 2."""
    p = (1 - similarity) / 2
    return BITS * p + DEVIATIONS * math.sqrt(BITS * p * (1 - p))


def sketch_links(ids: np.ndarray, sketches: np.ndarray, sizes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A tree over each group of sets that sketches connect, as links to the member reached before.

    Each set is compared with all that no group has yet, so a bucket of near copies takes one pass, not one per set.
    """
    limit = bit_limit(similarity)
    left = np.argsort(ids, kind="stable")
    links = []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            a = frontier.pop()
            differ = np.bitwise_count(sketches[left] ^ sketches[a]).sum(axis=1)
            near = (differ <= limit) & (np.minimum(sizes[left], sizes[a]) >= similarity * np.maximum(sizes[left], sizes[a]) - 1e-9)
            if near.any():
                met = left[near]
                links += [(int(ids[b]), int(ids[a])) for b in met]
                frontier += met.tolist()
                left = left[~near]
    return links


def _compare_buckets(similarity: float):
    """Buckets come whole and in order; a partition may hold many."""

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            last = frame["key"].to_numpy() == frame["key"].iloc[-1]
            rest, ready = frame[last], frame[~last]
            if len(ready):
                yield _links_frame(ready, similarity)
        if rest is not None and len(rest):
            yield _links_frame(rest, similarity)

    return compare


def _links_frame(frame: pd.DataFrame, similarity: float) -> pd.DataFrame:
    keys, ids, sizes = (frame[c].to_numpy() for c in ("key", "rep", "size"))
    sketches = np.frombuffer(b"".join(frame["sketch"]), np.uint64).reshape(len(frame), BITS // 64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    ends = np.concatenate([starts[1:], [len(keys)]])
    two = starts[ends - starts == 2]  # most buckets
    near = np.bitwise_count(sketches[two] ^ sketches[two + 1]).sum(axis=1) <= bit_limit(similarity)
    near &= np.minimum(sizes[two], sizes[two + 1]) >= similarity * np.maximum(sizes[two], sizes[two + 1]) - 1e-9
    pairs = list(zip(ids[two[near]].tolist(), ids[two[near] + 1].tolist(), strict=True))
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a > 2:
            pairs += sketch_links(ids[a:b], sketches[a:b], sizes[a:b], similarity)
    return pd.DataFrame(sorted(set(pairs)), columns=["a", "b"]).astype("int64")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its part, for all ends of ``links`` (``a``, ``b``).

    Each round hands every node the least root in its neighbourhood and follows roots one step; rounds end
    when no root changes. Each is written to the shared folder.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    roots = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    while True:
        heard = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("heard"))
        near = roots.join(heard, roots["node"] == heard["a"], "left").select("node", "root", F.least("root", F.coalesce("heard", "root")).alias("next"))
        up = roots.select(F.col("node").alias("next"), F.col("root").alias("further"))
        moved = written(near.join(up, "next", "left").select("node", "root", F.least("next", F.coalesce("further", "next")).alias("next")))
        done = moved.where("root <> next").isEmpty()
        roots = moved.select("node", F.col("next").alias("root"))
        if done:
            return roots


def exact_links(ids: list[np.ndarray], sets: list[list[np.ndarray]], same: bool, similarity: float) -> list[tuple[int, int, int]]:
    """For each set of two blocks (or of one, if ``same``): id, links found, least id linked or its own."""
    (left_ids, right_ids), (left, right) = ids, sets
    if not left or not right:
        return []
    tokens = np.concatenate(right)
    owner = np.repeat(np.arange(len(right)), [len(x) for x in right])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    sizes = np.array([len(x) for x in right])
    counts = {"l": np.zeros(len(left), np.int64), "r": np.zeros(len(right), np.int64)}
    least_l, least_r = left_ids.copy(), right_ids.copy()
    for k, own in enumerate(left):
        lo, hi = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
        n = hi - lo
        total = int(n.sum())
        if not total:
            continue
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)
        shared = np.bincount(owner[at], minlength=len(right))
        linked = shared >= similarity * (len(own) + sizes - shared) - 1e-9
        linked &= shared > 0
        if same:
            linked[k] = False
        found = np.flatnonzero(linked)
        if not len(found):
            continue
        counts["l"][k] += len(found)
        least_l[k] = min(least_l[k], right_ids[found].min())
        if not same:
            counts["r"][found] += 1
            least_r[found] = np.minimum(least_r[found], left_ids[k])
    out = [(int(i), int(c), int(m)) for i, c, m in zip(left_ids, counts["l"], least_l, strict=True) if c]
    if not same:
        out += [(int(i), int(c), int(m)) for i, c, m in zip(right_ids, counts["r"], least_r, strict=True) if c]
    return out


def _check_parts(words: int, similarity: float):
    """Texts come sorted by part and pair of blocks; each pair is checked when it is complete."""

    def check_one(frame: pd.DataFrame) -> list[tuple[int, int, int]]:
        column = pa.array(frame["text"], pa.string())
        sets = [s for _, _, data, offsets in text_chunks(column) for s in shingles(data, offsets, words)]
        ids, side = frame["rep"].to_numpy(), frame["block"].to_numpy()
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        at = [np.flatnonzero(side == i), np.flatnonzero(side == j)]
        return exact_links([ids[x] for x in at], [[sets[k] for k in x] for x in at], i == j, similarity)

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            names = list(zip(frame["root"].tolist(), frame["i"].tolist(), frame["j"].tolist(), strict=True))
            out, start = [], 0
            for k in range(1, len(names)):
                if names[k] != names[k - 1]:
                    out += check_one(frame.iloc[start:k])
                    start = k
            rest = frame.iloc[start:]
            if out:
                yield pd.DataFrame(out, columns=["rep", "n", "least"]).astype("int64")
        if rest is not None and len(rest):
            yield pd.DataFrame(check_one(rest), columns=["rep", "n", "least"]).astype("int64")

    return check


def jaccard_join(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Every document with its class of near duplicates: ``doc_id``, ``class_id``, ``copy_id``, ``n_links``.

    ``copy_id`` is the least id of the documents with the same set of word shingles, ``n_links`` the number of
    other such sets of Jaccard similarity ``similarity`` or more, ``class_id`` the least id of all that links
    connect. Words are those of lower-cased text; a text of fewer than ``words`` words is one shingle. Texts
    without words are alike only if their bytes are; null is like no other text. ``docs`` has ``doc_id`` and
    ``text``; rows that repeat both are answered each, as copies, and an id that is null is not linked.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = runs_for(recall)
    sets = written(texts.where("text is not null").mapInArrow(_sets_of(words, similarity, runs), _SETS))
    copies = sets.groupBy("low", "high", "size").agg(F.min("doc_id").alias("rep"))
    firsts = sets.join(copies, ["low", "high", "size"]).where((F.col("doc_id") == F.col("rep")) & (F.col("size") > 0)).dropDuplicates(["rep"])
    firsts = written(firsts.select("rep", "size", "sketch", "paths"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets_of(firsts, texts, words, similarity).repartition(tasks, "key").sortWithinPartitions("key")
    links = written(buckets.mapInPandas(_compare_buckets(similarity), "a long, b long").distinct())
    parts = components(links)

    sizes = parts.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    numbered = parts.join(sizes, "root").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    numbered = numbered.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # each block meets itself and every other block of its part once
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(F.col("block"), o).alias("i"), F.greatest(F.col("block"), o).alias("j")))
    wanted = numbered.select(F.col("node").alias("rep"), "root", "block", F.explode(pairs).alias("p")).select("rep", "root", "block", "p.i", "p.j")
    members = texts.where("text is not null").join(parts.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    dealt = members.withColumnRenamed("doc_id", "rep").join(wanted, "rep").repartition(tasks, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    checked = written(dealt.select("root", "i", "j", "rep", "block", "text").mapInPandas(_check_parts(words, similarity), "rep long, n long, least long"))
    degree = checked.groupBy("rep").agg(F.sum("n").alias("n_links"))
    classes = components(checked.select(F.col("rep").alias("a"), F.col("least").alias("b")))

    per_set = copies.join(degree, "rep", "left").join(classes.select(F.col("node").alias("rep"), "root"), "rep", "left")
    answered = sets.select("doc_id", "low", "high", "size").join(per_set, ["low", "high", "size"])
    with_text = answered.select("doc_id", F.coalesce("root", "rep").alias("class_id"), F.col("rep").alias("copy_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    alone = texts.where("text is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return rows_or_empty(with_text, "doc_id long, class_id long, copy_id long, n_links long").unionByName(alone)


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class, that of the least id; of rows that repeat an id, one."""
    kept = jaccard_join(docs, words, similarity).where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("class_id"))).select("doc_id").distinct()
    first = docs.dropDuplicates(["doc_id"])
    named = first.join(kept, "doc_id", "left_semi")
    return named.unionByName(docs.where("doc_id is null")).select(*docs.columns)
