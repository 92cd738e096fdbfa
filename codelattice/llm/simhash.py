"""Near duplicates by SimHash fingerprints, found by anchor points of a covering code.

A fingerprint's bits are dealt to two blocks of 23, each covered by the perfect binary Golay code of radius 3, and 18
that are left. The pairs of codewords are the anchors. Every fingerprint is at home at the one anchor that covers it,
and is replicated to each anchor within the covering radius plus the threshold: there it meets all fingerprints that
are at home there and differ in no more bits than the threshold. An anchor that many are replicated to is refined
by the 18 bits left, all words of which are anchors of radius 0. Fingerprints are compared per anchor only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.chosen_path import components
from codelattice.llm.common import LOWER, text_chunks, word_spans, written

WORDS = 3
SEED = 42
THRESHOLD = 2  # differing bits of a link
LONG = 1 << 22  # bytes of a text beyond which it is read in parts
GOLAY = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
LENGTH, RADIUS, INFO = 23, 3, 12
LEFT = 64 - 2 * LENGTH  # bits in no block
CROWD = 16384  # rows at an anchor, beyond which it is refined
SAMPLE = 64  # one in so many fingerprints is looked at to find crowded anchors
TILE = 1 << 22  # comparisons that are done at once
_codes = np.arange(256)
IS_TEXT = ~((_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D)))  # bytes of words: all but white space


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each run of ``words`` words of each text, joined by one space, and how many there are per text.

    A text of fewer words, but not none, has one: all its words.
    """
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, IS_TEXT)
    counts = np.diff(first)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    sizes = ends - starts
    at = np.cumsum(sizes + 1) - sizes - 1  # words one after the other, with a space behind each
    joined = np.full(int(at[-1] + sizes[-1]), 0x20, np.uint8)
    inside = np.repeat(starts - at, sizes) + (np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes))
    joined[inside - np.repeat(starts - at, sizes)] = data[inside]
    n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    low = np.repeat(first[:-1], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    high = low + np.repeat(np.minimum(counts, words) - 1, n)
    view, hashed = memoryview(joined), xxhash.xxh64_intdigest
    spans = zip(at[low].tolist(), (at[high] + sizes[high]).tolist(), strict=True)
    return np.fromiter((hashed(view[a:b], SEED) for a, b in spans), np.uint64, len(low)), n


def bit_counts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in the hashes of each text."""
    out = np.zeros((len(counts), 64), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        mine = owner[at : at + (1 << 16)]
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        out[mine[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return out


def _majority(ones: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _parts(data: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """A long text in parts that end between words; each begins with the last ``words - 1`` words of what was before."""
    at, carry, begun = 0, np.zeros(0, np.uint8), False
    while at < len(data):
        end = at + LONG
        while end < len(data):
            gap = np.flatnonzero(~IS_TEXT[data[end : end + LONG]])
            if len(gap):
                end += int(gap[0])
                break
            end += LONG
        part = np.concatenate([carry, data[at:end]])
        starts, _, _ = word_spans(part, np.array([0, len(part)]), IS_TEXT)
        at = end
        if len(starts) >= words:
            yield part
            begun, carry = True, part[starts[1 - words] :] if words > 1 else carry[:0]
        elif at < len(data):  # too few words so far: they all go on
            carry = part
        elif not begun:
            yield part


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The fingerprint of each text: a bit is set if it is in over half of the hashes."""
    if len(offsets) == 2 and len(data) > LONG:
        ones, total = np.zeros((1, 64), np.int64), np.zeros(1, np.int64)
        for part in _parts(data, words):
            hashes, n = shingle_hashes(part, np.array([0, len(part)]), words)
            ones += bit_counts(hashes, n)
            total += n
        return _majority(ones, total)
    hashes, counts = shingle_hashes(data, offsets, words)
    return _majority(bit_counts(hashes, counts), counts)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id`` and ``fp`` (64 bits, as a long) of every row; null and texts without words have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                found = fingerprints_of(data, offsets, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Cover:
    """The Golay code of length 23: where each word is at home, and which other codewords are near it."""

    def __init__(self):
        messages = np.arange(1 << INFO)
        codewords = np.zeros(1 << INFO, np.int64)
        for k in range(INFO):
            codewords ^= np.where(messages >> k & 1, GOLAY << k, 0)
        units = []
        for k in range(LENGTH):  # what is left of x^k when it is divided by the generator
            left = 1 << k
            for top in range(LENGTH - 1, LENGTH - INFO - 1, -1):
                if left >> top & 1:
                    left ^= GOLAY << (top - LENGTH + INFO)
            units.append(left)
        self.rests = np.zeros((3, 256), np.int64)  # by byte of the word
        for k, left in enumerate(units):
            self.rests[k // 8] ^= np.where(np.arange(256) >> (k % 8) & 1, left, 0)
        self.leaders = np.zeros(1 << (LENGTH - INFO), np.int64)  # the least error of each rest; the code is perfect
        ball = [0]
        for _ in range(RADIUS):
            ball = sorted({w ^ 1 << k for w in ball for k in range(LENGTH)} | set(ball))
        for w in sorted(ball, key=int.bit_count, reverse=True):
            self.leaders[self.rest(np.array([w]))[0]] = w
        #: by rest, codewords that are one or two flips further than the radius from an error; -1 fills up
        self.others = []
        away = np.bitwise_count(self.leaders[:, None] ^ codewords[None, :])
        for more in range(1, THRESHOLD + 1):
            rows = [codewords[row == RADIUS + more] for row in away]
            table = np.full((len(rows), max(map(len, rows))), -1, np.int64)
            for k, row in enumerate(rows):
                table[k, : len(row)] = row
            self.others.append(table)

    def rest(self, words: np.ndarray) -> np.ndarray:
        return self.rests[0][words & 255] ^ self.rests[1][words >> 8 & 255] ^ self.rests[2][words >> 16]

    def near(self, words: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray]:
        """Index into ``words`` and number of each codeword that takes ``more`` flips to be at home at."""
        rest = self.rest(words)
        home = words ^ self.leaders[rest]
        if more == 0:
            return np.arange(len(words)), home >> (LENGTH - INFO)
        table = self.others[more - 1][rest]
        row, column = np.nonzero(table >= 0)
        return row, (home[row] ^ table[row, column]) >> (LENGTH - INFO)  # a codeword's upper bits name it


@lru_cache(maxsize=1)
def cover() -> Cover:
    return Cover()


@lru_cache(maxsize=1)
def left_flips() -> list[np.ndarray]:
    """Words of the bits left with no, one or two bits set."""
    one = 1 << np.arange(LEFT)
    return [np.zeros(1, np.int64), one, np.array([a | b for k, a in enumerate(one) for b in one[:k]], np.int64)]


def anchors_of(fps: np.ndarray, most: int = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Index into ``fps``, anchor, and the flips that it takes to be at home there, up to ``most``."""
    code, mask = cover(), (1 << LENGTH) - 1
    a, b = (fps & np.uint64(mask)).astype(np.int64), (fps >> np.uint64(LENGTH) & np.uint64(mask)).astype(np.int64)
    for i in range(most + 1):
        row, left = code.near(a, i)
        for j in range(most + 1 - i):
            again, right = code.near(b[row], j)
            yield row[again], left[again] << INFO | right, i + j


class Bitmap:
    """A set of anchors, a bit for each: 2 MB, whatever the rows."""

    SIZE = 1 << (2 * INFO)

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, anchors: np.ndarray) -> np.ndarray:
        return self.words[anchors >> 6] >> (anchors & 63).astype(np.uint64) & np.uint64(1) == 1

    @staticmethod
    def of(anchors: DataFrame) -> Bitmap:
        """The one long column of ``anchors``."""

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(batch.column(0).to_numpy(zero_copy_only=False))
                if len(at):
                    first = np.flatnonzero(np.concatenate([[True], at[1:] >> 6 != at[:-1] >> 6]))
                    value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                    yield pa.RecordBatch.from_arrays([pa.array(at[first] >> 6), pa.array(value.view(np.int64))], ["word", "bits"])

        found = anchors.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most SIZE / 64 rows
        out = np.zeros(Bitmap.SIZE >> 6, np.uint64)
        out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        return Bitmap(out)


def _over(spread: Callable[[np.ndarray], Iterator[tuple[np.ndarray, ...]]], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 4096):
                for columns in spread(fps[at : at + 4096]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run


def _homes(fps: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    for _, anchor, _ in anchors_of(fps, 0):
        yield (anchor,)


def _visits(occupied: Bitmap):
    def spread(fps: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for _, anchor, _ in anchors_of(fps):
            yield (anchor[occupied.has(anchor)],)

    return spread


def _replicas(occupied: Bitmap, crowded: Bitmap):
    """``key``, ``away`` (flips, or 0 at home) and ``fp``, for each anchor where the fingerprint may meet one at home."""

    def spread(fps: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        rest = (fps >> np.uint64(2 * LENGTH)).astype(np.int64)
        for row, anchor, away in anchors_of(fps):
            there = occupied.has(anchor)
            row, anchor = row[there], anchor[there]
            split = crowded.has(anchor)
            plain = row[~split]
            yield anchor[~split] << LEFT, np.full(len(plain), away, np.int32), fps[plain].view(np.int64)
            row, anchor = row[split], anchor[split]
            if len(row):
                for more in range(THRESHOLD - away + 1):
                    flips = left_flips()[more]
                    key = (anchor << LEFT | rest[row])[:, None] ^ flips[None, :]
                    yield key.ravel(), np.full(key.size, away + more, np.int32), np.repeat(fps[row], len(flips)).view(np.int64)

    return spread


class Meeting:
    """What is at home at one anchor, and the links found there, as a tree for each group that they connect."""

    def __init__(self, key: int):
        self.key, self.homes, self.labels, self.links = key, np.zeros(0, np.uint64), None, []

    def add(self, fps: np.ndarray, home: bool) -> None:
        if home:
            self.homes = np.concatenate([self.homes, fps])
            return
        self.settle()
        self._compare(fps, False)

    def settle(self) -> None:
        """All that are at home have come; they are compared with each other."""
        if self.labels is None:
            self.labels = np.arange(len(self.homes))
            if len(self.homes) > 1:
                self._compare(self.homes, True)

    def _compare(self, fps: np.ndarray, home: bool) -> None:
        n = len(self.homes)
        if not n:
            return
        step = max(1, TILE // n)
        for at in range(0, len(fps), step):
            part = fps[at : at + step]
            near = np.bitwise_count(part[:, None] ^ self.homes[None, :]) <= THRESHOLD
            if not home:  # each link of two anchors' is found at both; one is enough
                near &= part[:, None] < self.homes[None, :]
            some = np.flatnonzero(near.any(axis=1))
            part, near = part[some], near[some]
            low = np.where(near, self.labels[None, :], n).min(axis=1, initial=n)
            high = np.where(near, self.labels[None, :], -1).max(axis=1, initial=-1)
            alike = low == high
            first = near.argmax(axis=1)
            self._link(part[alike], self.homes[first[alike]])
            for k in np.flatnonzero(~alike).tolist():
                met = np.flatnonzero(near[k])
                labels, at_first = np.unique(self.labels[met], return_index=True)
                self._link(np.repeat(part[k], len(labels)), self.homes[met[at_first]])
                if len(labels) > 1:
                    self.labels[np.isin(self.labels, labels)] = labels[0]

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        other = a != b
        if other.any():
            self.links.append((a[other], b[other]))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by anchor, those at home first; only those are kept while the others pass."""

    def out(meeting: Meeting) -> Iterator[pa.RecordBatch]:
        links, meeting.links = meeting.links, []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*links, strict=True)], ["a", "b"])

    last = None
    for batch in batches:
        key, away, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        fps = fps.view(np.uint64)
        if not len(key):
            continue
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.concatenate([first[1:], [len(key)]])
        going_on = np.zeros(len(first), bool)
        going_on[-1] = True  # its rows may go on in the next batch
        if last is not None and last.key == key[0]:
            going_on[0] = True
        two = (ends - first == 2) & ~going_on  # most anchors with more than one row
        a, b, there = fps[first[two]], fps[np.minimum(first[two] + 1, len(fps) - 1)], away[first[two]] == 0
        linked = there & (np.bitwise_count(a ^ b) <= THRESHOLD)
        if linked.any():
            yield pa.RecordBatch.from_arrays([pa.array(a[linked].view(np.int64)), pa.array(b[linked].view(np.int64))], ["a", "b"])
        for k in np.flatnonzero(going_on | (ends - first > 2)).tolist():
            lo, hi = int(first[k]), int(ends[k])
            if last is None or last.key != key[lo]:
                if last is not None:
                    last.settle()
                    yield from out(last)
                last = Meeting(int(key[lo]))
            middle = lo + int(np.searchsorted(away[lo:hi] > 0, True))
            if middle > lo:
                last.add(fps[lo:middle], True)
            if hi > middle:
                last.add(fps[middle:hi], False)
            yield from out(last)
    if last is not None:
        last.settle()
        yield from out(last)


def links_of(fps: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between the distinct fingerprints of the one column of ``fps``.

    Enough of them to connect whatever links connect: at an anchor, a tree for each group.
    """
    occupied = Bitmap.of(fps.mapInArrow(_over(_homes, ["anchor"]), "anchor long"))
    # crowded anchors are only refined; what is found does not depend on the sample
    some = fps.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).mapInArrow(_over(_visits(occupied), ["anchor"]), "anchor long")
    crowded = Bitmap.of(some.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CROWD // SAMPLE).select("anchor"))
    rows = fps.mapInArrow(_over(_replicas(occupied, crowded), ["key", "away", "fp"]), "key long, away int, fp long")
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "key").sortWithinPartitions("key", "away").mapInArrow(_meet, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex) and ``component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    Fingerprints that differ in at most ``THRESHOLD`` bits are linked; a component's id is the least ``doc_id`` of all
    that links connect, null where all are null. Null texts and texts without words have fingerprint 0 and are linked
    like others. Rows that repeat are answered each. Further columns are ignored; an empty table has no rows.
    """
    found = written(fingerprints(docs, words))
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = components(written(links_of(distinct.select("fp")).distinct()))
    rooted = written(distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(least, "root").select("fp", "component_id"))
    return found.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
