"""Repeated byte strings across documents, by merging Burrows-Wheeler transforms of shards.

A string of ``LENGTH`` bytes is assigned to its anchor, the k-gram of least hash in it, so equal strings have
equal anchors at equal places. A piece is a run of strings with one anchor. Pieces that are equal as a whole
need no sorting: the first stays, the others are repeats. Different pieces of one anchor are cut into bands, by
distance from the anchor; the strings of a band share a core, and only bands with equal cores can share a
string. Of equal bands the first goes on, in each task before they move and again where they meet. A core of
very many bands is cut into narrower ones, down to single strings. Different bands with equal cores stream into
buckets of bounded size, where suffix orders of shards are merged by refining their interleave: each step
carries it from the order by the first n bytes to that by the first n + 2, and keeps the intervals of equal
prefixes. At depth ``LENGTH`` the intervals are the repeated strings. No step sorts the suffixes of different
shards anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import fresh, mixed, powers, text_chunks, written

LENGTH = 100
GRAM = 20
SLICE = 1 << 19  # bytes of a long text that are looked at together
CHUNK = 1 << 17  # bytes of short texts that are: their arrays stay in a core's cache
BANDS = (16, 4, 1)  # strings of a band; the narrower ones are for cores of more than ``HOT`` bands
FLUSH_BYTES = 1 << 22  # bytes of bands among which a worker looks for equal ones before it hands them on
BUCKET_BYTES = 1 << 20  # bytes of bands that are merged together; the more, the slower each byte
TASK_BYTES = 1 << 24  # bytes of bands that come to a task, which merges them bucket by bucket
SHARD_BYTES = 1 << 18
GATHER_BYTES = 1 << 17  # bytes copied together, each of which has an index of 8 bytes
READ_BYTES = 1 << 22  # bytes of rows that a worker gets at once
ROWS_AT_ONCE = 256  # texts whose ranges are Python objects together
SEEN_BITS = 1 << 27  # of the set of anchors that occur more than once
HOT = 4096  # bands of one core, beyond which they are cut into narrower ones
ODD = np.uint64(0xC2B2AE3D27D4EB4F)
_PIECES = "anchor long, content long, length int, place int, doc_id long, row long, start long"
_BANDS = "again boolean, core long, content long, doc_id long, row long, start long, size int, place int, bytes binary"
_RANGES = "doc_id long, row long, start long, end long"


def pieces_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: row, start in its text, length, place of the anchor, its hash, content hash."""
    n = len(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    if n < length:
        return none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n), out=sums[1:])
    inverse = powers(n + 1, inverse=True)
    h = (sums[gram:] - sums[: n - gram + 1]) * inverse[: n - gram + 1]
    width = length - gram + 1
    low = np.uint64((1 << 24) - 1)
    least = (h * ODD & ~low) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least & low).astype(np.int64)  # one entry for each string
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    ok = np.arange(len(anchor)) + length <= offsets[row + 1]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(anchor)]]) - 1
    keep = ok[first]
    first, last = first[keep], last[keep]
    end = last + length
    content = mixed((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64))
    return row[first], first - offsets[row[first]], end - first, anchor[first] - first, mixed(h[anchor[first]]), content


def _slices(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, their first byte, bytes and offsets; a text longer than a slice comes in parts that overlap."""
    for lo, hi, data, offsets in text_chunks(column, CHUNK):
        if hi - lo > 1 or len(data) <= SLICE:
            yield np.arange(lo, hi), np.zeros(hi - lo, np.int64), data, offsets
            continue
        for at in range(0, len(data) - length + 1, SLICE - length + 1):
            part = data[at : at + SLICE]
            yield np.array([lo]), np.array([at]), part, np.array([0, len(part)])


class Seen:
    """A set of 64-bit hashes as bits, two for each; may answer yes for a hash that was not put in, never no for one that was."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def spots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(bits - 1)
        return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.spots(hashes, self.bits):
            out &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out


def seen_of(hashes: DataFrame) -> Seen:
    """The one column of ``hashes`` as a set of at most ``SEEN_BITS`` bits: its size is bounded, whatever the rows."""
    n = hashes.count()
    bits = 1 << 20
    while bits < min(SEEN_BITS, 16 * n):
        bits *= 2

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(Seen.spots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))
            at = np.unique(at)
            if len(at):
                word = at >> 6
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(value.view(np.int64))], ["word", "bits"])

    found = hashes.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits >> 6, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Seen(out, bits)


def _counted(length: int, gram: int):
    """Anchors of all pieces, and how many pieces have them, counted within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in _slices(batch.column(2), length):
                anchors, n = np.unique(pieces_of(data, offsets, length, gram)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return run


def _anchored(length: int, gram: int, seen: Seen):
    """Pieces of all texts whose anchor may be in ``seen``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for rows, begin, data, offsets in _slices(batch.column(2), length):
                row, start, size, place, anchor, content = pieces_of(data, offsets, length, gram)
                wanted = seen.maybe(anchor)
                row, start, size, place, anchor, content = (x[wanted] for x in (row, start, size, place, anchor, content))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32)),
                     pa.array(ids[rows[row]].astype(np.int64)), pa.array(keys[rows[row]]), pa.array(start + begin[row])],
                    ["anchor", "content", "length", "place", "doc_id", "row", "start"])

    return run


def shard_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the cyclic shard in order of their first ``depth`` bytes at least, by doubling ranks."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | np.roll(text, -k).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
    known = 8
    while known < depth and rank[order[-1]] < n - 1:
        pair = rank * n + np.roll(rank, -(known % n))
        order = np.argsort(pair, kind="stable")
        rank[order] = np.concatenate([[0], np.cumsum(pair[order][1:] != pair[order][:-1])])
        known *= 2
    return order


def symbols_of(shards: list[np.ndarray], depth: int, most: int = 1 << 16) -> tuple[int, list[np.ndarray]]:
    """The widest symbols that divide ``depth``, up to four bytes, of which there are at most ``most``.

    Returns the width, and for each byte the symbol that ends before it. Symbols are numbered in one order for
    all shards; each shard is cyclic.
    """
    sizes = np.cumsum([len(x) for x in shards])[:-1]
    wide = np.concatenate([np.roll(x, 1) for x in shards]).astype(np.uint32)
    width, code = 1, wide.astype(np.uint16)
    for more in (2, 3, 4):
        wide = wide | np.concatenate([np.roll(x, more) for x in shards]).astype(np.uint32) << np.uint32(8 * (more - 1))
        if depth % more:
            continue
        if more < 4:
            there = np.zeros(1 << (8 * more), bool)
            there[wide] = True
            if int(there.sum()) > most:
                break
            code = (np.cumsum(there, dtype=np.int32) - 1)[wide].astype(np.uint16)
        else:
            values, number = np.unique(wide, return_inverse=True)
            if len(values) > most:
                break
            code = number.astype(np.uint16)
        width = more
    return width, np.split(code, sizes)


def merge_transforms(transforms: list[np.ndarray], width: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' suffixes by their first ``depth`` bytes, and the interval of each.

    A transform has, for each suffix of its shard in order, the symbol of ``width`` bytes in front of it, and is
    all that is read. Entry j of the interleave is the shard of the jth suffix; its intervals number the groups
    of suffixes with equal prefixes. ``depth`` is a multiple of ``width``.
    """
    sizes = [len(t) for t in transforms]
    symbols = transforms[0] if len(sizes) == 1 else np.concatenate(transforms)
    interleave = np.repeat(np.arange(len(sizes), dtype=np.uint8 if len(sizes) <= 256 else np.uint16), sizes)
    interval = np.zeros(len(symbols), np.int32)
    count = 1
    for _ in range(depth // width):
        here = np.empty_like(symbols)
        for k, transform in enumerate(transforms):
            here[interleave == k] = transform
        step = np.argsort(here, kind="stable")
        sorted_symbols, sorted_intervals = here[step], interval[step]
        new = np.ones(len(here), bool)
        new[1:] = (sorted_symbols[1:] != sorted_symbols[:-1]) | (sorted_intervals[1:] != sorted_intervals[:-1])
        interleave = interleave[step]
        interval = np.cumsum(new, dtype=np.int32)
        if interval[-1] == count:  # no interval was split, so none will be
            break
        count = int(interval[-1])
    return interleave, interval


def repeated_starts(pieces: list[bytes], length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each piece, in order of age, which of its strings of ``length`` bytes start earlier too."""
    text = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(sizes) - sizes
    cuts = [0]
    for k in range(len(pieces)):
        if starts[k] + sizes[k] - cuts[-1] > shard_bytes and starts[k] > cuts[-1]:
            cuts.append(int(starts[k]))
    cuts.append(len(text))
    shards = [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    width, codes = symbols_of(shards, length)
    orders = [shard_order(x, length) for x in shards]
    transforms = [code[order] for code, order in zip(codes, orders, strict=True)]
    orders = [order + a for order, a in zip(orders, cuts[:-1], strict=True)]
    interleave, interval = merge_transforms(transforms, width, length)
    place = np.empty(len(text), np.int64)
    place[np.argsort(interleave, kind="stable")] = np.concatenate(orders)
    whole = np.zeros(len(text), bool)  # a string of full length starts here, within its piece
    for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        whole[s : s + n - length + 1] = n >= length
    mine = whole[place]
    place, interval = place[mine], interval[mine]
    repeated = np.zeros(len(text), bool)
    if len(place):
        group = np.concatenate([[0], np.flatnonzero(np.diff(interval)) + 1])
        oldest = np.minimum.reduceat(place, group)
        repeated[place] = place != np.repeat(oldest, np.diff(np.concatenate([group, [len(place)]])))
    return [repeated[s : s + n] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _ranges(doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (doc, row, start, end)], ["doc_id", "row", "start", "end"])


def _merge_held(held: list[tuple], length: int) -> pa.RecordBatch:
    """Ranges of the repeated strings in different bands, which come with all others of their core."""
    core, doc, row, start = (np.concatenate(x) for x in list(zip(*held, strict=True))[:4])
    pieces = [b for h in held for b in h[4]]
    _, number, n = np.unique(core, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(n[number] > 1)
    shared = shared[np.lexsort((start[shared], row[shared], doc[shared]))]  # by age
    docs, rows, starts, ends = [], [], [], []
    if len(shared):
        for k, flags in zip(shared.tolist(), repeated_starts([pieces[k] for k in shared.tolist()], length), strict=True):
            for x, y in zip(*_runs(flags), strict=True):
                docs.append(doc[k])
                rows.append(row[k])
                starts.append(start[k] + x)
                ends.append(start[k] + y - 1 + length)
    return _ranges(docs, rows, starts, ends)


def _merge_buckets(length: int):
    """Bands come in order of core, bytes and age. Of equal ones the oldest goes on; a bucket is merged whenever it is full."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # core, document, row, start and bytes of different bands
        size, last = 0, None  # last: core, content, document, row and start of the oldest of the equal bands that came last
        for batch in batches:
            if not len(batch):
                continue
            core, content, doc, row, start, length_of = _numbers(batch, "core", "content", "doc_id", "row", "start", "size")
            new = np.ones(len(core), bool)
            new[1:] = (core[1:] != core[:-1]) | (content[1:] != content[:-1])
            new[0] = last is None or last[:2] != (core[0], content[0])
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))  # -1: equal to the last of the batch before
            old = [np.where(first >= 0, x[first], 0 if last is None else last[k]) for k, x in ((2, doc), (3, row), (4, start))]
            # rows that repeat a document give the same band at the same place
            again = ~new & ((doc != old[0]) | (row != old[1]) | (start != old[2]))
            yield _ranges(doc[again], row[again], start[again], start[again] + length_of[again])
            last = (core[-1], content[-1], old[0][-1], old[1][-1], old[2][-1])
            at = np.flatnonzero(new)
            texts = batch.column(batch.schema.get_field_index("bytes")).take(pa.array(at)).to_pylist()
            filled = size + np.cumsum(length_of[at])
            bound = np.flatnonzero(np.concatenate([[False], core[at][1:] != core[at][:-1]])) if len(at) else at  # where a core begins
            if len(at) and held and held[-1][0][-1] != core[at[0]]:
                bound = np.concatenate([[0], bound])
            lo, gone = 0, 0
            for k in bound.tolist():
                if (filled[k - 1] if k else size) - gone < BUCKET_BYTES:
                    continue
                held.append((core[at[lo:k]], doc[at[lo:k]], row[at[lo:k]], start[at[lo:k]], texts[lo:k]))
                yield _merge_held(held, length)
                held, lo, gone = [], k, int(filled[k - 1] if k else size)
            if lo < len(at):
                held.append((core[at[lo:]], doc[at[lo:]], row[at[lo:]], start[at[lo:]], texts[lo:]))
            size = (int(filled[-1]) if len(at) else size) - gone
        if held:
            yield _merge_held(held, length)

    return merge


def bands_of(data: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray, band: int, length: int) -> tuple[np.ndarray, ...]:
    """Bands of pieces: piece, hash of the core, hash of the bytes, start and end in ``data``, start of the core.

    Where a band begins is counted from the anchor of its piece, which stands ``place`` bytes from the piece's start.
    """
    anchor, last = start + place, start + size - length  # last string
    high, low = (anchor - start) // band, (anchor - last) // band
    piece = np.repeat(np.arange(len(start)), high - low + 1)
    number = high[piece] - (np.arange(len(piece)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1))
    core = anchor[piece] - number * band  # where the core starts; all strings of the band hold it
    first = np.maximum(start[piece], core - band + 1)
    end = np.minimum(last[piece], core) + length
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=sums[1:])
    inverse = powers(len(data) + 1, inverse=True)
    whole = (sums[core - band + 1 + length] - sums[core]) * inverse[core]
    content = mixed((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64))
    return piece, mixed(whole + mixed(number.astype(np.uint64) + np.uint64(1))), content, first, end, core


def gathered(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all spans of ``data``, one behind the other; the indices are made for ``GATHER_BYTES`` or a span at a time."""
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    lo = 0
    while lo < len(size):
        begin = int(end[lo] - size[lo])
        hi = max(lo + 1, int(np.searchsorted(end, begin + GATHER_BYTES, side="right")))
        stop = int(end[hi - 1])
        shift = first[lo:hi] - (end[lo:hi] - size[lo:hi])
        out[begin:stop] = data[np.arange(begin, stop) + np.repeat(shift, size[lo:hi])]
        lo = hi
    return out


class _Combiner:
    """Bands of a task, gathered until there are ``FLUSH_BYTES``; of equal ones the oldest goes on, the others are ranges already."""

    def __init__(self):
        self.parts, self.texts, self.size = [], [], 0

    def put(self, core, content, doc, row, start, place, data, first, end) -> None:
        size = end - first
        total = int(size.sum())
        before = np.cumsum(size) - size
        self.texts.append(gathered(data, first, size))
        self.parts.append((core.view(np.int64), content.view(np.int64), doc, row, start, size, place, before + self.size))
        self.size += total

    def flush(self) -> pa.RecordBatch:
        core, content, doc, row, start, size, place, at = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        text = np.concatenate(self.texts)
        self.__init__()
        order = np.lexsort((start, row, doc, content, core))
        core, content, doc, row, start, size, place, at = (x[order] for x in (core, content, doc, row, start, size, place, at))
        new = np.ones(len(core), bool)
        new[1:] = (core[1:] != core[:-1]) | (content[1:] != content[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        kept = new | (doc != doc[first]) | (row != row[first]) | (start != start[first])  # else the same place, of a row that repeats a document
        core, content, doc, row, start, size, place, at, new = (x[kept] for x in (core, content, doc, row, start, size, place, at, new))
        held = np.where(new, size, 0)
        offsets = np.concatenate([[0], np.cumsum(held)])
        text = gathered(text, at, held)
        binary = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(text)])
        return pa.RecordBatch.from_arrays(
            [pa.array(~new), *(pa.array(x) for x in (core, content, doc, row, start)), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32)), binary],
            ["again", "core", "content", "doc_id", "row", "start", "size", "place", "bytes"])


def _cut_texts(length: int, band: int):
    """Bands of the wanted pieces of whole texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Combiner()
        for batch in batches:
            ids, keys = _numbers(batch, "doc_id", "row")
            wanted = batch.column(3)
            until, pieces = wanted.offsets.to_numpy(), wanted.values
            start, size, place = (pieces.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("start", "length", "place"))
            for lo, hi, data, offsets in text_chunks(batch.column(2), CHUNK):
                mine = slice(until[lo], until[hi])
                text = np.repeat(np.arange(hi - lo), np.diff(until[lo : hi + 1]))
                at, long, to = start[mine] + offsets[text], size[mine], place[mine]
                part = at // SLICE  # of a long text, what is looked at together
                for k in np.unique(part).tolist():
                    some = part == k
                    begin, stop = int(at[some].min()), int((at[some] + long[some]).max())
                    piece, core, content, first, end, middle = bands_of(data[begin:stop], at[some] - begin, long[some], to[some], band, length)
                    of = text[some][piece]
                    out.put(core, content, ids[lo + of], keys[lo + of], first + begin - offsets[of], middle - first, data[begin:stop], first, end)
                    if out.size >= FLUSH_BYTES:
                        yield out.flush()
        if out.parts:
            yield out.flush()

    return cut


def _cut_bands(length: int, band: int):
    """Narrower bands of bands."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Combiner()
        for batch in batches:
            doc, row, start, place = _numbers(batch, "doc_id", "row", "start", "place")
            for lo, hi, data, offsets in text_chunks(batch.column(batch.schema.get_field_index("bytes")), CHUNK):
                piece, core, content, first, end, middle = bands_of(data, offsets[:-1], np.diff(offsets), place[lo:hi].astype(np.int64), band, length)
                of = lo + piece
                out.put(core, content, doc[of], row[of], start[of] + first - offsets[piece], middle - first, data, first, end)
                if out.size >= FLUSH_BYTES:
                    yield out.flush()
        if out.parts:
            yield out.flush()

    return cut


def _merged(bands: DataFrame, length: int) -> DataFrame:
    size = bands.agg(F.sum("size")).first()[0] or 0
    dealt = bands.repartition(int(size // TASK_BYTES) + 1, "core").sortWithinPartitions("core", "content", "doc_id", "row", "start")
    return dealt.mapInArrow(_merge_buckets(length), _RANGES)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Byte ranges ``doc_id``, ``row``, ``start``, ``end`` covered by strings of ``length`` bytes that start earlier too.

    Ranges may overlap. Earlier is by document id, then ``row``, then place. ``docs`` has ``doc_id`` and ``row`` (not null;
    two texts of one id have different rows) and ``text``.
    """
    docs = docs.select("doc_id", "row", "text")
    anchors = docs.mapInArrow(_counted(length, gram), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    seen = seen_of(written(anchors.where("n > 1").select("anchor"), READ_BYTES))
    found = written(docs.mapInArrow(_anchored(length, gram, seen), _PIECES), READ_BYTES)
    key = ["anchor", "content", "length"]
    # equal pieces are counted before they move
    contents = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row", "start", "place")).alias("oldest"))
    per_anchor = contents.groupBy("anchor").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).where(F.col("all") > 1)
    known = written(contents.join(per_anchor, "anchor"))

    firsts = known.where(F.col("n") > 1).select(*key, *[F.col(f"oldest.{c}").alias(f"first_{c}") for c in ("doc_id", "row", "start")])
    again = found.drop("place").join(firsts, key).where("doc_id <> first_doc_id or row <> first_row or start <> first_start")
    ranges = written(again.select("doc_id", "row", "start", (F.col("start") + F.col("length")).alias("end")))

    several = known.where(F.col("kinds") > 1).select("length", "oldest.*")
    wanted = several.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "length", "place")).alias("wanted"))  # at most its pieces per document
    texts = docs.join(wanted, ["doc_id", "row"]).select("doc_id", "row", "text", "wanted")
    cut = written(texts.mapInArrow(_cut_texts(length, BANDS[0]), _BANDS), READ_BYTES)
    for narrower in (*BANDS[1:], None):
        ranges = ranges.unionByName(cut.where("again").select("doc_id", "row", "start", (F.col("start") + F.col("size")).alias("end")))
        bands = cut.where("not again").drop("again")
        hot = written(bands.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("core")) if narrower else None
        if hot is None or hot.isEmpty():  # bands of one string that share a core are equal, so no bucket grows with them
            return written(ranges.unionByName(_merged(bands, length)))
        ranges = ranges.unionByName(written(_merged(bands.join(hot, "core", "left_anti"), length)))
        cut = written(bands.join(hot, "core", "left_semi").mapInArrow(_cut_bands(length, narrower), _BANDS))


def row_of(text: Column) -> Column:
    """Tells apart texts that share an id; texts that share both are one document."""
    return F.xxhash64(F.lit(1), text)


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id``, ``row``, ``n_bytes``, ``removed`` (maximal ranges) and ``kept`` (the bytes left) of every document.

    Null is empty. Rows that repeat an id and its text are the same document and answered alike; different texts of one
    id are documents of their own, in the order of a hash of the text (``row``). Rows without an id have no place in the
    order, are not searched and lose nothing. Nor do texts shorter than ``length`` bytes. Further columns are ignored.
    """
    return _cut_out(docs, length, pa.binary())


def _cut_out(docs: DataFrame, length: int, kept_type: pa.DataType) -> DataFrame:
    """As :func:`deduplicated`; as text, ``kept`` is without bytes that no longer form a character."""
    as_text = pa.types.is_string(kept_type)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_of(text).alias("row"), text.alias("text"))
    found = repeats(texts.where("doc_id is not null"), length)
    ranges = found.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            sizes, removed, kept = [], [], []
            for text, spans in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                raw = text.encode()
                joined: list[list[int]] = []
                for s in spans or ():
                    if joined and s["start"] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], s["end"])
                    else:
                        joined.append([s["start"], s["end"]])
                at, left = 0, []
                for a, b in joined:
                    left.append(raw[at:a])
                    at = b
                sizes.append(len(raw))
                removed.append([{"start": a, "end": b} for a, b in joined])
                rest = b"".join([*left, raw[at:]])
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, kept_type)],
                ["doc_id", "row", "n_bytes", "removed", "kept"])

    schema = f"doc_id long, row long, n_bytes long, removed array<struct<start:long,end:long>>, kept {'string' if as_text else 'binary'}"
    return texts.join(ranges, ["doc_id", "row"], "left").select("doc_id", "row", "text", "ranges").mapInArrow(cut, schema)


def dedup_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The digest per document: bytes, bytes and runs removed, and the hash of what is left."""
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return deduplicated(docs, length).select(
        "doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated ranges cut out of ``text``; bytes that no longer form a character go with them.

    Each text loses its own ranges, also where it shares its id with another. Other columns stay as they are.
    """
    name, row = fresh("_kept", docs), fresh("_row", docs)
    changed = _cut_out(docs, length, pa.string()).where(F.size("removed") > 0)
    left = changed.select("doc_id", F.col("row").alias(row), F.col("kept").alias(name)).dropDuplicates(["doc_id", row])
    named = docs.withColumn(row, row_of(F.col("text").cast("string")))
    return named.join(left, ["doc_id", row], "left").withColumn("text", F.coalesce(F.col(name), F.col("text"))).select(*docs.columns)
