"""Best-fit packing of token pieces into sequences, improved by exchanges between underfull bins.

Pieces are dealt at random to groups of bounded size. Each group is packed best fit first; then documents move
or change places between underfull bins, each time so that the sum of squared fills grows, until bins are empty.
The underfull bins of all groups are pooled, dealt anew and packed again, until one group is left or no bin is freed.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import text_chunks, written
from codelattice.llm.tokens import Encoder

CAPACITY = 2048
GROUP = 20_000  # pieces that one task packs at a time
SEPARATOR = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long, fill long"


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """Each document's ids and one separator, cut into pieces of ``capacity``; the last may be shorter.

    ``docs`` has ``doc_id`` and ``text``; null is empty, and gives one piece that is the separator alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, raw, offsets in text_chunks(batch.column(1)):
                flat, bounds = encoder.encode(raw, offsets)
                row, piece, start, length, crc = [], [], [], [], []
                for k in range(hi - lo):
                    tokens = np.empty(bounds[k + 1] - bounds[k] + 1, "<u4")
                    tokens[:-1] = flat[bounds[k] : bounds[k + 1]]
                    tokens[-1] = separator
                    for n, at in enumerate(range(0, len(tokens), capacity)):
                        part = tokens[at : at + capacity]
                        row.append(k)
                        piece.append(n)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).cast(pa.int64()).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


class Returns:
    """What bins may give back, single items or pairs of two, in arrays that follow the bins' changes."""

    def __init__(self):
        self.values, self.owners = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.given: list[tuple[int, ...]] = []
        self.at: dict[int, tuple[int, int]] = {}

    def put(self, b: int, entries: list[tuple[int, ...]]) -> None:
        """``entries`` of bin b, each the length and the items, in place of those it had."""
        lo, hi = self.at.pop(b, (0, 0))
        self.values[lo:hi] = np.iinfo(np.int64).max >> 1  # longer than anything that could go
        lo, hi = len(self.given), len(self.given) + len(entries)
        while hi > len(self.values):
            self.values, self.owners = (np.concatenate([x, np.zeros_like(x)]) for x in (self.values, self.owners))
        self.values[lo:hi] = [x[0] for x in entries]
        self.owners[lo:hi] = b
        self.given += [x[1:] for x in entries]
        self.at[b] = (lo, hi)

    def best(self, out: list[tuple[int, tuple]], space: np.ndarray) -> tuple | None:
        """Gain, bin, items out and items back of the exchange that fills a bin most; ``space`` is that of each bin."""
        values, owners = self.values[: len(self.given)], self.owners[: len(self.given)]
        room = space[owners]
        on = np.flatnonzero(room)
        values, room, best = values[on], room[on], None
        for n, moved in out:
            gain = n - values
            gain[(gain > room) | (gain < 0)] = 0
            k = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[k] > (best[0] if best else 0):
                best = (int(gain[k]), int(owners[on[k]]), moved, self.given[on[k]])
        return best


class Bins:
    """Bins of one group: lists of item numbers, with the free space of each, and those with space in order."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths.tolist(), capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []
        self.order: list[tuple[int, int]] = []  # (free space, bin) of the bins with space that hold anything
        self.changed: set[int] = set()
        self.tables: tuple[Returns, Returns] | None = None

    def _set(self, b: int, free: int) -> None:
        if self.free[b] > 0:
            self.order.pop(bisect_left(self.order, (self.free[b], b)))
        self.free[b] = free
        self.changed.add(b)
        if free > 0 and self.items[b]:
            insort(self.order, (free, b))

    def best_fit(self) -> None:
        for i in np.argsort(-np.asarray(self.lengths), kind="stable").tolist():
            n = self.lengths[i]
            at = bisect_left(self.order, (n, -1))
            if at < len(self.order):
                b = self.order[at][1]
            else:
                b = len(self.items)
                self.items.append([])
                self.free.append(self.capacity)
                insort(self.order, (self.capacity, b))
            self.items[b].append(i)
            self._set(b, self.free[b] - n)

    def _shift(self, a: int, b: int, out: list[int], back: list[int]) -> None:
        """``out`` goes from bin a to bin b and ``back`` from b to a."""
        gain = sum(self.lengths[i] for i in out) - sum(self.lengths[i] for i in back)
        for i in out:
            self.items[a].remove(i)
        for i in back:
            self.items[b].remove(i)
        self.items[b] += out
        self.items[a] += back
        self._set(a, self.free[a] + gain)
        self._set(b, self.free[b] - gain)

    def _pairs(self, items: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Sums of two of the sorted ``items`` with the items, one pair for each two lengths: items of a length stand for each other.

        What one bin holds has at most some sqrt(2 * capacity) lengths, so there are about as many pairs as the capacity.
        """
        first: dict[int, int] = {}
        twice: dict[int, tuple[int, int, int]] = {}
        for n, i in items:
            if n not in first:
                first[n] = i
            elif n not in twice:
                twice[n] = (2 * n, first[n], i)
        apart = list(first.items())
        return sorted([*twice.values(), *[(x + y, i, j) for k, (x, i) in enumerate(apart) for y, j in apart[k + 1 :]]])

    def _improve(self, a: int, others: list[int]) -> bool:
        """One change that makes a fuller bin fuller at the cost of bin a: a move, or an exchange one for one, one for two or two for one."""
        best = None
        own = sorted((self.lengths[i], i) for i in self.items[a])
        out = [(n, (i,)) for n, i in own] + [(n, (i, j)) for n, i, j in self._pairs(own)]
        for b in others:
            space = self.free[b]
            if b == a or space <= 0 or space > self.free[a] or not self.items[b]:
                continue
            theirs = sorted((self.lengths[i], i) for i in self.items[b])
            pairs = self._pairs(theirs)
            for n, moved in out:
                if n <= space:
                    found = (n, b, moved, ())
                else:
                    need = n - space  # least that has to come back so that these fit
                    at, at2 = bisect_left(theirs, (need, -1)), bisect_left(pairs, (need, -1, -1))
                    one = theirs[at] if at < len(theirs) and theirs[at][0] < n else None
                    two = pairs[at2] if len(moved) == 1 and at2 < len(pairs) and pairs[at2][0] < n else None
                    if two and (not one or two[0] < one[0]):
                        found = (n - two[0], b, moved, two[1:])
                    elif one:
                        found = (n - one[0], b, moved, one[1:])
                    else:
                        continue
                if best is None or found[0] > best[0]:
                    best = found
            if best and best[0] == space:
                break
        if best is None:
            return False
        _, b, moved, back = best
        self._shift(a, b, list(moved), list(back))
        return True

    def _improve_anywhere(self, a: int) -> bool:
        """As :meth:`_improve`, against all bins that have no more space than bin a."""
        if self.tables is None:
            self.tables, self.changed = (Returns(), Returns()), set(range(len(self.items)))
        for b in self.changed:
            theirs = sorted((self.lengths[i], i) for i in self.items[b]) if self.free[b] > 0 else []
            self.tables[0].put(b, theirs)
            self.tables[1].put(b, self._pairs(theirs))
        self.changed = set()
        space = np.zeros(len(self.items), np.int64)
        for free, b in self.order[: bisect_left(self.order, (self.free[a] + 1, -1))]:
            space[b] = free
        space[a] = 0
        own = sorted((self.lengths[i], i) for i in self.items[a])
        one = [(n, (i,)) for n, i in own]
        # moves alone come first: what fits into the bin with most space fits somewhere
        widest = int(space.argmax())
        found = [(n, widest, moved, ()) for n, moved in one + [(n, (i, j)) for n, i, j in self._pairs(own)] if n <= space[widest]]
        found += [x for x in (self.tables[0].best(one + [(n, (i, j)) for n, i, j in self._pairs(own)], space), self.tables[1].best(one, space)) if x]
        if not found:
            return False
        _, b, moved, back = max(found, key=lambda x: x[0])
        self._shift(a, b, list(moved), list(back))
        return True

    def local_search(self, reach: int = 64) -> None:
        """Empties the emptiest bins one after the other, each against the ``reach`` bins with most space up to its own, then against all.

        Every exchange raises the sum of squared fills, so the search ends by itself.
        """
        stuck: set[int] = set()
        while True:
            a = next((b for _, b in reversed(self.order) if b not in stuck and self.items[b]), None)
            if a is None:
                return
            space = sum(free for free, b in self.order if b != a and self.items[b])
            if space < self.capacity - self.free[a]:  # what is free elsewhere can't hold it
                return
            while self.items[a]:
                at = bisect_left(self.order, (self.free[a] + 1, -1))
                others = [b for _, b in self.order[max(0, at - reach - 1) : at][::-1] if b != a]
                if not self._improve(a, others) and (at <= reach + 1 or not self._improve_anywhere(a)):
                    stuck.add(a)
                    break


def _pack(capacity: int, round_no: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins = Bins(rows["length"].to_numpy(), capacity)
        bins.best_fit()
        bins.local_search()
        sequence, offset, fill = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        n = 0
        for items in bins.items:
            if not items:
                continue
            at = 0
            for i in items:
                sequence[i], offset[i] = n, at
                at += bins.lengths[i]
            fill[items] = at
            n += 1
        rows["sequence_id"] = sequence + (np.int64(key[0]) << 24) + (np.int64(round_no) << 48)
        rows["offset"], rows["fill"] = offset, fill
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"]]

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, keep: float = 0.995) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; sequences hold at most ``capacity`` tokens, without gaps.

    Full pieces are sequences of their own. The others are packed in groups of about ``group`` rows, in rounds: bins
    at least ``keep`` full are done, the pieces of the rest are pooled for the next round, until one group is left.
    A round that frees no bin is not used, and is the last.
    """
    pieces = written(pieces)
    columns = [c.split()[0] for c in PIECES.split(", ")]
    full = pieces.where(F.col("length") >= capacity).select(
        *columns, F.xxhash64("doc_id", "piece").alias("_h"), F.lit(0).cast("long").alias("offset"))
    # ids of these: negative, and one for each row even if rows are repeated
    done = [full.select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), "offset")]
    rest, before, round_no = pieces.where(F.col("length") < capacity), None, 0
    while n := rest.count():
        round_no += 1
        groups = max(1, -(-n // group))
        dealt = rest.select(*columns, F.pmod(F.xxhash64(F.lit(round_no), "doc_id", "piece", "ids_crc32"), F.lit(groups)).alias("group"))
        placed = written(dealt.groupBy("group").applyInPandas(_pack(capacity, round_no), PLACED))
        if before is not None and placed.where("offset = 0").count() >= before:  # one piece of a sequence is at 0
            done.append(rest.select(*columns, "sequence_id", "offset"))
            break
        rest = placed.where(F.col("fill") < keep * capacity)
        before = rest.where("offset = 0").count()
        done.append((placed if groups == 1 else placed.where(F.col("fill") >= keep * capacity)).select(*columns, "sequence_id", "offset"))
        if groups == 1:
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """All documents, tokenised, cut and packed."""
    return pack_pieces(cut_pieces(docs, vocabulary, capacity), capacity)
