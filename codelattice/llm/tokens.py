"""Token ids of whole texts, encoded once for each distinct word.

The tokenizer's pre-tokens never hold white space, so a text's ids are those of its words in order. Words are
found on the bytes of many texts at a time; each worker keeps the ids of the words it has seen.
"""

from __future__ import annotations

import numpy as np

from codelattice.llm.common import span_hashes, word_spans

CACHE_WORDS = 250_000  # words that a worker remembers; beyond that it starts anew

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~_SPACE
_codes = np.arange(256, dtype=np.uint8)
_ASCII_LOWER = np.where((_codes >= 0x41) & (_codes <= 0x5A), _codes + 32, _codes).astype(np.uint8)
_LETTER = (_codes >= 0x61) & (_codes <= 0x7A)


def simple_lower(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the letters from U+00C0 to U+00DE; all else as it is."""
    out = _ASCII_LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = data[at]
    up = (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
    out[at[up]] += 0x20
    return out


class Encoder:
    """A tokenizer file with its remembered words."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _clear(self) -> None:
        self.at: dict[int, int] = {}  # hash of a unit -> its number
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def _remember(self, units: list[str], hashes: list[int]) -> None:
        for lo in range(0, len(units), 4096):
            part = units[lo : lo + 4096]
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            lengths = np.array([len(x) for x in encoded], np.int64)
            total, n = int(lengths.sum()), len(self.at)
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while n + len(part) > len(self.start):
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
                self.length = np.concatenate([self.length, np.zeros_like(self.length)])
            self.flat[self.used : self.used + total] = np.fromiter((i for x in encoded for i in x), np.uint32, total)
            ends = np.cumsum(lengths)
            self.start[n : n + len(part)] = self.used + ends - lengths
            self.length[n : n + len(part)] = lengths
            self.at.update(zip(hashes[lo : lo + 4096], range(n, n + len(part)), strict=True))
            self.used += total

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's begin (one entry more than texts)."""
        data = simple_lower(raw) if len(raw) else raw
        starts, ends, first = self._units(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes, inverse = np.unique(span_hashes(data, starts, ends), return_inverse=True)
        keys = hashes.tolist()
        if len(self.at) > CACHE_WORDS:
            self._clear()
        new = [k for k, h in enumerate(keys) if h not in self.at]
        if new:
            where = np.zeros(len(keys), np.int64)
            where[inverse] = np.arange(len(inverse))
            text = data.tobytes()
            at = where[new]
            self._remember([text[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], [keys[k] for k in new])
        number = np.fromiter((self.at[h] for h in keys), np.int64, len(keys))[inverse]
        lengths = self.length[number]
        stop = np.cumsum(lengths)
        source = np.arange(int(stop[-1])) + np.repeat(self.start[number] - (stop - lengths), lengths)
        bounds = np.concatenate([[0], stop])[first]
        return self.flat[source], bounds

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, those of plain letters with marks at their end cut before the first mark."""
        starts, ends, first = word_spans(data, offsets, NOT_SPACE)
        if not len(starts):
            return starts, ends, first
        letter = _LETTER[data]
        two = np.flatnonzero(data[:-1] == 0xC3)  # U+00DF to U+00FF but the division sign are letters of two bytes
        two = two[(data[two + 1] >= 0x9F) & (data[two + 1] != 0xB7)]
        letter[two] = letter[two + 1] = True
        sums = np.concatenate([[0], np.cumsum(letter)])
        ascii_other = np.concatenate([[0], np.cumsum(~letter & ((data >= 0x80) | (data == 0x27)))])
        run = np.flatnonzero(np.concatenate([~letter, [True]]))  # where letters end
        letters_end = np.minimum(run[np.searchsorted(run, starts)], ends)
        # letters, then only ASCII marks or digits without letters or apostrophes: two units
        split = (letters_end > starts) & (letters_end < ends) & (sums[ends] == sums[letters_end]) & (ascii_other[ends] == ascii_other[starts])
        if not split.any():
            return starts, ends, first
        cut = np.flatnonzero(split)
        new_starts = np.insert(starts, cut + 1, letters_end[cut])
        new_ends = np.insert(ends, cut, letters_end[cut])
        moved = first + np.concatenate([[0], np.cumsum(split)])[first]
        return new_starts, new_ends, moved
