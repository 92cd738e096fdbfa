"""A vocabulary of subwords as arrays, looked up for all substrings of many words at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from codelattice.llm.common import BASE, mixed, powers

START = "▁"  # marks where a word begins
CELLS = 1 << 20  # characters that one pass works on


def read_pieces(path: str) -> tuple[list[str], np.ndarray]:
    """Ordinary pieces of a SentencePiece file, in its order, and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return [model.id_to_piece(i) for i in ids], np.array([model.get_score(i) for i in ids])


def rank_probabilities(scores: np.ndarray) -> np.ndarray:
    """Logarithms of probabilities from the order of the scores: the better the rank, the likelier, after Zipf.

    One more entry, for a byte of a character that the vocabulary lacks, is as likely as the last piece.
    """
    rank = np.empty(len(scores) + 1)
    rank[np.argsort(-scores, kind="stable")] = np.arange(1, len(scores) + 1)
    rank[-1] = len(scores) + 1
    logs = -np.log(rank)
    return logs - np.log(np.exp(logs).sum())


class Lookup:
    """Numbers of pieces by hash of their characters. The number after the last is that of a byte."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max((len(p) for p in pieces), default=1)
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.keys, self.numbers = hashes[order], order.astype(np.int32)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        codes = np.array([ord(c) for c in piece], np.uint64) + np.uint64(1)
        return int(mixed((codes * powers(len(codes))).sum(keepdims=True) ^ np.uint64(len(codes) << 40))[0])

    def find(self, sums: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Number of the piece that spans ``begin`` to ``end`` of each row, or -1. ``sums`` are prefix sums of a row's characters."""
        inverse = powers(begin + 1, inverse=True)[begin]
        h = mixed((sums[:, end] - sums[:, begin]) * inverse ^ np.uint64((end - begin) << 40))
        out = np.full(len(h), -1, np.int32)
        at = np.flatnonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(at):
            k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            same = self.keys[k] == h[at]
            out[at[same]] = self.numbers[k[same]]
        return out


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    sums = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(codes.shape[1]), axis=1, out=sums[:, 1:])
    return sums


def utf8_sizes(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)


def by_length(words: list[str], cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(positions, codes)``: words of one length at a time, with the start mark, one row per word; some ``cells`` characters each."""
    lengths = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        if not len(group):
            continue
        n = int(lengths[group[0]])
        step = max(1, cells // (n + 1))
        for at in range(0, len(group), step):
            part = group[at : at + step]
            codes = np.frombuffer("".join(words[k] for k in part).encode("utf-32-le"), np.uint32).reshape(len(part), n)
            yield part, np.concatenate([np.full((len(part), 1), ord(START), np.uint32), codes], axis=1)


def edges(lookup: Lookup, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """All pieces in the rows, by end and begin: ``(begin, end, rows, numbers)``.

    A character that is no piece is one edge of its bytes, so every row can be spelled; its number is the byte's.
    """
    sums = prefix_sums(codes)
    width = codes.shape[1]
    for end in range(1, width + 1):
        for begin in range(end - 1, max(-1, end - 1 - lookup.longest), -1):
            numbers = lookup.find(sums, begin, end)
            if begin == end - 1:
                yield begin, end, np.arange(len(codes)), np.where(numbers < 0, lookup.size, numbers)
                continue
            rows = np.flatnonzero(numbers >= 0)
            if len(rows):
                yield begin, end, rows, numbers[rows]


assert int(BASE) & 1, "substrings are hashed with an invertible base"
