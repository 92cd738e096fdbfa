"""Token counts by best spelling, with scores shared along a trie of words.

The different words of many texts are put in order, which is a trie read from the top: a word's characters up to
where it leaves the word before it are nodes that exist. Best score and number of tokens are computed once for
each node, from its ancestors, and read off where a word ends. Texts then add up the numbers of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import span_hashes, text_chunks, word_spans
from codelattice.llm.subwords import CELLS, START, Lookup, prefix_sums, rank_probabilities, read_pieces, utf8_sizes
from codelattice.llm.tokens import NOT_SPACE

COUNTED = "doc_id long, n_words long, n_tokens long"


def _tries(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(positions, codes, lengths)`` of words in order, padded with 0, in parts of bounded size."""
    order = sorted(range(len(words)), key=words.__getitem__)
    short = [k for k in order if len(words[k]) <= 32]
    groups = [short[a : a + CELLS // 33] for a in range(0, len(short), CELLS // 33)] + [[k] for k in order if len(words[k]) > 32]
    for group in groups:
        lengths = np.array([len(words[k]) for k in group], np.int64)
        codes = np.zeros((len(group), int(lengths.max()) + 1), np.uint32)
        codes[:, 0] = ord(START)
        flat = np.frombuffer("".join(words[k] for k in group).encode("utf-32-le"), np.uint32)
        inside = np.arange(1, codes.shape[1])[None, :] <= lengths[:, None]
        codes[:, 1:][inside] = flat
        yield np.array(group), codes, lengths + 1


def best_counts(lookup: Lookup, logs: np.ndarray, words: list[str]) -> np.ndarray:
    """Number of tokens of each word's best spelling; of spellings that score alike, the one with fewest.

    A character that is no piece is spelled in its bytes, one token each.
    """
    out = np.zeros(len(words), np.int64)
    for where, codes, lengths in _tries(words):
        n, width = codes.shape
        differ = np.ones((n, width), bool)
        differ[1:] = np.logical_or.accumulate(codes[1:] != codes[:-1], axis=1)  # from where a word leaves the one before
        node = differ & (np.arange(width)[None, :] < lengths[:, None])
        owner = np.maximum.accumulate(np.where(differ, np.arange(n)[:, None], 0), axis=0)  # the word that made each node
        sums, sizes = prefix_sums(codes), utf8_sizes(codes)
        score, count = np.full((n, width + 1), -np.inf), np.zeros((n, width + 1), np.int64)
        score[:, 0] = 0
        for end in range(1, width + 1):
            made = np.flatnonzero(node[:, end - 1])
            if len(made):
                best, tokens = np.full(len(made), -np.inf), np.zeros(len(made), np.int64)
                part = sums[made]
                for begin in range(end - 1, max(-1, end - 1 - lookup.longest), -1):
                    number = lookup.find(part, begin, end)
                    if begin == end - 1:
                        times = np.where(number < 0, sizes[made, begin], 1)
                        value = score[made, begin] + logs[number] * times  # -1 is the last entry, that of a byte
                    else:
                        times = 1
                        value = np.where(number >= 0, score[made, begin] + logs[number], -np.inf)
                    total = count[made, begin] + times
                    better = (value > best) | ((value == best) & (total < tokens))
                    best, tokens = np.where(better, value, best), np.where(better, total, tokens)
                score[made, end], count[made, end] = best, tokens
            score[:, end], count[:, end] = score[owner[:, end - 1], end], count[owner[:, end - 1], end]
        out[where] = count[np.arange(n), lengths]
    return out


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id``, ``n_words`` and ``n_tokens`` of every text, whole; null and texts of white space have 0.

    Words are what ASCII white space separates, as it stands, each with the start mark in front. Scores are those
    of the vocabulary by rank. Repeated rows are counted each; further columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, scores = read_pieces(vocabulary)
        lookup, logs = Lookup(pieces), rank_probabilities(scores)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1), 4 << 20):
                starts, ends, first = word_spans(data, offsets, NOT_SPACE)
                if len(starts):
                    _, at, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
                    text = data.tobytes()
                    numbers = best_counts(lookup, logs, [text[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
                    sums = np.concatenate([[0], np.cumsum(numbers[inverse])])
                else:
                    sums = np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(sums[first[1:]] - sums[first[:-1]], pa.int64())],
                    ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, COUNTED)
