"""Document probability under a subword lattice.

A word's lattice probability is the sum over all ways to spell it with pieces of an existing vocabulary, by a
forward recursion in logarithms. The weights of the pieces start from the ranks of the vocabulary's scores and are
fitted to the different words of the training documents by expectation and maximisation. A word seen in training
has one edge more, from its begin to its end, with its share of the training tokens. There is a set of weights for
each language of the training documents; a text's probability is the sum over these too, so no label is read when
a text is scored. Spellings and edges of one set sum to one over all words and the end of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import SMALL_CHUNK, span_hashes, text_chunks, word_spans, written
from codelattice.llm.subwords import Lookup, by_length, edges, rank_probabilities, read_pieces, utf8_sizes
from codelattice.llm.tokens import _ASCII_LOWER, NOT_SPACE

ROUNDS = 3
SMOOTHING = 0.1  # added to the expected count of each piece
FREQUENT = 1_000_000  # words with more than this part of all tokens are sent to every task, so at most that many are
WORDS_AT_ONCE = 100_000  # rows of the word table that one pass works on
EDGE_CELLS = 1 << 17  # characters whose edges are kept at once
COMPONENTS = 8  # languages with weights of their own, by number of documents; the others share one set
SHARES = (0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5, 0.7, 0.95)  # tried for the lattice


def _words(raw: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, starts, ends, first word of each text, hashes."""
    data = _ASCII_LOWER[raw]
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    return data, starts, ends, first, span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    text = data.tobytes()
    return [text[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        component = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, raw, offsets in text_chunks(batch.column(0), 4 << 20):
            data, starts, ends, first, hashes = _words(raw, offsets)
            own = np.repeat(component[lo:hi], np.diff(first))
            order = np.lexsort((own, hashes))
            own, hashes = own[order], hashes[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[at].view(np.int64)), pa.array(_spelled(data, starts[order[at]], ends[order[at]]), pa.string()), pa.array(own[at].astype(np.int32)),
                 pa.array(np.diff(np.concatenate([at, [len(own)]])), pa.int64())],
                ["hash", "word", "component", "n"])


def word_counts(texts: DataFrame, components: int) -> DataFrame:
    """``hash``, ``word`` and its counts ``c0``, ``c1`` … by component, for all words of ``texts``.

    ``texts`` has ``text`` and ``component``; -1 marks texts that are not learned from, whose words come with
    no count. Words are told apart by a hash of 64 bits.
    """
    found = texts.select("text", "component").mapInArrow(_count, "hash long, word string, component int, n long")
    return found.groupBy("hash").agg(
        F.min("word").alias("word"), *[F.sum(F.when(F.col("component") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(components)])


def _bulk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= WORDS_AT_ONCE:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _add(total: np.ndarray, at: np.ndarray, more: np.ndarray) -> None:
    total[at] = np.logaddexp(total[at], more)


def marginals(lookup: Lookup, logs: np.ndarray, words: list[str]) -> np.ndarray:
    """Natural logarithm of each word's probability over all its spellings, one column for each column of ``logs``."""
    out = np.zeros((len(words), logs.shape[1]))
    for where, codes in by_length(words, EDGE_CELLS):
        width = codes.shape[1]
        forward = np.full((width + 1, len(codes), logs.shape[1]), -np.inf)
        forward[0] = 0
        sizes = utf8_sizes(codes)
        for begin, end, rows, numbers in edges(lookup, codes):
            weight = logs[numbers]
            byte = np.flatnonzero(numbers == lookup.size)
            if len(byte):
                weight[byte] *= sizes[rows[byte], begin][:, None]
            _add(forward[end], rows, forward[begin][rows] + weight)
        out[where] = forward[width]
    return out


def expected_counts(lookup: Lookup, logs: np.ndarray, words: list[str], counts: np.ndarray, component: np.ndarray | None = None) -> np.ndarray:
    """How often each piece is expected in ``words``, weighted with their ``counts``, by forward and backward sums.

    With ``component`` ``logs`` has a column for each component and so has the result; each word is spelled with its own component's.
    """
    if component is None:
        return expected_counts(lookup, logs[:, None], words, counts, np.zeros(len(words), np.int64))[:, 0]
    kinds = logs.shape[1]
    flat = np.ascontiguousarray(logs).ravel()
    total = np.zeros((lookup.size + 1) * kinds)
    for where, codes in by_length(words, EDGE_CELLS):
        width = codes.shape[1]
        sizes, own, n = utf8_sizes(codes), component[where], counts[where]
        forward = np.full((width + 1, len(codes)), -np.inf)
        forward[0] = 0
        backward = np.full((width + 1, len(codes)), -np.inf)
        backward[width] = 0
        kept = []
        for begin, end, rows, numbers in edges(lookup, codes):
            times = np.where(numbers == lookup.size, sizes[rows, begin], 1)
            spot = numbers * kinds + own[rows]
            weight = flat[spot] * times
            _add(forward[end], rows, forward[begin, rows] + weight)
            kept.append((begin, end, rows, spot, times, weight))
        for begin, end, rows, _, _, weight in sorted(kept, key=lambda e: -e[1]):
            _add(backward[begin], rows, backward[end, rows] + weight)
        spots, shares = [], []
        for begin, end, rows, spot, times, weight in kept:
            spots.append(spot)
            shares.append(np.exp(forward[begin, rows] + weight + backward[end, rows] - forward[width, rows]) * n[rows] * times)
        total += np.bincount(np.concatenate(spots), np.concatenate(shares), minlength=len(total))
    return total.reshape(-1, kinds)


def spelled(logs: np.ndarray) -> np.ndarray:
    """Weights for a lattice: a byte's share, the last row, is spread evenly over the 256 bytes."""
    logs = logs.copy()
    logs[-1] -= np.log(256.0)
    return logs


def fit(words: DataFrame, components: int, vocabulary: str, rounds: int = ROUNDS) -> np.ndarray:
    """Logarithms of the pieces' weights, one column per component, fitted to all its different words.

    Each round sends the weights, a number for each piece and component, to the tasks and adds up what they expect.
    """
    pieces, scores = read_pieces(vocabulary)
    lookup = Lookup(pieces)
    logs = np.repeat(rank_probabilities(scores)[:, None], components, axis=1)
    for _ in range(rounds):

        def expect(frames: Iterator[pd.DataFrame], logs: np.ndarray = spelled(logs)) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(pieces) + 1, components))
            for frame in _bulk(frames):
                seen, component = np.nonzero(frame[[f"c{k}" for k in range(components)]].to_numpy() > 0)
                total += expected_counts(lookup, logs, frame["word"].to_numpy()[seen].tolist(), np.ones(len(seen)), component)
            piece, k = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "component": k, "n": total[piece, k]})

        parts = words.drop("hash").mapInPandas(expect, "piece long, component long, n double")
        total = np.full(logs.shape, SMOOTHING)
        for r in parts.groupBy("piece", "component").agg(F.sum("n").alias("n")).collect():  # a row for each weight
            total[r["piece"], r["component"]] += r["n"]
        logs = np.log(total / total.sum(axis=0))
    return logs


def with_lattice(words: DataFrame, components: int, vocabulary: str, logs: np.ndarray) -> DataFrame:
    """``words`` with ``l0``, ``l1`` …: each word's lattice probability under each component, in logarithms."""
    pieces, _ = read_pieces(vocabulary)
    lookup, logs = Lookup(pieces), spelled(logs)
    names = [f"l{k}" for k in range(components)]
    counts = [f"c{k}" for k in range(components)]

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _bulk(frames):
            out = frame[["hash", *counts]].copy()
            out[names] = marginals(lookup, logs, frame["word"].tolist())
            yield out

    schema = ", ".join(["hash long", *[f"{c} long" for c in counts], *[f"{n} double" for n in names]])
    return words.select("hash", "word", *counts).mapInPandas(score, schema)


def lattice_shares(words: DataFrame, totals: list[int]) -> list[float]:
    """For each component, the share of the lattice among :data:`SHARES` that makes its training words likeliest.

    Each word is judged by the counts without one occurrence of its own.
    """
    asked = []
    for k, n in enumerate(totals):
        c = F.col(f"c{k}")
        for share in SHARES:
            left = (c - 1) / F.lit(float(max(1, n - 1)))
            asked.append(F.coalesce(F.sum(F.when(c > 0, c * F.log((1 - share) * left + share * F.exp(f"l{k}") + F.lit(1e-300)))), F.lit(0.0)))
    found = list(words.agg(*[x.alias(f"x{i}") for i, x in enumerate(asked)]).first())
    width = len(SHARES)
    return [SHARES[int(np.argmax(found[k * width : (k + 1) * width]))] for k in range(len(totals))]


def _per_document(frequent: np.ndarray, values: np.ndarray):
    """Tokens of each text, and what its frequent words add up to; the number of its other words."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in text_chunks(batch.column(2), SMALL_CHUNK):
                _, _, _, first, hashes = _words(raw, offsets)
                spot = np.minimum(np.searchsorted(frequent, hashes), max(0, len(frequent) - 1))
                often = frequent[spot] == hashes if len(frequent) else np.zeros(len(hashes), bool)
                sums = np.zeros((hi - lo, values.shape[1]))
                others = np.zeros(hi - lo, np.int64)
                for k in np.flatnonzero(np.diff(first)):  # one text at a time, so that its sum does not depend on others
                    a, b = first[k], first[k + 1]
                    mine = often[a:b]
                    sums[k] = values[spot[a:b][mine]].sum(axis=0)
                    others[k] = b - a - int(mine.sum())
                columns = [pa.array(sums[:, j]) for j in range(values.shape[1])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(first) + 1, pa.int64()), pa.array(others), *columns],
                    ["doc_id", "row", "n_tokens", "others", *[f"s{j}" for j in range(values.shape[1])]])

    return score


def _other_words(frequent: np.ndarray):
    """The words of each text that are not frequent, by hash, with their number in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, raw, offsets in text_chunks(batch.column(2), SMALL_CHUNK):
                _, _, _, first, hashes = _words(raw, offsets)
                text = np.repeat(np.arange(hi - lo), np.diff(first))
                if len(frequent) and len(hashes):
                    spot = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
                    rare = frequent[spot] != hashes
                    text, hashes = text[rare], hashes[rare]
                order = np.lexsort((hashes, text))
                text, hashes = text[order], hashes[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
                at = np.flatnonzero(new)
                n = np.diff(np.concatenate([at, [len(text)]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[at].view(np.int64)), pa.array(rows[lo + text[at]]), pa.array(n.astype(np.int32))], ["hash", "row", "n"])

    return run


def component_of(docs: DataFrame, training: Column) -> tuple[Column, int]:
    """Number of a training document's component, -1 for other documents; and how many components there are."""
    if "lang" not in docs.columns:
        return F.when(training, 0).otherwise(-1), 1
    top = docs.where(training & F.col("lang").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(COMPONENTS).collect()
    number = F.lit(0)  # of rarer languages, and of none
    for k, r in enumerate(top):
        number = F.when(F.col("lang") == r["lang"], k + 1).otherwise(number)
    return F.when(training, number).otherwise(-1), len(top) + 1


def score_documents(docs: DataFrame, training: Column, vocabulary: str, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """Every document of ``docs`` (``doc_id``, ``text``, maybe ``lang``) under the model learned from those that ``training`` picks.

    Returns ``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``, logarithms to
    base 10. Null is empty: one end. Without training documents counts are 0 and the weights are those of the
    vocabulary. Repeated rows are scored each; further columns are ignored.
    """
    number, components = component_of(docs, training)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), number.alias("component"))
    counts = [f"c{k}" for k in range(components)]
    words = written(word_counts(texts, components))
    ends = {r["component"]: r["n"] for r in texts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = words.agg(F.count_if(sum(F.col(c) for c in counts) > 0), *[F.coalesce(F.sum(c), F.lit(0)) for c in counts]).first()
    ends = [ends.get(k, 0) for k in range(components)]
    totals = [n + e for n, e in zip(of[1:], ends, strict=True)]
    n_texts, tokens, kinds = sum(ends), sum(totals), of[0] + (sum(ends) > 0)
    floor = float(np.log10(tokens + 0.5 * (kinds + 1)))

    logs = fit(words, components, vocabulary, rounds if n_texts else 0)
    spelt = written(with_lattice(words, components, vocabulary, logs))
    shares = lattice_shares(spelt, totals)
    used = [k for k in range(components) if totals[k]] or [0]
    c = sum(F.col(x) for x in counts)
    base = (F.log10(c + F.lit(0.5)) - F.lit(floor)).alias("s0")
    known = F.when(c > 0, 1.0).otherwise(0.0).alias("s1")
    per_word = [
        F.log10((1 - shares[k]) * F.col(f"c{k}") / F.lit(float(max(1, totals[k]))) + shares[k] * F.exp(f"l{k}") + F.lit(1e-300)).alias(f"s{j + 2}") for j, k in enumerate(used)]
    sums = [f"s{j}" for j in range(len(used) + 2)]
    priced = spelt.select("hash", c.alias("c"), base, known, *per_word)
    is_often = F.col("c") * F.lit(frequent) > F.lit(tokens)
    often = sorted((tuple(r) for r in priced.where(is_often).drop("c").collect()), key=lambda r: r[0] & (2**64 - 1))  # fewer than ``frequent``
    keys = np.array([r[0] & (2**64 - 1) for r in often], np.uint64)
    values = np.array([r[1:] for r in often], float).reshape(len(often), len(sums))

    head = ", ".join(f"{s} double" for s in sums)
    per_text = texts.select("doc_id", "row", "text").mapInArrow(_per_document(keys, values), f"doc_id long, row long, n_tokens long, others long, {head}")
    rare = texts.select("doc_id", "row", "text").mapInArrow(_other_words(keys), "hash long, row long, n int")
    met = rare.join(priced.where(~is_often).drop("c"), "hash")
    rest = met.groupBy("row").agg(F.sum("n").alias("rows_n"), *[F.sum(F.col("n") * F.col(s)).alias(f"rows_{s}") for s in sums])
    both = per_text.join(rest, "row", "left")
    # rows that are repeated were added up together
    times = F.when(F.col("others") > 0, F.col("rows_n") / F.col("others")).otherwise(F.lit(1.0))
    total = {s: F.col(s) + F.coalesce(F.col(f"rows_{s}") / times, F.lit(0.0)) for s in sums}
    likely = []
    for j, k in enumerate(used):
        prior = np.log10(totals[k] / tokens) if tokens else 0.0
        end = np.log10((1 - shares[k]) * ends[k] / totals[k]) if ends[k] else -np.log10(2.0)
        likely.append(total[f"s{j + 2}"] + F.lit(float(prior + end)))
    top = F.greatest(*likely) if len(likely) > 1 else likely[0]
    score = top + F.log10(sum(F.pow(F.lit(10.0), x - top) for x in likely))
    return both.select(
        "doc_id", "n_tokens", (F.round(total["s1"]).cast("long") + F.lit(int(n_texts > 0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (total["s0"] + F.lit(float(np.log10(n_texts + 0.5)) - floor)).alias("base_score"), score.alias("score"))
