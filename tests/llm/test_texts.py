"""Decontamination, packing, language, token counts and lattice scores against plain versions."""

import math
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codelattice.llm import decontaminate, langid, lattice, packing, subwords, tokens, trie_counts
from codelattice.llm.common import crc_mod, span_hashes, table, text_chunks, word_spans
from codelattice.llm.queries import PACK_VOCABULARY, PIECE_VOCABULARY, QUERIES, vocabulary
from tests.llm import brute
from tests.llm.conftest import messy_rows, prose

SF = "/root/testdata/sf0.001"
ITEMS = [(1, " ".join(prose(1, 120).split()[20:50])), (10, "One two"), (2, None), (3, ""), (4, "..."), (None, prose(5, 30000)[:200]), (11, prose(2, 13)), (11, prose(2, 13))]


def test_words_of_many_texts_are_those_of_each():
    texts = ["Ab cd", "", "é-É 12", None, "ab"]
    for lo, hi, data, offsets in text_chunks(pa.array(texts)):
        low = np.frombuffer(data.tobytes().lower(), np.uint8)
        starts, ends, first = word_spans(low, offsets)
        assert (lo, hi, np.diff(first).tolist()) == (0, 5, [2, 0, 3, 0, 1])
        hashes = span_hashes(low, starts, ends)
        assert hashes[0] == hashes[-1] and len(set(hashes.tolist())) == 5
    assert [(a, b) for a, b, _, _ in text_chunks(pa.array(["aa", "bbbbbb", "c"]), 3)] == [(0, 1), (1, 2), (2, 3)]
    assert list(text_chunks(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("block", [32_000_000, 200])
def test_contamination(spark, messy, block):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    hits = decontaminate.benchmark_hits(messy.dropDuplicates(["doc_id"]), bench, block_bytes=block).withColumn("n_hit", decontaminate.n_hit())
    got = {r.doc_id: (r.n_words, r.n_hit) for r in hits.collect()}
    report = decontaminate.decontamination_report(messy, bench)
    named = list(dict.fromkeys(x for x in ITEMS if x[0] is not None))
    rows = report.collect()
    assert len(rows) == messy.count()
    texts = {r[0]: r[1] for r in messy_rows()}
    for r in rows:
        n, hit, found, digest, _ = brute.contamination(texts[r.doc_id], named)
        all_hit = brute.contamination(texts[r.doc_id], ITEMS)[1]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, all_hit, found, digest), r
        assert r.contaminated == (all_hit > 0 and 20 * all_hit >= n)
        assert got[r.doc_id] == (n, all_hit)
    bad = {r.doc_id for r in rows if r.contaminated}
    left = decontaminate.remove_documents(messy, bench)
    assert left.columns == messy.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in rows} - bad | {None}
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(messy, bench).collect()}
    assert cut[8] == "" and cut[3] is None and cut[0] != texts[0] and cut[14] == texts[14]


def test_contamination_is_of_rows_whatever_their_ids(spark, messy):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = messy.unionByName(spark.createDataFrame([(None, "One two"), (None, None), (0, "a clean text"), (None, "clean")], "doc_id long, text string"), allowMissingColumns=True)
    one, many = (Counter(map(str, decontaminate.benchmark_hits(docs, bench, block_bytes=b).collect())) for b in (32_000_000, 200))
    assert one == many and sum(one.values()) == docs.count()
    named = decontaminate.remove_documents(docs, bench).where("text in ('a clean text', 'clean')")
    assert sorted(r.text for r in named.collect()) == ["a clean text", "clean"]
    left = decontaminate.remove_documents(docs, bench, unnamed=True).where("doc_id is null").collect()
    assert Counter(r.text for r in left) == Counter([None, "clean"])
    cut = [r.text for r in decontaminate.remove_spans(docs, bench).where("doc_id = 0").collect()]
    assert len(cut) == 4 and cut.count("a clean text") == 1


def test_windows_take_a_few_bytes_for_each_word():
    words = [f"w{k * 7919 % 30011}" for k in range(800_000)]
    items = [(str(k), " ".join(words[k : k + 400])) for k in range(0, len(words), 400)]
    assert len(pickle.dumps(decontaminate.Windows(items))) < 8 * sum(len(t) for _, t in items)


def test_windows_that_items_share():
    shared = " ".join(f"s{k}" for k in range(13))
    items = [("a", f"x {shared} y"), ("b", f"{shared} z {shared}"), (None, shared), ("c", "one two"), ("d", "ONE two"), ("e", ""), ("f", None), ("c", "one two")]
    windows = decontaminate.Windows(items)
    data = np.frombuffer(f"q {shared} one two".encode(), np.uint8)
    starts, ends, first = word_spans(data, np.array([0, len(data)]))
    assert sorted((k, size, sorted(map(str, found))) for k, size, found in windows.scan(data, starts, ends, first)) == [(1, 13, ["None", "a", "b"]), (14, 2, ["c", "c", "d"])]


def test_contamination_of_nothing(spark, messy, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontamination_report(nothing, none).count() == 0
    assert decontaminate.decontamination_report(messy, none).where("n_hit > 0 or contaminated").count() == 0


def test_tokens_are_the_tokenizers():
    encoder = tokens.Encoder.of(vocabulary(PACK_VOCABULARY))
    texts = [r[1] or "" for r in messy_rows()] + [
        "Ça n'est PAS ÉTÉ 3.14 «foo» it's I'LL x² — naïve÷x ×É", "<|endoftext|> a", "é İstanbul ΣΑΣ", "áb!! c--d... ß ÿ Ÿ it''s 'd", "abc123 123abc a.b.c"]
    for lo, hi, raw, offsets in text_chunks(pa.array(texts)):
        flat, bounds = encoder.encode(raw, offsets)
        for k in range(lo, hi):
            assert flat[bounds[k - lo] : bounds[k - lo + 1]].tolist() == encoder.tokenizer.encode(texts[k], add_special_tokens=False).ids


def _check_packing(rows, docs, capacity):
    encoder = tokens.Encoder.of(vocabulary(PACK_VOCABULARY))
    want = Counter()
    for doc, text in docs:
        ids = np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[doc, n, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in rows) // capacity)


def test_packing_is_an_exact_round_trip(spark, messy, nothing):
    path = vocabulary(PACK_VOCABULARY)
    used, least = _check_packing(packing.packed(messy, path).collect(), [(r[0], r[1]) for r in messy_rows()], 2048)
    assert used <= least + 1
    docs = spark.createDataFrame([(k, prose(k, 5 + k % 90)) for k in range(300)], "doc_id long, text string")
    pieces = packing.cut_pieces(docs, path, 128)
    used, least = _check_packing(packing.pack_pieces(pieces, 128, group=40).collect(), [tuple(r) for r in docs.collect()], 128)
    assert used <= 1.02 * least + 1
    assert packing.packed(nothing, path).count() == 0


def _searched(lengths, capacity):
    bins = packing.Bins(np.array(lengths), capacity)
    bins.best_fit()
    before = [list(x) for x in bins.items]
    bins.local_search()
    after = [x for x in bins.items if x]
    squares = [sum(sum(lengths[i] for i in x) ** 2 for x in b) for b in (before, after)]
    assert sorted(i for x in after for i in x) == list(range(len(lengths))) and squares[1] >= squares[0]
    assert all(sum(lengths[i] for i in x) <= capacity for x in after) and len(after) <= len(before)
    return len(before) - len(after), squares[1] > squares[0]


def test_local_search_only_improves():
    assert _searched([510] * 6 + [270] * 6 + [260] * 6 + [230] * 12, 1000)[0] >= 1
    found = [_searched([rng.randint(20, 45) for _ in range(40)], 100) for rng in map(random.Random, range(200))]
    assert sum(fewer for fewer, _ in found) and sum(fuller for _, fuller in found) > 20


def test_local_search_goes_on_past_stuck_and_emptied_bins():
    rng = random.Random(1)
    assert _searched([rng.randint(300, 1100) for _ in range(4000)], 2048)[0] >= 12


def test_exchanges_reach_every_bin():
    bins = packing.Bins(np.array([600, 300] + [850] * 200 + [290, 650]), 1000)
    bins.items = [[0, 1], *[[k] for k in range(2, 202)], [202, 203]]
    for b in range(202):
        bins.free.append(0)
        bins._set(b, 1000 - sum(bins.lengths[i] for i in bins.items[b]))
    assert bins._improve_anywhere(0) and bins.free[0] == 110 and bins.free[201] == 50


def test_codewords_differ():
    for n in (2, 3, 4, 7, 8, 20):
        codes = langid.codewords(n)
        assert min((codes[i] != codes[j]).sum() for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)
        assert len(codes) == n and (n > 7 or codes.shape[1] == 2 ** (n - 1) - 1)


def test_language_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op3_language"](spark, folder).join(table(spark, folder, "documents").select("doc_id", "lang", "n_chars"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_language_of_odd_texts(spark, messy, nothing):
    model = langid.train(messy)
    got = {r.doc_id: r for r in langid.identify(messy, model).collect()}
    assert langid.identify(messy, model).count() == messy.count()
    for k in (3, 4, 5, 6, 17):
        assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
    assert got[18].lang_pred in ("en", "fr")
    kept = langid.in_a_language(messy, model)
    assert kept.columns == messy.columns and {r.doc_id for r in kept.collect()} == set(range(22)) - {3, 4, 5, 6, 7, 17} | {None}
    assert langid.train(nothing) is None and langid.identify(nothing, None).count() == 0
    assert {r.lang_pred for r in langid.identify(messy, None).collect()} == {"und"}


def test_noise_is_in_no_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    noise = ["@@@ ### 12 x 99 ====", "12 34 !!?? -- 56 %% ## a", "x, " + "[47] 11; " * 5000, "<<<>>> {} [] é" + " ;;" * 40, None, "", "..."]
    more = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(noise)], "doc_id long, text string")
    kept = langid.in_a_language(docs.unionByName(more, allowMissingColumns=True), langid.train(docs))
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0 and kept.count() == docs.count()
    assert {r.doc_id for r in langid.in_a_language(more, None).collect()} == {-1, -2, -3, -4}


def test_close_languages_are_flagged():
    model = langid.fit([("aaaa bbbb", "x"), ("cccc dddd", "y")], margin=0.2)
    texts = pa.array(["aaaa", "cccc", "zzzz"])
    for _, _, data, offsets in text_chunks(texts):
        best, _, close = model.decode(model.margins(data, offsets))
        assert best.tolist()[:2] == [0, 1] and close.tolist() == [False, False, True]


PIECES = ["▁", "▁a", "a", "b", "ab", "▁ab", "bb", "abb"]


def test_marginal_is_the_sum_over_spellings():
    logs = np.log(np.arange(1.0, len(PIECES) + 2) / 50)
    lookup = subwords.Lookup(PIECES)
    words = ["a", "ab", "abb", "bbab", "babab", "aé", "", "a" * 40]
    got = lattice.marginals(lookup, np.stack([logs, 2 * logs], axis=1), words)
    count = lattice.expected_counts(lookup, logs, words[:5], np.array([1.0, 2, 3, 4, 5]))
    want = np.zeros(len(PIECES) + 1)
    for k, w in enumerate(words[:5]):
        for column in (0, 1):
            each = [(sum(logs[PIECES.index(p)] for p in s), s) for s in brute.spellings("▁" + w, PIECES)]
            assert math.isclose(got[k, column], math.log(sum(math.exp((column + 1) * x) for x, _ in each)), abs_tol=1e-9)
        whole = sum(math.exp(x) for x, _ in each)
        for x, s in each:
            for p in s:
                want[PIECES.index(p)] += (k + 1) * math.exp(x) / whole
    assert np.allclose(count, want)
    assert math.isclose(got[5, 0], math.log(math.exp(logs[1]) + math.exp(logs[0] + logs[2])) + 2 * logs[-1], abs_tol=1e-9)


def _base(rows, held):
    tokens = lambda t: "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in (t or "").translate(brute.LOWER)).split(" ")
    tokens = lambda t, f=tokens: [w for w in f(t) if w] + ["\0end"]
    counts = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return n, {(d, t): (len(tokens(t)), sum(w in counts for w in tokens(t)), sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for d, t in rows}


def test_all_components_are_fitted_in_one_pass():
    """op4's time: each component had a pass of its own over each batch of words."""
    pieces = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "bab"]
    lookup = subwords.Lookup(pieces)
    logs = np.log(np.random.default_rng(3).dirichlet(np.ones(len(pieces) + 1), 3).T)
    words = ["ab", "bab", "aéb", "abab", "b", "ab", "baba", "x" * 40]
    component = np.array([0, 1, 2, 0, 1, 2, 2, 1])
    counts = np.arange(1.0, len(words) + 1)
    got = lattice.expected_counts(lookup, logs, words, counts, component)
    for k in range(3):
        own = np.flatnonzero(component == k)
        assert np.allclose(got[:, k], lattice.expected_counts(lookup, logs[:, k], [words[i] for i in own], counts[own]))
    assert len(list(subwords.by_length(["ab"] * 10, 9))) == 4  # three words of three characters at a time


def test_lattice_scores(spark, messy, nothing):
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    docs = messy.where("doc_id is not null")
    got = lattice.score_documents(docs, crc_mod("doc_id", 5) != 1, vocabulary(PIECE_VOCABULARY), rounds=1).collect()
    rows = [(r[0], r[1]) for r in messy_rows() if r[0] is not None]
    n, want = _base(rows, held)
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        length, known, base = want[r.doc_id, texts[r.doc_id]]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (length, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert lattice.score_documents(nothing, F.lit(True), vocabulary(PIECE_VOCABULARY), rounds=1).count() == 0
    alone = lattice.score_documents(messy, F.lit(False), vocabulary(PIECE_VOCABULARY)).collect()
    assert len(alone) == messy.count() and all(r.n_known == 0 and math.isfinite(r.score) for r in alone)


def test_lattice_beats_the_base_on_held_out_texts(spark):
    sums = QUERIES["op4_lattice_score"](spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]


def test_token_counts_are_those_of_the_best_spelling(spark, messy, nothing):
    from tokenizers import Tokenizer, models

    path = vocabulary(PIECE_VOCABULARY)
    pieces, scores = subwords.read_pieces(path)
    logs = subwords.rank_probabilities(scores)
    vocab = [("<unk>", 0.0), *zip(pieces, logs[:-1].tolist(), strict=True), *((f"<0x{b:02X}>", float(logs[-1])) for b in range(256))]
    plain = Tokenizer(models.Unigram(vocab, 0, True))
    got = trie_counts.count_tokens(messy, path).collect()
    texts = {r[0]: r[1] for r in messy_rows()}
    assert len(got) == messy.count()
    for r in got:
        if r.doc_id in (13, 14):
            continue
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in texts[r.doc_id] or "").split(" ") if w]
        assert (r.n_words, r.n_tokens) == (len(words), sum(len(plain.encode("▁" + w).ids) for w in words)), r
    assert trie_counts.count_tokens(nothing, path).count() == 0


def test_trie_shares_prefixes_and_breaks_ties():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba"]
    logs = -np.array([1.0, 1, 1, 2, 2, 2, 9])
    words = ["ab", "aba", "abab", "b", "", "ab", "z", "é" * 3]
    want = []
    for w in words:
        found = [(sum(logs[pieces.index(p)] for p in s), -len(s)) for s in brute.spellings("▁" + w, pieces)]
        want.append(-max(found)[1] if found else None)
    got = trie_counts.best_counts(subwords.Lookup(pieces), logs, words).tolist()
    assert got[:6] == want[:6] and got[6:] == [2, 7]


def test_texts_of_numbers_and_few_words_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = ["36.128.82.53 Ount of +1 (748) 555-8257 ennt wh.", "Ntst of at 32.70.47.86 4534389088205400 esanre +1 (352) 555-5947 to.", "On 4942399381559813 91.96.62.88 the"]
    few = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    assert langid.in_a_language(few, langid.train(docs)).count() == len(texts)


def test_half_noise_needs_a_codeword_that_fits(spark):
    model = langid.fit([("aaaa bbbb", "x"), ("cccc dddd", "y")], margin=0.2)
    texts = ["aaaa" + "!" * 7, "zzzz" + "!" * 7, "zzzz!", "aaaa" + "!" * 20]
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    assert model.floor == 0.25 and {r.doc_id for r in langid.in_a_language(docs, model).collect()} == {0, 2}


def test_bins_of_many_items_give_back_pairs():
    """A bin of more than 24 items used to offer single ones only."""
    for improve in ("_improve_anywhere", "_improve"):
        bins = packing.Bins(np.array([7] + [3] * 30), 91)
        bins.items, bins.free, bins.order = [[0], list(range(1, 31))], [84, 1], [(1, 1), (84, 0)]
        assert getattr(bins, improve)(0, *([[1]] if improve == "_improve" else []))
        assert bins.free == [85, 0] and sorted(map(len, bins.items)) == [2, 29]


def test_language_is_learned_from_all_labelled_texts(spark):
    """The classifiers used to see some 400 texts of a language, and none of more than 20,000 characters."""
    rng = np.random.default_rng(5)
    rows = [("".join(rng.choice(list("abc de"), 30)), "x") for _ in range(900)] + [("".join(rng.choice(list("fgh ij"), 40)), "y") for _ in range(20)]
    rows += [("zett " * 5000, "long"), ("!!", "x"), (None, "x"), ("kkk", None)]
    docs = spark.createDataFrame([(k % 7, *row) for k, row in enumerate(rows)], "doc_id long, text string, lang string")
    model, want = langid.train(docs), langid.fit([r for r in rows[:-3]])
    assert model.languages == ["long", "x", "y"] and (model.weights == want.weights).all() and model.floor == want.floor


def test_floor_is_a_quantile_of_all_texts():
    texts = ["a" * k + "!" * (500 - k) for k in range(1, 500)]
    model = langid.fit([(t, "x") for t in texts])
    assert abs(model.floor - langid.FLOOR * np.quantile([k / 500 for k in range(1, 500)], 0.01)) < 1e-5


def test_counts_of_many_languages_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD", 2)
    rows = [(f"{chr(97 + k % 5) * 9} w{k}", f"l{k % 5}") for k in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    assert (langid.train(docs).weights == langid.fit(rows).weights).all()
