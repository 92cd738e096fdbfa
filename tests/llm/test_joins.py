"""Repeats, near duplicates, top-k, main text and URL filters against plain versions."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelattice.llm import bwt_dedup, chosen_path, common, content, fagin, urlmodel
from codelattice.llm.queries import QUERIES, URL_RULES
from tests.llm import brute
from tests.llm.conftest import messy_rows, prose


def test_merged_transforms_find_all_repeats():
    rng = random.Random(5)
    for alphabet, length in (("ab", 8), ("abcdefgh", 12), ("a", 10), ("abcdefghijklmnopqrstuvwxyz é", 100)):
        passage = "".join(rng.choice(alphabet) for _ in range(300)).encode()
        pieces = [passage[rng.randrange(150) :][: rng.randrange(1, 200)] + "".join(rng.choice(alphabet) for _ in range(rng.randrange(60))).encode() for _ in range(40)]
        seen, want = set(), []
        for p in pieces:
            flags = [False] * len(p)
            for k in range(len(p) - length + 1):
                flags[k] = p[k : k + length] in seen
                seen.add(p[k : k + length])
            want.append(flags)
        for shard in (200, 1000, 1 << 20):
            assert [x.tolist() for x in bwt_dedup.repeated_starts(pieces, length, shard)] == want


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats(messy, nothing, monkeypatch, hot):
    monkeypatch.setattr(bwt_dedup, "HOT", hot)
    named = [(r[0], r[1]) for r in messy_rows() if r[0] is not None]
    want = brute.repeats(dict(named).items())
    got = bwt_dedup.dedup_report(messy).collect()
    assert len(got) == messy.count()
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert tuple(r)[1:] == want[r.doc_id], r.doc_id
    cut = bwt_dedup.without_repeats(messy)
    assert cut.columns == messy.columns and cut.count() == messy.count()
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[1] == "" and texts[3] is None and texts[0] == dict(named)[0]
    assert bwt_dedup.dedup_report(nothing).count() == 0


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    a, b = "".join(random.Random(1).choices("abcdefgh", k=400)), prose(77, 200)[:400]
    docs = spark.createDataFrame([(1, a, "x"), (2, a, "y"), (2, b, "z"), (2, b, "z"), (3, prose(78, 30) + b, "w")], "doc_id long, text string, row string")
    kept = bwt_dedup.without_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.row) for r in kept.collect()) == sorted([(1, a, "x"), (2, "", "y"), (2, b, "z"), (2, b, "z"), (3, prose(78, 30), "w")])
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in bwt_dedup.dedup_report(docs).collect()) == [(1, 400, 0), (2, 400, 0), (2, 400, 0), (2, 400, 400), (3, len(prose(78, 30)) + 400, 400)]


def test_slices_of_long_texts_overlap(messy, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "SLICE", 1 << 12)
    named = dict((r[0], r[1]) for r in messy_rows() if r[0] is not None)
    monkeypatch.setattr(bwt_dedup, "CHUNK", 1 << 12)
    want = brute.repeats(named.items())
    assert {r.doc_id: tuple(r)[1:] for r in bwt_dedup.dedup_report(messy.where("doc_id is not null")).collect()} == want


@pytest.mark.parametrize("hot", [4096, 20, 2])
def test_a_passage_in_most_texts_is_merged_in_full_buckets(spark, monkeypatch, hot):
    monkeypatch.setattr(bwt_dedup, "HOT", hot)
    monkeypatch.setattr(bwt_dedup, "BUCKET_BYTES", 1 << 11)
    monkeypatch.setattr(bwt_dedup, "FLUSH_BYTES", 1 << 13)
    monkeypatch.setattr(bwt_dedup, "TASK_BYTES", 1 << 15)
    rng = random.Random(4)
    shared = ["".join(rng.choices("abcde ", k=n)) for n in (90, 104, 130, 260)]  # the first is shorter than a string
    rows = [(n, "".join(rng.choices("xyz", k=rng.randrange(3))) + rng.choice("qrst") * 3 + rng.choice(shared) + "".join(rng.choices("uvw", k=rng.randrange(4)))) for n in range(150)]
    rows += [(200 + n, "ab" * n + shared[3] * 2) for n in range(5)] + [(300, rows[0][1])]
    docs = spark.createDataFrame(rows + rows[:10], "doc_id long, text string").repartition(5)
    assert {r.doc_id: tuple(r)[1:] for r in bwt_dedup.dedup_report(docs).collect()} == brute.repeats(rows)


def test_near_duplicates(messy, nothing):
    got = chosen_path.jaccard_join(messy).collect()
    assert len(got) == messy.count()
    want = brute.near_duplicates({r[0]: r[1] for r in messy_rows() if r[0] is not None and r[1] is not None}.items())
    for r in got:
        if r.doc_id is not None:
            assert tuple(r)[1:] == want.get(r.doc_id, (r.doc_id, r.doc_id, 0)), r
    kept = chosen_path.one_of_each(messy)
    assert kept.columns == messy.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({c for c, _, _ in want.values()} | {3, None})
    assert chosen_path.jaccard_join(nothing).count() == 0 and chosen_path.one_of_each(nothing).count() == 0


def test_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BUCKET", 16)
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    rows, base, common = [], prose(9, 80).split(), prose(10, 12)
    for k in range(120):
        words = list(base)
        for at in random.Random(k).sample(range(80), k % 4):
            words[at] = f"w{k}x{at}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, common + " " + prose(100 + k, 20 + k % 9)) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in chosen_path.jaccard_join(docs).collect()} == brute.near_duplicates(rows)


def test_large_buckets_are_split_until_they_are_small(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BUCKET", 16)
    rows, common = [], prose(10, 25)
    for k in range(300):  # near copies of one text; texts that share a passage
        words = prose(9, 80).split()
        words[k % 80] = f"w{k}"
        rows += [(k, " ".join(words)), (1000 + k, common + " " + prose(100 + k, 60))]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    sets = texts.mapInArrow(chosen_path._sets_of(5, 0.8, chosen_path.runs_for(0.999999)), chosen_path._SETS)
    buckets = [tuple(r) for r in chosen_path.buckets_of(sets.withColumnRenamed("doc_id", "rep"), texts, 5, 0.8).select("key", "rep").collect()]
    met = defaultdict(set)
    for key, rep in buckets:
        met[key].add(rep)
    assert max(map(len, met.values())) <= 4 * 16  # blocks are dealt by a hash, so their sizes vary
    assert {(a, b) for x in met.values() for a in x for b in x if a < b < 1000} == {(a, b) for b in range(300) for a in range(b)}


def test_near_duplicates_lose_no_link(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op9_near_duplicates"](spark, folder).collect()}
    assert got == brute.near_duplicates(rows)


def test_repeats_of_a_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op8_repeats"](spark, folder).collect()} == brute.repeats(rows)


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(10, 40)] + [(100, 3), (3, 7), (7, 100), (50, 50)], "a long, b long")
    got = {r.node: r.root for r in chosen_path.components(links).collect()}
    assert got == {k: 10 for k in range(10, 41)} | {100: 3, 3: 3, 7: 3}
    assert chosen_path.components(links.limit(0)).count() == 0


def test_threshold_search_stops_early_and_is_exact():
    rng = np.random.default_rng(3)
    for n, dims in ((1, 3), (40, 4), (3000, 3)):
        x = rng.integers(-20, 20, (n, dims))
        ids = rng.permutation(n).astype(np.int64)
        for q in (rng.integers(-20, 20, dims), np.zeros(dims, np.int64)):
            got = fagin.threshold_search(x, ids, q, int(ids[0]), 10)
            want = sorted(((-int(s), int(i)) for s, i in zip(x @ q, ids, strict=True) if i != ids[0]))[:10]
            assert got == [(-s, i) for s, i in want]


def test_top_k(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(4)
    rows = [(k, [rng.choice([-1.5, 0.0, 0.25, 0.2500001]) for _ in range(4)], "x") for k in range(230)]
    rows += [(300, None, "x"), (301, [0.1, None, 0.0, 0.0], "x"), (302, [nan, 0.0, 0.0, 0.0], None), (400, [inf, 0.0, 0.0, 0.0], "x"), (None, [9.0] * 4, "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    sound = [(k, [math.floor(1024 * float(np.float32(c))) for c in v]) for k, v, _ in rows[:230]]
    want = brute.top_k(sound, [(k, v) for k, v in sound if k % 100 == 0])
    for shard, block in ((8192, 1024), (32, 1)):
        got = defaultdict(list)
        for r in fagin.top_k(vectors, F.col("vec_id") % 100 == 0, shard=shard, block=block).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.rank, r.vec_id, r.score))
        assert got == want
    again = vectors.unionByName(vectors)
    assert fagin.top_k(again, F.col("vec_id") % 100 == 0).count() == 60
    assert fagin.top_k(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert fagin.top_k(vectors.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 100 == 0).count() == 2


ARTICLE = "<h1>A &amp; B</h1><p>First  long paragraph of\n the text, with <b>bold</b> words.<br><p>Second one.</p><p>X.</p>"
WANT = "A & B First long paragraph of the text, with bold words. Second one. X."
PAGES = {
    "article": f"<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><div class=ad>Buy now</div><article>{ARTICLE}</article><footer>End</footer>",
    "main": f"<body><header><h2>Site</h2></header><main>{ARTICLE}<aside>See also these other things here</aside><form>Mail <input></form></main><div id='comments'><p>A reader comment that is quite long, really, much longer than it should be.</p></div>",
    "marks": f"<body><div class='top-menu'><a>Home</a></div><div class='cookie-notice'>We use cookies on this page and say so at length.</div><article class='post'>{ARTICLE}</article><div class='sidebar'>Side text here</div>",
    "header of an article": f"<article><header><h1>A &amp; B</h1></header>{ARTICLE.split('</h1>')[1]}<section class=comments><article><p>Comment text is long and should not be there at all.</p></article></section></article>",
    "no article": f"<body><div><a href=1>One</a><a href=2>Two</a><a href=3>Three</a></div><div>{ARTICLE}</div><div><a href=4>Four</a></div>",
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    assert content.main_text(PAGES[name]) == WANT


LONG = "<p>" + "A paragraph of the story that goes on for quite some time. " * 4 + "</p>"
STORY = " ".join(["A paragraph of the story that goes on for quite some time."] * 4)
LINKS = "<ul><li><a href=1>One</a><li><a href=2>Two</a></ul>"
REGIONS = {
    "articles side by side": (f"<body><article><h2>One</h2>{LONG}</article><article><h2>Two</h2>{LONG}</article>", f"One {STORY} Two {STORY}"),
    "short article between": (f"<body><article>{LONG}</article><article><p>Brief.</p></article><article>{LONG}</article><article><p><a href=x>See more</a></article>", f"{STORY} Brief. {STORY}"),
    "main around an article": (f"<body><main><h1>Title</h1>{LONG}<article>{LONG}</article></main>", f"Title {STORY} {STORY}"),
    "text beside an article": (f"<body><article>{LONG}</article><div>{LONG}</div><div>Short</div>", f"{STORY} {STORY}"),
    "empty article": (f"<body><article><p>x</p></article><div>Menu</div><div>{LONG * 3}</div>", f"{STORY} {STORY} {STORY}"),
    "list and table": (f"<body>{LINKS}<div>{LONG}<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>{LONG}{LINKS}</div>{LINKS}", f"{STORY} a b c d {STORY}"),
}


@pytest.mark.parametrize("name", REGIONS)
def test_all_regions_of_text_stay(name):
    assert content.main_text(REGIONS[name][0]) == REGIONS[name][1]


def test_main_text_of_a_table(spark):
    odd = [None, "", "<", "plain text only", "<p>&#0;&bogus;&lt;</p>", "<nav>only a menu</nav>", "<div>" * 3000 + "deep", "<article>" + "<p>word</p>" * 20000 + "</article>"]
    pages = spark.createDataFrame([(k, "u", h, "t") for k, h in enumerate([*odd, odd[3]])] + [(None, None, None, None)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in content.extract(pages).collect()}
    assert content.extract(pages).count() == 10 and got[0] == got[1] == got[5] == got[None] == "" and got[3] == got[8] == "plain text only"
    assert got[6] == "deep" and got[7] == " ".join(["word"] * 20000)
    assert content.extract(pages.limit(0)).count() == 0


def test_ratios_fall_into_two_clusters():
    assert content.two_clusters(np.array([1.0, 1.2, 9.0, 8.0, 1.1])) == 8.0 and content.two_clusters(np.array([3.0, 3.0])) == 3.0
    flat = content.smoothed(np.full(9, 4.0))
    assert np.allclose(flat, 4) and len(content.smoothed(np.array([1.0, 2.0]))) == 2


URLS = [
    "http://Example.COM/en/1?x=/fr/", "https://www.example.com/en/2", "https://a.www.example.com/en/", "http://b.example.com/de/", "http://x.net/es/1", "http://x.net/fr", "http://x.net/fr/#a",
    "https://x.org/en/5", "https://notexample.org/", "http://x.com", "http://x.com:80/", "mailto:x", "", None, "http://", "http://h?q", "x://A.B#f", "http://Ä.com/é", "https://spam.org/en/1", "https://spam.org/en/1",
]


def _rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    return rest[:cut].translate(brute.LOWER), path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]


def _ratio(grams, counts):
    """Mean log ratio, by the recursion over contexts."""

    def p(gram, kind):
        if not gram:
            return 1 / (len(urlmodel.ALPHABET) + 1)
        n = sum(c[kind] for g, c in counts.items() if g.endswith(gram))
        after = defaultdict(int)
        for g, c in counts.items():
            tail = g[len(g) - len(gram) :]
            if tail[:-1] == gram[:-1]:
                after[tail[-1]] += c[kind]
        total, kinds = sum(after.values()), sum(v > 0 for v in after.values())
        return (n + kinds * p(gram[1:], kind)) / (total + kinds) if total else p(gram[1:], kind)

    return sum(math.log(p(g, "allow") / p(g, "block")) for g in grams) / len(grams) if grams else 0.0


def test_url_filter(spark):
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = urlmodel.judge(pages, URL_RULES).collect()
    assert len(got) == len(URLS)
    spelled, counts = {}, defaultdict(lambda: {"allow": 0, "block": 0})
    for k, u in enumerate(URLS):
        s = "".join(c if c in urlmodel.ALPHABET else urlmodel.OTHER for c in (u or "").lower().translate(str.maketrans("123456789", "0" * 9)))
        spelled[k] = [("^^^" + s)[i : i + 4] for i in range(len(s))]
        verdict = _rule(*_parts(u))[1]
        for g in spelled[k]:
            counts[g]["allow"] += verdict == "allow"
            counts[g]["block"] += verdict == "block"
    for r in got:
        host, path = _parts(URLS[r.page_id])
        rule, verdict = _rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
        assert math.isclose(r.score, _ratio(spelled[r.page_id], counts), abs_tol=1e-9)
    free = {v: [r.score for r in got if r.rule is None and r.verdict == v] for v in ("allow", "block")}
    assert free["block"] and max(free["block"]) < min(free["allow"], default=9)
    assert urlmodel.judge(pages.limit(0), URL_RULES).count() == 0
    assert urlmodel.judge(pages.where("page_id = 7"), URL_RULES).first().verdict == "allow"


def test_a_workers_memory_does_not_grow_with_the_bands_it_combines(monkeypatch):
    """The pipeline's ``repeats``: an index of 8 bytes for each byte of all bands took a worker over 100 MB."""
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 1 << 17).astype(np.uint8)
    first = rng.integers(0, len(data) - 600, 10_000)
    size = rng.integers(0, 600, 10_000)
    want = b"".join(data[a : a + n].tobytes() for a, n in zip(first.tolist(), size.tolist(), strict=True))
    for at_once in (1, 1000, bwt_dedup.GATHER_BYTES):
        monkeypatch.setattr(bwt_dedup, "GATHER_BYTES", at_once)
        assert bwt_dedup.gathered(data, first, size).tobytes() == want
    assert len(bwt_dedup.gathered(data, first[:0], size[:0])) == 0
    out, numbers = bwt_dedup._Combiner(), np.arange(10_000, dtype=np.int64)
    tracemalloc.start()
    out.put(numbers.view(np.uint64), numbers.view(np.uint64), numbers, numbers, numbers, numbers, data, first, first + size)
    batch = out.flush()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert b"".join(batch.column(batch.schema.get_field_index("bytes")).to_pylist()) == want
    assert peak < 12 * len(want)  # was over 17 times


def test_written_puts_the_session_back(spark):
    before = spark.conf.get(common.BATCH_BYTES)
    assert common.written(spark.range(3), 1 << 20).count() == 3 and spark.conf.get(common.BATCH_BYTES) == before
