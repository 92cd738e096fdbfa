import random

from codelattice.operators import locate as L
from tests.conftest import rows

SYMBOL = "id string, file_path string, line int, end_line int"
PLACE = "file_path string, line int"


def test_nearest_small(frame):
    symbols = frame(SYMBOL, [("symA", "/tmp/A.java", 10, 20), ("symB", "/tmp/B.java", 5, 8)])
    places = frame(PLACE, [("/tmp/A.java", 10), ("/tmp/A.java", 15), ("/tmp/B.java", 7), ("Unknown", 1), ("", 3), ("/tmp/A.java", 0)])
    assert rows(L.locate_nearest(places, symbols), "file_path", "line", "symbol_id") == [
        ("", 3, None), ("/tmp/A.java", 0, None), ("/tmp/A.java", 10, "symA"), ("/tmp/A.java", 15, "symA"), ("/tmp/B.java", 7, "symB"), ("Unknown", 1, None)]


def test_narrowest_nested(frame):
    symbols = frame(SYMBOL, [("wide", "c.go", 10, 100), ("narrow", "c.go", 24, 30), ("callee", "b.go", 20, 48), ("one", "b.go", 60, 0)])
    places = frame(PLACE, [("c.go", 26), ("c.go", 40), ("b.go", 34), ("b.go", 60), ("b.go", 61)])
    assert dict(((f, n), s) for f, n, s in rows(L.locate_narrowest(places, symbols), "file_path", "line", "symbol_id")) == {
        ("c.go", 26): "narrow", ("c.go", 40): "wide", ("b.go", 34): "callee", ("b.go", 60): "one", ("b.go", 61): None}


def _brute(symbols, place, rule):
    file, line = place
    found = []
    for sid, f, a, b in symbols:
        if f != file or line <= 0:
            continue
        if rule == "nearest" and a <= line and (b == 0 or b >= line):
            found.append(((-a,), sid))
        if rule == "narrowest" and a > 0:
            end = max(b, a) if b > 0 else a
            if a <= line <= end:
                found.append(((end - a, a, end), sid))
    return min(found)[1] if found else None


def test_against_brute_force_with_a_crowded_file(frame):
    rng = random.Random(5)
    symbols, places = [], []
    for i in range(400):
        start = rng.choice([rng.randint(1, 60), rng.randint(1, 5000), rng.randint(1, 2_000_000)])
        end = rng.choice([0, start, start + rng.randint(0, 40), start + rng.randint(0, 70_000), start - 1])
        symbols.append((f"s{i:03d}", rng.choice(["hot", "hot", "cold"]), start, end))
    for _ in range(600):
        places.append((rng.choice(["hot", "cold", "none"]), rng.choice([rng.randint(-1, 70), rng.randint(1, 6000), rng.randint(1, 2_100_000)])))
    places += [("hot", 16), ("hot", 256), ("hot", 4096), ("hot", 2**31 - 1)]
    s, p = frame(SYMBOL, symbols), frame(PLACE, places)
    for rule, fn in (("nearest", L.locate_nearest), ("narrowest", L.locate_narrowest)):
        want = sorted(((f, n, _brute(symbols, (f, n), rule)) for f, n in places), key=repr)
        assert rows(fn(p, s), "file_path", "line", "symbol_id") == want
        assert rows(fn(p, s, hot_files=["hot"]), "file_path", "line", "symbol_id") == want


def test_rules_agree_on_disjoint_ranges(frame):
    symbols = frame(SYMBOL, [(f"s{i}", "f", i * 10, i * 10 + 7) for i in range(1, 30)])
    places = frame(PLACE, [("f", n) for n in range(1, 320)])
    assert rows(L.locate_nearest(places, symbols), "*") == rows(L.locate_narrowest(places, symbols), "*")


def test_sites_become_distinct_calls(frame):
    symbols = frame(SYMBOL, [("t", "b.go", 1, 9)])
    sites = frame("caller_id string, callee_file string, callee_line int, file_path string, line int", [
        ("c", "b.go", 3, "a.go", 7), ("c", "b.go", 4, "a.go", 7), ("c", "b.go", 30, "a.go", 8)])
    assert rows(L.sites_to_calls(sites, symbols), "*") == [("c", "t", "direct", "a.go", 7)]
    assert L.resolution_stats(L.resolve_sites(sites, symbols)).first().asDict() == {"pending": 3, "resolved": 2, "unresolved": 1}
    assert L.changed_sites_to_calls(sites, frame("id string", [("other",)]), symbols).count() == 0


def test_equal_ranges_come_down_to_one_before_they_are_cut(spark, frame):
    """Every symbol's range was cut into blocks, and a task sorted the blocks of all symbols it read."""
    symbols = [(f"s{(k * 37) % 900:03d}", "f", 1 + k % 3, 30 if k % 2 else 0) for k in range(900)]
    s, places = frame(SYMBOL, symbols), frame(PLACE, [("f", n) for n in range(1, 40)])
    for rule, fn, ranges in (("nearest", L.locate_nearest, L.nearest_ranges), ("narrowest", L.locate_narrowest, L.narrowest_ranges)):
        want = []
        for n in range(1, 40):
            found = [((-a,) if rule == "nearest" else (max(b, a) - a, a), i) for i, _, a, b in symbols if a <= n <= ((b or 2**31) if rule == "nearest" else max(b, a))]
            want.append(("f", n, min(found)[1] if found else None))
        assert rows(fn(places, s), "file_path", "line", "symbol_id") == sorted(want, key=repr)
        cut = []
        whole = L._tile_ranges
        L._tile_ranges = lambda given: cut.append(given) or whole(given)
        try:
            L._enclosing(places, ranges(s))
        finally:
            L._tile_ranges = whole
        assert cut[0].count() == cut[0].select("file_path", "start", "stop").distinct().count() < 10
