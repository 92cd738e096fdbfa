"""Positions by order, and the walk over trees of planned nodes."""

import random

from pyspark.sql import functions as F

from codelattice.operators import ranks, report

NODES = "snapshot_id string, seq bigint, id string, label string, parent_id string, is_virtual boolean"


def test_running_sums_and_positions(spark):
    rng = random.Random(3)
    rows = [(("hot" if k % 3 else f"g{k % 7}"), rng.randrange(50), rng.randrange(9)) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(6)
    got = ranks.running_sum(df, ["g"], ["o", "v"], F.col("v"), "before").collect()
    want, sums = [], {}
    for g, o, v in sorted(rows):
        want.append((g, o, v, sums.get(g, 0)))
        sums[g] = sums.get(g, 0) + v
    assert sorted(map(tuple, got)) == sorted(want)
    places = ranks.numbered(df, ["g"], ["o", "v"], "nr").groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("nr").alias("d"), F.min("nr").alias("a"), F.max("nr").alias("b"))
    assert all(r.n == r.d == r.b and r.a == 1 for r in places.collect())


def _walk(rows):
    """Preorder by label and id: ``(snapshot, id, depth)``."""
    kids = {}
    for s, _, i, label, parent, virtual in rows:
        if virtual:
            kids.setdefault((s, parent or ""), []).append((label, i))
    out = []
    for s in sorted({r[0] for r in rows}):
        todo = [(label, i, 0) for label, i in sorted(kids.get((s, ""), []), reverse=True)]
        while todo:
            _, i, depth = todo.pop()
            out.append((s, i, depth))
            todo += [(label, c, depth + 1) for label, c in sorted(kids.get((s, i), []), reverse=True)]
    return out


def test_walk_over_deep_wide_and_broken_trees(spark):
    rng = random.Random(4)
    rows = [("deep", k, f"n{k:04}", f"L{k % 5}", f"n{k - 1:04}" if k else None, True) for k in range(1000)]
    rows += [("wide", k, f"w{k}", f"L{rng.randrange(20)}", "" if k == 0 else f"w{rng.choice([0, rng.randrange(k)])}", True) for k in range(400)]
    rows += [("odd", 1, "a", "A", "", True), ("odd", 2, "b", "B", "gone", True), ("odd", 3, "c", "C", "b", True), ("odd", 4, "d", "D", "e", True), ("odd", 5, "e", "E", "d", True),
             ("odd", 6, "f", "F", "e", True), ("odd", 7, "g", "G", "g", True), ("odd", 8, "h", "H", "a", True), ("odd", 9, "x", "X", "a", False)]
    tree = report.virtual_tree(spark.createDataFrame(rows, NODES))
    got = [(r.snapshot_id, r.id, r.depth) for r in tree.orderBy("snapshot_id", "order").collect()]
    assert got == _walk(rows) and not tree.where("flat").count()
    assert tree.where(F.size("order") > 1).isEmpty()  # the key does not grow with the depth


def test_a_snapshot_without_roots_is_a_flat_list(spark):
    rows = [("s", 2, "a", "A", "b", True), ("s", -1, "b", "B", "a", True), ("s", 5, "c", "C", "gone", True), ("t", 1, "d", "D", None, True)]
    got = report.virtual_tree(spark.createDataFrame(rows, NODES)).orderBy("snapshot_id", "order").collect()
    assert [(r.id, r.depth, r.flat) for r in got] == [("b", 0, True), ("a", 0, True), ("c", 0, True), ("d", 0, False)]
    assert report.virtual_tree(spark.createDataFrame([], NODES)).count() == 0
