from pyspark.sql import functions as F

from codelattice.operators import edges as E
from codelattice.operators import index as I
from codelattice.operators import nodes as N
from codelattice.operators.skew import first_per_key, hot_keys, skew_join
from tests.conftest import rows

SYMBOL = "id string, name string, kind string, file_path string, line int"
VIRTUAL = "id string, label string, type string, virtual_class_id string, virtual_directory string, materialized boolean"
NOTE = "node_id string, description string, ai_remarks string"
CALL = "caller_id string, callee_id string, call_type string, file_path string, line int"
REMARK = "edge_id string, source_node_id string, target_node_id string, remarks string, call_count int"


def small_graph(frame):
    symbols = frame(SYMBOL, [
        ("c1", "UserService", "class", "src/UserService.java", 1),
        ("m1", "UserService.createUser", "method", "src/UserService.java", 10),
        ("m2", "UserService.deleteUser", "method", "src/UserService.java", 20)])
    virtual = frame(VIRTUAL, [
        ("v1", "PlannedFeature.process", "method", None, None, False),
        ("v2", "UserService.audit", "method", None, "plan", False),
        ("v3", "UserService.createUser", "method", None, None, True)])
    notes = frame(NOTE, [("m1", "makes a user", "")])
    return symbols, virtual, notes


def test_nodes_are_symbols_and_unbuilt_plans(frame):
    symbols, virtual, notes = small_graph(frame)
    nodes = N.graph_nodes(symbols, virtual, notes)
    assert rows(nodes, "id", "file_path", "line", "is_virtual", "annotated") == [
        ("c1", "src/UserService.java", 1, False, False),
        ("m1", "src/UserService.java", 10, False, True),
        ("m2", "src/UserService.java", 20, False, False),
        ("v1", "virtual/PlannedFeature.virtual", 0, True, False),
        ("v2", "src/UserService.java", 0, True, False)]
    assert N.node_count(symbols, virtual).first()["total"] == 5


def test_search_ignores_case_and_finds_built_plans(frame):
    symbols, virtual, notes = small_graph(frame)
    found = [r.id for r in N.search_nodes(symbols, virtual, notes, "USERSERVICE.C").collect()]
    assert found == ["m1", "v3"]
    assert len(N.search_nodes(symbols, virtual, notes, "user", limit=2).collect()) == 2


def test_lookup_reports_what_is_missing(frame):
    symbols, virtual, notes = small_graph(frame)
    got = N.lookup_nodes(symbols, virtual, notes, frame("id string", [("m1",), ("v2",), ("zz",)]))
    assert rows(got, "id", "found", "file_path") == [
        ("m1", True, "src/UserService.java"), ("v2", True, "src/UserService.java"), ("zz", False, "")]


def test_rollup_keeps_directions_and_resolves_labels(frame):
    symbols, virtual, notes = small_graph(frame)
    calls = frame(CALL, [
        ("m1", "m2", "direct", "f", 1), ("UserService.createUser", "m2", "manual", "", 0), ("m2", "m1", "direct", "f", 2),
        ("m1", "m1", "direct", "f", 3), ("m1", "nowhere", "direct", "f", 4)])
    remarks = frame(REMARK, [("m1::m2", "m1", "m2", "why", 1)])
    edges = E.edge_rollup(calls, N.graph_nodes(symbols, virtual, notes), None, remarks)
    assert rows(edges, "edge_id", "call_count", "is_manual", "remarks") == [
        ("m1::m1", 1, False, ""), ("m1::m2", 2, True, "why"), ("m2::m1", 1, False, "")]


def test_rollup_is_the_same_with_hubs(spark, frame):
    calls = spark.range(3000).select(
        F.concat(F.lit("n"), (F.col("id") % 50).cast("string")).alias("caller_id"),
        F.when(F.col("id") % 3 == 0, F.lit("n0")).otherwise(F.concat(F.lit("n"), (F.col("id") % 70).cast("string"))).alias("callee_id"),
        F.when(F.col("id") % 7 == 0, "manual").otherwise("direct").alias("call_type"))
    nodes = spark.range(60).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id")).withColumn("label", F.col("id"))
    keys, pairs = E.endpoint_keys(nodes), E.call_pairs(calls)
    hubs = E.find_hubs(calls.select("caller_id", "callee_id"), share=0.2)
    assert hubs.callees == ["n0"]
    assert rows(E.roll_up(pairs, keys, hot=hubs), "*") == rows(E.roll_up(pairs, keys), "*")


def test_skew_join_kinds_agree_with_plain_joins(spark):
    left = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).alias("k"), "id")
    right = spark.range(0, 60, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = hot_keys(left, "k", share=0.3)
    assert hot == [7]
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(skew_join(left, right, "k", how, hot=hot, salts=8), "*") == rows(left.join(right, ["k"], how), "*")


def test_neighbours_are_undirected(frame):
    calls = frame(CALL, [("a", "b", "direct", "f", 1), ("c", "a", "direct", "f", 1), ("a", "a", "direct", "f", 1)])
    remarks = frame(REMARK, [("d::a", "d", "a", "x", 1)])
    got = E.neighbour_ids(calls, remarks, frame("id string", [("a",)]))
    assert rows(got, "id") == [("a",), ("b",), ("c",), ("d",)]


def test_khop_counts_least_steps(frame):
    edges = frame("edge_id string, source string, target string", [(f"n{i}::n{i + 1}", f"n{i}", f"n{i + 1}") for i in range(8)])
    seeds = frame("id string", [("n0",)])
    assert rows(E.khop_nodes(edges, seeds, 2), "id", "hop") == [("n0", 0), ("n1", 1), ("n2", 2)]
    # Past the rounds after which lineage is cut.
    assert E.khop_nodes(edges, seeds, 7).count() == 8
    assert rows(E.khop_edges(edges, E.khop_nodes(edges, seeds, 2), 2), "edge_id") == [("n0::n1",), ("n1::n2",)]


def test_merge_adds_new_rows_and_keeps_repeats_of_the_batch(frame):
    old, batch = frame("id string, v int", [("a", 1)]), frame("id string, v int", [("a", 2), ("b", 3), ("b", 3)])
    merged = E.merge_new(old, batch)
    assert rows(merged, "id", "v") == [("a", 1), ("b", 3), ("b", 3)]
    assert E.merge_new(merged, batch).count() == 3


def test_removed_nodes_take_their_edges(frame):
    edges = frame("edge_id string, source string, target string", [("a::b", "a", "b"), ("b::c", "b", "c"), ("c::a", "c", "a")])
    assert rows(E.remove_nodes(edges, frame("id string", [("a",)])), "edge_id") == [("b::c",)]
    assert rows(E.connected_edges(edges, frame("id string", [("a",)]), frame("id string", [("b",)])), "edge_id") == [("a::b",)]
    assert rows(E.induced_edges(edges, frame("id string", [("b",), ("c",)])), "edge_id") == [("b::c",)]


def test_view_parents_must_be_visible_containers(frame):
    visible = frame("id string, type string, file_path string, is_virtual boolean, parent_id string", [
        ("f", "class", "a/A.java", False, "d"), ("d", "directory", "a", False, ""), ("m", "method", "a/A.java", False, ""),
        ("x", "method", "a/A.java", False, "m"), ("v", "method", "", True, "vc"), ("vc", "class", "", True, "vc")])
    files = frame("id string, path string, name string, directory string", [("f", "a/A.java", "A.java", "d")])
    got = dict(rows(N.effective_parents(visible, files), "id", "parent"))
    assert got == {"f": "d", "d": "", "m": "f", "x": "", "v": "vc", "vc": ""}


def test_first_per_key_returns_whole_rows(frame):
    df = frame("k string, n int, s string", [("a", 2, "y"), ("a", 1, "x"), ("b", 5, "z")])
    assert rows(first_per_key(df, ["k"], "n"), "k", "n", "s") == [("a", 1, "x"), ("b", 5, "z")]


def test_edge_requests_answer_with_the_stored_count(frame):
    asks = frame("request_id bigint, source_id string, target_id string, remarks string", [
        (1, "a", "b", ""), (2, "a", "c", "new"), (3, "a", "zz", "")])
    known = frame("id string", [("a",), ("b",), ("c",)])
    stored = frame(REMARK, [("a::b", "a", "b", "old", 4)])
    made, calls, rejected = I.create_manual_edges(asks, known, stored)
    assert rows(made, "edge_id", "call_count", "remarks") == [("a::b", 4, "old"), ("a::c", 1, "new")]
    assert calls.count() == 2 and rows(rejected, "request_id") == [(3,)]


def test_neighbourhood_of_a_label_of_many_seeds_and_a_hub(spark):
    nodes = [(f"n{k}", "same" if k % 3 == 0 else f"label{k % 40}" if k % 3 == 1 else f"n{k}") for k in range(90)]
    calls = [("same", f"n{k % 90}", "direct") for k in range(120)] + [("same", "same", "manual"), ("n0", "same", "manual"), ("n3", "n3", "direct")]
    calls += [(f"n{k * 7 % 90}", f"label{k % 40}", "manual" if k % 5 == 0 else "direct") for k in range(200)] + [("n5", "unknown", "direct"), ("n0", "n0", "manual")]
    seeds = spark.createDataFrame(nodes, "id string, label string")
    got = E.neighbourhood_edges(spark.createDataFrame(calls, "caller_id string, callee_id string, call_type string"), seeds, seeds)
    meant = {}
    for node, label in sorted(nodes, key=lambda n: (n[1], n[0])):
        meant[label] = node
        meant[node] = node
    want = {}
    for seed, label in nodes:
        for caller, callee, kind in calls:
            out = caller in (seed, label)
            if (out or callee in (seed, label)) and caller in meant and callee in meant:
                key = (seed, meant[caller], meant[callee], meant[callee] if out else meant[caller])
                n, manual = want.get(key, (0, False))
                want[key] = (n + 1, manual or kind == "manual")
    found = {(r.seed_id, r.source, r.target, r.other_id): (r.call_count, r.is_manual) for r in got.collect()}
    assert found == want and len(want) > 1000


def test_neighbours_and_their_files_need_no_counts(spark):
    nodes = [(f"n{k}", "same" if k % 3 == 0 else f"label{k % 40}" if k % 3 == 1 else f"n{k}", k % 5 == 0, "" if k % 7 == 0 else f"f{k % 4}") for k in range(60)]
    calls = [("same", f"n{k % 60}", "direct") for k in range(70)] + [("n0", "same", None), ("same", "n3", "manual"), ("n0", "n0", "direct"), ("n5", "unknown", "direct")]
    calls += [(f"n{k * 7 % 60}", f"label{k % 40}", "direct") for k in range(90)]
    shown = spark.createDataFrame(nodes, "id string, label string, is_virtual boolean, file_path string")
    table = spark.createDataFrame(calls, "caller_id string, callee_id string, call_type string")
    meant = {key: n[0] for n in sorted(nodes, key=lambda n: (n[1], n[0])) for key in (n[1], n[0])}
    file_of = {n[0]: n[3] for n in nodes if not n[2] and n[3]}
    for seeds, sift in ((nodes, False), (nodes, True), (nodes[:4], True)):
        want = {(n[0], n[0]) for n in seeds}
        for seed, label, _, _ in seeds:
            for caller, callee, _ in calls:
                if caller in meant and callee in meant and {caller, callee} & {seed, label}:
                    want.add((seed, meant[callee] if caller in (seed, label) else meant[caller]))
        given = shown.where(shown.id.isin([n[0] for n in seeds])).select("id", "label")
        found, files = E.neighbourhood_node_ids(table, given, shown, sift=sift), E.neighbourhood_files(table, given, shown, sift=sift)
        assert rows(found, "seed_id", "id") == sorted(want, key=repr)
        assert rows(files, "seed_id", "path") == sorted({(s, file_of[n]) for s, n in want if n in file_of}, key=repr)
    edges = E.neighbourhood_edges(table, shown.select("id", "label"), shown, sift=False)
    assert {r.is_manual for r in edges.where("seed_id = 'n0' and source = target").collect()} == {False}


def test_neighbourhoods_deal_rows_of_seeds_out_once(spark):
    """Rolled-up edges were dealt out, then neighbours twice more, and once more for their files."""
    from codelattice.plans import load

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("neighbourhood", "neighbourhood_nodes", "neighbourhood_files"):
            plan = load()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(seed_id#" in line and "_label#" not in line]
            assert len(dealt) == 1, (name, dealt)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _looked(spark, df, column):
    """``df`` whose ``column`` goes by way of Python, and the number of rows that did."""
    seen = spark.sparkContext.accumulator(0)

    def look(value):
        seen.add(1)
        return value

    return df.withColumn(column, F.udf(look, "string").asNondeterministic()(column)), seen


def test_hubs_of_any_share_are_looked_for_in_written_pairs(spark):
    pairs = [("hub", f"n{k}") for k in range(40)] + [(f"n{k}", "end") for k in range(20)]
    calls, seen = _looked(spark, spark.createDataFrame([(a, b, "direct") for a, b in pairs], "caller_id string, callee_id string, call_type string"), "callee_id")
    got, hubs = E.counted(calls, share=1 / 2)
    assert (list(hubs.callers), list(hubs.callees), got.count(), seen.value) == (["hub"], [], 60, 60)


def test_a_step_reads_the_edges_once(spark):
    edges, seen = _looked(spark, spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(50)] * 2, "source string, target string"), "target")
    found = E.khop_nodes(edges, spark.createDataFrame([("n7",)], "id string"), 3)
    assert rows(found, "id", "hop") == sorted((f"n{7 + d}", abs(d)) for d in range(-3, 4))
    assert seen.value <= 3 * 100
