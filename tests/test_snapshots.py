from pyspark.sql import functions as F

from codelattice.model import SNAPSHOT_EDGES, SNAPSHOT_NODES
from codelattice.operators import codec, report
from codelattice.operators import snapshot as S
from tests.conftest import rows

CALL = "caller_id string, callee_id string, call_type string, file_path string, line int"
REMARK = "edge_id string, source_node_id string, target_node_id string, remarks string, call_count int"
NOTE = "node_id string, description string, ai_remarks string"
VIRTUAL = "id string, label string, type string, virtual_class_id string, virtual_directory string, materialized boolean"
FRESH = "id string, label string, type string, file_path string, line int, annotated boolean, description string, ai_remarks string"
BOX = "id string, path string, name string, directory string"


def node(seq, nid, label, kind, path="", line=0, virtual=False, parent="", text="", remarks="", snapshot="s"):
    return (snapshot, seq, nid, label, kind, path, line, virtual, parent, text, remarks)


def state(spark):
    nodes = spark.createDataFrame([
        node(1, "vc", "Plan", "class", virtual=True, text="a plan"),
        node(2, "vm", "Plan.run", "method", virtual=True, parent="vc"),
        node(3, "vx", "Lost", "method", virtual=True, parent="outside"),
        node(4, "r1", "A.a", "method", "A.java", 3, text="real note"),
        node(5, "r2", "A.b", "method", "A.java", 9),
        node(6, "stale", "A.c", "method", "A.java", 12, text="lost note"),
        node(7, "fileid", "A.java", "file", "A.java"),
        node(8, "oldfile", "B.java", "class", "B.java", 0),
        node(9, "dirid", "src", "directory", "src"),
    ], SNAPSHOT_NODES)
    edges = spark.createDataFrame([
        ("s", 1, "vm", "r1", "plans"), ("s", 2, "r1", "r2", "real"), ("s", 3, "r1", "stale", ""), ("s", 4, "r1", "fileid", ""),
        ("s", 5, "r2", "r1", ""), ("s", 6, "vm", "r1", "again"), ("s", 7, "r1", "alsogone", ""), ("s", 8, "vx", "stale", ""),
    ], SNAPSHOT_EDGES)
    symbols = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "id string")
    calls = spark.createDataFrame([("r1", "r2", "direct", "f", 1), ("vm", "r1", "direct", "f", 1)], CALL)
    return nodes, edges, symbols, calls


def test_stale_symbols_count_once_and_containers_never(spark):
    nodes, edges, symbols, _ = state(spark)
    assert rows(S.stale_context(nodes, edges, symbols), "id") == [("alsogone",), ("stale",)]


def test_restore_stats(spark):
    nodes, edges, symbols, _ = state(spark)
    assert S.restore_stats(nodes, edges, symbols).first().asDict() == {
        "snapshot_id": "s", "restored_nodes": 3, "restored_edges": 5, "missing_context_nodes": 2}


def test_loading_twice_is_loading_once(spark):
    nodes, edges, symbols, calls = state(spark)
    empty = [spark.createDataFrame([], s) for s in (VIRTUAL, NOTE, REMARK)]
    once = S.restore(nodes, edges, symbols, calls, *empty)
    assert rows(once["virtual_nodes"], "id", "virtual_class_id", "materialized") == [("vc", None, False), ("vm", "vc", False), ("vx", None, False)]
    assert rows(once["node_annotations"], "node_id", "description") == [("r1", "real note"), ("vc", "a plan")]
    # r1→r2 is there already; vm→r1 needs a manual call beside the indexed one.
    added = rows(once["method_calls"].where("call_type = 'manual'"), "caller_id", "callee_id")
    assert added == [("r2", "r1"), ("vm", "r1"), ("vx", "stale")]
    assert rows(once["edge_annotations"], "edge_id", "remarks", "call_count") == [("r1::r2", "real", 0), ("vm::r1", "again", 0)]
    twice = S.restore(nodes, edges, symbols, *(once[t] for t in ("method_calls", "virtual_nodes", "node_annotations", "edge_annotations")))
    for name, table in once.items():
        assert rows(twice[name], *table.columns) == rows(table, *table.columns), name


def test_stored_edge_count_survives_a_load(spark):
    nodes, edges, symbols, calls = state(spark)
    stored = spark.createDataFrame([("r1::r2", "r1", "r2", "older", 6)], REMARK)
    out = S.restore(nodes, edges, symbols, calls, spark.createDataFrame([], VIRTUAL), spark.createDataFrame([], NOTE), stored)
    assert rows(out["edge_annotations"].where("edge_id = 'r1::r2'"), "remarks", "call_count") == [("real", 6)]


def fresh(spark):
    nodes = spark.createDataFrame([("m1", "UserService.save(User)", "method", "src/service/U.java", 4, False, "", "")], FRESH)
    files = spark.createDataFrame([("fhash", "src/service/U.java", "U.java", "dhash")], BOX)
    dirs = spark.createDataFrame([("dhash", "src/service", "service", "")], BOX).drop("directory")
    edges = spark.createDataFrame([("fhash::m1", "fhash", "m1", 2, "")], "edge_id string, source string, target string, call_count bigint, remarks string")
    return nodes, files, dirs, edges


def test_reconcile_by_id_then_path_then_placeholder(spark):
    snap = spark.createDataFrame([
        node(1, "dir:src/service", "service", "directory", "src/service", text="kept"),
        node(2, "file:src/service/U.java", "U.java", "file", "src/service/U.java"),
        node(3, "fhash", "U.java", "class", "src/service/U.java"), node(4, "m1", "x", "method", "src/service/U.java", 4),
        node(5, "gone", "Gone.it", "method", "src/Gone.java", 2, text="why"), node(6, "fgone", "G.java", "file", "src/G.java"),
    ], SNAPSHOT_NODES)
    nodes, files, dirs, edges = fresh(spark)
    got = S.reconcile_nodes(snap, nodes, files, dirs)
    assert rows(got, "id", "resolved_id", "r_type", "stale", "first", "r_description") == [
        ("dir:src/service", "dhash", "directory", False, True, "kept"), ("fgone", "fgone", "class", True, True, ""),
        ("fhash", "fhash", "class", False, False, ""), ("file:src/service/U.java", "fhash", "class", False, True, ""),
        ("gone", "gone", "method", True, True, "why"), ("m1", "m1", "method", False, True, "")]
    links = spark.createDataFrame([
        ("s", 1, "file:src/service/U.java", "m1", "told"), ("s", 2, "fhash", "m1", "second"), ("s", 3, "gone", "m1", "bye"), ("s", 4, "m1", "unknown", "")],
        SNAPSHOT_EDGES)
    assert rows(S.reconcile_edges(links, got, edges), "edge_id", "call_count", "remarks", "stale") == [
        ("fhash::m1", 2, "told", False), ("gone::m1", 1, "bye", True)]


def test_codec_round_trip(spark):
    nodes, _, _, _ = state(spark)
    packed = nodes.where("seq <= 3").groupBy("snapshot_id").agg(codec.encode(F.collect_list(codec.node_items())).alias("json"))
    back = codec.decode_nodes(packed, "snapshot_id", "json")
    assert rows(back, "id", "label", "is_virtual", "parent_id") == rows(nodes.where("seq <= 3"), "id", "label", "is_virtual", "parent_id")
    odd = spark.createDataFrame([("a", None), ("b", ""), ("c", "[]"), ("d", '[{"id":"x"}]')], "k string, j string")
    assert rows(codec.decode_edges(odd, "k", "j"), "k", "id", "remarks") == [("d", "x", "")]


def _text(spark, lines):
    order = ["section", "order", "step", "line"]
    return [r.line for r in lines.orderBy(*order).collect()]


def test_report_text(spark, tmp_path):
    snap = spark.createDataFrame([
        node(1, "d", "core", "directory", virtual=True, text="the core"), node(2, "c", "Repo", "class", virtual=True, parent="d", remarks="slow"),
        node(3, "m", "Repo.get", "method", "R.java", virtual=True, parent="c"), node(4, "x", "Svc.run", "method", "S.java", 7, text="main"),
    ], SNAPSHOT_NODES)
    links = spark.createDataFrame([("s", 1, "x", "m", "uses"), ("s", 2, "c", "zz", "")], SNAPSHOT_EDGES)
    named = spark.createDataFrame([("s", "first")], "id string, name string")
    lines = report.report_lines(named, snap, links)
    text = _text(spark, lines)
    assert text[:5] == ["# Graph Snapshot: s", "", "**Name:** first", "", "**Summary:** 3 virtual node(s), 1 context node(s), 2 relationship(s)."]
    body = text[text.index("## Virtual Design"):]
    assert body[:24] == [
        "## Virtual Design", "", "Methods/classes to implement or refine:", "",
        "### 📁 core *(virtual directory)*", "", "- Description: the core", "",
        "#### 📦 Repo *(virtual class)*", "- AI Remarks: slow", "- Related: → zz", "",
        "##### Repo.get *(virtual method)*", "- Type: method", "- Target file: `R.java`", "- Related: ← Svc.run", "",
        "## Context Nodes (Existing Code)", "", "Reference these existing implementations for patterns and integration:", "",
        "**File:** `S.java`", "- **Svc.run** (line 7) — method: main", ""]
    assert "- `Svc.run` → `Repo.get` (context → virtual) — uses" in body and "- `Repo` → `zz` (virtual → context)" in body
    report.write_report(lines, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == len(text)


def test_rootless_report_is_a_numbered_list(spark):
    snap = spark.createDataFrame([node(i, f"v{i}", f"L{i}", "method", virtual=True, parent="gone") for i in (200_001, 3, 7)], SNAPSHOT_NODES)
    named = spark.createDataFrame([("s", "")], "id string, name string")
    lines = report.report_lines(named, snap, spark.createDataFrame([], SNAPSHOT_EDGES))
    heads = [x for x in _text(spark, lines) if x.startswith("### ")]
    assert heads == ["### 1. L3 *(virtual)*", "### 2. L7 *(virtual)*", "### 3. L200001 *(virtual)*"]
    assert "No relationships defined." in _text(spark, lines)


def test_small_reports_are_numbered_without_ranges(spark):
    """ranges make all lines twice; only a report that may be too long for one task is dealt by them."""
    rows = [node(k, f"v{k % 5}", f"L{k}", "class", virtual=True, parent="") for k in range(12)] + [node(k, f"c{k % 4}", f"C{k}", "method") for k in range(20, 30)]
    rows += [(f"t{k % 2}", *x[1:]) for k, x in enumerate(rows)] + [("empty", *rows[-1][1:])]
    edges = [(s, k, f"v{k % 5}", f"c{k % 7}", "r") for s in ("s", "t0", "t1", "only edges") for k in range(15)]
    snap, linked = spark.createDataFrame(rows, SNAPSHOT_NODES), spark.createDataFrame(edges, SNAPSHOT_EDGES)
    names = snap.select("snapshot_id").distinct().selectExpr("snapshot_id AS id", "'named' AS name")
    lines, most = report.report_lines(names, snap, linked).persist(), report.most_lines(snap, linked)
    counted, bounds = {r[0]: r[1] for r in lines.groupBy("snapshot_id").count().collect()}, dict(map(tuple, most.collect()))
    assert counted.keys() == bounds.keys() and all(n <= bounds[s] for s, n in counted.items())
    want = sorted(map(tuple, report.numbered_lines(lines).collect()))
    least = sorted(bounds.values())
    assert least[0] < least[-1]
    for whole in (0, least[0], least[-2], least[-1]):  # all, some and none by ranges
        assert sorted(map(tuple, report.numbered_lines(lines, most, whole).collect())) == want
    plan = report.numbered_lines(lines, most)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "row_number" in plan
    lines.unpersist()
