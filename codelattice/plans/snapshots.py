"""Queries on snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelattice.functions import ids
from codelattice.operators import codec, report
from codelattice.operators import edges as E
from codelattice.operators import nodes as N
from codelattice.operators import snapshot as S
from codelattice.plans.graph import BASENAME, all_edges, all_nodes
from codelattice.plans.registry import oracle_view, query
from codelattice.session import cut_lineage, stored

BACKED = "NOT (type IN ('directory', 'file') OR (type IN ('class', 'interface') AND file_path <> '' AND line = 0))"

oracle_view("ox_sn_virtual", "SELECT DISTINCT snapshot_id, id FROM fx_snapshot_nodes WHERE is_virtual")
oracle_view("ox_sn_candidates", f"""
    SELECT snapshot_id, id FROM fx_snapshot_nodes WHERE NOT is_virtual AND {BACKED}
    UNION SELECT e.snapshot_id, e.id FROM (SELECT snapshot_id, source_id AS id FROM fx_snapshot_edges
      UNION SELECT snapshot_id, target_id FROM fx_snapshot_edges) e
    WHERE NOT EXISTS (SELECT 1 FROM fx_snapshot_nodes n WHERE n.snapshot_id = e.snapshot_id AND n.id = e.id
      AND (n.is_virtual OR NOT ({BACKED.replace('type', 'n.type').replace('file_path', 'n.file_path').replace('line', 'n.line')})))""")
oracle_view("ox_sn_known", "SELECT * FROM ox_sn_candidates WHERE id IN (SELECT id FROM fx_symbols)")
oracle_view("ox_sn_restorable", """
    SELECT e.*, sv.id IS NOT NULL OR tv.id IS NOT NULL AS planned FROM fx_snapshot_edges e
    LEFT JOIN ox_sn_virtual sv ON sv.snapshot_id = e.snapshot_id AND sv.id = e.source_id
    LEFT JOIN ox_sn_virtual tv ON tv.snapshot_id = e.snapshot_id AND tv.id = e.target_id
    LEFT JOIN ox_sn_known sk ON sk.snapshot_id = e.snapshot_id AND sk.id = e.source_id
    LEFT JOIN ox_sn_known tk ON tk.snapshot_id = e.snapshot_id AND tk.id = e.target_id
    WHERE sv.id IS NOT NULL OR tv.id IS NOT NULL OR (sk.id IS NOT NULL AND tk.id IS NOT NULL)""")
oracle_view("ox_sn_missing", """
    SELECT DISTINCT source_id AS caller_id, target_id AS callee_id FROM ox_sn_restorable r WHERE NOT EXISTS (
      SELECT 1 FROM fx_method_calls c WHERE c.caller_id = r.source_id AND c.callee_id = r.target_id AND (NOT r.planned OR c.call_type = 'manual'))""")


@query("stale_context", "SELECT snapshot_id, id FROM ox_sn_candidates WHERE id NOT IN (SELECT id FROM fx_symbols)")
def stale_context(t):
    return S.stale_context(t.fx_snapshot_nodes, t.fx_snapshot_edges, t.fx_symbols)


@query("restorable_edges", "SELECT snapshot_id, seq, source_id, target_id, planned FROM ox_sn_restorable")
def restorable_edges(t):
    return S.restorable_edges(t.fx_snapshot_nodes, t.fx_snapshot_edges, t.fx_symbols).select("snapshot_id", "seq", "source_id", "target_id", "planned")


@query("missing_edges_insert", "SELECT caller_id, callee_id, 'manual' AS call_type FROM ox_sn_missing")
def missing_edges_insert(t):
    back = S.restorable_edges(t.fx_snapshot_nodes, t.fx_snapshot_edges, t.fx_symbols)
    return S.missing_edges(back, t.fx_method_calls).select("caller_id", "callee_id", "call_type")


@query("restore_stats", """
    SELECT n.snapshot_id, sum(CASE WHEN is_virtual THEN 1 ELSE 0 END)::BIGINT AS restored_nodes,
      (SELECT count(*) FROM ox_sn_restorable r WHERE r.snapshot_id = n.snapshot_id) AS restored_edges,
      (SELECT count(*) FROM ox_sn_candidates c WHERE c.snapshot_id = n.snapshot_id AND c.id NOT IN (SELECT id FROM fx_symbols)) AS missing_context_nodes
    FROM fx_snapshot_nodes n GROUP BY n.snapshot_id""")
def restore_stats(t):
    return S.restore_stats(t.fx_snapshot_nodes, t.fx_snapshot_edges, t.fx_symbols)


@query("snapshot_counts", """
    SELECT s.id, (SELECT count(*) FROM fx_snapshot_nodes n WHERE n.snapshot_id = s.id AND n.is_virtual) AS virtual_nodes,
      (SELECT count(*) FROM fx_snapshot_nodes n WHERE n.snapshot_id = s.id AND NOT n.is_virtual) AS context_nodes,
      (SELECT count(*) FROM fx_snapshot_edges e WHERE e.snapshot_id = s.id) AS edges FROM fx_snapshots s""")
def snapshot_counts(t):
    return S.snapshot_counts(t.fx_snapshots, t.fx_snapshot_nodes, t.fx_snapshot_edges)


NOW = 1_700_000_000


def _restored(t, back=None):
    # Some planned nodes and notes exist already.
    have = t.fx_snapshot_nodes.where("is_virtual AND seq % 4 = 0").select(
        "id", F.lit("older").alias("label"), "type", F.lit("k").alias("virtual_class_id"), F.lit("x").alias("virtual_directory"), F.lit(1).alias("materialized"))
    virtual = t.fx_virtual_nodes.select(*have.columns, "created_at").unionByName(have.withColumn("created_at", F.lit(None).cast("bigint")))
    notes = t.fx_node_annotations.withColumn("code_snippet", F.concat(F.lit("code of "), "node_id")).withColumn("created_at", F.col("updated_at") - 1)
    return S.restore(t.fx_snapshot_nodes, t.fx_snapshot_edges, t.fx_symbols, t.fx_method_calls, virtual, notes, t.fx_edge_annotations, now=NOW, back=back)


@query("snapshot_restore", """
    SELECT id, label, type, coalesce(virtual_class_id, '') AS virtual_class_id, coalesce(virtual_directory, '') AS virtual_directory,
      materialized = 1 AS materialized FROM fx_virtual_nodes
    UNION ALL SELECT n.id, n.label, n.type, coalesce(p.id, ''), '', false FROM fx_snapshot_nodes n
      LEFT JOIN ox_sn_virtual p ON p.snapshot_id = n.snapshot_id AND p.id = n.parent_id WHERE n.is_virtual""")
def snapshot_restore_nodes(t):
    rows = _restored(t)["virtual_nodes"]
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("virtual_class_id", "virtual_directory")]
    return rows.select("id", "label", "type", *blank, "materialized")


@query("snapshot_restore_annotations", f"""
    WITH said AS (SELECT n.id, arg_max(n.description, concat(n.snapshot_id, chr(1), CASE WHEN n.is_virtual THEN '0' ELSE '1' END, lpad(cast(n.seq AS string), 12, '0'))) AS description,
        arg_max(n.ai_remarks, concat(n.snapshot_id, chr(1), CASE WHEN n.is_virtual THEN '0' ELSE '1' END, lpad(cast(n.seq AS string), 12, '0'))) AS ai_remarks
      FROM fx_snapshot_nodes n LEFT JOIN ox_sn_known k ON k.snapshot_id = n.snapshot_id AND k.id = n.id
      WHERE (n.description <> '' OR n.ai_remarks <> '') AND (n.is_virtual OR k.id IS NOT NULL) GROUP BY n.id)
    SELECT coalesce(s.id, a.node_id) AS node_id, CASE WHEN s.id IS NULL THEN a.description ELSE s.description END AS description,
      CASE WHEN s.id IS NULL THEN a.ai_remarks ELSE s.ai_remarks END AS ai_remarks, CASE WHEN a.node_id IS NULL THEN '' ELSE concat('code of ', a.node_id) END AS code_snippet,
      coalesce(a.updated_at - 1, {NOW}) AS created_at, CASE WHEN s.id IS NULL THEN a.updated_at ELSE {NOW} END AS updated_at
    FROM said s FULL JOIN fx_node_annotations a ON a.node_id = s.id""")
def snapshot_restore_annotations(t):
    notes = _restored(t)["node_annotations"]
    return notes.withColumn("code_snippet", F.coalesce("code_snippet", F.lit("")))


@query("snapshot_restore_edges", """
    SELECT 'call' AS part, concat(caller_id, '::', callee_id) AS edge_id, count(*) AS n, '' AS remarks FROM (
      SELECT caller_id, callee_id FROM fx_method_calls UNION ALL SELECT caller_id, callee_id FROM ox_sn_missing) c GROUP BY 2
    UNION ALL SELECT 'remark', coalesce(a.edge_id, r.edge_id), coalesce(a.call_count, 0), coalesce(r.remarks, a.remarks)
    FROM fx_edge_annotations a FULL JOIN (SELECT concat(source_id, '::', target_id) AS edge_id,
        arg_max(remarks, concat(snapshot_id, chr(1), lpad(cast(seq AS string), 12, '0'))) AS remarks
      FROM ox_sn_restorable WHERE remarks <> '' GROUP BY 1) r ON r.edge_id = a.edge_id""")
def snapshot_restore_edges(t):
    out = _restored(t, stored(S.restorable_edges(t.fx_snapshot_nodes, t.fx_snapshot_edges, t.fx_symbols)))
    calls = out["method_calls"].groupBy(ids.edge_id(F.col("caller_id"), F.col("callee_id")).alias("edge_id")).agg(F.count(F.lit(1)).alias("n"))
    return calls.select(F.lit("call").alias("part"), "edge_id", "n", F.lit("").alias("remarks")).unionByName(
        out["edge_annotations"].select(F.lit("remark").alias("part"), "edge_id", F.col("call_count").cast("bigint").alias("n"), "remarks"))


@query("snapshot_capture", f"""
    SELECT 'node' AS part, concat('view', line % 7) AS snapshot_id, id, CASE WHEN NOT is_virtual AND type IN ('class', 'interface') AND line = 0
      AND file_path <> '' AND label = {BASENAME.format('file_path')} THEN 'file' ELSE type END AS type, concat(description, '|', ai_remarks) AS text FROM ox_nodes
    UNION ALL SELECT 'edge', 'view0', e.edge_id, '', coalesce(a.remarks, '') FROM ox_edges e LEFT JOIN fx_edge_annotations a ON a.edge_id = e.edge_id""")
def snapshot_capture(t):
    nodes = N.with_parents(all_nodes(t)).withColumn("snapshot_id", F.concat(F.lit("view"), (F.col("line") % 7).cast("string"))).withColumn("seq", F.xxhash64("id"))
    shown = E.annotate_edges(all_edges(t), t.fx_edge_annotations).withColumn("snapshot_id", F.lit("view0")).withColumn("seq", F.xxhash64("edge_id"))
    got, linked = S.capture(nodes, shown)
    return got.select(F.lit("node").alias("part"), "snapshot_id", "id", "type", F.concat_ws("|", "description", "ai_remarks").alias("text")).unionByName(
        linked.select(F.lit("edge").alias("part"), "snapshot_id", ids.edge_id(F.col("source_id"), F.col("target_id")).alias("id"), F.lit("").alias("type"), F.col("remarks").alias("text")))


oracle_view("ox_sn_resolved", """
    SELECT n.snapshot_id, n.seq, n.id, n.is_virtual, coalesce(f.id, d1.id, d2.id, f1.id, f2.id, n.id) AS resolved_id,
      coalesce(f.label, d1.name, d2.name, f1.name, f2.name, n.label) AS r_label,
      CASE WHEN f.id IS NOT NULL THEN f.type WHEN d1.id IS NOT NULL OR d2.id IS NOT NULL THEN 'directory'
        WHEN f1.id IS NOT NULL OR f2.id IS NOT NULL THEN 'class' WHEN n.type = 'file' THEN 'class' ELSE n.type END AS r_type,
      coalesce(f.id, d1.id, d2.id, f1.id, f2.id) IS NULL AS stale,
      CASE WHEN f.id IS NOT NULL THEN f.description ELSE n.description END AS r_description
    FROM (SELECT *, NOT is_virtual AND type = 'directory' AS isd, NOT is_virtual AND (type = 'file' OR (type IN ('class', 'interface') AND file_path <> '' AND line = 0)) AS isf
      FROM fx_snapshot_nodes) n
    LEFT JOIN ox_nodes f ON f.id = n.id LEFT JOIN ox_dirs d1 ON isd AND d1.id = n.id LEFT JOIN ox_dirs d2 ON isd AND d2.path = n.file_path
    LEFT JOIN ox_files f1 ON isf AND f1.id = n.id LEFT JOIN ox_files f2 ON isf AND f2.path = n.file_path""")
oracle_view("ox_sn_pairs", """
    SELECT *, row_number() OVER (PARTITION BY snapshot_id, source, target ORDER BY seq) AS rn FROM (
      SELECT e.snapshot_id, e.seq, coalesce(a.rid, e.source_id) AS source, coalesce(b.rid, e.target_id) AS target, e.remarks
      FROM fx_snapshot_edges e
      LEFT JOIN (SELECT snapshot_id, id, arg_max(resolved_id, concat(CASE WHEN is_virtual THEN '0' ELSE '1' END, lpad(cast(seq AS string), 12, '0'))) AS rid FROM ox_sn_resolved GROUP BY 1, 2) a
        ON a.snapshot_id = e.snapshot_id AND a.id = e.source_id
      LEFT JOIN (SELECT snapshot_id, id, arg_max(resolved_id, concat(CASE WHEN is_virtual THEN '0' ELSE '1' END, lpad(cast(seq AS string), 12, '0'))) AS rid FROM ox_sn_resolved GROUP BY 1, 2) b
        ON b.snapshot_id = e.snapshot_id AND b.id = e.target_id) m
    WHERE EXISTS (SELECT 1 FROM ox_sn_resolved r WHERE r.snapshot_id = m.snapshot_id AND r.resolved_id = m.source)
      AND EXISTS (SELECT 1 FROM ox_sn_resolved r WHERE r.snapshot_id = m.snapshot_id AND r.resolved_id = m.target)""")


def _reconciled(t):
    files = N.files_of(N.real_nodes(t.fx_symbols))
    return S.reconcile_nodes(t.fx_snapshot_nodes, all_nodes(t), files, N.directories_of(files))


@query("snapshot_reconcile_nodes", """
    SELECT snapshot_id, id, resolved_id, r_label, r_type, stale, r_description, row_number() OVER (
      PARTITION BY snapshot_id, resolved_id ORDER BY NOT is_virtual, seq) = 1 AS first FROM ox_sn_resolved""")
def snapshot_reconcile_nodes(t):
    return _reconciled(t).select("snapshot_id", "id", "resolved_id", "r_label", "r_type", "stale", "r_description", "first")


@query("snapshot_reconcile_edges", """
    SELECT p.snapshot_id, concat(p.source, '::', p.target) AS edge_id, p.source, p.target, coalesce(e.call_count, 1) AS call_count,
      coalesce(nullif(a.remarks, ''), p.remarks) AS remarks, e.edge_id IS NULL AS stale
    FROM ox_sn_pairs p LEFT JOIN ox_edges e ON e.edge_id = concat(p.source, '::', p.target)
      LEFT JOIN fx_edge_annotations a ON a.edge_id = e.edge_id WHERE p.rn = 1""")
def snapshot_reconcile_edges(t):
    fresh = E.annotate_edges(all_edges(t), t.fx_edge_annotations)
    return S.reconcile_edges(t.fx_snapshot_edges, cut_lineage(_reconciled(t)), fresh)


@query("snapshot_codec", """
    SELECT event_id, 0 AS pos, concat('e', event_id) AS id, event_type AS label, cast(json_extract_string(props, '$.k') AS int) AS line, event_id % 2 = 0 AS is_virtual FROM events
    UNION ALL SELECT event_id, 1, concat('f', event_id), '', 0, false FROM events""")
def snapshot_codec(t):
    key = F.col("event_id").cast("string")
    one = F.struct(F.concat(F.lit("e"), key).alias("id"), F.col("event_type").alias("label"), F.get_json_object("props", "$.k").cast("int").alias("line"),
                   (F.col("event_id") % 2 == 0).alias("isVirtual"))
    two = F.struct(F.concat(F.lit("f"), key).alias("id"), F.lit("").alias("label"), F.lit(0).alias("line"), F.lit(False).alias("isVirtual"))
    text = t.events.select("event_id", codec.encode(F.array(one, two)).alias("nodes"))
    return codec.decode_nodes(text, "event_id", "nodes").select("event_id", "pos", "id", "label", "line", "is_virtual")


@query("snapshot_tree", """
    WITH RECURSIVE v AS (SELECT * FROM fx_snapshot_nodes WHERE is_virtual),
      tree AS (SELECT snapshot_id, id, label, 0 AS depth, false AS flat FROM v WHERE parent_id = ''
        UNION ALL SELECT c.snapshot_id, c.id, c.label, p.depth + 1, false FROM tree p JOIN v c ON c.snapshot_id = p.snapshot_id AND c.parent_id = p.id)
    SELECT snapshot_id, id, label, depth, flat FROM tree
    UNION ALL SELECT snapshot_id, id, label, 0, true FROM v WHERE snapshot_id NOT IN (SELECT snapshot_id FROM v WHERE parent_id = '')""")
def snapshot_tree(t):
    return report.virtual_tree(t.fx_snapshot_nodes).select("snapshot_id", "id", "label", "depth", "flat")


oracle_view("ox_sn_label", "SELECT snapshot_id, id, arg_max(label, concat(CASE WHEN is_virtual THEN '0' ELSE '1' END, lpad(cast(seq AS string), 12, '0'))) AS label FROM fx_snapshot_nodes GROUP BY 1, 2")


def _reported(t):
    """Lines of all reports, and how many each has at most; reports go through nodes and edges again and again, so the views are worked out once."""
    nodes, edges = stored(t.fx_snapshot_nodes), stored(t.fx_snapshot_edges)
    snapshots = nodes.select(F.col("snapshot_id").alias("id")).distinct().withColumn("name", F.lit(""))
    return report.report_lines(snapshots, nodes, edges), report.most_lines(nodes, edges)


@query("snapshot_report", """
    SELECT e.snapshot_id, 'relation' AS kind, concat('- `', coalesce(nullif(a.label, ''), e.source_id), '` → `', coalesce(nullif(b.label, ''), e.target_id), '`',
      CASE WHEN sv.id IS NOT NULL AND tv.id IS NOT NULL THEN ' (virtual → virtual)' WHEN sv.id IS NOT NULL THEN ' (virtual → context)'
        WHEN tv.id IS NOT NULL THEN ' (context → virtual)' ELSE '' END, CASE WHEN e.remarks <> '' THEN concat(' — ', e.remarks) ELSE '' END) AS line
    FROM fx_snapshot_edges e LEFT JOIN ox_sn_label a ON a.snapshot_id = e.snapshot_id AND a.id = e.source_id
    LEFT JOIN ox_sn_label b ON b.snapshot_id = e.snapshot_id AND b.id = e.target_id
    LEFT JOIN ox_sn_virtual sv ON sv.snapshot_id = e.snapshot_id AND sv.id = e.source_id
    LEFT JOIN ox_sn_virtual tv ON tv.snapshot_id = e.snapshot_id AND tv.id = e.target_id
    UNION ALL SELECT snapshot_id, 'context', concat('- **', label, '**', CASE WHEN line > 0 THEN concat(' (line ', line, ')') ELSE '' END, ' — ', type,
      CASE WHEN description <> '' THEN concat(': ', description) ELSE '' END) FROM fx_snapshot_nodes WHERE NOT is_virtual
    UNION ALL SELECT DISTINCT snapshot_id, 'file', concat('**File:** `', CASE WHEN file_path = '' THEN '(no file)' ELSE file_path END, '`') FROM fx_snapshot_nodes WHERE NOT is_virtual""")
def snapshot_report(t):
    lines = _reported(t)[0]
    return lines.where(F.col("kind").isin("relation", "context", "file")).select("snapshot_id", "kind", "line")


@query("snapshot_report_outline", """
    SELECT snapshot_id, concat('**Summary:** ', concat_ws(', ', CASE WHEN v > 0 THEN concat(v, ' virtual node(s)') END,
      CASE WHEN c > 0 THEN concat(c, ' context node(s)') END, CASE WHEN e > 0 THEN concat(e, ' relationship(s)') END), '.') AS line
    FROM (SELECT n.snapshot_id, count(*) FILTER (WHERE is_virtual) AS v, count(*) FILTER (WHERE NOT is_virtual) AS c,
      (SELECT count(*) FROM fx_snapshot_edges e WHERE e.snapshot_id = n.snapshot_id) AS e FROM fx_snapshot_nodes n GROUP BY n.snapshot_id) x""")
def snapshot_report_outline(t):
    lines = _reported(t)[0]
    return lines.where(F.col("kind") == "summary").select("snapshot_id", "line")


oracle_view("ox_sn_head", """
    SELECT n.snapshot_id, count(*) FILTER (WHERE is_virtual) AS v, count(*) FILTER (WHERE NOT is_virtual) AS c,
      (SELECT count(*) FROM fx_snapshot_edges e WHERE e.snapshot_id = n.snapshot_id) AS e FROM fx_snapshot_nodes n GROUP BY n.snapshot_id""")
oracle_view("ox_sn_walk", """
    WITH RECURSIVE v AS (SELECT * FROM fx_snapshot_nodes WHERE is_virtual),
      tree AS (SELECT v.*, 0 AS depth, [label, id] AS k FROM v WHERE parent_id = ''
        UNION ALL SELECT c.*, p.depth + 1, list_concat(p.k, [c.label, c.id]) FROM tree p JOIN v c ON c.snapshot_id = p.snapshot_id AND c.parent_id = p.id)
    SELECT *, false AS flat, 0 AS nr FROM tree
    UNION ALL SELECT *, 0, [lpad(cast(seq AS string), 20, '0')], true, row_number() OVER (PARTITION BY snapshot_id ORDER BY seq) FROM v
      WHERE snapshot_id NOT IN (SELECT snapshot_id FROM v WHERE parent_id = '')""")
oracle_view("ox_sn_edge", """
    SELECT e.*, coalesce(nullif(a.label, ''), e.source_id) AS source_label, coalesce(nullif(b.label, ''), e.target_id) AS target_label, sv.id IS NOT NULL AS source_virtual, tv.id IS NOT NULL AS target_virtual
    FROM fx_snapshot_edges e LEFT JOIN ox_sn_label a ON a.snapshot_id = e.snapshot_id AND a.id = e.source_id
    LEFT JOIN ox_sn_label b ON b.snapshot_id = e.snapshot_id AND b.id = e.target_id
    LEFT JOIN ox_sn_virtual sv ON sv.snapshot_id = e.snapshot_id AND sv.id = e.source_id
    LEFT JOIN ox_sn_virtual tv ON tv.snapshot_id = e.snapshot_id AND tv.id = e.target_id""")


def _fixed(section: int, lines: list[tuple[str, str]]) -> str:
    """SQL for lines of each snapshot's head: text and condition."""
    return "\n    UNION ALL ".join(
        f"SELECT snapshot_id, {section} AS section, []::VARCHAR[] AS k, {step} AS step, {text} AS line FROM ox_sn_head WHERE {cond}" for step, (text, cond) in enumerate(lines))


def _said(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TITLES = [
    (1, report.PLANNED_TITLE, report.NO_PLANNED, report.PLANNED_INTRO, "v"), (3, report.CONTEXT_TITLE, report.NO_CONTEXT, report.CONTEXT_INTRO, "c"),
    (5, report.RELATION_TITLE, report.NO_RELATION, report.RELATION_INTRO, "e")]
_SUMMARY = """concat('**Summary:** ', concat_ws(', ', CASE WHEN v > 0 THEN concat(v, ' virtual node(s)') END, CASE WHEN c > 0 THEN concat(c, ' context node(s)') END,
      CASE WHEN e > 0 THEN concat(e, ' relationship(s)') END), '.')"""
_PLANNED = [  # step, text, condition
    (0, "concat('### 📁 ', label, ' *(virtual directory)*')", "NOT flat AND depth = 0"), (1, "''", "NOT flat AND depth = 0"),
    (2, "concat('#### 📦 ', label, ' *(virtual class)*')", "NOT flat AND depth = 1"), (3, "concat('##### ', label, ' *(virtual ', type, ')*')", "NOT flat AND depth > 1"),
    (4, "concat('### ', nr, '. ', label, ' *(virtual)*')", "flat"), (5, "concat(CASE WHEN flat THEN '- **Type:** ' ELSE '- Type: ' END, type)", "flat OR depth > 1"),
    (6, "concat(CASE WHEN flat THEN '- **Target file:** `' ELSE '- Target file: `' END, file_path, '`')", "(flat OR depth > 1) AND file_path <> ''"),
    (7, "concat(CASE WHEN flat THEN '- **Description:** ' ELSE '- Description: ' END, description)", "description <> ''"), (8, "''", "NOT flat AND depth = 0 AND description <> ''"),
    (9, "concat(CASE WHEN flat THEN '- **AI Remarks:** ' ELSE '- AI Remarks: ' END, ai_remarks)", "ai_remarks <> '' AND (flat OR depth > 0)"), (99, "''", "flat OR depth > 0")]
_WALKED = "\n    UNION ALL ".join(f"SELECT snapshot_id, 2, k, {step}, {text} FROM ox_sn_walk WHERE {cond}" for step, text, cond in _PLANNED)


@query("snapshot_report_lines", f"""
    WITH all_lines AS (
    {_fixed(0, [("concat('# Graph Snapshot: ', snapshot_id)", "true"), ("''", "true"), (_SUMMARY, "true"), ("''", "true"), (_said(report.ADVICE), "true"), ("''", "true"), ("'---'", "true"), ("''", "true")])}
    UNION ALL {" UNION ALL ".join(_fixed(s, [(_said(title), "true"), ("''", "true"), (_said(none), f"{n} = 0"), (_said(intro), f"{n} > 0"), ("''", "true")]) for s, title, none, intro, n in _TITLES)}
    UNION ALL {_fixed(7, [("''", "e > 0")])}
    UNION ALL {_fixed(8, [("'---'", "true"), ("''", "true"), (_said(report.USAGE), "true")])}
    UNION ALL {_WALKED}
    UNION ALL SELECT w.snapshot_id, 2, w.k, 10, concat(CASE WHEN flat THEN '- **Related:** ' ELSE '- Related: ' END, r.line) FROM ox_sn_walk w JOIN (
        SELECT snapshot_id, source_id AS id, concat('→ ', target_label, CASE WHEN target_virtual THEN ' (virtual)' ELSE '' END) AS line FROM ox_sn_edge
        UNION ALL SELECT snapshot_id, target_id, concat('← ', source_label, CASE WHEN source_virtual THEN ' (virtual)' ELSE '' END) FROM ox_sn_edge WHERE source_id <> target_id) r
      ON r.snapshot_id = w.snapshot_id AND r.id = w.id WHERE flat OR depth > 0
    UNION ALL SELECT DISTINCT snapshot_id, 4, [f, ''], 0, concat('**File:** `', f, '`') FROM (SELECT *, CASE WHEN file_path = '' THEN '(no file)' ELSE file_path END AS f FROM fx_snapshot_nodes WHERE NOT is_virtual) x
    UNION ALL SELECT snapshot_id, 4, [CASE WHEN file_path = '' THEN '(no file)' ELSE file_path END, lpad(cast(seq AS string), 20, '0')], 0,
      concat('- **', label, '**', CASE WHEN line > 0 THEN concat(' (line ', line, ')') ELSE '' END, ' — ', type, CASE WHEN description <> '' THEN concat(': ', description) ELSE '' END) FROM fx_snapshot_nodes WHERE NOT is_virtual
    UNION ALL SELECT DISTINCT snapshot_id, 4, [CASE WHEN file_path = '' THEN '(no file)' ELSE file_path END, '~'], 0, '' FROM fx_snapshot_nodes WHERE NOT is_virtual
    UNION ALL SELECT snapshot_id, 6, [lpad(cast(seq AS string), 20, '0')], 0, concat('- `', source_label, '` → `', target_label, '`',
      CASE WHEN source_virtual AND target_virtual THEN ' (virtual → virtual)' WHEN source_virtual THEN ' (virtual → context)' WHEN target_virtual THEN ' (context → virtual)' ELSE '' END,
      CASE WHEN remarks <> '' THEN concat(' — ', remarks) ELSE '' END) FROM ox_sn_edge)
    SELECT snapshot_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY section, k, step, line) AS line_no, line FROM all_lines""")
def snapshot_report_lines(t):
    """All lines of all reports, in order."""
    lines, most = _reported(t)
    return report.numbered_lines(lines, most).select("snapshot_id", "line_no", "line")
