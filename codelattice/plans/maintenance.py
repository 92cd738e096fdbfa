"""Queries on table maintenance and change data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codelattice.functions import ids, paths
from codelattice.operators import index as I
from codelattice.plans.graph import HASH
from codelattice.plans.registry import oracle_view, query
from codelattice.session import checkpoint_dir
from codelattice.sources import folders

EDGE = "concat(caller_id, '::', callee_id)"


@query("upsert_last_wins", """
    SELECT edge_id, remarks, seq FROM (
      SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY seq DESC) AS rn FROM fx_edge_annotation_writes) x WHERE rn = 1""")
def upsert_last_wins(t):
    writes = t.fx_edge_annotation_writes.select("edge_id", "remarks", "seq")
    half = F.col("seq") % 2 == 0
    stored = I.last_per_key(writes.where(half), ["edge_id"], "seq")
    # The stored half first, then the whole log on top of it.
    return I.upsert_last_wins(stored, writes, ["edge_id"], "seq")


@query("upsert_keep_created", """
    SELECT edge_id, max_by(remarks, seq) AS remarks, max(seq) AS updated_at, min(seq) AS created_at
    FROM fx_edge_annotation_writes GROUP BY edge_id""")
def upsert_keep_created(t):
    writes = t.fx_edge_annotation_writes.select("edge_id", "remarks", F.col("seq").alias("updated_at"), F.col("seq").alias("created_at"))
    return I.upsert_keep_created(writes, ["edge_id"], "updated_at", "created_at")


oracle_view("ox_patches", """
    SELECT concat('p', cast(o_custkey AS string)) AS node_id, o_orderkey AS seq,
      CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN '' END AS description,
      CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus END AS ai_remarks FROM orders""")


@query("annotation_patch", """
    SELECT coalesce(a.node_id, p.node_id) AS node_id,
      CASE WHEN p.d IS NOT NULL THEN p.d ELSE coalesce(a.description, '') END AS description,
      CASE WHEN p.r IS NOT NULL THEN p.r ELSE coalesce(a.ai_remarks, '') END AS ai_remarks, a.updated_at
    FROM fx_node_annotations a FULL JOIN (
      SELECT node_id, arg_max(description, seq) FILTER (WHERE description IS NOT NULL) AS d,
        arg_max(ai_remarks, seq) FILTER (WHERE ai_remarks IS NOT NULL) AS r FROM ox_patches GROUP BY node_id) p
    ON p.node_id = a.node_id""")
def annotation_patch(t):
    key = F.col("o_orderkey")
    patches = t.orders.select(
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("node_id"), key.alias("seq"),
        F.when(key % 3 == 0, F.col("o_orderpriority")).when(key % 3 == 1, "").alias("description"),
        F.when(key % 4 == 0, F.col("o_orderstatus")).alias("ai_remarks"),
    )
    return I.patch_annotations(t.fx_node_annotations, patches, ["description", "ai_remarks"], "seq")


@query("node_patch", """
    SELECT id, CASE WHEN n % 3 = 0 THEN concat('Renamed', n) ELSE label END AS label,
      CASE WHEN n % 2 = 0 AND n % 5 = 0 THEN 'class' ELSE type END AS type,
      CASE WHEN n % 2 = 0 OR n % 3 = 0 THEN '' ELSE coalesce(virtual_class_id, '') END AS virtual_class_id,
      CASE WHEN n % 2 = 0 THEN concat('moved/', n) WHEN n % 3 = 0 THEN '' ELSE coalesce(virtual_directory, '') END AS virtual_directory,
      CASE WHEN n % 2 = 0 THEN true ELSE materialized = 1 END AS materialized
    FROM (SELECT *, created_at AS n FROM fx_virtual_nodes) x""")
def node_patch(t):
    n = F.col("created_at")
    virtual = t.fx_virtual_nodes.withColumn("materialized", F.col("materialized") == 1)
    patches = virtual.where((n % 2 == 0) | (n % 3 == 0)).select(
        "id", F.when(n % 3 == 0, F.concat(F.lit("Renamed"), n.cast("string"))).otherwise("").alias("label"),
        F.when((n % 2 == 0) & (n % 5 == 0), "class").otherwise("").alias("type"), F.lit("").alias("virtual_class_id"),
        F.when(n % 2 == 0, F.concat(F.lit("moved/"), n.cast("string"))).otherwise("").alias("virtual_directory"),
        F.when(n % 2 == 0, F.lit(True)).alias("materialized"),
    )
    out = I.patch_nodes(virtual, patches)
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("virtual_class_id", "virtual_directory")]
    return out.select("id", "label", "type", *blank, "materialized")


@query("edges_append", """
    SELECT caller_id, callee_id, call_type, count(*) AS n FROM (
      SELECT * FROM fx_method_calls UNION ALL SELECT * FROM fx_mixed_calls) x GROUP BY caller_id, callee_id, call_type""")
def edges_append(t):
    table = I.append_calls(t.fx_method_calls, t.fx_mixed_calls)
    return table.groupBy("caller_id", "callee_id", "call_type").agg(F.count(F.lit(1)).alias("n"))


oracle_view("ox_scan", """
    SELECT CASE WHEN seq % 7 = 0 THEN concat('p', cast(seq + 1 AS string)) ELSE id END AS id, name, file_path, seq FROM fx_symbols""")


def _scan(t):
    dup = F.when(F.col("seq") % 7 == 0, F.concat(F.lit("p"), (F.col("seq") + 1).cast("string"))).otherwise(F.col("id"))
    return t.fx_symbols.select(dup.alias("id"), "name", "file_path", "seq")


@query("index_replace", """
    SELECT 'symbol' AS part, id AS a, name AS b, 1 AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM ox_scan) x WHERE rn = 1
    UNION ALL SELECT 'call', caller_id, callee_id, count(*) FROM (
      SELECT * FROM fx_method_calls WHERE call_type = 'manual' UNION ALL SELECT * FROM fx_mixed_calls) y GROUP BY caller_id, callee_id""")
def index_replace(t):
    symbols, calls = I.replace_index(t.fx_method_calls, _scan(t), t.fx_mixed_calls, "seq")
    counted = calls.groupBy("caller_id", "callee_id").agg(F.count(F.lit(1)).alias("n"))
    return symbols.select(F.lit("symbol").alias("part"), F.col("id").alias("a"), F.col("name").alias("b"), F.lit(1).cast("bigint").alias("n")).unionByName(
        counted.select(F.lit("call").alias("part"), F.col("caller_id").alias("a"), F.col("callee_id").alias("b"), "n")
    )


@query("index_replace_rebuild", "SELECT caller_id, callee_id, count(*) AS n FROM fx_mixed_calls GROUP BY caller_id, callee_id")
def index_replace_rebuild(t):
    _, calls = I.replace_index(t.fx_method_calls, _scan(t), t.fx_mixed_calls, "seq", rebuild=True)
    return calls.groupBy("caller_id", "callee_id").agg(F.count(F.lit(1)).alias("n"))


@query("index_clear", "SELECT caller_id, callee_id, count(*) AS n FROM fx_method_calls WHERE file_path = '' GROUP BY caller_id, callee_id")
def index_clear(t):
    _, calls = I.clear_index(t.fx_symbols, t.fx_method_calls)
    return calls.groupBy("caller_id", "callee_id").agg(F.count(F.lit(1)).alias("n"))


@query("file_purge", """
    SELECT 'symbol' AS part, id AS key, 1 AS n FROM fx_symbols WHERE file_path NOT IN (SELECT file_path FROM fx_symbols WHERE line = 1)
    UNION ALL SELECT 'call', file_path, count(*) FROM fx_method_calls WHERE file_path NOT LIKE '%7.java' GROUP BY file_path""")
def file_purge(t):
    files = t.fx_symbols.where("line = 1").select("file_path")
    touched = t.fx_method_calls.where(F.col("file_path").endswith("7.java")).select("file_path").distinct()
    symbols = I.purge_files(t.fx_symbols, files).select(F.lit("symbol").alias("part"), F.col("id").alias("key"), F.lit(1).cast("bigint").alias("n"))
    calls = I.purge_files(t.fx_method_calls, touched).groupBy(F.col("file_path").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return symbols.unionByName(calls.select(F.lit("call").alias("part"), "key", "n"))


oracle_view("ox_gone_edges", f"SELECT DISTINCT {EDGE} AS edge_id FROM fx_method_calls WHERE line % 2 = 0 UNION SELECT edge_id FROM fx_edge_annotations WHERE updated_at % 3 = 0")


@query("manual_edge_delete", f"""
    SELECT 'call' AS part, {EDGE} AS edge_id, count(*) AS n FROM fx_method_calls
    WHERE NOT (call_type = 'manual' AND {EDGE} IN (SELECT edge_id FROM ox_gone_edges)) GROUP BY 2
    UNION ALL SELECT 'remark', edge_id, 1 FROM fx_edge_annotations WHERE edge_id NOT IN (SELECT edge_id FROM ox_gone_edges)""")
def manual_edge_delete(t):
    eid = ids.edge_id(F.col("caller_id"), F.col("callee_id")).alias("edge_id")
    gone = t.fx_method_calls.where("line % 2 = 0").select(eid).union(t.fx_edge_annotations.where("updated_at % 3 = 0").select("edge_id"))
    calls, remarks = I.delete_manual_edges(t.fx_method_calls, t.fx_edge_annotations, gone)
    return calls.groupBy(eid).agg(F.count(F.lit(1)).alias("n")).select(F.lit("call").alias("part"), "edge_id", "n").unionByName(
        remarks.select(F.lit("remark").alias("part"), "edge_id", F.lit(1).cast("bigint").alias("n"))
    )


def _parts(tables: dict, keys: dict):
    """Each table as counted keys, in one frame."""
    out = None
    for name, key in keys.items():
        rows = tables[name].groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "key", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


CALL_KEY = ids.edge_id


@query("virtual_cascade_delete", f"""
    WITH gone AS (SELECT id FROM fx_virtual_nodes WHERE created_at % 2 = 0 UNION SELECT node_id FROM fx_node_annotations WHERE updated_at % 2 = 0)
    SELECT 'virtual_nodes' AS part, id AS key, count(*) AS n FROM fx_virtual_nodes WHERE id NOT IN (SELECT id FROM gone) GROUP BY id
    UNION ALL SELECT 'node_annotations', node_id, count(*) FROM fx_node_annotations WHERE node_id NOT IN (SELECT id FROM gone) GROUP BY node_id
    UNION ALL SELECT 'edge_annotations', edge_id, count(*) FROM fx_edge_annotations WHERE source_node_id NOT IN (SELECT id FROM gone)
      AND target_node_id NOT IN (SELECT id FROM gone) GROUP BY edge_id
    UNION ALL SELECT 'method_calls', {EDGE}, count(*) FROM fx_method_calls WHERE NOT (call_type = 'manual' AND
      (caller_id IN (SELECT id FROM gone) OR callee_id IN (SELECT id FROM gone))) GROUP BY 2""")
def virtual_cascade_delete(t):
    gone = t.fx_virtual_nodes.where("created_at % 2 = 0").select("id").union(
        t.fx_node_annotations.where("updated_at % 2 = 0").select("node_id"))
    out = I.delete_virtual_cascade(t.fx_virtual_nodes, t.fx_node_annotations, t.fx_edge_annotations, t.fx_method_calls, gone)
    return _parts(out, {"virtual_nodes": F.col("id"), "node_annotations": F.col("node_id"), "edge_annotations": F.col("edge_id"),
                        "method_calls": CALL_KEY(F.col("caller_id"), F.col("callee_id"))})


@query("overlay_clear", f"""
    SELECT 'node_annotations' AS part, node_id AS key, count(*) AS n FROM (
      SELECT node_id FROM fx_node_annotations UNION ALL SELECT id FROM fx_virtual_nodes) a
      WHERE node_id NOT IN (SELECT id FROM fx_virtual_nodes) GROUP BY node_id
    UNION ALL SELECT 'edge_annotations', edge_id, count(*) FROM fx_edge_annotations
      WHERE edge_id NOT IN (SELECT {EDGE} FROM fx_method_calls WHERE call_type = 'manual')
      AND source_node_id NOT IN (SELECT id FROM fx_virtual_nodes) AND target_node_id NOT IN (SELECT id FROM fx_virtual_nodes) GROUP BY edge_id
    UNION ALL SELECT 'method_calls', {EDGE}, count(*) FROM fx_method_calls WHERE call_type <> 'manual' GROUP BY 2""")
def overlay_clear(t):
    notes = t.fx_node_annotations.select("node_id").union(t.fx_virtual_nodes.select("id"))
    out = I.clear_overlay(t.fx_virtual_nodes, notes, t.fx_edge_annotations, t.fx_method_calls, t.fx_virtual_directories)
    return _parts(out, {"virtual_nodes": F.col("id"), "virtual_directories": F.col("id"), "node_annotations": F.col("node_id"),
                        "edge_annotations": F.col("edge_id"), "method_calls": CALL_KEY(F.col("caller_id"), F.col("callee_id"))})


oracle_view("ox_endpoints", f"""
    SELECT id FROM fx_symbols UNION SELECT id FROM fx_virtual_nodes UNION SELECT {HASH.format('path')} FROM fx_virtual_directories""")


@query("manual_edge_create", """
    WITH good AS (SELECT *, concat(source_id, '::', target_id) AS edge_id FROM fx_edge_requests
        WHERE source_id IN (SELECT id FROM ox_endpoints) AND target_id IN (SELECT id FROM ox_endpoints)),
      said AS (SELECT edge_id, arg_max(remarks, request_id) AS remarks FROM good WHERE remarks <> '' GROUP BY edge_id)
    SELECT 'made' AS part, g.request_id, g.edge_id, coalesce(a.call_count, 1) AS call_count, coalesce(s.remarks, a.remarks, '') AS remarks
    FROM good g LEFT JOIN said s ON s.edge_id = g.edge_id LEFT JOIN fx_edge_annotations a ON a.edge_id = g.edge_id
    UNION ALL SELECT 'rejected', request_id, concat(source_id, '::', target_id), 0, remarks FROM fx_edge_requests
    WHERE NOT (source_id IN (SELECT id FROM ox_endpoints) AND target_id IN (SELECT id FROM ox_endpoints))""")
def manual_edge_create(t):
    known = I.endpoint_ids(t.fx_symbols, t.fx_virtual_nodes, t.fx_virtual_directories)
    made, _, rejected = I.create_manual_edges(t.fx_edge_requests, known, t.fx_edge_annotations)
    cols = ["part", "request_id", "edge_id", "call_count", "remarks"]
    bad = rejected.withColumn("edge_id", ids.edge_id(F.col("source_id"), F.col("target_id"))).withColumn("call_count", F.lit(0))
    return made.withColumn("part", F.lit("made")).select(*cols).unionByName(bad.withColumn("part", F.lit("rejected")).select(*cols))


@query("virtual_entity_create", """
    SELECT 'node' AS part, concat('vnode_', substr(sha256(concat(created_at, ':', label, ':', type)), 1, 32)) AS id, label AS name,
      coalesce(virtual_directory, '') AS path FROM fx_virtual_nodes WHERE created_at % 5 <> 0
    UNION ALL SELECT 'node_rejected', cast(created_at AS string), '', '' FROM fx_virtual_nodes WHERE created_at % 5 = 0
    UNION ALL SELECT 'dir', concat('vdir_', substr(sha256(concat(r, ':', path)), 1, 32)), path, '' FROM (
      SELECT concat('plan/new', c_custkey % 70) AS path, min(c_custkey) AS r FROM customer GROUP BY 1) d WHERE path <> 'plan/new3'
    UNION ALL SELECT 'dir_rejected', cast(c_custkey AS string), '', '' FROM customer
      WHERE c_custkey % 70 = 3 OR c_custkey NOT IN (SELECT min(c_custkey) FROM customer GROUP BY c_custkey % 70)""")
def virtual_entity_create(t):
    n, c = F.col("created_at"), F.col("c_custkey")
    asks = t.fx_virtual_nodes.select(
        n.alias("request_id"), F.when(n % 5 == 0, "").otherwise(F.col("label")).alias("label"), "type",
        F.coalesce("virtual_class_id", F.lit("")).alias("virtual_class_id"), F.coalesce("virtual_directory", F.lit("")).alias("virtual_directory"))
    nodes, bad_nodes = I.create_virtual_nodes(asks)
    path = F.concat(F.lit("plan/new"), (c % 70).cast("string"))
    wishes = t.customer.select(c.alias("request_id"), path.alias("path"), path.alias("name"), F.lit("plan").alias("parent_path"))
    have = wishes.where(F.col("path") == "plan/new3").select("path").distinct()
    dirs, bad_dirs = I.create_directories(wishes, have)
    none, rid = F.lit(""), F.col("request_id").cast("string")

    def row(df, part, key, name, where):
        return df.select(F.lit(part).alias("part"), key.alias("id"), name.alias("name"), where.alias("path"))

    return (
        row(nodes, "node", F.col("id"), F.col("label"), F.coalesce("virtual_directory", none))
        .unionByName(row(bad_nodes, "node_rejected", rid, none, none))
        .unionByName(row(dirs, "dir", F.col("id"), F.col("path"), none))
        .unionByName(row(bad_dirs, "dir_rejected", rid, none, none))
    )


@query("simple_deletes", """
    SELECT 'kept' AS part, node_id FROM fx_node_annotations WHERE node_id NOT IN (SELECT id FROM fx_symbols WHERE line < 20)
    UNION ALL SELECT 'absent', id FROM fx_symbols WHERE line < 20 AND id NOT IN (SELECT node_id FROM fx_node_annotations)""")
def simple_deletes(t):
    gone = t.fx_symbols.where("line < 20").select(F.col("id").alias("node_id"))
    kept, absent = I.delete_by_key(t.fx_node_annotations.select("node_id"), gone, "node_id")
    return kept.select(F.lit("kept").alias("part"), "node_id").unionByName(absent.select(F.lit("absent").alias("part"), "node_id"))


@query("prompt_override", """
    SELECT s.id, CASE WHEN coalesce(c.p, '') <> '' THEN c.p WHEN c.id IS NULL AND coalesce(s.custom_prompt, '') <> '' THEN s.custom_prompt
        ELSE concat('# ', s.name) END AS prompt,
      CASE WHEN c.id IS NOT NULL THEN coalesce(c.p, '') <> '' ELSE coalesce(s.custom_prompt, '') <> '' END AS is_custom
    FROM fx_snapshots s LEFT JOIN (
      SELECT id, list_last(list(p ORDER BY o_orderkey)) AS p FROM (SELECT concat('sn', o_custkey) AS id, o_orderkey,
        CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS p FROM orders WHERE o_custkey % 2 = 0) x GROUP BY id) c ON c.id = s.id""")
def prompt_override(t):
    changes = t.orders.where("o_custkey % 2 = 0").select(
        F.concat(F.lit("sn"), F.col("o_custkey").cast("string")).alias("id"), "o_orderkey",
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("prompt"))
    snapshots, _ = I.override_prompts(t.fx_snapshots, changes, "o_orderkey")
    return I.apply_prompts(snapshots, t.fx_snapshots.select("id", F.concat(F.lit("# "), "name").alias("generated")))


# --- change data ----------------------------------------------------------------------------------


@query("file_fingerprint", "SELECT doc_id, sha256(text) AS file_hash FROM documents")
def file_fingerprint(t):
    return t.documents.select("doc_id", F.sha2(F.col("text"), 256).alias("file_hash"))


@query("cache_valid", """
    SELECT coalesce(o.id, n.id) AS file_path, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'gone'
      WHEN o.body_hash = n.body_hash THEN 'same' ELSE 'changed' END AS state
    FROM fx_units_old o FULL JOIN fx_units_new n ON o.id = n.id""")
def cache_valid(t):
    cols = [F.col("id").alias("file_path"), F.col("body_hash").alias("file_hash")]
    return I.cache_state(t.fx_units_old.select(*cols), t.fx_units_new.select(*cols))


oracle_view("ox_unit_diff", """
    SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'removed'
      WHEN o.id IS NULL OR o.body_hash <> n.body_hash THEN 'changed' ELSE 'same' END AS change
    FROM (SELECT * FROM fx_units_old WHERE kind IN ('method', 'constructor', 'function')) o FULL JOIN fx_units_new n ON o.id = n.id""")


@query("unit_diff", "SELECT id, change FROM ox_unit_diff")
def unit_diff(t):
    return I.unit_diff(t.fx_units_old, t.fx_units_new)


@query("unit_diff_strict", """
    SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'removed'
      WHEN o.id IS NULL OR o.body_hash <> n.body_hash THEN 'changed' ELSE 'same' END AS change
    FROM (SELECT * FROM fx_units_old WHERE kind IN ('method', 'constructor')) o FULL JOIN fx_units_new n ON o.id = n.id""")
def unit_diff_strict(t):
    return I.unit_diff(t.fx_units_old, t.fx_units_new, strict_reference=True)


# The saved files are two of every three sources; calls run between documents.
oracle_view("ox_saved", "SELECT DISTINCT file_path, md5(file_path) AS file_hash FROM fx_units_new WHERE right(md5(file_path), 1) > '4'")
oracle_view("ox_doc_calls", """
    SELECT concat('d', cast(l_suppkey AS string)) AS caller_id, concat('d', cast(l_partkey % 1000 AS string)) AS callee_id,
      CASE l_returnflag WHEN 'R' THEN 'manual' ELSE 'direct' END AS call_type, 'f' AS file_path, l_linenumber AS line FROM lineitem""")
oracle_view("ox_delta_diff", """
    SELECT d.id, d.change FROM ox_unit_diff d LEFT JOIN fx_units_old o ON o.id = d.id LEFT JOIN fx_units_new n ON n.id = d.id
    WHERE coalesce(n.file_path, o.file_path) IN (SELECT file_path FROM ox_saved)""")


def delta_inputs(t):
    """Old tables, saved files, their symbols, the diff, and new calls."""
    files = t.fx_units_new.select("file_path").distinct().withColumn("file_hash", F.md5("file_path")).where(F.right("file_hash", F.lit(1)) > "4")
    seq = F.lit(1).alias("seq")
    old = t.fx_units_old.select("id", "kind", "file_path", "body_hash", seq)
    new = t.fx_units_new.select("id", "kind", "file_path", "body_hash", seq).join(files.select("file_path"), "file_path", "left_semi")
    diff = I.unit_diff(old.join(files.select("file_path"), "file_path", "left_semi"), new)
    calls = t.lineitem.select(
        F.concat(F.lit("d"), F.col("l_suppkey").cast("string")).alias("caller_id"),
        F.concat(F.lit("d"), (F.col("l_partkey") % 1000).cast("string")).alias("callee_id"),
        F.when(F.col("l_returnflag") == "R", "manual").otherwise("direct").alias("call_type"), F.lit("f").alias("file_path"),
        F.col("l_linenumber").alias("line"))
    changed = diff.where("change = 'changed'").select(F.col("id").alias("caller_id"))
    fresh = changed.select("caller_id", F.lit("d1").alias("callee_id"), F.lit("direct").alias("call_type"), F.lit("g").alias("file_path"), F.lit(1).alias("line"))
    manifest = old.select("file_path").distinct().withColumn("file_hash", F.lit("old"))
    return old, calls, manifest, files, new, diff, fresh


@query("file_delta_apply", """
    SELECT 'symbols' AS part, id AS key, body_hash AS value, 1 AS n FROM fx_units_new WHERE file_path IN (SELECT file_path FROM ox_saved)
    UNION ALL SELECT 'symbols', id, body_hash, 1 FROM fx_units_old WHERE file_path NOT IN (SELECT file_path FROM ox_saved)
      AND id NOT IN (SELECT id FROM fx_units_new WHERE file_path IN (SELECT file_path FROM ox_saved))
    UNION ALL SELECT 'method_calls', caller_id, callee_id, count(*) FROM (
      SELECT caller_id, callee_id FROM ox_doc_calls WHERE call_type = 'manual' OR (
        caller_id NOT IN (SELECT id FROM ox_delta_diff WHERE change IN ('changed', 'removed'))
        AND callee_id NOT IN (SELECT id FROM ox_delta_diff WHERE change = 'removed'))
      UNION ALL SELECT id, 'd1' FROM ox_delta_diff WHERE change = 'changed') c GROUP BY caller_id, callee_id
    UNION ALL SELECT 'manifest', file_path, file_hash, 1 FROM ox_saved
    UNION ALL SELECT DISTINCT 'manifest', file_path, 'old', 1 FROM fx_units_old WHERE file_path NOT IN (SELECT file_path FROM ox_saved)""")
def file_delta_apply(t):
    old, calls, manifest, files, new, diff, fresh = delta_inputs(t)
    out = I.apply_file_delta(old, calls, manifest, files, new, diff, fresh, "seq")
    one = F.lit(1).cast("bigint").alias("n")
    counted = out["method_calls"].groupBy(F.col("caller_id").alias("key"), F.col("callee_id").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return (
        out["symbols"].select(F.lit("symbols").alias("part"), F.col("id").alias("key"), F.col("body_hash").alias("value"), one)
        .unionByName(counted.select(F.lit("method_calls").alias("part"), "key", "value", "n"))
        .unionByName(out["manifest"].select(F.lit("manifest").alias("part"), F.col("file_path").alias("key"), F.col("file_hash").alias("value"), one))
    )


@query("indexed_files", """
    SELECT file_path FROM fx_symbols WHERE file_path <> '' UNION SELECT file_path FROM fx_method_calls WHERE file_path <> ''""")
def indexed_files(t):
    return I.indexed_files(t.fx_symbols, t.fx_method_calls)


@query("stale_files", """
    SELECT DISTINCT file_path FROM fx_symbols WHERE file_path NOT IN (SELECT file_path FROM fx_symbols WHERE line > 20 AND seq % 3 = 0)""")
def stale_files(t):
    corpus = t.fx_symbols.where("line > 20 AND seq % 3 = 0").select("file_path")
    return I.stale_files(I.indexed_files(t.fx_symbols, t.fx_symbols), corpus)


@query("mark_materialised", """
    SELECT id, materialized = 1 OR label IN (SELECT name FROM fx_symbols WHERE file_path LIKE '%1.java') AS materialized FROM fx_virtual_nodes""")
def mark_materialised(t):
    built = t.fx_symbols.where(F.col("file_path").endswith("1.java"))
    return I.mark_materialised(t.fx_virtual_nodes, built).select("id", "materialized")


# --- corpus ---------------------------------------------------------------------------------------

KNOWN = "('.go', '.java', '.js', '.jsx', '.mjs', '.cjs', '.py', '.ts', '.tsx', '.mts', '.cts')"
EXT = "lower(regexp_extract({0}, '(\\.[^./]*)$', 1))"


@query("corpus_scan", f"""
    SELECT path FROM fx_paths WHERE {EXT.format('path')} IN {KNOWN}
      AND NOT regexp_matches(path, '/(\\.[^/]*|node_modules|target|build)/')""")
def corpus_scan(t):
    from codelattice.sources.corpus import source_paths

    return source_paths(t.fx_paths, "/ws").select("path")


@query("language_route", f"""
    SELECT path, CASE {EXT.format('path')} WHEN '.go' THEN 'go' WHEN '.java' THEN 'java' WHEN '.py' THEN 'python'
      WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.mjs' THEN 'javascript' WHEN '.cjs' THEN 'javascript'
      ELSE 'typescript' END AS language
    FROM fx_paths WHERE {EXT.format('path')} IN {KNOWN}""")
def language_route(t):
    return t.fx_paths.select("path", paths.language_of(F.col("path")).alias("language")).where(F.col("language").isNotNull())


@query("workspace_inventory", f"""
    WITH f AS (SELECT substr(path, 5) AS path FROM fx_paths WHERE NOT regexp_matches(path, '/\\.[^/]*/')),
      d AS (SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS path
        FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS i FROM f) x)
    SELECT 'directory' AS part, {HASH.format('path')} AS id, path, regexp_extract(path, '([^/]*)$', 1) AS name, '' AS directory FROM d
    UNION ALL SELECT 'file', {HASH.format('path')}, path, regexp_extract(path, '([^/]*)$', 1), {HASH.format("regexp_extract(path, '^(.*)/[^/]*$', 1)")}
    FROM f WHERE {EXT.format('path')} IN {KNOWN}""")
def workspace_inventory(t):
    from codelattice.sources.corpus import workspace_inventory as inventory

    dirs, files = inventory(t.fx_paths, "/ws")
    return dirs.select(F.lit("directory").alias("part"), "id", "path", "name", F.lit("").alias("directory")).unionByName(
        files.select(F.lit("file").alias("part"), "id", "path", "name", "directory"))


def _workspace(t) -> str:
    """The files of ``fx_paths``, each with its path as text, written to a folder that all executors share."""
    root = f"{checkpoint_dir(t.spark).rstrip('/')}/ws-{uuid.uuid4().hex}"
    folders.write_files(t.fx_paths.select(F.substr("path", F.lit(5)).alias("path"), F.col("path").alias("text")), root)
    return root


@query("corpus_read", f"""
    SELECT substr(path, 5) AS path, CASE {EXT.format('path')} WHEN '.go' THEN 'go' WHEN '.java' THEN 'java' WHEN '.py' THEN 'python'
      WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.mjs' THEN 'javascript' WHEN '.cjs' THEN 'javascript'
      ELSE 'typescript' END AS language, octet_length(encode(path)) AS length, sha256(path) AS file_hash, path AS text
    FROM fx_paths WHERE {EXT.format('path')} IN {KNOWN} AND NOT regexp_matches(path, '/(\\.[^/]*|node_modules|target|build)/')""")
def corpus_read(t):
    """Source files read back from a folder tree that was written first."""
    root = _workspace(t)
    found = folders.read_sources(t.spark, root)
    return found.withColumn("path", F.substr("path", F.lit(len(folders.opened(root)[1]) + 2)))


@query("workspace_listing", f"""
    WITH f AS (SELECT substr(path, 5) AS path FROM fx_paths WHERE NOT regexp_matches(path, '/\\.[^/]*/')),
      d AS (SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS path
        FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS i FROM f) x)
    SELECT 'directory' AS part, {HASH.format('path')} AS id, path, regexp_extract(path, '([^/]*)$', 1) AS name, '' AS directory FROM d
    UNION ALL SELECT 'file', {HASH.format('path')}, path, regexp_extract(path, '([^/]*)$', 1), {HASH.format("regexp_extract(path, '^(.*)/[^/]*$', 1)")}
    FROM f WHERE {EXT.format('path')} IN {KNOWN}""")
def workspace_listing(t):
    """Folders and files listed from a folder tree that was written first."""
    dirs, files = folders.list_workspace(t.spark, _workspace(t))
    return dirs.select(F.lit("directory").alias("part"), "id", "path", "name", F.lit("").alias("directory")).unionByName(
        files.select(F.lit("file").alias("part"), "id", "path", "name", "directory"))
