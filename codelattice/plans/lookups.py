"""Lookups, searches and small projections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codelattice.functions import coerce, ids, paths
from codelattice.operators import lookup as K
from codelattice.operators import nodes as N
from codelattice.operators import sessions as S
from codelattice.operators import view as V
from codelattice.plans.graph import BASENAME, CLASS, all_edges, all_nodes
from codelattice.plans.registry import oracle_view, query
from codelattice.session import checkpoint_dir

oracle_view("ox_pool", "SELECT * FROM ox_real UNION ALL SELECT * FROM ox_planned")


def _search(text: str) -> str:
    return f"""
      SELECT p.id, p.label, p.type, p.file_path, p.is_virtual, coalesce(a.description, '') AS description
      FROM (SELECT * FROM ox_pool WHERE label ILIKE '%{text}%' ORDER BY label, id LIMIT 50) p
      LEFT JOIN fx_node_annotations a ON a.node_id = p.id"""


def _searched(t, text, limit=50):
    found = N.search_nodes(t.fx_symbols, t.fx_virtual_nodes, t.fx_node_annotations, text, limit)
    return found.select("id", "label", "type", "file_path", "is_virtual", "description")


@query("node_search", _search("BRAND1"))
def node_search(t):
    return _searched(t, "BRAND1")


@query("node_search_wildcard", _search("d_3.%(1"))
def node_search_wildcard(t):
    return _searched(t, "d_3.%(1")


@query("ordered_list_topn", "SELECT edge_id, remarks, updated_at FROM fx_edge_annotations ORDER BY updated_at DESC, edge_id LIMIT 50")
def ordered_list_topn(t):
    rows = t.fx_edge_annotations.select("edge_id", "remarks", "updated_at")
    return rows.orderBy(F.col("updated_at").desc(), "edge_id").limit(50)


@query("nodes_by_file", """
    SELECT r.file_path, r.line, r.id, r.label, coalesce(a.description, '') AS description
    FROM ox_real r LEFT JOIN fx_node_annotations a ON a.node_id = r.id""")
def nodes_by_file(t):
    files = t.fx_symbols.select("file_path")
    rows = N.nodes_by_file(t.fx_symbols, t.fx_node_annotations, files)
    return rows.select("file_path", "line", "id", "label", "description").orderBy("file_path", "line", "id")


oracle_view("ox_wanted", """
    SELECT id FROM fx_symbols UNION SELECT id FROM fx_virtual_nodes UNION SELECT concat('x', id) FROM fx_virtual_nodes""")


@query("node_lookup", f"""
    SELECT w.id, coalesce(r.label, v.label, '') AS label, coalesce(r.file_path, f.file_path, v.file_path, '') AS file_path,
      r.id IS NULL AND v.id IS NOT NULL AS is_virtual, r.id IS NOT NULL OR v.id IS NOT NULL AS found
    FROM ox_wanted w LEFT JOIN ox_real r ON r.id = w.id LEFT JOIN ox_planned v ON v.id = w.id LEFT JOIN (
      SELECT cls, file_path FROM (SELECT lower(split_part(name, '.', 1)) AS cls, file_path,
        row_number() OVER (PARTITION BY lower(split_part(name, '.', 1)) ORDER BY name, id) AS rn
        FROM fx_symbols WHERE instr(name, '.') > 0) x WHERE rn = 1) f ON f.cls = lower({CLASS.format('v.label')})""")
def node_lookup(t):
    wanted = t.fx_symbols.select("id").union(t.fx_virtual_nodes.select("id")).union(
        t.fx_virtual_nodes.select(F.concat(F.lit("x"), "id")))
    rows = N.lookup_nodes(t.fx_symbols, t.fx_virtual_nodes, t.fx_node_annotations, wanted)
    return rows.select("id", "label", "file_path", "is_virtual", "found")


@query("virtual_by_directory", """
    SELECT 'node' AS part, id, label AS name FROM fx_virtual_nodes WHERE virtual_directory = 'plan/area1'
    UNION ALL SELECT 'directory', id, name FROM fx_virtual_directories WHERE parent_path = 'plan/zone7'""")
def virtual_by_directory(t):
    nodes = K.virtual_in_directory(t.fx_virtual_nodes, "plan/area1").select(F.lit("node").alias("part"), "id", F.col("label").alias("name"))
    dirs = K.directories_in(t.fx_virtual_directories, "plan/zone7").select(F.lit("directory").alias("part"), "id", "name")
    return nodes.unionByName(dirs)


@query("point_lookups", """
    SELECT k.key, s.id IS NOT NULL AS found, coalesce(s.name, '') AS name FROM (
      SELECT concat('sn', cast(o_custkey * 2 AS string)) AS key FROM orders GROUP BY o_custkey) k LEFT JOIN fx_snapshots s ON s.id = k.key""")
def point_lookups(t):
    keys = t.orders.select(F.concat(F.lit("sn"), (F.col("o_custkey") * 2).cast("string")).alias("key"))
    rows = K.point_lookup(t.fx_snapshots.withColumnRenamed("id", "key"), keys, "key")
    return rows.select("key", "found", F.coalesce("name", F.lit("")).alias("name"))


@query("edge_annotation_undirected", """
    SELECT q.a, q.b, max(r.edge_id) AS edge_id FROM (
      SELECT DISTINCT concat('p', cast(l_partkey % 200 AS string)) AS a, concat('p', cast(l_suppkey AS string)) AS b FROM lineitem) q
    JOIN fx_edge_annotations r ON (r.source_node_id = q.a AND r.target_node_id = q.b) OR (r.source_node_id = q.b AND r.target_node_id = q.a)
    GROUP BY q.a, q.b""")
def edge_annotation_undirected(t):
    asked = t.lineitem.select(
        F.concat(F.lit("p"), (F.col("l_partkey") % 200).cast("string")).alias("a"),
        F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("b")).distinct()
    return K.remarks_between(asked, t.fx_edge_annotations).groupBy("a", "b").agg(F.max("edge_id").alias("edge_id"))


@query("callable_filter", """
    SELECT id, concat('file://', '/ws x/', replace(file_path, ' ', '%20')) AS uri_raw, kind FROM fx_symbols
    WHERE kind IN ('method', 'constructor', 'function')""".replace("'/ws x/'", "'/ws%20x/'"))
def callable_filter(t):
    rows = K.callables(t.fx_symbols)
    uri = paths.file_uri(F.concat(F.lit("/ws x/"), "file_path"))
    return rows.select("id", uri.alias("uri_raw"), "kind")


@query("workspace_bound", "SELECT path FROM fx_paths WHERE starts_with(path, '/ws/blog/') OR path = '/ws/blog'")
def workspace_bound(t):
    messy = F.replace("path", F.lit("/ws/"), F.lit("/ws//./"))
    return t.fx_paths.withColumn("messy", messy).where(paths.within(F.col("messy"), "/ws/blog/")).select("path")


oracle_view("ox_snapshot_ctx", "SELECT snapshot_id, seq, id, label, type, file_path, line, is_virtual FROM fx_snapshot_nodes")


@query("snapshot_context_type", f"""
    SELECT id, CASE WHEN NOT is_virtual AND type IN ('class', 'interface') AND line = 0 AND file_path <> ''
      AND label = {BASENAME.format('file_path')} THEN 'file' ELSE type END AS context_type
    FROM (SELECT id, label, type, file_path, line, is_virtual FROM ox_nodes
      UNION ALL SELECT id, name, 'class', path, 0, false FROM ox_files UNION ALL SELECT id, name, 'directory', path, 0, false FROM ox_dirs) x""")
def snapshot_context_type(t):
    from codelattice.operators.snapshot import context_type

    cols = ["id", "label", "type", "file_path", "line", "is_virtual"]
    files = N.files_of(N.real_nodes(t.fx_symbols))
    rows = all_nodes(t).select(*cols).unionByName(N.file_rows(files).select(*cols)).unionByName(
        N.directory_rows(N.directories_of(files)).select(*cols))
    return rows.select("id", context_type().alias("context_type"))


@query("symbol_backed_filter", """
    SELECT snapshot_id, seq, id, NOT (type IN ('directory', 'file') OR (type IN ('class', 'interface') AND file_path <> '' AND line = 0)) AS symbol_backed
    FROM fx_snapshot_nodes""")
def symbol_backed_filter(t):
    from codelattice.operators.snapshot import symbol_backed

    return t.fx_snapshot_nodes.select("snapshot_id", "seq", "id", symbol_backed().alias("symbol_backed"))


@query("edge_id_split", """
    SELECT edge_id, split_part(edge_id, '::', 1) AS source, substr(edge_id, instr(edge_id, '::') + 2) AS target, true AS valid
    FROM (SELECT concat(edge_id, '::x') AS edge_id FROM fx_edge_annotation_writes) x
    UNION ALL SELECT source_node_id, '', '', false FROM fx_edge_annotation_writes""")
def edge_id_split(t):
    rows = t.fx_edge_annotation_writes.select(F.concat("edge_id", F.lit("::x")).alias("edge_id")).union(
        t.fx_edge_annotation_writes.select("source_node_id"))
    e = F.col("edge_id")
    source = ids.edge_source(e)
    return rows.select("edge_id", F.coalesce(source, F.lit("")).alias("source"), F.coalesce(ids.edge_target(e), F.lit("")).alias("target"),
                       source.isNotNull().alias("valid"))


@query("symbol_exists", """
    SELECT n.name, n.name IN (SELECT name FROM fx_symbols) AS present FROM (
      SELECT DISTINCT label AS name FROM fx_virtual_nodes UNION SELECT DISTINCT caller_id FROM fx_mixed_calls) n""")
def symbol_exists(t):
    names = t.fx_virtual_nodes.select(F.col("label").alias("name")).union(t.fx_mixed_calls.select("caller_id"))
    return K.names_exist(t.fx_symbols, names)


@query("table_load", """
    SELECT 'calls' AS part, concat(file_path, ':', line) AS key, count(*) AS n FROM fx_method_calls GROUP BY 2
    UNION ALL SELECT 'notes', node_id, 1 FROM fx_node_annotations UNION ALL SELECT 'virtual', id, 1 FROM fx_virtual_nodes
    UNION ALL SELECT 'dirs', path, 1 FROM fx_virtual_directories UNION ALL SELECT 'symbols', id, 1 FROM fx_symbols
    UNION ALL SELECT 'snapshots', id, 1 FROM fx_snapshots UNION ALL SELECT 'sessions', id, 1 FROM fx_mask_sessions""")
def table_load(t):
    one = F.lit(1).cast("bigint").alias("n")
    calls = K.ordered(t.fx_method_calls, "calls").groupBy(F.concat_ws(":", "file_path", "line").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    out = calls.select(F.lit("calls").alias("part"), "key", "n")
    for part, df, key in (("notes", t.fx_node_annotations, "node_id"), ("virtual", t.fx_virtual_nodes, "id"),
                          ("dirs", t.fx_virtual_directories, "path"), ("symbols", t.fx_symbols, "id"),
                          ("snapshots", t.fx_snapshots, "id"), ("sessions", t.fx_mask_sessions, "id")):
        out = out.unionByName(K.ordered(df, part).select(F.lit(part).alias("part"), F.col(key).alias("key"), one))
    return out


# --- counts ---------------------------------------------------------------------------------------


@query("sessions_by_status", "SELECT status, count(*) AS n FROM fx_mask_sessions GROUP BY status")
def sessions_by_status(t):
    return t.fx_mask_sessions.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("session_history", """
    SELECT row_number() OVER (ORDER BY created_at DESC NULLS LAST, id DESC) AS position, id, file_path, status, created_at FROM fx_mask_sessions""")
def session_history(t):
    return S.session_history(t.fx_mask_sessions)


# Numbers and texts that may come as the other kind, as null, or not at all.
oracle_view("ox_loose", """
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderpriority ELSE '' END AS text,
      CASE WHEN o_orderkey % 5 IN (1, 3, 4) THEN 0 ELSE cast(trunc(o_totalprice) AS bigint) END AS number FROM orders""")


@query("loose_json", "SELECT o_orderkey, text, number FROM ox_loose")
def loose_json(t):
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    json = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit('{"f": "'), "o_orderpriority", F.lit('", "n": '), price, F.lit("}")))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit('{"f": 3, "n": "'), price, F.lit('"}')))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit('{"n": '), price, F.lit("}")))
        .when(F.col("o_orderkey") % 5 == 3, F.lit('{"f": null, "n": "many"}')).otherwise(F.lit("broken")))
    rows = t.orders.select("o_orderkey", json.alias("j"))
    return rows.select("o_orderkey", coerce.json_text_or_empty(F.col("j"), "$.f").alias("text"), coerce.json_int_or_zero(F.col("j"), "$.n").cast("bigint").alias("number"))


@query("cache_stats", "SELECT count(*) AS entries FROM fx_units_old")
def cache_stats(t):
    return t.fx_units_old.agg(F.count(F.lit(1)).alias("entries"))


@query("index_stats", "SELECT (SELECT count(*) FROM fx_symbols) AS symbols, (SELECT count(*) FROM fx_method_calls) AS edges")
def index_stats(t):
    return K.index_stats(t.fx_symbols, t.fx_method_calls)


@query("index_run_stats", """
    SELECT cast(1 AS bigint) AS version, (SELECT count(*) FROM fx_symbols) AS symbols, (SELECT count(*) FROM fx_method_calls) AS edges, true AS timed""")
def index_run_stats(t):
    spark = t.fx_symbols.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/index-run-{uuid.uuid4().hex}"
    return K.save_index(spark, root, t.fx_symbols, t.fx_method_calls).withColumn("timed", F.col("duration_ms") >= 0).drop("duration_ms")


# --- containers and selections --------------------------------------------------------------------

oracle_view("ox_class_of_file", """
    SELECT file_path, min(id) AS id FROM ox_nodes WHERE type IN ('class', 'interface') AND NOT is_virtual GROUP BY file_path""")


@query("container_of", """
    SELECT n.id, CASE WHEN n.type IN ('method', 'field') THEN coalesce(c.id, f.id, '')
      WHEN n.type IN ('class', 'interface') THEN coalesce(f.directory, '') ELSE '' END AS container_id
    FROM ox_parented n LEFT JOIN ox_class_of_file c ON c.file_path = n.file_path LEFT JOIN ox_files f ON f.path = n.file_path""")
def container_of(t):
    nodes = N.with_parents(all_nodes(t))
    files = N.files_of(N.real_nodes(t.fx_symbols))
    return V.container_of(nodes, nodes, files, N.directories_of(files))


oracle_view("ox_picks", """
    SELECT id, 'method' AS type, label AS name, file_path AS path FROM ox_nodes WHERE line % 3 = 0
    UNION ALL SELECT concat('file:', path), 'file', name, path FROM ox_files
    UNION ALL SELECT concat('dir:', path), 'directory', name, path FROM ox_dirs
    UNION ALL SELECT 'dir:src', 'directory', 'src', 'src' UNION ALL SELECT 'file:none', 'file', 'none', 'none'""")
oracle_view("ox_selected", """
    SELECT p.id AS pick_id, coalesce(n.id, CASE WHEN p.type = 'file' THEN coalesce(c.id, f.id)
        WHEN p.type = 'directory' THEN coalesce(d.id, p.id) END) AS node_id
    FROM ox_picks p LEFT JOIN ox_nodes n ON n.id = p.id LEFT JOIN ox_class_of_file c ON c.file_path = p.path
      LEFT JOIN ox_files f ON f.path = p.path LEFT JOIN ox_dirs d ON d.path = p.path""")


def _picks(t):
    files = N.files_of(N.real_nodes(t.fx_symbols))
    dirs = N.directories_of(files)
    nodes = all_nodes(t)
    rows = nodes.where("line % 3 = 0").select("id", F.lit("method").alias("type"), F.col("label").alias("name"), F.col("file_path").alias("path"))
    rows = rows.union(files.select(F.concat(F.lit("file:"), "path"), F.lit("file"), "name", "path"))
    rows = rows.union(dirs.select(F.concat(F.lit("dir:"), "path"), F.lit("directory"), "name", "path"))
    extra = t.region.where("r_regionkey = 0").select(F.lit("dir:src"), F.lit("directory"), F.lit("src"), F.lit("src")).union(
        t.region.where("r_regionkey = 0").select(F.lit("file:none"), F.lit("file"), F.lit("none"), F.lit("none")))
    return rows.union(extra), nodes, files, dirs


@query("selection_to_node", "SELECT pick_id, node_id FROM ox_selected WHERE node_id IS NOT NULL")
def selection_to_node(t):
    return V.selected_nodes(*_picks(t)).select("pick_id", F.col("id").alias("node_id"))


@query("selection_edges", """
    SELECT edge_id FROM ox_edges WHERE (source IN (SELECT node_id FROM ox_selected WHERE node_id IS NOT NULL AND node_id NOT IN (SELECT id FROM fx_visible)) AND target IN (SELECT id FROM fx_visible))
      OR (target IN (SELECT node_id FROM ox_selected WHERE node_id IS NOT NULL AND node_id NOT IN (SELECT id FROM fx_visible)) AND source IN (SELECT id FROM fx_visible))""")
def selection_edges(t):
    picked = V.selected_nodes(*_picks(t))
    return V.selection_edges(picked, all_edges(t), t.fx_visible).select("edge_id")
