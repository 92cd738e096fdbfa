"""Queries on the whole graph: nodes, edges, neighbourhoods, views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.functions import ids, paths
from codelattice.operators import edges as E
from codelattice.operators import nodes as N
from codelattice.operators.skew import first_per_key, last_per_key
from codelattice.plans.registry import oracle_view, query
from codelattice.plans.views import Tables
from codelattice.session import cut_lineage

CLASS = "CASE WHEN instr({0}, '.') > 1 THEN split_part({0}, '.', 1) ELSE {0} END"
HASH = "substr(sha256({0}), 1, 16)"
DIRNAME = (
    "CASE WHEN instr({0}, '/') = 0 THEN '.' WHEN regexp_extract({0}, '^(.*)/[^/]*$', 1) = '' THEN '/' "
    "ELSE regexp_extract({0}, '^(.*)/[^/]*$', 1) END"
)
BASENAME = "regexp_extract({0}, '([^/]*)$', 1)"

oracle_view("ox_real", """
    SELECT id, name AS label, kind AS type, file_path, line, false AS is_virtual, false AS materialized,
      '' AS virtual_class_id, '' AS virtual_directory FROM fx_symbols""")
oracle_view("ox_planned", """
    SELECT id, label, type, concat(CASE WHEN coalesce(virtual_directory, '') = '' THEN 'virtual' ELSE virtual_directory END,
        '/', split_part(label, '.', 1), '.virtual') AS file_path,
      0 AS line, true AS is_virtual, materialized = 1 AS materialized, coalesce(virtual_class_id, '') AS virtual_class_id,
      coalesce(virtual_directory, '') AS virtual_directory FROM fx_virtual_nodes""")
oracle_view("ox_class_files", f"""
    SELECT class_name, file_path AS class_file FROM (
      SELECT {CLASS.format('label')} AS class_name, file_path,
        row_number() OVER (PARTITION BY {CLASS.format('label')} ORDER BY label DESC, id DESC) AS rn
      FROM ox_real WHERE file_path <> '') x WHERE rn = 1 AND class_name <> ''""")
oracle_view("ox_nodes", f"""
    SELECT u.*, a.node_id IS NOT NULL AS annotated, coalesce(a.description, '') AS description,
      coalesce(a.ai_remarks, '') AS ai_remarks
    FROM (SELECT * FROM ox_real UNION ALL
      SELECT id, label, type, coalesce(c.class_file, p.file_path), line, is_virtual, materialized, virtual_class_id, virtual_directory
      FROM ox_planned p LEFT JOIN ox_class_files c ON c.class_name = {CLASS.format('p.label')}
      WHERE NOT (p.materialized AND p.label IN (SELECT name FROM fx_symbols))) u
    LEFT JOIN fx_node_annotations a ON a.node_id = u.id""")
oracle_view("ox_node_keys", """
    SELECT key, node_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY a DESC, b DESC, s DESC) AS rn FROM (
      SELECT label AS key, id AS node_id, label AS a, id AS b, 0 AS s FROM ox_nodes
      UNION ALL SELECT id, id, label, id, 1 FROM ox_nodes) c) x WHERE rn = 1""")
oracle_view("ox_keys", f"""
    SELECT key, node_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY g DESC, a DESC, b DESC, s DESC) AS rn FROM (
      SELECT label AS key, id AS node_id, 0 AS g, label AS a, id AS b, 0 AS s FROM ox_nodes
      UNION ALL SELECT id, id, 0, label, id, 1 FROM ox_nodes
      UNION ALL SELECT name, {HASH.format('path')}, 1, path, {HASH.format('path')}, 0 FROM fx_virtual_directories
      UNION ALL SELECT {HASH.format('path')}, {HASH.format('path')}, 1, path, {HASH.format('path')}, 1 FROM fx_virtual_directories) c) x
    WHERE rn = 1""")
oracle_view("ox_calls", "SELECT * FROM fx_method_calls UNION ALL SELECT * FROM fx_mixed_calls")
oracle_view("ox_edges", """
    SELECT concat(s.node_id, '::', t.node_id) AS edge_id, s.node_id AS source, t.node_id AS target,
      count(*) AS call_count, bool_or(call_type = 'manual') AS is_manual
    FROM ox_calls c JOIN ox_keys s ON s.key = c.caller_id JOIN ox_keys t ON t.key = c.callee_id
    GROUP BY s.node_id, t.node_id""")
oracle_view("ox_files", f"""
    SELECT {HASH.format('path')} AS id, path, {BASENAME.format('path')} AS name,
      {HASH.format(f"({DIRNAME.format('path')})")} AS directory
    FROM (SELECT DISTINCT file_path AS path FROM ox_nodes WHERE NOT is_virtual AND file_path <> '') f""")
oracle_view("ox_dirs", f"""
    SELECT {HASH.format('path')} AS id, path, {BASENAME.format('path')} AS name
    FROM (SELECT DISTINCT {DIRNAME.format('path')} AS path FROM ox_files) d""")
PARENT = f"""CASE WHEN NOT is_virtual AND type NOT IN ('class', 'interface') AND file_path <> '' THEN {HASH.format('file_path')}
    WHEN is_virtual AND virtual_class_id <> '' THEN virtual_class_id
    WHEN is_virtual AND type = 'class' AND virtual_directory <> '' THEN {HASH.format('virtual_directory')} ELSE '' END"""
oracle_view("ox_parented", f"SELECT *, {PARENT} AS parent_id FROM ox_nodes")


def all_nodes(t: Tables) -> DataFrame:
    return N.graph_nodes(t.fx_symbols, t.fx_virtual_nodes, t.fx_node_annotations)


def all_calls(t: Tables) -> DataFrame:
    return t.fx_method_calls.unionByName(t.fx_mixed_calls)


def all_edges(t: Tables) -> DataFrame:
    keys = E.endpoint_keys(all_nodes(t), t.fx_virtual_directories)
    pairs, hot = E.counted(all_calls(t))
    return E.roll_up(pairs, keys, hot=hot)


# --- node set -------------------------------------------------------------------------------------


@query("graph_nodes", "SELECT * FROM ox_nodes")
def graph_nodes(t):
    return all_nodes(t)


@query("node_count", "SELECT count(*) AS total FROM ox_nodes")
def node_count(t):
    return N.node_count(t.fx_symbols, t.fx_virtual_nodes)


@query("class_of_label", f"""
    SELECT id, {CLASS.format('label')} AS class_name FROM (
      SELECT id, name AS label FROM fx_symbols UNION ALL SELECT id, label FROM fx_virtual_nodes
      UNION ALL SELECT concat('dot', id), concat('.', label) FROM fx_virtual_nodes) x""")
def class_of_label(t):
    labels = t.fx_symbols.select("id", F.col("name").alias("label")).unionByName(t.fx_virtual_nodes.select("id", "label"))
    dotted = t.fx_virtual_nodes.select(F.concat(F.lit("dot"), "id").alias("id"), F.concat(F.lit("."), "label").alias("label"))
    return labels.unionByName(dotted).select("id", paths.class_of_label(F.col("label")).alias("class_name"))


@query("virtual_file_path", "SELECT id, file_path FROM ox_planned")
def virtual_file_path(t):
    return N.planned_nodes(t.fx_virtual_nodes).select("id", "file_path")


@query("unmaterialised_virtuals", """
    SELECT id, label, materialized FROM fx_virtual_nodes
    WHERE NOT (materialized = 1 AND label IN (SELECT name FROM fx_symbols))""")
def unmaterialised_virtuals(t):
    return N.unmaterialised(t.fx_virtual_nodes, t.fx_symbols).select("id", "label", "materialized")


@query("virtual_adopts_real_file", f"""
    SELECT p.id, coalesce(c.class_file, p.file_path) AS file_path
    FROM ox_planned p LEFT JOIN ox_class_files c ON c.class_name = {CLASS.format('p.label')}""")
def virtual_adopts_real_file(t):
    files = N.class_files(N.real_nodes(t.fx_symbols))
    return N.adopt_real_files(N.planned_nodes(t.fx_virtual_nodes), files).select("id", "file_path")


@query("annotate_nodes", """
    SELECT r.id, a.node_id IS NOT NULL AS annotated, coalesce(a.description, '') AS description,
      coalesce(a.ai_remarks, '') AS ai_remarks
    FROM ox_real r LEFT JOIN fx_node_annotations a ON a.node_id = r.id""")
def annotate_nodes(t):
    return N.annotate_nodes(N.real_nodes(t.fx_symbols).select("id"), t.fx_node_annotations)


@query("annotate_nodes_details", """
    SELECT r.id, a.node_id IS NOT NULL AS annotated, coalesce(a.description, '') AS description, coalesce(a.ai_remarks, '') AS ai_remarks,
      CASE WHEN a.updated_at % 2 = 0 THEN 'see ' || a.description ELSE '' END AS code_snippet,
      CASE WHEN a.node_id IS NULL THEN '' ELSE concat('{"at":', a.updated_at, '}') END AS custom_properties
    FROM ox_real r LEFT JOIN fx_node_annotations a ON a.node_id = r.id""")
def annotate_nodes_details(t):
    notes = t.fx_node_annotations.withColumn("code_snippet", F.when(F.col("updated_at") % 2 == 0, F.concat(F.lit("see "), "description")))
    notes = notes.withColumn("custom_properties", F.to_json(F.struct(F.col("updated_at").alias("at"))))
    return N.annotate_nodes(N.real_nodes(t.fx_symbols).select("id"), notes, details=True)


@query("parent_id_assign", "SELECT id, parent_id FROM ox_parented")
def parent_id_assign(t):
    return N.with_parents(all_nodes(t)).select("id", "parent_id")


@query("files_dirs", """
    SELECT 'file' AS part, id, path, name, directory FROM ox_files
    UNION ALL SELECT 'directory', id, path, name, '' FROM ox_dirs""")
def files_dirs(t):
    files = N.files_of(N.real_nodes(t.fx_symbols))
    dirs = N.directories_of(files)
    return files.select(F.lit("file").alias("part"), "id", "path", "name", "directory").unionByName(
        dirs.select(F.lit("directory").alias("part"), "id", "path", "name", F.lit("").alias("directory"))
    )


@query("container_rows", """
    SELECT id, name AS label, 'class' AS type, path AS file_path, 0 AS line, false AS is_virtual, directory AS parent_id FROM ox_files
    UNION ALL SELECT id, name, 'directory', path, 0, false, '' FROM ox_dirs""")
def container_rows(t):
    files = N.files_of(N.real_nodes(t.fx_symbols))
    return N.file_rows(files).unionByName(N.directory_rows(N.directories_of(files)))


@query("display_node_type", """
    SELECT id, CASE WHEN is_virtual THEN CASE type WHEN 'class' THEN 'virtual-class' WHEN 'directory' THEN 'virtual-directory' ELSE 'virtual' END
      WHEN type = 'directory' THEN 'directory' WHEN type IN ('class', 'interface') THEN 'file'
      WHEN type = 'field' THEN 'field' ELSE 'method' END AS display_type
    FROM (SELECT id, type, is_virtual FROM ox_nodes UNION ALL SELECT id, 'directory', false FROM ox_dirs
      UNION ALL SELECT id, 'directory', true FROM fx_virtual_directories) x""")
def display_node_type(t):
    rows = all_nodes(t).select("id", "type", "is_virtual")
    dirs = N.directories_of(N.files_of(N.real_nodes(t.fx_symbols)))
    rows = rows.unionByName(dirs.select("id", F.lit("directory").alias("type"), F.lit(False).alias("is_virtual")))
    planned = t.fx_virtual_directories.select("id", F.lit("directory").alias("type"), F.lit(True).alias("is_virtual"))
    return rows.unionByName(planned).select("id", N.display_type().alias("display_type"))


# --- edges ----------------------------------------------------------------------------------------


@query("endpoint_resolve", """
    SELECT c.caller_id, c.callee_id, s.node_id AS source, t.node_id AS target, count(*) AS n, bool_or(call_type = 'manual') AS manual
    FROM ox_calls c JOIN ox_keys s ON s.key = c.caller_id JOIN ox_keys t ON t.key = c.callee_id
    GROUP BY c.caller_id, c.callee_id, s.node_id, t.node_id""")
def endpoint_resolve(t):
    keys = E.endpoint_keys(all_nodes(t), t.fx_virtual_directories)
    return E.resolve_endpoints(E.call_pairs(all_calls(t)), keys)


@query("edge_rollup", """
    SELECT e.*, coalesce(a.remarks, '') AS remarks FROM ox_edges e LEFT JOIN fx_edge_annotations a ON a.edge_id = e.edge_id""")
def edge_rollup(t):
    return E.edge_rollup(all_calls(t), all_nodes(t), t.fx_virtual_directories, t.fx_edge_annotations)


@query("edge_rollup_hubs", "SELECT * FROM ox_edges")
def edge_rollup_hubs(t):
    """The roll-up with every name that has one pair in 200 spread over tasks."""
    pairs, hubs = E.counted(all_calls(t), share=1 / 200)
    return E.roll_up(pairs, E.endpoint_keys(all_nodes(t), t.fx_virtual_directories), hot=hubs)


@query("annotate_edges", """
    SELECT p.edge_id, coalesce(a.remarks, '') AS remarks
    FROM (SELECT DISTINCT concat(caller_id, '::', callee_id) AS edge_id FROM fx_method_calls) p
    LEFT JOIN fx_edge_annotations a ON a.edge_id = p.edge_id""")
def annotate_edges(t):
    pairs = t.fx_method_calls.select(ids.edge_id(F.col("caller_id"), F.col("callee_id")).alias("edge_id")).distinct()
    return E.annotate_edges(pairs, t.fx_edge_annotations)


@query("dedupe_calls", """
    SELECT caller_id, callee_id, line, call_type, file_path FROM (
      SELECT *, row_number() OVER (PARTITION BY caller_id, callee_id, line ORDER BY file_path, call_type) AS rn FROM fx_method_calls) x
    WHERE rn = 1""")
def dedupe_calls(t):
    calls = t.fx_method_calls.select("caller_id", "callee_id", "line", "call_type", "file_path")
    return first_per_key(calls, ["caller_id", "callee_id", "line"], "file_path", "call_type")


@query("keep_first", """
    SELECT target_node_id, edge_id, remarks, seq FROM (
      SELECT *, row_number() OVER (PARTITION BY target_node_id ORDER BY seq, edge_id) AS rn FROM fx_edge_annotation_writes) x WHERE rn = 1""")
def keep_first(t):
    writes = t.fx_edge_annotation_writes.select("target_node_id", "edge_id", "remarks", "seq")
    return first_per_key(writes, ["target_node_id"], "seq", "edge_id")


@query("keep_last", """
    SELECT label, id, file_path FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY id DESC) AS rn FROM ox_real) x WHERE rn = 1""")
def keep_last(t):
    return last_per_key(N.real_nodes(t.fx_symbols).select("label", "id", "file_path"), ["label"], "id")


oracle_view("ox_links", """
    SELECT caller_id AS a, callee_id AS b FROM ox_calls UNION SELECT source_node_id, target_node_id FROM fx_edge_annotations""")


oracle_view("ox_ids", "SELECT id FROM fx_symbols UNION SELECT id FROM fx_virtual_nodes")


def _class_ids(t: Tables) -> DataFrame:
    return t.fx_symbols.where(F.col("kind") == "class").select("id")


@query("neighbours", f"""
    SELECT p.seed_id, n.id, n.label, n.type, n.file_path, n.line, n.is_virtual FROM (
      SELECT a AS seed_id, b AS id FROM ox_links WHERE a IN (SELECT id FROM ox_ids) UNION SELECT b, a FROM ox_links WHERE b IN (SELECT id FROM ox_ids)) p
    JOIN (SELECT id, label, type, file_path, line, is_virtual FROM ox_real UNION ALL
      SELECT id, label, type, coalesce(f.file_path, p.file_path), line, is_virtual FROM ox_planned p LEFT JOIN (
        SELECT cls, file_path FROM (SELECT lower(split_part(name, '.', 1)) AS cls, file_path,
          row_number() OVER (PARTITION BY lower(split_part(name, '.', 1)) ORDER BY name, id) AS rn
          FROM fx_symbols WHERE instr(name, '.') > 0) x WHERE rn = 1) f ON f.cls = lower({CLASS.format('p.label')})) n
    ON n.id = p.id""")
def neighbours(t):
    seeds = t.fx_symbols.select("id").unionByName(t.fx_virtual_nodes.select("id"))
    pairs = E.neighbour_ids(all_calls(t), t.fx_edge_annotations, seeds)
    found = N.lookup_nodes(t.fx_symbols, t.fx_virtual_nodes, t.fx_node_annotations, pairs.select("id")).where("found")
    cols = ["id", "label", "type", "file_path", "line", "is_virtual"]
    return E.skew_join(pairs, found.select(*cols), "id").select("seed_id", *cols)


oracle_view("ox_seeds", "SELECT id, label FROM ox_nodes")
oracle_view("ox_touched", """
    WITH c AS (SELECT *, row_number() OVER () AS nr FROM ox_calls),
      k AS (SELECT id AS seed_id, id AS key FROM ox_seeds UNION SELECT id, label FROM ox_seeds),
      m AS (SELECT seed_id, caller_id, callee_id, nr, call_type, bool_or(out) AS out FROM (
        SELECT k.seed_id, c.*, true AS out FROM c JOIN k ON k.key = c.caller_id
        UNION ALL SELECT k.seed_id, c.*, false FROM c JOIN k ON k.key = c.callee_id) x GROUP BY seed_id, caller_id, callee_id, nr, call_type)
    SELECT m.seed_id, m.out, a.node_id AS source, b.node_id AS target, m.call_type
    FROM m JOIN ox_node_keys a ON a.key = m.caller_id JOIN ox_node_keys b ON b.key = m.callee_id""")


def _all_seeds(t: Tables):
    """Calls, seeds and nodes; every node is a seed, so there is no call to sift out."""
    nodes = all_nodes(t)
    return all_calls(t), nodes.select("id", "label"), nodes


@query("neighbourhood", """
    SELECT seed_id, concat(source, '::', target) AS edge_id, source, target, count(*) AS call_count,
      bool_or(call_type = 'manual') AS is_manual FROM ox_touched GROUP BY seed_id, source, target""")
def neighbourhood_edges(t):
    return E.merge_neighbourhood_edges(E.neighbourhood_edges(*_all_seeds(t), sift=False))


@query("neighbourhood_few_seeds", """
    SELECT seed_id, concat(source, '::', target) AS edge_id, count(*) AS call_count FROM ox_touched
    WHERE seed_id IN (SELECT id FROM fx_virtual_nodes) GROUP BY seed_id, source, target""")
def neighbourhood_few_seeds(t):
    """Planned nodes as seeds, of which there are few."""
    nodes = all_nodes(t)
    seeds = nodes.join(t.fx_virtual_nodes.select("id"), "id", "left_semi").select("id", "label")
    found = E.merge_neighbourhood_edges(E.neighbourhood_edges(all_calls(t), seeds, nodes))
    return found.select("seed_id", "edge_id", "call_count")


@query("neighbourhood_nodes", """
    SELECT p.seed_id, n.id, n.label, n.type, n.file_path, n.parent_id FROM (
      SELECT seed_id, CASE WHEN out THEN target ELSE source END AS id FROM ox_touched UNION SELECT id, id FROM ox_seeds) p
    JOIN ox_parented n ON n.id = p.id""")
def neighbourhood_nodes(t):
    calls, seeds, nodes = _all_seeds(t)
    near = E.neighbourhood_node_ids(calls, seeds, nodes, sift=False)
    rows = N.with_parents(nodes).select("id", "label", "type", "file_path", "parent_id")
    return E.skew_join(near, rows, "id").select("seed_id", "id", "label", "type", "file_path", "parent_id")


@query("neighbourhood_files", """
    SELECT DISTINCT p.seed_id, f.id, f.path FROM (
      SELECT seed_id, CASE WHEN out THEN target ELSE source END AS id FROM ox_touched UNION SELECT id, id FROM ox_seeds) p
    JOIN ox_nodes n ON n.id = p.id AND NOT n.is_virtual JOIN ox_files f ON f.path = n.file_path""")
def neighbourhood_files(t):
    files = E.neighbourhood_files(*_all_seeds(t), sift=False)
    return files.select("seed_id", ids.path_id(F.col("path")).alias("id"), "path")


def _far_seeds(t: Tables) -> DataFrame:
    return t.fx_virtual_directories.select(ids.path_id(F.col("path")).alias("id"))


oracle_view("ox_hops", f"""
    WITH adj AS (SELECT source AS a, target AS b FROM ox_edges UNION SELECT target, source FROM ox_edges),
      h0 AS (SELECT {HASH.format('path')} AS id FROM fx_virtual_directories),
      h1 AS (SELECT DISTINCT b AS id FROM adj WHERE a IN (SELECT id FROM h0) AND b NOT IN (SELECT id FROM h0)),
      h2 AS (SELECT DISTINCT b AS id FROM adj WHERE a IN (SELECT id FROM h1)
        AND b NOT IN (SELECT id FROM h0) AND b NOT IN (SELECT id FROM h1))
    SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""")


@query("khop_expand", "SELECT id, hop FROM ox_hops")
def khop_expand(t):
    return E.khop_nodes(cut_lineage(all_edges(t)), _far_seeds(t), 2)


@query("khop_edges", """
    SELECT e.edge_id, e.source, e.target, e.call_count FROM ox_edges e
    WHERE source IN (SELECT id FROM ox_hops WHERE hop < 2) OR target IN (SELECT id FROM ox_hops WHERE hop < 2)""")
def khop_edges(t):
    edges = cut_lineage(all_edges(t))
    return E.khop_edges(edges, E.khop_nodes(edges, _far_seeds(t), 2), 2).select("edge_id", "source", "target", "call_count")


# --- composition ----------------------------------------------------------------------------------


@query("connected_edges", """
    SELECT edge_id, call_count FROM ox_edges e WHERE
      (source IN (SELECT id FROM fx_symbols WHERE kind = 'class') AND target IN (SELECT id FROM fx_visible))
      OR (target IN (SELECT id FROM fx_symbols WHERE kind = 'class') AND source IN (SELECT id FROM fx_visible))""")
def connected_edges(t):
    return E.connected_edges(all_edges(t), _class_ids(t), t.fx_visible).select("edge_id", "call_count")


@query("induced_edges", """
    SELECT edge_id, call_count, is_manual FROM ox_edges
    WHERE source IN (SELECT id FROM fx_visible) AND target IN (SELECT id FROM fx_visible)""")
def induced_edges(t):
    return E.induced_edges(all_edges(t), t.fx_visible).select("edge_id", "call_count", "is_manual")


@query("graph_merge", """
    SELECT id, label, 'old' AS origin FROM ox_nodes WHERE is_virtual
    UNION ALL SELECT x.id, x.label, 'new' FROM (SELECT id, label FROM ox_nodes UNION ALL SELECT id, label FROM ox_real) x
    WHERE x.id NOT IN (SELECT id FROM ox_nodes WHERE is_virtual)""")
def graph_merge(t):
    nodes = all_nodes(t).select("id", "label", "is_virtual")
    old = nodes.where("is_virtual").select("id", "label", F.lit("old").alias("origin"))
    batch = nodes.select("id", "label").unionByName(N.real_nodes(t.fx_symbols).select("id", "label"))
    return E.merge_new(old, batch.withColumn("origin", F.lit("new")))


@query("graph_remove_node", """
    SELECT edge_id, call_count FROM ox_edges WHERE source NOT IN (SELECT id FROM fx_symbols WHERE kind = 'class')
      AND target NOT IN (SELECT id FROM fx_symbols WHERE kind = 'class')""")
def graph_remove_node(t):
    return E.remove_nodes(all_edges(t), _class_ids(t)).select("edge_id", "call_count")


@query("graph_remove_edge", """
    SELECT edge_id, call_count FROM ox_edges WHERE edge_id NOT IN (SELECT edge_id FROM fx_edge_annotations)""")
def graph_remove_edge(t):
    gone = t.fx_edge_annotations.select("edge_id")
    return all_edges(t).join(gone, "edge_id", "left_anti").select("edge_id", "call_count")


@query("graph_bundle_nodes", f"""
    SELECT id, label, type, file_path, line, is_virtual, parent_id FROM ox_parented UNION ALL
    SELECT {HASH.format('path')}, name, 'directory', '', 0, true, '' FROM fx_virtual_directories""")
def graph_bundle_nodes(t):
    rows = N.with_parents(all_nodes(t)).select("id", "label", "type", "file_path", "line", "is_virtual", "parent_id")
    return rows.unionByName(N.directory_nodes(t.fx_virtual_directories))


@query("graph_bundle", """
    SELECT 'directories' AS part, count(*) AS n FROM ox_dirs UNION ALL SELECT 'edges', count(*) FROM ox_edges
    UNION ALL SELECT 'files', count(*) FROM ox_files
    UNION ALL SELECT 'nodes', (SELECT count(*) FROM ox_nodes) + (SELECT count(*) FROM fx_virtual_directories)""")
def graph_bundle_sizes(t):
    from codelattice.plans.bundle import graph_bundle

    bundle = graph_bundle(
        t.fx_symbols, t.fx_virtual_nodes, t.fx_node_annotations, all_calls(t), t.fx_edge_annotations, t.fx_virtual_directories
    )
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        for name, df in (("directories", bundle.directories), ("edges", bundle.edges), ("files", bundle.files), ("nodes", bundle.nodes))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


oracle_view("ox_visible", """
    SELECT n.id, n.label, n.type, n.file_path, n.is_virtual, CASE WHEN n.line % 2 = 0 THEN n.parent_id ELSE '' END AS parent_id
    FROM ox_parented n WHERE n.id IN (SELECT id FROM fx_visible)
    UNION ALL SELECT id, name, 'class', path, false, directory FROM ox_files
    UNION ALL SELECT id, name, 'directory', path, false, '' FROM ox_dirs""")
oracle_view("ox_typed", """
    SELECT *, CASE WHEN is_virtual THEN CASE type WHEN 'class' THEN 'virtual-class' WHEN 'directory' THEN 'virtual-directory' ELSE 'virtual' END
      WHEN type = 'directory' THEN 'directory' WHEN type IN ('class', 'interface') THEN 'file'
      WHEN type = 'field' THEN 'field' ELSE 'method' END AS display_type FROM ox_visible""")


def _visible(t: Tables) -> DataFrame:
    nodes = N.with_parents(all_nodes(t)).join(t.fx_visible, "id", "left_semi")
    cut = F.when(F.col("line") % 2 == 0, F.col("parent_id")).otherwise(F.lit(""))
    cols = ["id", "label", "type", "file_path", "is_virtual", "parent_id"]
    files = N.files_of(N.real_nodes(t.fx_symbols))
    return (
        nodes.withColumn("parent_id", cut).select(*cols)
        .unionByName(N.file_rows(files).select(*cols))
        .unionByName(N.directory_rows(N.directories_of(files)).select(*cols))
    )


@query("effective_parent", """
    SELECT id, display_type, CASE WHEN cand <> id AND cand IN (SELECT id FROM ox_typed WHERE display_type IN
        ('directory', 'file', 'virtual-directory', 'virtual-class')) THEN cand ELSE '' END AS parent
    FROM (SELECT v.id, v.display_type, CASE WHEN v.parent_id <> '' THEN v.parent_id WHEN v.is_virtual OR v.file_path = '' THEN ''
        WHEN v.display_type IN ('method', 'field') THEN coalesce(f.id, '') WHEN v.display_type = 'file' THEN coalesce(f.directory, '')
        ELSE '' END AS cand
      FROM ox_typed v LEFT JOIN ox_files f ON f.path = v.file_path) x""")
def effective_parent(t):
    files = N.files_of(N.real_nodes(t.fx_symbols))
    return N.effective_parents(_visible(t), files).select("id", "display_type", "parent")


@query("view_elements", """
    SELECT e.edge_id, e.source, e.target, e.call_count, e.is_manual OR e.source IN (SELECT id FROM ox_visible WHERE is_virtual)
      OR e.target IN (SELECT id FROM ox_visible WHERE is_virtual) AS user_created
    FROM ox_edges e WHERE e.source IN (SELECT id FROM ox_visible) AND e.target IN (SELECT id FROM ox_visible)""")
def view_elements(t):
    return E.view_edges(all_edges(t), _visible(t)).select("edge_id", "source", "target", "call_count", "user_created")


oracle_view("ox_previous", """
    SELECT id, type FROM ox_nodes WHERE line % 2 = 0 UNION ALL SELECT id, 'directory' FROM ox_dirs
    UNION ALL SELECT concat('gone', id), type FROM ox_nodes WHERE line % 5 = 0""")
oracle_view("ox_refreshed", """
    SELECT id, type FROM ox_nodes WHERE id IN (SELECT id FROM ox_previous) UNION ALL
    SELECT id, type FROM ox_previous WHERE type IN ('directory', 'file') AND id NOT IN (SELECT id FROM ox_nodes)""")


def _refreshed(t: Tables):
    nodes = all_nodes(t)
    dirs = N.directories_of(N.files_of(N.real_nodes(t.fx_symbols)))
    gone = nodes.where(F.col("line") % 5 == 0).select(F.concat(F.lit("gone"), "id").alias("id"), "type")
    previous = (
        nodes.where(F.col("line") % 2 == 0).select("id", "type")
        .unionByName(dirs.select("id", F.lit("directory").alias("type"))).unionByName(gone)
    )
    return E.refresh_view(previous, nodes.select("id", "type"), all_edges(t))


@query("view_refresh", """
    SELECT 'node' AS part, id FROM ox_refreshed UNION ALL SELECT 'edge', edge_id FROM ox_edges
    WHERE source IN (SELECT id FROM ox_refreshed) AND target IN (SELECT id FROM ox_refreshed)""")
def view_refresh(t):
    nodes, kept = _refreshed(t)
    return nodes.select(F.lit("node").alias("part"), "id").unionByName(
        kept.select(F.lit("edge").alias("part"), F.col("edge_id").alias("id"))
    )


@query("graph_diff", """
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'kept' END AS change
    FROM (SELECT DISTINCT id FROM ox_previous) a FULL JOIN (SELECT DISTINCT id FROM ox_nodes) b ON a.id = b.id""")
def graph_diff(t):
    from codelattice.operators.index import id_diff

    nodes = all_nodes(t)
    dirs = N.directories_of(N.files_of(N.real_nodes(t.fx_symbols))).select("id")
    gone = nodes.where(F.col("line") % 5 == 0).select(F.concat(F.lit("gone"), "id").alias("id"))
    previous = nodes.where(F.col("line") % 2 == 0).select("id").unionByName(dirs).unionByName(gone)
    return id_diff(previous, nodes.select("id"))
