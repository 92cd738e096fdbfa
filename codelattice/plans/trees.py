"""Queries on folder trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelattice.operators import hierarchy as H
from codelattice.operators import nodes as N
from codelattice.plans.graph import all_nodes
from codelattice.plans.registry import oracle_view, query
from codelattice.session import cut_lineage

oracle_view("ox_tree_in", """
    SELECT id, label, file_path, line FROM ox_nodes UNION ALL SELECT concat('pg', cast(page_id AS string)), split_part(url, '/', 3), path, 1
    FROM (SELECT p.page_id, p.url, f.path FROM pages p JOIN fx_paths f ON f.page_id = p.page_id) x""")
PARTS = "[x for x in string_split({0}, '/') if x <> '']"
oracle_view("ox_tree_files", f"SELECT path, parts, len(parts) AS n FROM (SELECT DISTINCT file_path AS path, {PARTS.format('file_path')} AS parts FROM ox_tree_in) x")
oracle_view("ox_tree_dirs", "SELECT DISTINCT list_slice(parts, 1, i) AS parts, i AS n FROM (SELECT parts, unnest(range(1, n)) AS i FROM ox_tree_files) x")
oracle_view("ox_tree", """
    SELECT concat('dir:', array_to_string(parts, '/')) AS id, CASE WHEN n > 1 THEN concat('dir:', array_to_string(list_slice(parts, 1, n - 1), '/')) ELSE '' END AS parent_id,
      parts[n] AS name, 'directory' AS type, array_to_string(parts, '/') AS path, 0 AS line FROM ox_tree_dirs
    UNION ALL SELECT concat('file:', path), CASE WHEN n > 1 THEN concat('dir:', array_to_string(list_slice(parts, 1, n - 1), '/')) ELSE '' END, parts[n], 'file', path, 0 FROM ox_tree_files
    UNION ALL SELECT id, concat('file:', file_path), label, 'method', file_path, line FROM ox_tree_in""")


def tree_input(t):
    pages = t.pages.select("page_id", "url").join(t.fx_paths, "page_id").select(
        F.concat(F.lit("pg"), F.col("page_id").cast("string")).alias("id"), F.split_part("url", F.lit("/"), F.lit(3)).alias("label"),
        F.col("path").alias("file_path"), F.lit(1).alias("line"))
    return all_nodes(t).select("id", "label", "file_path", "line").unionByName(pages)


@query("path_tree", "SELECT * FROM ox_tree")
def path_tree(t):
    return H.path_tree(tree_input(t))


@query("tree_sort", "SELECT parent_id, id, name, CASE type WHEN 'directory' THEN 0 WHEN 'file' THEN 1 ELSE 2 END AS type_rank FROM ox_tree")
def tree_sort(t):
    return H.tree_sorted(H.path_tree(tree_input(t))).select("parent_id", "id", "name", "type_rank")


@query("compact_chains", """
    WITH RECURSIVE kids AS (SELECT parent_id, count(*) AS n, min(id) AS only, bool_and(type = 'directory') AS folder FROM ox_tree GROUP BY parent_id),
      link AS (SELECT d.id, d.path, d.name, d.parent_id, CASE WHEN k.n = 1 AND k.folder THEN k.only END AS next
        FROM ox_tree d LEFT JOIN kids k ON k.parent_id = d.id WHERE d.type = 'directory'),
      walk AS (SELECT id, path, name, parent_id AS above, next FROM link
          WHERE parent_id = '' OR parent_id IN (SELECT id FROM link WHERE next IS NULL)
        UNION ALL SELECT l.id, l.path, concat(w.name, '/', l.name), w.above, l.next FROM walk w JOIN link l ON l.id = w.next)
    SELECT id, path, name, above AS parent_id FROM walk WHERE next IS NULL""")
def compact_chains(t):
    return H.compact_chains(cut_lineage(H.path_tree(tree_input(t))))


@query("tree_search", """
    WITH RECURSIVE hit AS (SELECT id, parent_id FROM ox_tree WHERE contains(lower(name), 'th')),
      up AS (SELECT parent_id AS id FROM hit UNION SELECT t.parent_id FROM up JOIN ox_tree t ON t.id = up.id),
      low AS (SELECT id FROM hit WHERE id NOT IN (SELECT id FROM up)),
      down AS (SELECT id FROM low UNION SELECT t.id FROM down JOIN ox_tree t ON t.parent_id = down.id)
    SELECT id, name, type FROM ox_tree WHERE id IN (SELECT id FROM hit UNION SELECT id FROM up UNION SELECT id FROM down)""")
def tree_search(t):
    return H.search_tree(cut_lineage(H.path_tree(tree_input(t))), "TH").select("id", "name", "type")


@query("file_tree_report", """
    SELECT 'directory' AS part, id, path, name, false AS is_virtual, 0 AS line, 'directory' AS type, '' AS description FROM ox_dirs
    UNION ALL SELECT 'directory', id, path, name, true, 0, 'directory', '' FROM fx_virtual_directories
    UNION ALL SELECT 'file', id, path, name, false, 0, 'file', '' FROM ox_files
    UNION ALL SELECT 'method', r.id, r.file_path, r.label, false, r.line, r.type, coalesce(a.description, '') FROM ox_real r LEFT JOIN fx_node_annotations a ON a.node_id = r.id""")
def file_tree_report(t):
    files = N.files_of(N.real_nodes(t.fx_symbols))
    return H.file_tree(N.directories_of(files), files, t.fx_virtual_directories, t.fx_symbols, t.fx_node_annotations)
