"""Queries on source locations and call sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelattice.operators import locate as L
from codelattice.operators.skew import hot_keys
from codelattice.plans.registry import oracle_view, query

oracle_view("ox_nearest", """
    SELECT file_path, line, id FROM (
      SELECT l.file_path, l.line, s.id, row_number() OVER (PARTITION BY l.file_path, l.line ORDER BY s.line DESC, s.id) AS rn
      FROM (SELECT DISTINCT file_path, line FROM fx_locations) l JOIN fx_symbols s ON s.file_path = l.file_path
        AND s.line <= l.line AND (s.end_line = 0 OR s.end_line >= l.line)) x WHERE rn = 1""")
oracle_view("ox_spans", """
    SELECT id, file_path, line AS a, CASE WHEN end_line > 0 THEN greatest(end_line, line) ELSE line END AS b FROM fx_symbols""")
oracle_view("ox_narrowest", """
    SELECT file_path, line, id FROM (
      SELECT l.file_path, l.line, s.id, row_number() OVER (PARTITION BY l.file_path, l.line ORDER BY s.b - s.a, s.a, s.b, s.id) AS rn
      FROM (SELECT DISTINCT file_path, line FROM fx_locations) l JOIN ox_spans s ON s.file_path = l.file_path
        AND l.line BETWEEN s.a AND s.b) x WHERE rn = 1""")


def _asked(t):
    """The locations, with some that cannot resolve."""
    bad = t.nation.select(F.lit("").alias("file_path"), F.col("n_nationkey").alias("line")).union(
        t.nation.select(F.lit("src/none.java"), -F.col("n_nationkey")))
    return t.fx_locations.unionByName(bad)


ASKED = """(SELECT file_path, line FROM fx_locations UNION ALL SELECT '', n_nationkey FROM nation
    UNION ALL SELECT 'src/none.java', -n_nationkey FROM nation)"""


def _answer(df):
    return df.select("file_path", "line", F.coalesce("symbol_id", F.lit("")).alias("symbol_id"))


@query("locate_enclosing_nearest", f"""
    SELECT l.file_path, l.line, coalesce(n.id, '') AS symbol_id FROM {ASKED} l
    LEFT JOIN ox_nearest n ON n.file_path = l.file_path AND n.line = l.line""")
def locate_enclosing_nearest(t):
    asked = _asked(t)
    return _answer(L.locate_nearest(asked, t.fx_symbols, hot_keys(asked, "file_path")))


@query("locate_enclosing_narrowest", f"""
    SELECT l.file_path, l.line, coalesce(n.id, '') AS symbol_id FROM {ASKED} l
    LEFT JOIN ox_narrowest n ON n.file_path = l.file_path AND n.line = l.line""")
def locate_enclosing_narrowest(t):
    asked = _asked(t)
    return _answer(L.locate_narrowest(asked, t.fx_symbols, hot_keys(asked, "file_path")))


@query("interval_rank", """
    SELECT file_path, start_line, min(id) AS id, max(stop_line) AS stop_line FROM (
      SELECT file_path, line AS start_line, id, CASE WHEN end_line = 0 THEN 2147483648 ELSE cast(end_line AS bigint) + 1 END AS stop_line FROM fx_symbols) x
    GROUP BY file_path, start_line""")
def interval_rank(t):
    ranges = L.nearest_ranges(t.fx_symbols)
    return ranges.groupBy("file_path", F.col("start").cast("int").alias("start_line")).agg(
        F.min(F.struct("rank", "id")).alias("r"), F.max("stop").alias("stop_line")).select("file_path", "start_line", "r.id", "stop_line")


@query("callsite_to_edges", """
    SELECT DISTINCT c.caller_id, n.id AS callee_id, 'direct' AS call_type, c.file_path, c.line
    FROM fx_call_sites c JOIN ox_narrowest n ON n.file_path = c.callee_file AND n.line = c.callee_line""")
def callsite_to_edges(t):
    return L.sites_to_calls(t.fx_call_sites, t.fx_symbols, hot_keys(t.fx_call_sites, "callee_file"))


@query("resolution_stats", """
    SELECT count(*) AS pending, count(n.id) AS resolved, count(*) - count(n.id) AS unresolved
    FROM fx_call_sites c LEFT JOIN ox_narrowest n ON n.file_path = c.callee_file AND n.line = c.callee_line""")
def resolution_stats(t):
    return L.resolution_stats(L.resolve_sites(t.fx_call_sites, t.fx_symbols))


@query("callsite_to_edges_incremental", """
    SELECT DISTINCT c.caller_id, n.id AS callee_id, 'direct' AS call_type, c.file_path, c.line
    FROM fx_call_sites c JOIN ox_nearest n ON n.file_path = c.callee_file AND n.line = c.callee_line
    WHERE c.caller_id IN (SELECT id FROM fx_symbols WHERE seq % 3 = 0)""")
def callsite_to_edges_incremental(t):
    return L.changed_sites_to_calls(t.fx_call_sites, t.fx_symbols.where("seq % 3 = 0").select("id"), t.fx_symbols)
