"""Clean paths, runs that count what they write, and the course of sessions."""

from pyspark.sql import functions as F

from codelattice.functions import paths
from codelattice.operators.lookup import save_index
from codelattice.operators.sessions import session_history
from codelattice.sources.versioned import load_tables


def test_only_paths_that_need_it_are_rewritten(spark):
    want = {
        "a/b.go": "a/b.go", "/a/.b/c": "/a/.b/c", "a..b/c.": "a..b/c.", "a//b": "a/b", "a/./b": "a/b", "a/././b": "a/b", "a/b/": "a/b", "a/b/.": "a/b",
        "/": "/", "//": "/", "a/../b": "b", "/..": "/", "/../a": "/a", "../a": "../a", "a/..": "", "..": "..", "": "", "...": "...", "a/...": "a/...", None: None,
    }
    rows = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r.p: r.n for r in rows.select("p", paths.normalised(F.col("p")).alias("n")).collect()} == want


def test_a_save_counts_what_it_writes(spark, tmp_path):
    symbols, calls = spark.range(7).select(F.col("id").cast("string").alias("id")), spark.range(20_000, numPartitions=4).toDF("n")
    for number, (s, c) in enumerate([(symbols, calls), (symbols.limit(0), calls), (spark.createDataFrame([], "id string"), calls.where("n < 3"))], 1):
        row = save_index(spark, str(tmp_path), s, c).first()
        stored = load_tables(spark, str(tmp_path), ["symbols", "calls"], number)
        assert (row.symbols, row.edges) == (stored["symbols"].count(), stored["calls"].count()) and row.duration_ms >= 0
        assert row.version == number


def test_history_is_newest_first(spark):
    rows = [("a", "f", "pending", 3), ("b", "f", "filled", 5), ("c", "g", "pending", 3), ("d", "g", "pending", None)]
    sessions = spark.createDataFrame(rows, "id string, file_path string, status string, created_at int").repartition(3)
    assert [r.id for r in session_history(sessions).orderBy("position").collect()] == ["b", "c", "a", "d"]
    assert session_history(sessions.limit(0)).count() == 0
