"""Set-based lookups: many keys in, one row per key out."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from codelattice.operators.skew import skew_join
from codelattice.sources.versioned import save_tables

CALLABLE_KINDS = ("method", "constructor", "function")

# Listing order of each table.
LIST_ORDER = {
    "calls": ["file_path", "line"],
    "notes": ["-updated_at"],
    "virtual": ["-created_at"],
    "dirs": ["path"],
    "snapshots": ["-created_at"],
    "sessions": ["-created_at"],
    "symbols": [],
}


def ordered(table: DataFrame, name: str) -> DataFrame:
    """The whole table in its listing order; a leading ``-`` means newest first."""
    order = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c) for c in LIST_ORDER[name]]
    return table.orderBy(*order) if order else table


def point_lookup(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """One row per distinct key, with ``found`` false where the table has none."""
    return keys.select(key).distinct().join(table.withColumn("_found", F.lit(True)), key, "left").select(
        *table.columns, F.coalesce("_found", F.lit(False)).alias("found")
    )


def virtual_in_directory(virtual: DataFrame, directory: str) -> DataFrame:
    return virtual.where(F.col("virtual_directory") == directory).orderBy("label")


def directories_in(directories: DataFrame, parent: str) -> DataFrame:
    return directories.where(F.col("parent_path") == parent).orderBy("name")


def remarks_between(pairs: DataFrame, edge_annotations: DataFrame) -> DataFrame:
    """Remarks for pairs ``a, b`` whichever way the edge points."""
    low, high = F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi")
    notes = edge_annotations.select(
        F.least("source_node_id", "target_node_id").alias("_lo"), F.greatest("source_node_id", "target_node_id").alias("_hi"),
        "edge_id", "remarks",
    )
    return pairs.select("a", "b", low, high).join(notes, ["_lo", "_hi"]).drop("_lo", "_hi")


def callables(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isin(*CALLABLE_KINDS))


def names_exist(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """``name, present`` for each distinct name asked for."""
    known = symbols.select("name").distinct().withColumn("_known", F.lit(True))
    return skew_join(names.select("name").distinct(), known, "name", "left").select(
        "name", F.coalesce("_known", F.lit(False)).alias("present")
    )


def index_stats(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Numbers of symbols and calls, in one row."""
    tagged = symbols.select(F.lit(1).alias("s"), F.lit(0).alias("e")).unionByName(calls.select(F.lit(0).alias("s"), F.lit(1).alias("e")))
    return tagged.agg(F.sum("s").alias("symbols"), F.sum("e").alias("edges"))


def save_index(spark: SparkSession, root: str, symbols: DataFrame, calls: DataFrame, source: str = "") -> DataFrame:
    """Save both tables as the next version under ``root``: ``version, symbols, edges, duration_ms``, in one row.

    The writes themselves count their rows, so no table is read again for it.
    """
    seen = {name: Observation(f"{name}-{uuid.uuid4().hex}") for name in ("symbols", "calls")}
    tables = {name: df.observe(seen[name], F.count(F.lit(1)).alias("n")) for name, df in (("symbols", symbols), ("calls", calls))}
    start = time.monotonic()
    version = save_tables(spark, root, tables, source)
    took = int(1000 * (time.monotonic() - start))
    counts = [seen[name].get.get("n", 0) for name in ("symbols", "calls")]
    return spark.createDataFrame([(version, *counts, took)], "version long, symbols long, edges long, duration_ms long")
