"""Sets of tables that change together.

Each save writes all tables of a new version and then one commit row. Readers take the newest
committed version, so a save that dies half way is never seen. Tables in buckets are written in part: a save
has the buckets it touched, and its commit a row for each of them.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from codelattice.session import shuffles_removed

COMMIT = "version bigint, source string, name string, bucket int, fields string"
BUCKETS = 64


def _commits(spark: SparkSession, root: str) -> DataFrame | None:
    """The commit rows, None where nothing was ever saved; any other fault in reading them is raised."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{root}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest_version(spark: SparkSession, root: str) -> int:
    """Newest committed version, 0 if there is none."""
    commits = _commits(spark, root)
    return 0 if commits is None else commits.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def is_committed(spark: SparkSession, root: str, source: str) -> bool:
    """True if a save with this ``source`` label, such as a batch id, went through before."""
    commits = _commits(spark, root)
    return commits is not None and not commits.where(F.col("source") == source).isEmpty()


def load_tables(spark: SparkSession, root: str, names: list[str], version: int | None = None) -> dict[str, DataFrame]:
    number = latest_version(spark, root) if version is None else version
    return {name: spark.read.parquet(f"{root}/version={number}/{name}") for name in names}


def save_tables(spark: SparkSession, root: str, tables: dict[str, DataFrame], source: str = "") -> int:
    """Write ``tables`` as the next version and commit it.

    One writer at a time, such as the one stream that owns the set: what a save that died before its commit
    left under the number is written over, and a number that was committed meanwhile is refused.
    """
    number = latest_version(spark, root) + 1
    with shuffles_removed(spark):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{root}/version={number}/{name}")
    if latest_version(spark, root) >= number:
        raise RuntimeError(f"version {number} of {root} was committed by another writer")
    commit = spark.range(1).select(F.lit(number).cast("bigint").alias("version"), F.lit(source).alias("source"))
    commit.write.mode("append").parquet(f"{root}/commits")
    return number


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def save_buckets(
    spark: SparkSession, root: str, tables: dict[str, tuple[DataFrame, str]], touched: dict[str, DataFrame] | None = None, source: str = "", buckets: int = BUCKETS
) -> int:
    """Write the buckets of ``tables`` (rows and the column they are dealt by) that hold a key of ``touched``, and commit them.

    Without ``touched`` all buckets are written. One writer at a time, as in :func:`save_tables`.
    """
    number, rows = latest_version(spark, root) + 1, []
    with shuffles_removed(spark):  # a save shuffles its tables several times over
        for name, (df, key) in tables.items():
            which = list(range(buckets))
            if touched is not None:
                which = [r[0] for r in touched[name].select(bucket_of(key, buckets)).distinct().collect()]  # at most one row for each bucket
            if which:
                part = df.withColumn("bucket", bucket_of(key, buckets)).where(F.col("bucket").isin(which))
                part.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/version={number}/{name}")
                rows += [(number, source, name, b, df.schema.json()) for b in which]
    if latest_version(spark, root) >= number:
        raise RuntimeError(f"version {number} of {root} was committed by another writer")
    rows = rows or [(number, source, None, None, None)]
    spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return number


def load_buckets(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables put together from the newest committed version of each bucket."""
    newest = _commits(spark, root).where(F.col("name").isin(names)).groupBy("name", "bucket").agg(F.max(F.struct("version", "fields")).alias("last"))
    found: dict[str, dict[tuple[int, str], list[int]]] = {name: {} for name in names}
    for r in newest.collect():  # one row for each bucket of each table
        found[r["name"]].setdefault((r["last"]["version"], r["last"]["fields"]), []).append(r["bucket"])
    out = {}
    for name, versions in found.items():
        parts = []
        for (version, fields), which in sorted(versions.items()):
            schema = StructType.fromJson(json.loads(fields))
            stored = spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(f"{root}/version={version}/{name}")
            parts.append(stored.where(F.col("bucket").isin(which)).drop("bucket"))
        out[name] = reduce(DataFrame.unionByName, parts)
    return out
