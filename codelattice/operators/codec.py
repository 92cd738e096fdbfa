"""The JSON form of snapshots, at the boundary only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelattice.model import SNAPSHOT_EDGE_JSON, SNAPSHOT_NODE_JSON


def encode(items: Column) -> Column:
    """JSON text of an array column; a missing array is an empty one."""
    return F.coalesce(F.to_json(items), F.lit("[]"))


def node_items() -> Column:
    """A snapshot node row as its JSON struct."""
    return F.struct("id", "label", "type", F.col("file_path").alias("filePath"), "line", F.col("is_virtual").alias("isVirtual"),
                    F.col("parent_id").alias("parentId"), "description", F.col("ai_remarks").alias("aiRemarks"))


def _decode(df: DataFrame, key: str, column: str, schema: T.StructType) -> DataFrame:
    items = F.from_json(F.coalesce(F.nullif(column, F.lit("")), F.lit("[]")), T.ArrayType(schema))
    return df.select(key, F.posexplode(items).alias("pos", "item")).select(key, "pos", "item.*")


def decode_nodes(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row per node of the JSON array in ``column``, text and numbers filled where absent."""
    rows = _decode(df, key, column, SNAPSHOT_NODE_JSON)
    named = rows.withColumnsRenamed({"filePath": "file_path", "isVirtual": "is_virtual", "parentId": "parent_id", "aiRemarks": "ai_remarks"})
    return named.na.fill("").na.fill(0, ["line"]).na.fill(False)


def decode_edges(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row per edge of the JSON array in ``column``."""
    rows = _decode(df, key, column, SNAPSHOT_EDGE_JSON)
    return rows.withColumnsRenamed({"sourceId": "source_id", "targetId": "target_id"}).na.fill("")
