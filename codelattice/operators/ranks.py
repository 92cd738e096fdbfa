"""Positions and running sums by order, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.session import stored

_ROW_BITS = 33  # that monotonically_increasing_id gives to the row in its partition


def running_sum(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over the rows before them in their ``group`` by ``order``.

    Rows are dealt by ranges of group and order, summed by range, and the ranges' sums are carried on. Group columns
    are not null; rows that are equal in group and order follow each other in any order.
    """
    keys = [*group, *order]
    ranged = rows.withColumn("_value", value.cast("bigint")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", _ROW_BITS))
    # a row for each range and group that it holds some of
    ranges = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*group, "_part").agg(F.sum("_value").alias("_sum"))
    carried = sums.select(*group, "_part", F.coalesce(F.sum("_sum").over(ranges), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(carried, [*group, "_part"])
    return summed.withColumn(name, F.col("_inside") + F.col("_carried")).select(*rows.columns, name)


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``name``, their position in their ``group`` by ``order``, counting from 1."""
    return running_sum(rows, group, order, F.lit(1), name).withColumn(name, F.col(name) + 1)
