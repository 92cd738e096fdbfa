"""Joins and dedupes that hold when one key owns a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1 / 64  # a key with at least this share of the rows is hot, so at most 64 keys are
SALTS = 64


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Values of ``key`` that hold at least ``share`` of all rows of ``df``.

    Runs one counting job over that column. There are never more than ``1 / share`` such values,
    whatever the size of ``df``, so the list is safe to bring to the driver.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNotNull())
    total = df.agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where(F.col("n") >= total.scalar() * F.lit(share))
    return [row[0] for row in hot.select(key).collect()]


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    hot: Sequence | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join of a large ``left`` with a ``right`` that has few rows per key.

    Without ``hot`` this is a plain join, for which adaptive execution splits partitions that turn out
    large. Columns come in the order of ``left``, then ``right``. With ``hot``, key values from :func:`hot_keys`, the rows of ``left`` for those keys are
    spread over ``salts`` tasks and only the matching rows of ``right`` are repeated. Inner, left,
    left_semi and left_anti. Rows of ``left`` equal in every column share a salt, so count exact
    duplicates first.
    """
    keys = [on] if isinstance(on, str) else list(on)
    shown = left.columns if how in ("left_semi", "left_anti") else [*left.columns, *[c for c in right.columns if c not in keys]]
    if not hot:
        return left.join(right, keys, how).select(*shown)
    is_hot = F.col(keys[0]).isin(list(hot))
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_left = left.withColumn("_salt", F.when(is_hot, spread).otherwise(F.lit(0)))
    salted_right = right.withColumn("_salt", F.explode(copies))
    return salted_left.join(salted_right, [*keys, "_salt"], how).select(*shown)


def matchable(key: Column, usable: Column, row_id: Column) -> Column:
    """``key`` where it is usable, else a value of the row's own that matches nothing.

    A left join on a column that is empty or NULL for many rows would send all of those to one task.
    """
    return F.when(usable, key).otherwise(F.concat(F.lit("\0"), row_id))


def last_per_key(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The row with the greatest ``order`` per key, by aggregation, so each task sends one row per key."""
    return _pick(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The row with the smallest ``order`` per key."""
    return _pick(df, keys, order, F.min_by)


def _pick(df, keys, order, choose) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(choose(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
