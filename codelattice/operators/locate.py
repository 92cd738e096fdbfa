"""Finding the symbol that encloses a source location.

An interval join of locations with symbols, done by equal keys only. Each symbol's line range is cut
into aligned blocks of 1, 16, 256, … lines, the fewest that tile it. Per block only the best symbol
is kept, since the order of preference does not depend on the location. A location lies in exactly one
block per size, so it looks up a handful of keys and takes the best hit. However many ranges overlap
and however many locations one file has, no list of pairs per file is ever built. ``hot_files``, from
``hot_keys`` on the location's file, spreads the look-ups of files with a large share of the locations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.functions import paths
from codelattice.operators.skew import skew_join

BITS = 4  # blocks of 16 ** level lines
LEVELS = 8  # 16 ** 8 lines is beyond any int line number
OPEN_END = 2**31


_SEQ = "IF({0} < {1}, sequence({0}, {1} - 1), array())"


def _tile_ranges(ranges: DataFrame) -> DataFrame:
    """``ranges`` repeated per aligned block (``level, block``) that tiles ``start <= line < stop``.

    At each level a range takes the blocks inside it that no larger block inside it covers.
    """
    bounds = ranges.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).selectExpr(
        "*",
        f"shiftright(start + shiftleft(1L, {BITS} * level) - 1, {BITS} * level) AS lo",
        f"shiftright(stop, {BITS} * level) AS hi",
        f"shiftleft(shiftright(start + shiftleft(1L, {BITS} * (level + 1)) - 1, {BITS} * (level + 1)), {BITS}) AS up_lo",
        f"shiftleft(shiftright(stop, {BITS} * (level + 1)), {BITS}) AS up_hi",
    )
    edges = f"concat({_SEQ.format('lo', 'least(hi, up_lo)')}, {_SEQ.format('greatest(lo, up_hi)', 'hi')})"
    blocks = F.expr(f"IF(up_lo < up_hi, {edges}, {_SEQ.format('lo', 'hi')})")
    return bounds.withColumn("block", F.explode(blocks)).drop("lo", "hi", "up_lo", "up_hi")


def _enclosing(locations: DataFrame, ranges: DataFrame, hot_files=None) -> DataFrame:
    """Best symbol per distinct location.

    ``ranges`` has ``file_path, start, stop`` (half open), ``rank`` (smaller is better) and ``id``.
    """
    # Equal ranges first come down to their best symbol, so that a task which reads many symbols does not sort all their blocks.
    distinct = ranges.groupBy("file_path", "start", "stop").agg(F.min(F.struct("rank", "id")).alias("best"))
    best = _tile_ranges(distinct).groupBy("file_path", "level", "block").agg(F.min("best").alias("best"))
    asked = locations.select("file_path", "line").where((F.col("file_path") != "") & (F.col("line") > 0)).distinct()
    keys = asked.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).withColumn(
        "block", F.expr(f"shiftright(cast(line AS bigint), {BITS} * level)")
    )
    hits = skew_join(keys, best, ["file_path", "level", "block"], hot=hot_files)
    return hits.groupBy("file_path", "line").agg(F.min("best").alias("best")).select(
        "file_path", "line", F.col("best.id").alias("symbol_id")
    )


def nearest_ranges(symbols: DataFrame) -> DataFrame:
    """Ranges for the nearest-start rule. An end line of 0 means "to the end of the file"."""
    stop = F.when(F.col("end_line") == 0, F.lit(OPEN_END)).otherwise(F.col("end_line").cast("bigint") + 1)
    return symbols.select(
        "file_path", F.col("line").cast("bigint").alias("start"), stop.cast("bigint").alias("stop"),
        F.struct((-F.col("line")).alias("a")).alias("rank"), "id",
    ).where((F.col("start") < F.col("stop")) & (F.col("stop") > 0))


def narrowest_ranges(symbols: DataFrame) -> DataFrame:
    """Ranges for the narrowest-span rule. An end line of 0 or less means a single line."""
    end = F.when(F.col("end_line") > 0, F.greatest("end_line", "line")).otherwise(F.col("line"))
    return symbols.where((F.col("file_path") != "") & (F.col("line") > 0) & (F.col("id") != "")).select(
        paths.normalised(F.col("file_path")).alias("file_path"), F.col("line").cast("bigint").alias("start"),
        (end.cast("bigint") + 1).alias("stop"),
        F.struct((end - F.col("line")).alias("a"), F.col("line").alias("b"), end.alias("c")).alias("rank"), "id",
    )


def locate_nearest(locations: DataFrame, symbols: DataFrame, hot_files=None) -> DataFrame:
    """``file_path, line, symbol_id`` per location: the enclosing symbol that starts last.

    Symbols that start on the same line rank by id. Every location row stays; ``symbol_id`` is NULL where
    nothing encloses it or the location is not a proper one.
    """
    found = _enclosing(locations, nearest_ranges(symbols), hot_files)
    return skew_join(locations, found, ["file_path", "line"], "left", hot=hot_files)


def locate_narrowest(locations: DataFrame, symbols: DataFrame, hot_files=None) -> DataFrame:
    """``file_path, line, symbol_id`` per location: the enclosing symbol with the shortest range.

    Equal ranges rank by start, end and id. Every location row stays.
    """
    flat = locations.withColumn("file_path", paths.normalised(F.col("file_path")))
    return _located(flat, narrowest_ranges(symbols), hot_files)


def _located(flat: DataFrame, ranges: DataFrame, hot_files=None) -> DataFrame:
    """``flat``, whose paths are normalised, with the ``symbol_id`` of the best range."""
    return skew_join(flat, _enclosing(flat, ranges, hot_files), ["file_path", "line"], "left", hot=hot_files)


def _resolved(sites: DataFrame, ranges: DataFrame, hot_files=None) -> DataFrame:
    """``sites`` with ``callee_id``; each distinct place is normalised and looked up, and joined back as it was written."""
    written = sites.select("callee_file", "callee_line").distinct()
    places = written.select("callee_file", paths.normalised(F.col("callee_file")).alias("file_path"), F.col("callee_line").alias("line"))
    callee = _located(places, ranges, hot_files).select(
        "callee_file", F.col("line").alias("callee_line"), F.col("file_path").alias("_clean"), F.col("symbol_id").alias("callee_id")
    )
    joined = skew_join(sites, callee, ["callee_file", "callee_line"], "left", hot=hot_files)
    return joined.withColumn("callee_file", F.coalesce("_clean", paths.normalised(F.col("callee_file")))).drop("_clean")


def _as_calls(resolved: DataFrame) -> DataFrame:
    return (
        resolved.where(F.col("callee_id").isNotNull())
        .select("caller_id", "callee_id", F.lit("direct").alias("call_type"), "file_path", "line").distinct()
    )


def resolve_sites(sites: DataFrame, symbols: DataFrame, hot_files=None) -> DataFrame:
    """Call sites (``caller_id, callee_file, callee_line, file_path, line``) with the narrowest ``callee_id``."""
    return _resolved(sites, narrowest_ranges(symbols), hot_files)


def sites_to_calls(sites: DataFrame, symbols: DataFrame, hot_files=None) -> DataFrame:
    """Distinct calls from call sites; sites without an enclosing callee drop out."""
    return _as_calls(resolve_sites(sites, symbols, hot_files))


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """Pending, resolved and unresolved sites of :func:`resolve_sites`."""
    hit = F.col("callee_id").isNotNull()
    return resolved.agg(
        F.count(F.lit(1)).alias("pending"), F.count_if(hit).alias("resolved"), F.count_if(~hit).alias("unresolved")
    )


def changed_sites_to_calls(sites: DataFrame, changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """The same for changed callers (``id``) only, by the nearest-start rule on the stored symbols."""
    callers = changed.select(F.col("id").alias("caller_id")).distinct()
    mine = skew_join(sites, callers, "caller_id", "left_semi")
    return _as_calls(_resolved(mine, nearest_ranges(symbols)))
