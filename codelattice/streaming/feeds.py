"""Change feeds as streams, with the same functions as the batch jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions.paths import language_of
from codelattice.operators import index as I
from codelattice.operators.locate import changed_sites_to_calls
from codelattice.operators.skew import skew_join
from codelattice.session import checkpoint_dir
from codelattice.sources import versioned

# Fixed value: quiet time after a save before its file is indexed.
DEBOUNCE_MS = 900


def debounce(saves: DataFrame, gap: str, time: str = "ts") -> DataFrame:
    """One job per burst of saves of a file: ``file_path, started, due, saves, last_event``.

    For a stream, put a watermark on ``saves`` first. Rows need ``event_id``. Bursts of one file meet in
    one task; ``spark.sql.sessionWindow.merge.sessionsInLocalPartition`` merges them before the shuffle.
    """
    return saves.groupBy("file_path", F.session_window(time, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("saves"), F.max_by("event_id", F.col(time)).alias("last_event")
    ).select("file_path", F.col("w.start").alias("started"), F.col("w.end").alias("due"), "saves", "last_event")


def debounce_batch(saves: DataFrame, gap_ms: int = DEBOUNCE_MS, time: str = "ts") -> DataFrame:
    """The same on a table, counted first in slots of the gap's length.

    Saves of a file in one slot are always one burst, so each task sends a row per file and slot and not
    one per save.
    """
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time).cast("timestamp_ntz"))
    slots = saves.withColumn("_us", micros).groupBy("file_path", F.floor(F.col("_us") / F.lit(gap_ms * 1000)).alias("_slot")).agg(
        F.min(time).alias("_from"), F.max("_us").alias("_to_us"), F.min("_us").alias("_from_us"),
        F.count(F.lit(1)).alias("_n"), F.max(F.struct("_us", "event_id")).alias("_last"))
    # A slot lasts from its first save to the gap after its last one.
    length = F.make_interval(secs=((F.col("_to_us") - F.col("_from_us")) / F.lit(1e6) + F.lit(gap_ms / 1000)).cast("decimal(18,6)"))
    return slots.groupBy("file_path", F.session_window("_from", length).alias("w")).agg(
        F.sum("_n").alias("saves"), F.max("_last").alias("_last")
    ).select("file_path", F.col("w.start").alias("started"), F.col("w.end").alias("due"), "saves", F.col("_last.event_id").alias("last_event"))


def index_jobs(saves: DataFrame) -> DataFrame:
    """Saves of files in a language that is indexed."""
    return saves.where(language_of(F.col("file_path")).isNotNull())


def queue_once(jobs: DataFrame, time: str, wait: str) -> DataFrame:
    """Stream of jobs in which a file that already waits is not queued again."""
    return jobs.withWatermark(time, wait).dropDuplicatesWithinWatermark(["file_path"])


USAGE_LINE = r"^\[([^\]]*)\] \[MCP\] \[([^\]]*)\] \[([^\]]*)\] ?(.*)$"


def usage_line(ts: Column, feature: Column, status: Column, details: Column) -> Column:
    """A usage log line as it is written."""
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("] [MCP] ["), feature, F.lit("] ["), status, F.lit("] "), details)


def parse_usage(lines: DataFrame, column: str = "line") -> DataFrame:
    """``ts, feature, status, details`` (a map) of each line that has the form of a usage line."""
    part = [F.regexp_extract(column, USAGE_LINE, g) for g in (1, 2, 3, 4)]
    return lines.where(F.rlike(column, F.lit(USAGE_LINE))).select(
        part[0].try_cast("timestamp_ntz").alias("ts"), part[1].alias("feature"), part[2].alias("status"),
        F.str_to_map(part[3], F.lit(", "), F.lit("=")).alias("details"))


def usage_windows(usage: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Uses per feature, status and window; put a watermark on a stream first to drop late lines."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return usage.groupBy(window.alias("w"), "feature", "status").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "feature", "status", "n")


def latest_status(events: DataFrame) -> DataFrame:
    """Status of each session after its events so far (``id, seq, status``); run in update mode."""
    return events.groupBy("id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


# --- running streams ------------------------------------------------------------------------------


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table of a shared folder, one Parquet file or a folder of them, as a stream.

    All files there come in one batch, unless ``files_per_trigger`` bounds it: rows that belong together (the units of one
    save, the saves of one hour) may lie in different files, and a watermark drops what comes a batch too late.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A pattern fits a file as well as a folder; a plain path must be a folder.
    return reader.parquet(f"{folder}/{name}[.]parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below the session's checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def append_available(stream: DataFrame, label: str, root: str | None = None) -> DataFrame:
    """Run an append-mode stream over all there is, into Parquet, and read the result.

    With the ``root`` of an earlier run the stream goes on where that one ended.
    """
    spark = stream.sparkSession
    root = root or scratch(spark, label)
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def update_available(stream: DataFrame, label: str, keys: list[str], order: str) -> DataFrame:
    """Run an update-mode aggregate over all there is; the last row per key is its state."""
    spark, root = stream.sparkSession, scratch(stream.sparkSession, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        # Overwriting by batch id makes a repeated batch harmless.
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{root}/out")
    return I.last_per_key(rows.select(*stream.columns), keys, order)


INDEX_TABLES = ["symbols", "method_calls", "manifest"]


def incremental_index(
    saved_units: DataFrame, root: str, calls_of: Callable[[DataFrame], DataFrame], state: str
) -> None:
    """Apply a stream of saved files to the tables kept at ``root``, one batch after the other.

    ``saved_units`` has, for each saved file, all its units: ``file_path, file_hash, id, kind, body_hash,
    seq``; a file saved without units has one row with no ``id``. Of several saves in a batch the last counts. ``calls_of`` gives the new calls of changed units (``id``). A batch that was applied before is
    skipped, so a restart does not apply it twice.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark, label = batch.sparkSession, f"batch {batch_id}"
        if versioned.is_committed(spark, root, label):
            return
        tables = versioned.load_tables(spark, root, INDEX_TABLES)
        batch = batch.persist()
        files = batch.groupBy("file_path").agg(F.max_by("file_hash", "seq").alias("file_hash"))
        # units of each file's last save; a save without units is a row without an id
        last = batch.join(files, ["file_path", "file_hash"], "left_semi").where("id is not null")
        new = I.last_per_key(last.select("id", "kind", "file_path", "body_hash", "seq"), ["id"], "seq")
        old = tables["symbols"].join(files.select("file_path"), "file_path", "left_semi")
        diff = I.unit_diff(old, new)
        fresh = calls_of(diff.where(F.col("change") == "changed").select("id"))
        out = I.apply_file_delta(
            tables["symbols"], tables["method_calls"], tables["manifest"], files, new, diff, fresh, "seq")
        versioned.save_tables(spark, root, out, label)
        batch.unpersist()

    query = saved_units.writeStream.foreachBatch(apply).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def index_saves(saved_units: DataFrame, root: str, state: str, buckets: int = versioned.BUCKETS) -> None:
    """Apply a stream of saved files, with their call sites, to the tables kept in buckets at ``root``.

    ``saved_units`` has, for each saved file, all its units: ``file_path, file_hash, id, kind, body_hash, line, end_line,
    seq, sites``; ``sites`` is an array of ``callee_file, callee_line, line``, null or empty for none. A file saved without units
    has one row with no ``id``. The units of a batch are compared with the stored ones, the sites of changed units are
    resolved on the symbols as stored before the batch, and the tables follow. Symbols and manifest are dealt by file,
    calls by caller; a batch writes the buckets of what it changes, and a batch that was applied is skipped.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark, label = batch.sparkSession, f"batch {batch_id}"
        if versioned.is_committed(spark, root, label):
            return
        tables = versioned.load_buckets(spark, root, INDEX_TABLES)
        batch = batch.persist()
        files = batch.groupBy("file_path").agg(F.max_by("file_hash", "seq").alias("file_hash"))
        last = batch.join(files, ["file_path", "file_hash"], "left_semi").where("id is not null")
        new = I.last_per_key(last, ["id"], "seq").select("file_path", "id", "kind", "body_hash", "line", "end_line", "seq", "sites")
        old = tables["symbols"].join(files.select("file_path"), "file_path", "left_semi")
        diff = I.unit_diff(old, new).persist()
        sites = new.select(F.col("id").alias("caller_id"), "file_path", F.inline("sites"))
        fresh = changed_sites_to_calls(sites, diff.where(F.col("change") == "changed"), tables["symbols"])
        out = I.apply_file_delta(tables["symbols"], tables["method_calls"], tables["manifest"], files, new, diff, fresh, "seq")
        moved = tables["symbols"].join(new.select("id"), "id", "left_semi").select("file_path")
        gone = diff.where(F.col("change") == "removed").select(F.col("id").alias("callee_id"))
        callers = diff.where(F.col("change") != "same").select(F.col("id").alias("caller_id")).unionByName(
            skew_join(tables["method_calls"], gone, "callee_id", "left_semi").select("caller_id"))
        versioned.save_buckets(
            spark, root, {"symbols": (out["symbols"], "file_path"), "method_calls": (out["method_calls"], "caller_id"), "manifest": (out["manifest"], "file_path")},
            {"symbols": files.select("file_path").unionByName(moved), "method_calls": callers, "manifest": files}, label, buckets)
        diff.unpersist()
        batch.unpersist()

    query = saved_units.writeStream.foreachBatch(apply).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
