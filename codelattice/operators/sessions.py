"""Mask sessions, validation results and markers per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.operators.ranks import numbered


def validation_rollup(results: DataFrame) -> DataFrame:
    """``session_id, passed, status`` from results (``session_id, stage, passed``).

    A session passes if it has a parse result and none of them failed.
    """
    parsed = F.col("stage") == "parse"
    passed = F.coalesce(F.bool_and(F.when(parsed, F.col("passed"))), F.lit(False))
    return results.groupBy("session_id").agg(passed.alias("passed")).withColumn(
        "status", F.when(F.col("passed"), "validated").otherwise("filled"))


def diagnostic_counts(results: DataFrame) -> DataFrame:
    """Errors and warnings per file from results with a nested ``errors`` array (``severity, message``)."""
    each = results.select("file_path", F.explode_outer("errors").alias("e"))
    return each.groupBy("file_path").agg(
        F.count_if(F.col("e.severity") == "error").alias("errors"), F.count_if(F.col("e.severity") == "warning").alias("warnings"))


def marker_sessions(files: DataFrame, markers: DataFrame, tracked: DataFrame) -> DataFrame:
    """Per file: distinct sessions, seen now or before, and whether markers remain."""
    seen = markers.select("file_path", "session_id", F.lit(True).alias("open")).unionByName(
        tracked.select("file_path", "session_id", F.lit(False).alias("open")))
    once = seen.groupBy("file_path", "session_id").agg(F.max("open").alias("open"))
    per_file = once.groupBy("file_path").agg(F.count(F.lit(1)).alias("sessions"), F.max("open").alias("has_markers"))
    return files.select("file_path").distinct().join(per_file, "file_path", "left").select(
        "file_path", F.coalesce("sessions", F.lit(0).cast("bigint")).alias("sessions"), F.coalesce("has_markers", F.lit(False)).alias("has_markers"))


def session_transitions(sessions: DataFrame, submissions: DataFrame, results: DataFrame) -> DataFrame:
    """Sessions (``id, …, filled_code, status``) after submissions (``id, seq, code``) and their results.

    ``results`` are validation results with ``session_id`` and the ``seq`` they belong to. The last
    submission of a session decides: validated if it passes, else filled.
    """
    last = submissions.groupBy("id").agg(F.max_by(F.struct("code", "seq"), "seq").alias("s")).select("id", "s.code", "s.seq")
    mine = results.join(last.select(F.col("id").alias("session_id"), "seq"), ["session_id", "seq"], "left_semi")
    verdict = validation_rollup(mine).select(F.col("session_id").alias("id"), "passed")
    state = last.join(verdict, "id", "left").select(
        "id", F.col("code").alias("_code"), F.when(F.coalesce("passed", F.lit(False)), "validated").otherwise("filled").alias("_status"))
    out = sessions.join(state, "id", "left")
    return out.withColumn("filled_code", F.coalesce("_code", "filled_code")).withColumn("status", F.coalesce("_status", "status")).select(*sessions.columns)


def session_history(sessions: DataFrame) -> DataFrame:
    """``position, id, file_path, status, created_at``, position 1 being the newest; equal times by descending id, no time last.

    Positions are counted over ranges of time, so no task sees the whole history.
    """
    rows = sessions.select("id", "file_path", "status", "created_at")
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return numbered(rows, [], ["created_at", "id"], "_oldest").select((total + 1 - F.col("_oldest")).alias("position"), *rows.columns)
