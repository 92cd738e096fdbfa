"""Queries on the change feeds. Streams run over all that is there and end."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelattice.plans.registry import oracle_view, query
from codelattice.session import shuffles_removed, stored
from codelattice.sources import versioned
from codelattice.streaming import feeds as S
from codelattice.streaming import stateful

SIX_HOURS = 6 * 3600 * 1000


oracle_view("ox_bursts", """
    SELECT file_path, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS due, count(*) AS saves, arg_max(event_id, ts) AS last_event FROM (
      SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY ts, event_id) AS burst FROM (
        SELECT *, lag(ts) OVER (PARTITION BY file_path ORDER BY ts, event_id) AS prev FROM fx_save_events) a) b GROUP BY file_path, burst""")
BURST = """SELECT file_path, strftime(started, '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(due, '%Y-%m-%d %H:%M:%S.%f') AS due, saves, last_event FROM ox_bursts"""


@query("save_debounce", BURST)
def save_debounce(t):
    return _stamped(S.debounce_batch(t.fx_save_events, SIX_HOURS))


def _stamped(jobs):
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return jobs.select("file_path", F.date_format("started", stamp).alias("started"), F.date_format("due", stamp).alias("due"), "saves", "last_event")


def _save_stream(t):
    events = S.table_stream(t.spark, t.sf_dir, "events")
    path = F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".go"))
    return S.index_jobs(events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), path.alias("file_path")))


# An append-mode stream holds bursts back until the watermark has passed their end.
@query("save_debounce_stream", BURST + " WHERE due <= (SELECT max(ts) FROM fx_save_events) - INTERVAL 1 HOUR")
def save_debounce_stream(t):
    jobs = S.debounce(_save_stream(t).withWatermark("ts", "1 hour"), "6 hours")
    return _stamped(S.append_available(jobs, "debounce"))


# All saves of the table come in one batch, so each file is queued once.
@query("queue_dedupe", "SELECT DISTINCT file_path FROM fx_save_events")
def queue_dedupe(t):
    return S.append_available(S.queue_once(_save_stream(t), "ts", "6 hours"), "queue").select("file_path")


@query("incremental_index_stream", """
    SELECT id, body_hash FROM fx_units_new UNION ALL SELECT id, body_hash FROM fx_units_old
    WHERE file_path NOT IN (SELECT file_path FROM fx_units_new) AND id NOT IN (SELECT id FROM fx_units_new)""")
def incremental_index_stream(t):
    root = S.scratch(t.spark, "index")
    old = t.fx_units_old.select("id", "kind", "file_path", "body_hash", F.lit(0).cast("bigint").alias("seq"))
    calls = t.fx_method_calls.select("caller_id", "callee_id", "call_type", "file_path", "line")
    manifest = old.select("file_path").distinct().withColumn("file_hash", F.lit("old"))
    versioned.save_tables(t.spark, root, {"symbols": old, "method_calls": calls, "manifest": manifest}, "start")
    docs = S.table_stream(t.spark, t.sf_dir, "documents").where("doc_id % 11 <> 0")
    body = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" edit"))).otherwise(F.col("text"))
    units = docs.select(
        F.col("source").alias("file_path"), F.md5("source").alias("file_hash"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("doc_id") % 4 == 0, "function").otherwise("method").alias("kind"), F.md5(body).alias("body_hash"), F.col("doc_id").alias("seq"))

    def calls_of(changed):
        return changed.select(F.col("id").alias("caller_id"), F.lit("d1").alias("callee_id"), F.lit("direct").alias("call_type"),
                              F.lit("g").alias("file_path"), F.lit(1).alias("line"))

    S.incremental_index(units, root, calls_of, S.scratch(t.spark, "index-state"))
    return versioned.load_tables(t.spark, root, ["symbols"])["symbols"].select("id", "body_hash")


oracle_view("ox_t0_symbols", "SELECT id, kind, file_path, body_hash FROM fx_units_old")
oracle_view("ox_t0_manifest", "SELECT DISTINCT file_path, 'old' AS file_hash FROM fx_units_old")
oracle_view("ox_t0_calls", """
    SELECT concat('d', cast(l_suppkey AS string)) AS caller_id, concat('d', cast(l_partkey % 1000 AS string)) AS callee_id, l_returnflag = 'R' AS manual FROM lineitem""")
for _k, _p in ((1, 0), (2, 1), (3, 2)):
    oracle_view(f"ox_t{_k}_files", f"SELECT file_path, max(save) AS save FROM fx_saves WHERE batch = {_k} GROUP BY file_path")
    oracle_view(f"ox_t{_k}_new", f"""
        SELECT s.id, s.kind, s.file_path, s.body_hash FROM fx_saves s JOIN ox_t{_k}_files f ON f.file_path = s.file_path AND f.save = s.save WHERE s.id IS NOT NULL""")
    oracle_view(f"ox_t{_k}_diff", f"""
        SELECT coalesce(o.id, n.id) AS id, n.id IS NULL AS removed FROM ox_t{_k}_new n FULL JOIN (SELECT * FROM ox_t{_p}_symbols
          WHERE kind IN ('method', 'constructor', 'function') AND file_path IN (SELECT file_path FROM ox_t{_k}_files)) o ON o.id = n.id
        WHERE n.id IS NULL OR o.id IS NULL OR o.body_hash <> n.body_hash""")
    oracle_view(f"ox_t{_k}_symbols", f"""
        SELECT * FROM ox_t{_k}_new UNION ALL SELECT * FROM ox_t{_p}_symbols
        WHERE file_path NOT IN (SELECT file_path FROM ox_t{_k}_files) AND id NOT IN (SELECT id FROM ox_t{_k}_new)""")
    oracle_view(f"ox_t{_k}_calls", f"""
        SELECT * FROM ox_t{_p}_calls WHERE manual OR (caller_id NOT IN (SELECT id FROM ox_t{_k}_diff) AND callee_id NOT IN (SELECT id FROM ox_t{_k}_diff WHERE removed))
        UNION ALL SELECT id, 'd1', false FROM ox_t{_k}_diff WHERE NOT removed""")
    oracle_view(f"ox_t{_k}_manifest", f"""
        SELECT file_path, concat('h', cast(save AS string)) AS file_hash FROM ox_t{_k}_files
        UNION ALL SELECT * FROM ox_t{_p}_manifest WHERE file_path NOT IN (SELECT file_path FROM ox_t{_k}_files)""")


@query("incremental_index_batches", """
    SELECT 'symbols' AS part, id AS key, body_hash AS value, count(*) AS n FROM ox_t3_symbols GROUP BY id, body_hash
    UNION ALL SELECT 'calls', caller_id, callee_id, count(*) FROM ox_t3_calls GROUP BY caller_id, callee_id
    UNION ALL SELECT 'manifest', file_path, file_hash, count(*) FROM ox_t3_manifest GROUP BY file_path, file_hash""")
def incremental_index_batches(t):
    """Three batches of saves, and a last run that finds nothing new."""
    root = S.scratch(t.spark, "index")
    old = t.fx_units_old.select("id", "kind", "file_path", "body_hash", F.lit(0).cast("bigint").alias("seq"))
    calls = t.lineitem.select(
        F.concat(F.lit("d"), F.col("l_suppkey").cast("string")).alias("caller_id"), F.concat(F.lit("d"), (F.col("l_partkey") % 1000).cast("string")).alias("callee_id"),
        F.when(F.col("l_returnflag") == "R", "manual").otherwise("direct").alias("call_type"), F.lit("f").alias("file_path"), F.lit(1).alias("line"))
    manifest = old.select("file_path").distinct().withColumn("file_hash", F.lit("old"))
    versioned.save_tables(t.spark, f"{root}/tables", {"symbols": old, "method_calls": calls, "manifest": manifest}, "start")
    saves = t.fx_saves.select(
        "batch", "file_path", F.concat(F.lit("h"), F.col("save").cast("string")).alias("file_hash"), "id", "kind", "body_hash", F.col("save").cast("bigint").alias("seq"))

    def calls_of(changed):
        return changed.select(F.col("id").alias("caller_id"), F.lit("d1").alias("callee_id"), F.lit("direct").alias("call_type"),
                              F.lit("g").alias("file_path"), F.lit(1).alias("line"))

    for batch in (1, 2, 3, 4):
        saves.where(F.col("batch") == batch).drop("batch").write.mode("append").parquet(f"{root}/feed")
        feed = t.spark.readStream.schema(saves.drop("batch").schema).parquet(f"{root}/feed")
        S.incremental_index(feed, f"{root}/tables", calls_of, f"{root}/state")
    got = versioned.load_tables(t.spark, f"{root}/tables", S.INDEX_TABLES)
    parts = [("symbols", "symbols", "id", "body_hash"), ("calls", "method_calls", "caller_id", "callee_id"), ("manifest", "manifest", "file_path", "file_hash")]
    out = [got[name].groupBy(F.col(a).alias("key"), F.col(b).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "key", "value", "n")
           for part, name, a, b in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("edge_append_stream", """
    SELECT concat('p', l_suppkey) AS caller_id, concat('p', l_partkey) AS callee_id, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def edge_append_stream(t):
    lines = S.table_stream(t.spark, t.sf_dir, "lineitem")
    calls = lines.select(
        F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("caller_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("callee_id"))
    stored = S.append_available(calls, "edges")
    return stored.groupBy("caller_id", "callee_id").agg(F.count(F.lit(1)).alias("n"))


def _usage(t):
    details = F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(", event="), F.col("event_id").cast("string"))
    lines = t.fx_usage_log.select(S.usage_line(F.col("ts"), F.col("feature"), F.col("status"), details).alias("line"))
    return S.parse_usage(lines)


def _windows(df):
    return df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "feature", "status", "n")


@query("usage_log_windows", """
    SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, feature, status, count(*) AS n FROM fx_usage_log GROUP BY 1, 2, 3""")
def usage_log_windows(t):
    return _windows(S.usage_windows(_usage(t), "6 hours"))


@query("usage_log_sliding", """
    SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL (k * 6) HOUR, '%Y-%m-%d %H:%M') AS window_start, feature, status, count(*) AS n
    FROM fx_usage_log, (SELECT unnest([0, 1]) AS k) s GROUP BY 1, 2, 3""")
def usage_log_sliding(t):
    return _windows(S.usage_windows(_usage(t), "12 hours", "6 hours"))


# One line in ten comes after all others, and too late for any window that is out by then.
@query("usage_log_windows_stream", """
    SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, feature, status, count(*) AS n FROM fx_usage_log
    WHERE event_id % 10 <> 0 AND time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM fx_usage_log WHERE event_id % 10 <> 0) - INTERVAL 1 DAY
    GROUP BY 1, 2, 3""")
def usage_log_windows_stream(t):
    root = S.scratch(t.spark, "usage")
    feed = f"{root}/feed"
    lines = t.fx_usage_log.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "feature", "status")
    out = None
    for late in (False, True):
        lines.where((F.col("event_id") % 10 == 0) == F.lit(late)).write.mode("append").parquet(feed)
        stream = t.spark.readStream.schema(lines.schema).parquet(feed).withWatermark("ts", "1 day")
        out = S.append_available(S.usage_windows(stream, "6 hours"), "usage", f"{root}/run")
    return _windows(out)


@query("usage_log_details", "SELECT event_id, user_id, feature, status FROM fx_usage_log")
def usage_log_details(t):
    d = F.col("details")
    return _usage(t).select(d["event"].cast("bigint").alias("event_id"), d["user"].cast("bigint").alias("user_id"), "feature", "status")


@query("session_status_stream", """
    SELECT concat('s', conv_id) AS id, CASE max(turn) % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'filled' ELSE 'validated' END AS status, max(turn) AS seq
    FROM conversations GROUP BY conv_id""")
def session_status_stream(t):
    turns = S.table_stream(t.spark, t.sf_dir, "conversations")
    status = F.when(F.col("turn") % 3 == 0, "pending").when(F.col("turn") % 3 == 1, "filled").otherwise("validated")
    events = turns.select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("id"), F.col("turn").alias("seq"), status.alias("status"))
    return S.update_available(S.latest_status(events), "status", ["id"], "seq")


# --- states of their own, and the whole chain on save ---------------------------------------------


def _in_parts(t, rows, label, count, make):
    """Run the stream that ``make`` builds over ``rows`` in ``count`` batches by ``part``, and read all it wrote."""
    root, out = S.scratch(t.spark, label), None
    schema = rows.drop("part").schema
    for part in range(count):
        rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{root}/feed")
        with stateful.keyed_state(t.spark):
            out = S.append_available(make(t.spark.readStream.schema(schema).parquet(f"{root}/feed")), label, f"{root}/run")
    return out


# After a save a file waits, after it was taken it does not, so the event before tells.
@query("queue_waits", """
    SELECT file_path, event_id FROM (SELECT *, lag(event) OVER (PARTITION BY file_path ORDER BY ts, event_id) AS before FROM fx_queue_events) x
    WHERE event = 'saved' AND coalesce(before, 'taken') = 'taken'""")
def queue_waits(t):
    span = t.fx_queue_events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    third = (span["b"] - span["a"]) / 3
    part = F.when(F.col("ts") < span["a"] + third, 0).when(F.col("ts") < span["a"] + 2 * third, 1).otherwise(2)
    events = t.fx_queue_events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event", "file_path", part.alias("part"))
    return _in_parts(t, events, "waits", 3, lambda stream: stateful.queue_files(stream, 10**12)).select("file_path", "event_id")


@query("session_course_stream", """
    WITH RECURSIVE steps AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM fx_session_steps),
    fold AS (
        SELECT id, seq, status, n, status = 'pending' AS accepted, CASE WHEN status = 'pending' THEN status ELSE '' END AS state FROM steps WHERE n = 1
        UNION ALL SELECT s.id, s.seq, s.status, s.n, ok, CASE WHEN ok THEN s.status ELSE f.state END
        FROM (SELECT s.*, f.state, CASE f.state WHEN '' THEN s.status = 'pending' WHEN 'pending' THEN s.status = 'filled' WHEN 'filled' THEN s.status IN ('filled', 'validated') ELSE false END AS ok
              FROM fold f JOIN steps s ON s.id = f.id AND s.n = f.n + 1) s JOIN fold f ON f.id = s.id AND f.n = s.n - 1)
    SELECT id, CAST(seq AS bigint) AS seq, status, accepted FROM fold""")
def session_course_stream(t):
    steps = t.fx_session_steps.select(
        "id", F.col("seq").cast("bigint").alias("seq"), "status", F.timestamp_seconds(F.col("seq") + 1).alias("ts"), F.least(F.col("seq"), F.lit(2)).cast("int").alias("part"))
    return _in_parts(t, steps, "course", 3, lambda stream: stateful.session_course(stream, 10**12))


oracle_view("ox_c0_symbols", "SELECT id, kind, file_path, body_hash, line, end_line FROM fx_symbols")
oracle_view("ox_c0_manifest", "SELECT DISTINCT file_path, 'old' AS file_hash FROM fx_symbols")
oracle_view("ox_c0_calls", """
    SELECT concat('p', cast(l_partkey AS string)) AS caller_id, concat('p', cast(l_suppkey * 5 AS string)) AS callee_id, l_returnflag = 'R' AS manual, l_linenumber AS line, 'f' AS file_path FROM lineitem""")
for _k, _p in ((1, 0), (2, 1), (3, 2)):
    oracle_view(f"ox_c{_k}_files", f"SELECT DISTINCT file_path FROM fx_code_saves WHERE batch = {_k}")
    oracle_view(f"ox_c{_k}_new", f"SELECT id, kind, file_path, body_hash, line, end_line FROM fx_code_saves WHERE batch = {_k} AND id IS NOT NULL")
    oracle_view(f"ox_c{_k}_diff", f"""
        SELECT coalesce(o.id, n.id) AS id, n.id IS NULL AS removed FROM ox_c{_k}_new n FULL JOIN (SELECT * FROM ox_c{_p}_symbols
          WHERE kind IN ('method', 'constructor', 'function') AND file_path IN (SELECT file_path FROM ox_c{_k}_files)) o ON o.id = n.id
        WHERE n.id IS NULL OR o.id IS NULL OR o.body_hash <> n.body_hash""")
    oracle_view(f"ox_c{_k}_symbols", f"""
        SELECT * FROM ox_c{_k}_new UNION ALL SELECT * FROM ox_c{_p}_symbols
        WHERE file_path NOT IN (SELECT file_path FROM ox_c{_k}_files) AND id NOT IN (SELECT id FROM ox_c{_k}_new)""")
    oracle_view(f"ox_c{_k}_found", f"""
        SELECT DISTINCT d.id AS caller_id, r.callee_id, false AS manual, s.line, n.file_path FROM ox_c{_k}_diff d JOIN ox_c{_k}_new n ON n.id = d.id JOIN fx_code_sites s ON s.caller_id = d.id
        JOIN (SELECT p.callee_file, p.callee_line, arg_min(y.id, [lpad(cast(1000000 - y.line AS string), 9, '0'), y.id]) AS callee_id
              FROM (SELECT DISTINCT callee_file, callee_line FROM fx_code_sites WHERE callee_line > 0) p JOIN ox_c{_p}_symbols y
                ON y.file_path = p.callee_file AND y.line <= p.callee_line AND (y.end_line = 0 OR y.end_line >= p.callee_line) GROUP BY 1, 2) r
          ON r.callee_file = s.callee_file AND r.callee_line = s.callee_line
        WHERE NOT d.removed""")
    oracle_view(f"ox_c{_k}_calls", f"""
        SELECT * FROM ox_c{_p}_calls WHERE manual OR (caller_id NOT IN (SELECT id FROM ox_c{_k}_diff) AND callee_id NOT IN (SELECT id FROM ox_c{_k}_diff WHERE removed))
        UNION ALL SELECT * FROM ox_c{_k}_found""")
    oracle_view(f"ox_c{_k}_manifest", f"""
        SELECT file_path, 'h{_k}' AS file_hash FROM ox_c{_k}_files UNION ALL SELECT * FROM ox_c{_p}_manifest WHERE file_path NOT IN (SELECT file_path FROM ox_c{_k}_files)""")


@query("incremental_index_chain", """
    SELECT 'symbols' AS part, id AS key, body_hash AS value, CAST(line AS bigint) AS line, count(*) AS n FROM ox_c3_symbols GROUP BY ALL
    UNION ALL SELECT 'calls', caller_id, callee_id, CAST(line AS bigint), count(*) FROM ox_c3_calls GROUP BY ALL
    UNION ALL SELECT 'manifest', file_path, file_hash, 0, count(*) FROM ox_c3_manifest GROUP BY ALL""")
def incremental_index_chain(t):
    """Three batches of saves, whose call sites are resolved on the symbols stored so far."""
    root = S.scratch(t.spark, "chain")
    symbols = t.fx_symbols.select("id", "kind", "file_path", "body_hash", "line", "end_line", F.col("seq").cast("bigint").alias("seq"))
    calls = t.lineitem.select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("caller_id"), F.concat(F.lit("p"), (F.col("l_suppkey") * 5).cast("string")).alias("callee_id"),
        F.when(F.col("l_returnflag") == "R", "manual").otherwise("direct").alias("call_type"), F.lit("f").alias("file_path"), F.col("l_linenumber").cast("int").alias("line"))
    manifest = symbols.select("file_path").distinct().withColumn("file_hash", F.lit("old"))
    versioned.save_buckets(
        t.spark, f"{root}/tables", {"symbols": (symbols, "file_path"), "method_calls": (calls, "caller_id"), "manifest": (manifest, "file_path")}, source="start", buckets=8)
    sites = t.fx_code_sites.groupBy("caller_id").agg(F.collect_list(F.struct("callee_file", F.col("callee_line").cast("int").alias("callee_line"), F.col("line").cast("int").alias("line"))).alias("sites"))
    saves = t.fx_code_saves.join(sites, F.col("id") == F.col("caller_id"), "left").select(
        "batch", "file_path", F.concat(F.lit("h"), F.col("save").cast("string")).alias("file_hash"), "id", "kind", "body_hash", "line", "end_line", F.col("seq").cast("bigint").alias("seq"), "sites")
    with shuffles_removed(t.spark):
        saves = stored(saves)  # each batch would put all sites together anew
    for batch in (1, 2, 3):
        saves.where(F.col("batch") == batch).drop("batch").write.mode("append").parquet(f"{root}/feed")
        feed = t.spark.readStream.schema(saves.drop("batch").schema).parquet(f"{root}/feed")
        S.index_saves(feed, f"{root}/tables", f"{root}/state", buckets=8)
    got = versioned.load_buckets(t.spark, f"{root}/tables", S.INDEX_TABLES)
    parts = [("symbols", "symbols", "id", "body_hash", F.col("line")), ("calls", "method_calls", "caller_id", "callee_id", F.col("line")),
             ("manifest", "manifest", "file_path", "file_hash", F.lit(0))]
    out = [got[name].select(F.lit(part).alias("part"), F.col(a).alias("key"), F.col(b).alias("value"), line.cast("bigint").alias("line"))
           .groupBy("part", "key", "value", "line").agg(F.count(F.lit(1)).alias("n")) for part, name, a, b, line in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])
