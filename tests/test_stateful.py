"""Streams with a state of their own, and saves applied to tables in buckets."""

import datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from codelattice.sources import versioned
from codelattice.streaming import feeds as S
from codelattice.streaming import stateful
from tests.conftest import rows


def _run(spark, folder, state, schema, part, make):
    spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    with stateful.keyed_state(spark):
        return S.append_available(make(spark.readStream.schema(schema).parquet(folder)), "state", state)


def _at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_a_file_waits_once_until_it_is_taken_or_given_up(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, event string, file_path string"
    batches = [
        [(2, _at(2), "saved", "a.go"), (1, _at(1), "saved", "a.go"), (3, _at(3), "saved", "b.go")],
        [(4, _at(4), "saved", "a.go"), (5, _at(5), "taken", "a.go"), (6, _at(6), "saved", "a.go"), (7, _at(7), "saved", "a.go")],
        [(8, _at(90), "saved", "c.go")],  # the watermark passes the wait of a.go and b.go
        [(9, _at(91), "saved", "b.go"), (10, _at(92), "taken", "c.go"), (11, _at(93), "saved", "c.go")],
    ]
    for batch in batches:
        out = _run(spark, str(tmp_path / "feed"), str(tmp_path / "run"), schema, batch, lambda x: stateful.queue_files(x, 60_000))
    assert rows(out, "event_id", "file_path") == [(1, "a.go"), (11, "c.go"), (3, "b.go"), (6, "a.go"), (8, "c.go"), (9, "b.go")]


def test_steps_that_may_not_follow_are_refused(spark, tmp_path):
    schema = "id string, seq bigint, status string, ts timestamp"
    batches = [
        [("s", 1, "filled", _at(1)), ("s", 2, "pending", _at(2)), ("t", 1, "pending", _at(2))],
        [("s", 4, "filled", _at(4)), ("s", 3, "validated", _at(3)), ("t", 2, "filled", _at(4)), ("t", 3, "filled", _at(4)), ("t", 4, "validated", _at(4)), ("t", 5, "filled", _at(4))],
        [("s", 4, "filled", _at(5)), ("s", 5, "validated", _at(5)), ("u", 1, "pending", _at(200))],
        [("t", 9, "pending", _at(201))],  # t was forgotten meanwhile
    ]
    for batch in batches:
        out = _run(spark, str(tmp_path / "feed"), str(tmp_path / "run"), schema, batch, lambda x: stateful.session_course(x, 60_000))
    refused = [("s", 1, "filled"), ("s", 3, "validated"), ("s", 4, "filled"), ("t", 5, "filled")]
    assert sorted(map(tuple, out.where(~F.col("accepted")).select("id", "seq", "status").collect())) == refused
    assert out.where("accepted").count() == 9


def test_a_batch_of_a_file_asks_for_its_state_once():
    """Each question goes to another process, and so does each frame; rows are taken and given as they are."""
    asked = []

    class Handle:
        def getValueState(self, name, schema):
            return self

        def __getattr__(self, call):
            return lambda *given: asked.append((call, *given))

    queue = stateful.Queue(60_000)
    queue.init(Handle())
    events = [Row(event_id=n, ts=ts, event=event, file_path="a.go") for n, ts, event in (
        (3, _at(3), "saved"), (None, _at(4), "saved"), (1, _at(1), "saved"), (2, _at(2), "taken"))]
    due = 1_704_067_200_000 + 3_000 + 60_000
    assert list(map(tuple, queue.handleInputRows(("a.go",), iter(events), None))) == [("a.go", _at(1), 1), ("a.go", _at(3), 3)]
    assert asked == [("get",), ("update", (due,)), ("registerTimer", due)]


UNITS = "file_path string, file_hash string, id string, kind string, body_hash string, line int, end_line int, seq bigint, sites array<struct<callee_file:string,callee_line:int,line:int>>"


def test_a_save_of_one_file_writes_one_bucket_of_each_table(spark, tmp_path):
    root, folder, state = (str(tmp_path / n) for n in ("store", "feed", "state"))
    symbols = spark.createDataFrame(
        [(f"f{k}", "method", f"F{k}", "1", 1, 9, 0) for k in range(40)], "id string, kind string, file_path string, body_hash string, line int, end_line int, seq bigint")
    calls = spark.createDataFrame([(f"f{k}", f"f{k + 1}", "direct", f"F{k}", 2) for k in range(39)], "caller_id string, callee_id string, call_type string, file_path string, line int")
    manifest = symbols.select("file_path", F.lit("1").alias("file_hash"))
    versioned.save_buckets(spark, root, {"symbols": (symbols, "file_path"), "method_calls": (calls, "caller_id"), "manifest": (manifest, "file_path")})
    saves = [
        [("F3", "2", "f3", "method", "2", 1, 9, 1, [("F7", 5, 4), ("F8", 20, 5)])],  # a call into f7; one to no symbol
        [("F3", "3", "f3", "method", "2", 1, 9, 2, [("F9", 5, 4)])],  # same body: its calls stay
        [("F5", "4", None, None, None, None, None, 3, None)],  # emptied: f4's call of f5 goes, too
    ]
    for part in saves:
        spark.createDataFrame(part, UNITS).coalesce(1).write.mode("append").parquet(folder)
        for _ in range(2):  # the second run finds nothing new
            S.index_saves(spark.readStream.schema(UNITS).parquet(folder), root, state)
    got = versioned.load_buckets(spark, root, S.INDEX_TABLES)
    want = {(f"f{k}", f"f{k + 1}") for k in range(39)} - {("f3", "f4"), ("f4", "f5"), ("f5", "f6")} | {("f3", "f7")}
    assert {tuple(r) for r in got["method_calls"].select("caller_id", "callee_id").collect()} == want
    assert rows(got["symbols"].where("id in ('f3', 'f5')"), "id", "body_hash") == [("f3", "2")] and got["symbols"].count() == 39
    assert rows(got["manifest"].where("file_hash <> '1'"), "*") == [("F3", "3"), ("F5", "4")]
    written = spark.read.parquet(f"{root}/commits").where("version > 1").groupBy("version", "name").count()
    assert sorted(map(tuple, written.collect())) == [
        (2, "manifest", 1), (2, "method_calls", 1), (2, "symbols", 1), (3, "manifest", 1), (3, "symbols", 1), (4, "manifest", 1), (4, "method_calls", 2), (4, "symbols", 1)]
