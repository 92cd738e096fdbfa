"""Streams that keep a state of their own per key: the queue of files to index, and the course of sessions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams that are started inside keep their state in a store that such operators need."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


EPOCH, MILLISECOND = datetime(1970, 1, 1, tzinfo=timezone.utc), timedelta(milliseconds=1)
JOB, STEP = Row("file_path", "ts", "event_id"), Row("id", "seq", "status", "accepted")


def _millis(ts: datetime | None) -> int:
    """Milliseconds since 1970, 0 for no time; a time without a zone is in UTC, as Spark hands it over."""
    return 0 if ts is None else ((ts if ts.tzinfo else ts.replace(tzinfo=timezone.utc)) - EPOCH) // MILLISECOND


def _in_order(rows: Iterator[Row], columns: list[str], *order: int) -> list[tuple]:
    """``columns`` of the rows of one key in one batch, nulls last; a trigger's size bounds them."""
    return sorted(map(itemgetter(*columns), rows), key=lambda r: [(True,) if r[i] is None else (False, r[i]) for i in order])


class Queue(StatefulProcessor):
    """A file that waits is not queued again until it is taken, or until ``wait_ms`` have passed without that."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        queued, waiting = [], self.waiting.get()
        due = waiting[0] if waiting else None
        was = due
        for event, ts, number in _in_order(rows, ["event", "ts", "event_id"], 1, 2):
            if event == "taken":
                due = None
            elif due is None:
                queued.append(JOB(key[0], ts, number))
                due = _millis(ts) + self.wait_ms
        if due != was:
            if was is not None:
                self.handle.deleteTimer(was)
            if due is None:
                self.waiting.clear()
            else:
                self.waiting.update((due,))
                self.handle.registerTimer(due)
        return iter(queued)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.waiting.clear()
        return iter(())


def queue_files(events: DataFrame, wait_ms: int, late: str = "0 seconds") -> DataFrame:
    """Stream of jobs ``file_path, ts, event_id`` from ``file_path, event, ts, event_id`` (``saved`` or ``taken``).

    A save queues its file unless it waits already. ``taken`` ends the wait, so the next save queues the file again; so
    does the watermark when it is ``wait_ms`` past the save that queued it, for jobs that were lost.
    """
    return events.withWatermark("ts", late).groupBy("file_path").transformWithState(
        statefulProcessor=Queue(wait_ms), outputStructType="file_path string, ts timestamp, event_id bigint", outputMode="Append", timeMode="EventTime")


# What may follow what; a session begins as pending. A filled session may be filled again.
FOLLOWS = {None: ("pending",), "pending": ("filled",), "filled": ("filled", "validated"), "validated": ()}


class Course(StatefulProcessor):
    """Steps of a session in the order of ``seq``; one that may not follow is answered, and changes nothing."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, seq bigint, until bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, last, until = self.state.get() or (None, None, None)
        was, out = until, []
        for seq, asked, ts in _in_order(rows, ["seq", "status", "ts"], 0):
            fits = asked in FOLLOWS[status] and seq is not None and (last is None or seq > last)
            if fits:
                status, last, until = asked, seq, _millis(ts) + self.keep_ms
            out.append(STEP(key[0], seq, asked, fits))
        if until != was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.state.update((status, last, until))
            self.handle.registerTimer(until)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())


def session_course(events: DataFrame, keep_ms: int, late: str = "0 seconds") -> DataFrame:
    """Stream ``id, seq, status, accepted`` from ``id, seq, status, ts``: whether each step may follow those before it.

    pending, then filled (also again), then validated. A step whose ``seq`` is not above the last accepted one comes too
    late. A session is forgotten when the watermark is ``keep_ms`` past its last accepted step.
    """
    return events.withWatermark("ts", late).groupBy("id").transformWithState(
        statefulProcessor=Course(keep_ms), outputStructType="id string, seq bigint, status string, accepted boolean", outputMode="Append", timeMode="EventTime")
