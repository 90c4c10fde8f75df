"""Runs and token streams that are closed while the log still grows.

Both keep state for each run with ``transformWithState``, in a RocksDB store that is checkpointed in
the shared folder, so that a lost executor's runs go on elsewhere.  State is bounded: a run leaves
it when it closes, or by a timer in event time when nothing has come for ``idle``.
"""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

# processors go along by value: the worker beside the driver, which asks them for their state's
# schemas, doesn't get the files that a session sends to its executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Times are microseconds within the state, so that no time zone is met.
_CLOSED = "run string, status string, events long, entered long, left long, began long, ended long"
_OPEN = "events long, entered long, left long, began long, ended long, status string"
_STATUS = {"pipeline_complete": "complete", "pipeline_error": "error"}


def _after(micros: int, ms: int) -> int:
    return micros // 1000 + ms


class _Timer:
    """The one timer of a key, moved as events come."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle

    def move(self, to: int) -> None:
        self.stop()
        self.handle.registerTimer(to)

    def stop(self) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)


class _Runs(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", _OPEN)
        self.timer = _Timer(handle)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n, entered, left, began, ended, status = self.open.get() if self.open.exists() else (0, 0, 0, None, None, None)
        for r in rows:
            n += 1
            entered += r.event_type == "handler_enter"
            left += r.event_type == "handler_exit"
            began = r.micros if began is None else min(began, r.micros)
            ended = r.micros if ended is None else max(ended, r.micros)
            status = _STATUS.get(r.event_type, status)
        self.open.update((n, entered, left, began, ended, status))
        # nothing before the watermark is still to come, so a run that has ended is whole then
        self.timer.move(ended // 1000 if status is not None else _after(ended, self.idle_ms))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.open.exists():
            n, entered, left, began, ended, status = self.open.get()
            self.open.clear()
            yield Row(run=key[0], status=status or "expired", events=n, entered=entered, left=left, began=began, ended=ended)

    def close(self) -> None:
        pass


def closed_runs(events: DataFrame, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """(run, status, events, entered, left, began, ended): each run of a growing event log, when it closes.

    A run closes with its complete or error event, once the watermark has passed all of its events: so
    they may come in any order and in any micro-batch, up to ``late`` behind the newest event of all
    runs, and with no delay where ``late`` is nothing.  A run without news for ``idle_ms`` of event time
    is given up as ``expired``; what still comes of it is a run anew.  Events without a run or a time
    are none of any run.
    """
    known = events.where("pipeline_run_id is not null and timestamp is not null").select("pipeline_run_id", "event_type", "timestamp")
    known = known.withColumn("micros", F.unix_micros("timestamp")).withWatermark("timestamp", late)
    closed = known.groupBy("pipeline_run_id").transformWithState(_Runs(idle_ms), _CLOSED, "Append", "EventTime")
    return closed.withColumns({c: F.timestamp_micros(c) for c in ("began", "ended")})


TEXTS = "run string, status string, text string, pieces long, missing long"


class _Fragments(StatefulProcessor):
    """Pieces that wait for one before them, by number; the text so far; the number that comes next."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "seq long", "piece string, done boolean")
        self.ready = handle.getListState("ready", "piece string")
        self.place = handle.getValueState("place", "next long, last long, latest long")
        self.timer = _Timer(handle)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        following, last, latest = self.place.get() if self.place.exists() else (0, None, None)
        for r in rows:
            latest = r.micros if latest is None else max(latest, r.micros)
            if r.done:
                last = r.seq
            if r.seq >= following:  # what has come before is ignored
                self.waiting.updateValue((r.seq,), (r.piece, r.done))
        fresh = []
        while self.waiting.containsKey((following,)):
            fresh.append((self.waiting.getValue((following,))[0] or "",))
            self.waiting.removeKey((following,))
            following += 1
        if fresh:
            self.ready.appendList(fresh)
        if last is not None and following > last:
            yield Row(run=key[0], status="whole", text="".join(p[0] for p in self.ready.get()), pieces=following, missing=None)
            self._forget()
        else:
            self.place.update((following, last, latest))
            self.timer.move(_after(latest, self.idle_ms))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.place.exists():
            following, last, _ = self.place.get()
            gap = last is not None or any(True for _ in self.waiting.keys())
            yield Row(run=key[0], status="gap" if gap else "unfinished", text=None, pieces=following, missing=following)
            self._forget()

    def _forget(self) -> None:
        for state in (self.waiting, self.ready, self.place):
            state.clear()
        self.timer.stop()

    def close(self) -> None:
        pass


def assembled_stream(fragments: DataFrame, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """The texts of token streams from rows (run, seq, piece, done, at), as their last missing piece comes (``TEXTS``).

    Pieces may come in any order and repeat; each is kept until those before it are there.  A run
    that waits for longer than ``idle_ms`` of event time is given up: ``gap`` where a later piece or
    the end has come, else ``unfinished``, with the first number that is missing.  A stream doesn't
    resume.  Pieces without a run, a number or a time are none of any stream.
    """
    known = fragments.where("run is not null and seq is not null and at is not null")
    known = known.select(F.col("run").cast("string").alias("run"), F.col("seq").cast("long").alias("seq"), "piece", F.coalesce("done", F.lit(False)).alias("done"), "at", F.unix_micros("at").alias("micros"))
    return known.withWatermark("at", late).groupBy("run").transformWithState(_Fragments(idle_ms), TEXTS, "Append", "EventTime")


@contextlib.contextmanager
def _held(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting while a query starts, which takes the session's settings with it."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def to_table(rows: DataFrame, path: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Starts the stream into files at ``path``; as much as is there now, unless ``trigger`` says otherwise."""
    with _held(rows.sparkSession, _STORE, _ROCKS):
        writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
