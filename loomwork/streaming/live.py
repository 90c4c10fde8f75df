"""Event logs and token fragments as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwork.operators.eventlog import event_schema


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """New rows of an event table, as they are appended."""
    return spark.readStream.schema(event_schema()).parquet(path)


def live_pairs(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Training pairs as both events arrive: a stream-stream join with a watermark."""
    enter = events.where("event_type = 'handler_enter' and node_kind = 'trainable'").withWatermark("timestamp", late)
    enter = enter.select("pipeline_run_id", "handler_position", "reads_snapshot", F.col("timestamp").alias("entered"))
    leave = events.where("event_type = 'handler_exit'").withWatermark("timestamp", late)
    leave = leave.select(F.col("pipeline_run_id").alias("run"), F.col("handler_position").alias("at"), "writes_snapshot", F.col("timestamp").alias("left"))
    on = (F.col("pipeline_run_id") == F.col("run")) & (F.col("handler_position") == F.col("at"))
    on = on & F.col("left").between(F.col("entered"), F.col("entered") + F.expr(f"interval {late}"))
    return enter.join(leave, on).drop("run", "at")


def closing(events: DataFrame) -> DataFrame:
    """The events, batch or stream, each with whether it closes its run."""
    return events.withColumn("closes", F.col("event_type").isin("pipeline_complete", "pipeline_error"))


def fan_out(events: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every batch of new events to ``deliver``; its failures stop this query only, never a run."""
    return events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def assembled(fragments: DataFrame) -> DataFrame:
    """(run, text) of the finished token streams among rows (run, seq, piece, done).

    Fragments join in order of seq; a run without its end marker gives no row, and neither does one
    with a gap, as a stream doesn't resume.
    """
    listed = fragments.groupBy("run").agg(
        F.array_sort(F.collect_list(F.struct("seq", "piece", "done"))).alias("x"), F.max("seq").alias("last"), F.countDistinct("seq").alias("n")
    )
    whole = listed.where((F.col("n") == F.col("last") + 1) & F.element_at("x", -1).done)
    return whole.select("run", F.array_join(F.transform("x", lambda p: F.coalesce(p.piece, F.lit(""))), "").alias("text"))
