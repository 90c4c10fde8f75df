"""Queries that replay the conversations as streams, in micro-batches and out of order.

A conversation begins a minute after the one before; its turns are seconds apart.  Rows arrive up to
ten minutes early or late, in four appends to one table, which a stream takes one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.catalogue import query, table
from loomwork.sources.shared import cut, drop_path, shared_path
from loomwork.streaming import live, stateful

APPENDS = 4
LATE, IDLE_MS = "30 minutes 7 milliseconds", 600_123  # no timer falls on a watermark
_BEGAN = 1_700_000_000_000_000  # microseconds; a stream takes nothing at or before the epoch


def _replay(rows: DataFrame, run: str, name: str, closed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``closed`` gives for a stream of the rows, which are appended by the times at which they arrive.

    The stream is stopped after each append and goes on from its checkpoint; the folders are removed
    at the end.
    """
    spark = rows.sparkSession
    path, out, state = (shared_path(spark, f"{name}-{x}") for x in ("in", "out", "state"))
    arrives = F.col(run).cast("long") * 60 + F.pmod(F.xxhash64(*rows.columns), F.lit(1201)) - 600
    known, rows = rows.schema, rows.withColumn("arrives", arrives)
    last = rows.agg(F.max("arrives")).first()[0] or 0
    place = F.least(F.greatest(F.floor(F.col("arrives") * APPENDS / (last + 1)), F.lit(0)), F.lit(APPENDS - 1))
    for k in range(APPENDS):
        rows.where(place == k).drop("arrives").write.mode("append").parquet(path)
        stream = closed(spark.readStream.schema(known).parquet(path))
        stateful.to_table(stream, out, state).awaitTermination()
    got = cut(spark.read.schema(stream.schema).parquet(out))
    for used in (path, out, state):
        drop_path(spark, used)
    return got


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = Window.partitionBy("conv_id")
    ends = F.max_by("role", "turn").over(whole).alias("ends"), F.min_by("role", "turn").over(whole).alias("begins"), F.max("turn").over(whole).alias("top")
    return table(spark, sf_dir, "conversations").select("*", *ends)


def _at(seconds: Column) -> Column:
    return F.timestamp_micros((F.col("conv_id") * 60_000_000 + seconds * 1_000_000).cast("long") + _BEGAN)


_SHAPES = "(select conv_id, max(turn) as top, count(*) as n, arg_max(role, turn) as ends, arg_min(role, turn) as begins from conversations group by conv_id)"
_CLOSES = "case when ends = 'assistant' then 'complete' when begins = 'system' then 'error' end"


@query(
    "stream_closed_runs",
    f"""with runs as (select *, {_CLOSES} as closes from {_SHAPES}),
told as (select *, n * 2 + 1 + (closes is not null)::int - (coalesce(closes, '') = 'error')::int as events,
  conv_id * 60000 + top * 1000 + case when closes is not null then 900 else 500 end as ended from runs)
select conv_id::varchar as run, coalesce(closes, 'expired') as status, events, n as entered, n - (coalesce(closes, '') = 'error')::int as "left", ended - conv_id * 60000 as took_ms
from told where ended + case when closes is null then {IDLE_MS} else 0 end < (select max(ended) from told) - 1800007""",
)
def stream_closed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as they close, from events in micro-batches: by their last event, or by a timer where none comes."""
    t = _turns(spark, sf_dir)
    run, closes = F.col("conv_id").cast("string").alias("pipeline_run_id"), F.when(F.col("ends") == "assistant", "pipeline_complete").when(F.col("begins") == "system", "pipeline_error")
    last = F.col("turn") == F.col("top")

    def event(rows: DataFrame, kind: Column, after: float) -> DataFrame:
        return rows.select("conv_id", run, kind.alias("event_type"), _at(F.col("turn") + after).alias("timestamp"))

    events = event(t.where("turn = 0"), F.lit("pipeline_start"), 0).union(event(t, F.lit("handler_enter"), 0.1))
    events = events.union(event(t.where(~F.coalesce(last & (closes == "pipeline_error"), F.lit(False))), F.lit("handler_exit"), 0.5))
    events = events.union(event(t.where(last & closes.isNotNull()), closes, 0.9))
    got = _replay(events, "conv_id", "runs", lambda stream: stateful.closed_runs(stream, LATE, IDLE_MS))
    return got.select("run", "status", "events", "entered", "left", (F.unix_millis("ended") - F.unix_millis("began")).alias("took_ms"))


@query(
    "stream_fragments",
    f"""with sent as (select * from conversations where not (role = 'system')),
runs as (select s.conv_id, count(s.turn) as n, max(s.turn) as top, min(s.turn) as first, max(s.conv_id * 60000 + s.turn * 1000) as latest, any_value(ends) as ends,
  string_agg(s.text, '' order by s.turn) as text from sent s join {_SHAPES} using (conv_id) group by s.conv_id),
told as (select *, case when first = 0 and ends = 'assistant' then 'whole' when first > 0 then 'gap' else 'unfinished' end as status from runs)
select conv_id::varchar as run, status, case when status = 'whole' then text end as text, case when status = 'gap' then 0 else top + 1 end::bigint as pieces,
  case when status = 'gap' then 0 when status = 'unfinished' then top + 1 end::bigint as missing
from told where status = 'whole' or latest + {IDLE_MS} < (select max(latest) from told) - 1800007""",
)
def stream_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put together from pieces out of order, of which some are lost and some have no end mark.

    Pieces of the system are lost on the way; only what ends with the assistant's turn has an end mark.
    """
    t = _turns(spark, sf_dir).where("role <> 'system'")
    done = (F.col("turn") == F.col("top")) & (F.col("ends") == "assistant")
    pieces = t.select(F.col("conv_id").alias("run"), F.col("turn").alias("seq"), F.col("text").alias("piece"), done.alias("done"), _at(F.col("turn")).alias("at"))
    return _replay(pieces, "run", "texts", lambda stream: stateful.assembled_stream(stream, LATE, IDLE_MS))


@query(
    "run_stream",
    f"""select conv_id::varchar as run, event_type, n, closes from (
  select conv_id, unnest(['handler_enter', 'handler_exit', 'pipeline_start', coalesce('pipeline_' || closes, '')]) as event_type,
    unnest([n, n, 1, 1]) as n, unnest([false, false, false, true]) as closes from (select *, {_CLOSES} as closes from {_SHAPES})) where event_type <> ''""",
)
def run_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run's events by kind, with whether they close it."""
    t = _turns(spark, sf_dir)
    closes = F.when(F.col("ends") == "assistant", "pipeline_complete").when(F.col("begins") == "system", "pipeline_error")
    kinds = F.array(F.when(F.col("turn") == 0, "pipeline_start"), F.lit("handler_enter"), F.lit("handler_exit"), F.when(F.col("turn") == F.col("top"), closes))
    events = t.select(F.col("conv_id").cast("string").alias("pipeline_run_id"), F.explode(kinds).alias("event_type")).where("event_type is not null")
    told = live.closing(events)
    return told.groupBy(F.col("pipeline_run_id").alias("run"), "event_type", "closes").agg(F.count("*").alias("n"))
