"""Queries over the log of events that runs leave.

One row an event, with the columns of every kind (``EVENT_COLUMNS``).  An event is named by
(pipeline_run_id, handler_position); a service call and the exit of its step share a
correlation_id ``run:position``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.sources.shared import cut

#: The kinds of events (fixed values of the log's format).
KINDS = (
    "pipeline_start", "handler_enter", "handler_exit", "service_invocation", "pipeline_complete", "pipeline_error",
    "training_bundle_hash_changed", "pipeline_hash_changed",
)
#: Columns that name an event, then those of some kinds.  Snapshots are canonical JSON text.
EVENT_COLUMNS = {
    "event_type": "string", "pipeline_run_id": "string", "handler_position": "int", "handler_name": "string", "node_kind": "string",
    "timestamp": "timestamp", "elapsed_ms": "long", "pipeline_hash": "string", "parent_run_id": "string", "correlation_id": "string",
    "inputs_snapshot": "string", "reads_snapshot": "string", "writes_snapshot": "string", "outputs_snapshot": "string",
    "input_payload": "string", "output_payload": "string", "error_class": "string", "failed_name": "string", "failed_position": "int",
    "error_message": "string", "cause_class": "string", "failure_category": "string", "trainable_name": "string", "old_hash": "string", "new_hash": "string",
}
_STEP = ["pipeline_run_id", "handler_position"]


def event_schema() -> str:
    return ", ".join(f"{k} {v}" for k, v in EVENT_COLUMNS.items())


def _of(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("event_type") == kind)


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """Events with others of the same log: both grow with it, and a join of them sorts.

    A log that is computed from a compressed table has so many bytes more than Spark's estimate, which
    goes by the table's file, that it would be collected on the driver and broadcast.
    """
    return left.join(right.hint("merge"), on, how)


def pairs(events: DataFrame, node_kind: str | None = "trainable") -> DataFrame:
    """(run, position, name, reads_snapshot, writes_snapshot): entry and exit of the same step.

    With the kind trainable these are training pairs.  An equality join on run and position.
    """
    enter = _of(events, "handler_enter")
    enter = enter if node_kind is None else enter.where(F.col("node_kind") == node_kind)
    leave = _of(events, "handler_exit").select(*_STEP, "writes_snapshot", "elapsed_ms")
    return _joined(enter.select(*_STEP, "handler_name", "node_kind", "reads_snapshot"), leave, _STEP)


def incomplete(events: DataFrame) -> DataFrame:
    """(run, position, name) of steps that were entered and not left."""
    enter = _of(events, "handler_enter").select(*_STEP, "handler_name")
    return _joined(enter, _of(events, "handler_exit").select(*_STEP), _STEP, "left_anti")


#: Rows of a run beyond which its windows are spread over ``SPREAD`` buckets.
HOT_ROWS, SPREAD = 100_000, 64


def with_previous(rows: DataFrame, run: str, order: Sequence[str], carried: Sequence[str], out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with a struct of the carried columns of the run's row before; null for its first.

    order: columns, the first a number.  A run of more than ``hot_rows`` rows is dealt into buckets of
    about equal size by its own quantiles of that number, so that it doesn't meet in one task: each
    bucket has a window of its own, and the last row of each is carried to the first of the next.
    """
    first, at = F.col(order[0]), F.struct(*order)
    hot = rows.groupBy(run).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select(run)
    cuts = F.percentile_approx(first, [k / SPREAD for k in range(1, SPREAD)], 10_000)
    bounds = rows.join(hot, run, "left_semi").groupBy(run).agg(F.array_distinct(cuts).alias("__bounds"))
    dealt = rows.join(bounds, run, "left")
    # a number that is null has no bucket of its own; equal numbers share one
    dealt = dealt.withColumn("__bucket", F.coalesce(F.size(F.filter("__bounds", lambda b: b < first)), F.lit(0)))
    within = F.lag(F.struct(*carried)).over(Window.partitionBy(run, "__bucket").orderBy(*order))
    last = dealt.where("__bounds is not null").groupBy(run, "__bucket").agg(F.max_by(F.struct(*carried), at).alias("__last"))
    # as many rows as a hot run has buckets
    edges = last.select(run, "__bucket", F.lag("__last").over(Window.partitionBy(run).orderBy("__bucket")).alias("__edge"))
    found = dealt.withColumn("__within", within).join(edges, [run, "__bucket"], "left")
    return found.withColumn(out, F.coalesce("__within", "__edge")).drop("__bounds", "__bucket", "__within", "__edge")


def holes(events: DataFrame, kind: str = "handler_exit", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(run, after, before) where a run's positions are not consecutive."""
    at = with_previous(_of(events, kind).select(*_STEP).distinct(), "pipeline_run_id", ["handler_position"], ["handler_position"], "before", hot_rows)
    after = F.col("before.handler_position")
    return at.where(F.col("handler_position") > after + 1).select("pipeline_run_id", after.alias("after"), F.col("handler_position").alias("before"))


def repeated_calls(events: DataFrame) -> DataFrame:
    """(correlation_id, n) of steps with more than one service call."""
    return _of(events, "service_invocation").groupBy("correlation_id").agg(F.count("*").alias("n")).where("n > 1")


def divergence(events: DataFrame) -> DataFrame:
    """(correlation_id, output_payload, writes_snapshot) where a step wrote other than its service gave."""
    call = _of(events, "service_invocation").select("correlation_id", "output_payload")
    leave = _of(events, "handler_exit").where("correlation_id is not null").select("correlation_id", "writes_snapshot")
    return _joined(call, leave, "correlation_id").where(~F.col("output_payload").eqNullSafe(F.col("writes_snapshot")))


def lineage(events: DataFrame) -> DataFrame:
    """(run, root, depth) of every started run: the outermost run that it is nested in.

    By pointer jumping: the rounds double the distance, so their number is the logarithm of the
    number of runs at most; each is kept in the shared folder, so no plan grows.  A parent that never
    started ends the chain.  Runs that are nested in themselves are an error.
    """
    now, endless = _jumped(events)
    if endless is not None:
        raise ValueError("a run is nested in itself")
    return now


def entangled(events: DataFrame) -> DataFrame:
    """(run) of every started run whose chain of parents never ends: it is nested in itself, or in one that is."""
    now, endless = _jumped(events)
    return now.select("run").limit(0) if endless is None else endless.select("run")


def _starts(events: DataFrame) -> DataFrame:
    return _of(events, "pipeline_start").select("pipeline_run_id", "parent_run_id").distinct()


def _jumped(events: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(run, root, depth) after the last round, and those that still moved in it, if any."""
    starts = cut(_starts(events))
    known = starts.select(F.col("pipeline_run_id").alias("parent_run_id"), F.lit(True).alias("known")).distinct()
    up = F.when(F.col("known"), F.col("parent_run_id"))
    linked = starts.join(known, "parent_run_id", "left")
    return _jump(linked.select(F.col("pipeline_run_id").alias("run"), F.coalesce(up, "pipeline_run_id").alias("root"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth")))


def _jump(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """links (run, root, depth): what each run hangs on, and how far up; those that hang on themselves end a chain."""
    now = cut(links)
    ahead, rounds = now, now.count().bit_length() + 1  # a chain has fewer links than there are runs
    for _ in range(rounds):
        upper = now.select(F.col("run").alias("root"), F.col("root").alias("upper"), F.col("depth").alias("more"))
        ahead = now.join(upper, "root").select("run", F.col("upper").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved"))
        ahead = cut(ahead)
        now = ahead.select("run", "root", "depth")
        if ahead.where("moved").isEmpty():
            return now, None
    return now, ahead.where("moved")


STORED = "run string, root string, depth long, up string"


def lineage_appended(stored: DataFrame, events: DataFrame) -> DataFrame:
    """``stored`` (run, root, depth, up) after an append to the log: the same as of all events at once.

    up: the parent that a root has named, and that hasn't started yet; null elsewhere.  Chains are
    followed among the new runs, the roots that they hang on, and the roots whose parent starts now,
    so the rounds' work grows with the append.  Of the stored runs only those under a root that has
    moved change.  Runs that are stored already are ignored.
    """
    new = _starts(events).join(stored.select(F.col("run").alias("pipeline_run_id")), "pipeline_run_id", "left_anti")
    new = cut(new.select(F.col("pipeline_run_id").alias("run"), F.col("parent_run_id").alias("parent")).dropDuplicates(["run"]))
    above = stored.select(F.col("run").alias("parent"), F.col("root").alias("over"), F.col("depth").alias("over_depth"))
    beside = new.select(F.col("run").alias("parent"), F.lit(True).alias("beside"))
    hung = new.join(beside, "parent", "left").join(above, "parent", "left")
    on = F.when(F.col("beside"), F.col("parent")).otherwise(F.col("over"))
    far = F.when(F.col("beside"), 1).otherwise(F.col("over_depth") + 1)
    hung = cut(hung.select("run", F.coalesce(on, "run").alias("root"), F.coalesce(far, F.lit(0)).cast("long").alias("depth"), F.when(on.isNull(), F.col("parent")).alias("up")))
    moved = stored.where("run = root and up is not null").join(new.select(F.col("run").alias("up")), "up").select("run", F.col("up").alias("root"), F.lit(1).cast("long").alias("depth"))
    still = hung.select(F.col("root").alias("run")).distinct().join(new.select("run"), "run", "left_anti").join(moved.select("run"), "run", "left_anti")
    links = hung.select("run", "root", "depth").union(moved).union(still.select("run", F.col("run").alias("root"), F.lit(0).cast("long").alias("depth")))
    tops, endless = _jump(links)
    if endless is not None:
        raise ValueError("a run is nested in itself")
    tops = tops.select(F.col("run").alias("at"), F.col("root").alias("top"), F.col("depth").alias("more"))
    fresh = hung.join(tops, F.col("run") == F.col("at")).select("run", F.col("top").alias("root"), F.col("more").alias("depth"), "up")
    before = stored.join(tops, F.col("root") == F.col("at"), "left")
    root = F.coalesce("top", "root")
    return before.select("run", root.alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.when(F.col("run") == root, F.col("up")).alias("up")).union(fresh)


def with_hash(events: DataFrame) -> DataFrame:
    """Every step event with its run's pipeline_hash, from the run's start."""
    start = _of(events, "pipeline_start").select("pipeline_run_id", F.col("pipeline_hash").alias("run_hash"))
    return _joined(events.where(F.col("handler_position").isNotNull()), start, "pipeline_run_id")


def buckets(events: DataFrame) -> DataFrame:
    """(run_hash, runs, steps): the corpus by pipeline hash."""
    return with_hash(events).groupBy("run_hash").agg(F.countDistinct("pipeline_run_id").alias("runs"), F.count("*").alias("steps"))


def digests(log: DataFrame, by: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """(by, __n, __a, __b): how many rows each group has, and 128 bits of their content whatever their order."""
    a, b = F.xxhash64(*columns), F.xxhash64(F.lit("other"), *reversed(columns))
    total = lambda h: F.sum(h.cast("decimal(20,0)"))
    return log.groupBy(*by).agg(F.count("*").alias("__n"), total(a).alias("__a"), total(b).alias("__b"))


#: Positions of a run that share a digest at the lower level.
BLOCK = 1024


def replay_differences(first: DataFrame, second: DataFrame, columns: Sequence[str] = (*_STEP, "reads_snapshot", "writes_snapshot")) -> DataFrame:
    """Rows of either log that the other hasn't, as often as they are missing there, with the side that has them.

    By digests: those of runs are compared first, then, of runs that differ, those of blocks of
    positions.  Only the rows of blocks that differ are exchanged and compared; what is the same costs
    a hash a row and one row a run.  Equal digests are taken for equal rows (128 bits).
    """
    run, block = F.col(_STEP[0]).alias("__run"), F.floor(F.col(_STEP[1]) / BLOCK).alias("__block")

    def differing(a: DataFrame, b: DataFrame, by: list[Column], names: list[str]) -> DataFrame:
        x, y = digests(a, by, columns), digests(b, by, columns)
        both = x.withColumn("__side", F.lit(1)).union(y.withColumn("__side", F.lit(-1)))
        total = both.groupBy(*names).agg(*(F.sum(F.col(c) * F.col("__side")).alias(c) for c in ("__n", "__a", "__b")))
        return total.where("__n <> 0 or __a <> 0 or __b <> 0").select(*names)

    def of(log: DataFrame, places: DataFrame, by: list[Column], names: list[str]) -> DataFrame:
        keyed = log.select(*columns, *by)
        on = [keyed[n].eqNullSafe(places[n]) for n in names]
        return keyed.join(places, on, "left_semi").select(*columns)

    a, b = first.select(*columns), second.select(*columns)
    for by, names in (([run], ["__run"]), ([run, block], ["__run", "__block"])):
        places = cut(differing(a, b, by, names))
        a, b = of(a, places, by, names), of(b, places, by, names)
    both = a.withColumn("__n", F.lit(1)).union(b.withColumn("__n", F.lit(-1)))
    left = both.groupBy(*columns).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    again = F.explode(F.array_repeat(F.when(F.col("__n") > 0, "first").otherwise("second"), F.abs("__n").cast("int")))
    return left.select(*columns, again.alias("side"))


def gaps(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(run, position, event_type, gap_ms): time since the run's event before, in order of position, entries first."""
    known = events.where(F.col("handler_position").isNotNull()).select(*_STEP, "event_type", "timestamp", (F.col("event_type") != "handler_enter").alias("left"))
    found = with_previous(known, "pipeline_run_id", ["handler_position", "left", "timestamp"], ["timestamp"], "before", hot_rows)
    ms = (F.unix_micros("timestamp") - F.unix_micros("before.timestamp")) / 1000
    return found.select(*_STEP, "event_type", ms.alias("gap_ms"))


def harvest(events: DataFrame) -> DataFrame:
    """One row a step entered: what it read, wrote, and said to its service; what is missing is null."""
    enter = _of(events, "handler_enter").select(*_STEP, "handler_name", "node_kind", "reads_snapshot")
    leave = _of(events, "handler_exit").select(*_STEP, "writes_snapshot")
    call = _of(events, "service_invocation").select(*_STEP, "input_payload", "output_payload")
    return _joined(_joined(enter, leave, _STEP, "left"), call, _STEP, "left")


def of_run(events: DataFrame, run: str) -> DataFrame:
    """A run's events, each with whether it closes the run."""
    return events.where(F.col("pipeline_run_id") == run).withColumn("closes", F.col("event_type").isin("pipeline_complete", "pipeline_error"))


def unknown_kinds(events: DataFrame) -> DataFrame:
    """Rows whose event_type is none of the log's kinds."""
    return events.where(F.col("event_type").isNull() | ~F.col("event_type").isin(*KINDS))
