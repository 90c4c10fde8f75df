"""Runs and texts closed on a stream, over restarts, gaps and silence."""

from pyspark.sql import functions as F

from loomwork.streaming import stateful

T0 = 1_700_000_000


def _append(spark, rows, schema, path):
    frame = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds(F.col("at") + T0))
    frame.coalesce(1).write.mode("append").parquet(path)
    return frame.schema


def test_runs_close_over_a_restart(spark, tmp_path):
    path, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = "pipeline_run_id string, event_type string, at long"

    def more(*rows):
        kind = _append(spark, rows, schema, path)
        events = spark.readStream.schema(kind).parquet(path).withColumnRenamed("at", "timestamp")
        stateful.to_table(stateful.closed_runs(events, "10 seconds", 60_000), out, state).awaitTermination()
        got = spark.read.parquet(out) if spark.sparkContext._jvm.java.io.File(out).exists() else None
        return [] if got is None else sorted((r.run, r.status, r.events, r.entered, r.left) for r in got.collect())

    # the end of "a" comes before its middle; "b" never ends; "c" fails; a row without a run is none
    assert more(("a", "pipeline_complete", 9), ("a", "pipeline_start", 1), ("b", "pipeline_start", 2), (None, "pipeline_start", 2)) == []
    assert more(("a", "handler_enter", 3), ("a", "handler_exit", 4), ("c", "handler_enter", 15), ("c", "pipeline_error", 16)) == []
    assert more(("d", "pipeline_start", 30)) == [("a", "complete", 4, 1, 1), ("c", "error", 2, 1, 0)]
    assert more(("e", "pipeline_start", 80)) == [("a", "complete", 4, 1, 1), ("b", "expired", 1, 0, 0), ("c", "error", 2, 1, 0)]


def test_texts_over_a_restart(spark, tmp_path):
    path, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = "run string, seq long, piece string, done boolean, at long"

    def more(*rows):
        kind = _append(spark, rows, schema, path)
        pieces = spark.readStream.schema(kind).parquet(path)
        stateful.to_table(stateful.assembled_stream(pieces, "10 seconds", 60_000), out, state).awaitTermination()
        return sorted(map(tuple, spark.read.schema(stateful.TEXTS).parquet(out).collect()), key=repr)

    assert more(("a", 2, "C", True, 3), ("a", 0, "A", False, 1), ("b", 0, "x", True, 1), ("g", 1, "lost before me", True, 2), ("u", 0, "no end", False, 2)) == [("b", "whole", "x", 1, None)]
    whole = [("a", "whole", "ABC", 3, None), ("b", "whole", "x", 1, None)]
    assert more(("a", 1, "B", None, 2), ("a", 0, "again", False, 4), ("n", 0, None, True, 5)) == [*whole, ("n", "whole", "", 1, None)]
    assert more(("z", 0, "later", False, 100)) == [*whole, ("g", "gap", None, 0, 0), ("n", "whole", "", 1, None), ("u", "unfinished", None, 1, 1)]
