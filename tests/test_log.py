"""Queries over event logs on runs of any size, and logs that grow."""

import random

from pyspark.sql import functions as F

from loomwork.operators import eventlog


def log(spark, rows):
    return spark.createDataFrame(rows, "pipeline_run_id string, handler_position int, event_type string, at long").withColumn("timestamp", F.timestamp_millis("at"))


def test_a_hot_run_is_spread_with_equal_results(spark):
    rng = random.Random(2)
    rows = []
    for run, n in (("hot", 3000), ("small", 20), ("one", 1)):
        places = sorted(rng.sample(range(50), min(n, 20))) + sorted(rng.sample(range(10_000, 20_000), max(0, n - 20)))
        for p in places:
            rows += [(run, p, "handler_enter", p * 10 + rng.randrange(5)), (run, p, "handler_exit", p * 10 + 5 + rng.randrange(5))]
    rows += [(None, 3, "handler_exit", 9), ("hot", None, "handler_exit", 9)]
    rng.shuffle(rows)
    events = log(spark, rows)
    for query in (eventlog.holes, eventlog.gaps):
        whole, spread = (sorted(map(tuple, query(events, hot_rows=n).collect()), key=repr) for n in (10**9, 500))
        assert whole == spread and len(whole) > 100
    known = sorted({p for r, p, k, _ in rows if r == "hot" and p is not None and k == "handler_exit"})
    assert sorted((r.after, r.before) for r in eventlog.holes(events, hot_rows=500).where("pipeline_run_id = 'hot'").collect()) == [(a, b) for a, b in zip(known, known[1:]) if b > a + 1]
    plan = eventlog.gaps(events, hot_rows=500)._jdf.queryExecution().optimizedPlan().toString()
    assert "__bucket" in plan


def test_replays_are_compared_by_digests(spark):
    rows = [(f"r{k % 40}", k // 40, f"read {k}", f"write {k}") for k in range(4000)]
    schema = "pipeline_run_id string, handler_position int, reads_snapshot string, writes_snapshot string"
    other = [r for r in rows if r[:2] != ("r3", 7)] + [("r5", 1, "twice", None)] * 2
    other[100] = (*other[100][:3], "changed")
    first, second = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    got = sorted(map(tuple, eventlog.replay_differences(first, second).collect()), key=repr)
    want = [(*rows[7 * 40 + 3], "first"), ("r5", 1, "twice", None, "second"), ("r5", 1, "twice", None, "second"), (*rows[100], "first"), (*other[100], "second")]
    assert got == sorted(want, key=repr)
    assert eventlog.replay_differences(first, first).count() == 0
    assert eventlog.replay_differences(first.limit(0), second).where("side = 'second'").count() == len(other)


def test_logs_are_not_broadcast_by_the_size_of_a_table_that_they_come_from(spark, tmp_path):
    """Events have many times the bytes of a small table's file: no side of a join of them goes through the driver."""
    path = str(tmp_path / "small")
    spark.range(50).coalesce(1).write.parquet(path)
    kinds = F.explode(F.array(*(F.lit(k) for k in ("pipeline_start", "handler_enter", "service_invocation", "handler_exit"))))
    none = {"node_kind": "string", "handler_name": "string", "elapsed_ms": "long", "pipeline_hash": "string"}
    events = spark.read.parquet(path).select(F.col("id").cast("string").alias("pipeline_run_id"), kinds.alias("event_type"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    long = F.repeat("pipeline_run_id", 1000)
    events = events.withColumns({"handler_position": F.lit(0), "correlation_id": F.col("pipeline_run_id"), **{c: long for c in ("reads_snapshot", "writes_snapshot", "input_payload", "output_payload")}})
    for found, n in ((eventlog.pairs(events, None), 50), (eventlog.incomplete(events), 0), (eventlog.divergence(events), 0), (eventlog.with_hash(events), 200), (eventlog.harvest(events), 50)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == n


def _starts(spark, pairs):
    return spark.createDataFrame(pairs, "pipeline_run_id string, parent_run_id string").withColumn("event_type", F.lit("pipeline_start"))


def test_lineage_of_appends_is_that_of_the_whole(spark):
    rng = random.Random(6)
    pairs = [(str(k), None if k == 0 or rng.random() < 0.1 else str(rng.randrange(k)) if rng.random() < 0.9 else f"unknown {k}") for k in range(60)]
    want = sorted(map(tuple, eventlog.lineage(_starts(spark, pairs)).collect()))
    rng.shuffle(pairs)
    stored = spark.createDataFrame([], eventlog.STORED)
    for part in (pairs[:20], pairs[20:45], [*pairs[45:], *pairs[:3]], []):
        stored = eventlog.cut(eventlog.lineage_appended(stored, _starts(spark, part)))
    assert sorted(map(tuple, stored.select("run", "root", "depth").collect())) == want
    assert {r.up for r in stored.collect()} == {None, *(p for _, p in pairs if p and p.startswith("unknown"))}
