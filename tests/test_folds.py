"""Folds against a plain Python fold, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators import folds, reduce


def present(v):
    return len(v) > 0 if isinstance(v, (str, list, dict)) else True


def step(strategy, a, b):
    if strategy == "last_wins":
        return b
    if strategy == "first_wins":
        return a
    if strategy == "last_present_wins":
        return b if present(b) else a if present(a) else b
    if strategy in ("append_list", "concat_str"):
        return a + b
    if strategy == "union_set":
        out = []
        for x in a + b:
            if x not in out:
                out.append(x)
        return out
    return merged(a, b)


def merged(a, b):
    return {k: (merged(a[k], b[k]) if isinstance(a.get(k), dict) and isinstance(b.get(k), dict) else b.get(k, a.get(k))) if k in b else a[k] for k in [*a, *(k for k in b if k not in a)]}


def fold(strategy, values):
    if not values:
        return None
    out = step("union_set", values[0], []) if strategy == "union_set" else values[0]
    for v in values[1:]:
        out = step(strategy, out, v)
    return out


TEXT, LIST = T.StringType(), T.ArrayType(T.StringType())
FLAT = T.MapType(T.StringType(), T.LongType())
DEEP = T.MapType(T.StringType(), FLAT)
DEEPER = T.MapType(T.StringType(), DEEP)
MAPS = T.ArrayType(FLAT)
FLOATS = T.ArrayType(T.DoubleType())
CASES = [
    ("last_wins", TEXT), ("first_wins", LIST), ("last_present_wins", TEXT), ("last_present_wins", LIST), ("append_list", LIST),
    ("union_set", LIST), ("union_set", MAPS), ("deep_merge_dict", FLAT), ("deep_merge_dict", DEEP), ("deep_merge_dict", DEEPER), ("union_set", FLOATS), ("concat_str", TEXT),
]


def made(kind, rng):
    if kind == TEXT:
        return rng.choice(["", "", "a", "b", "😀"])
    if kind == FLAT:
        return {k: rng.randrange(5) for k in rng.sample("xyz", rng.randrange(4))}
    if kind == DEEP:
        return {k: None if rng.random() < 0.2 else made(FLAT, rng) for k in rng.sample("pq", rng.randrange(3))}
    if kind == DEEPER:
        return {k: None if rng.random() < 0.2 else made(DEEP, rng) for k in rng.sample("mn", rng.randrange(3))}
    if kind == T.DoubleType():
        return rng.choice([0.5, 1.0, 2.0, 1e300])
    item = kind.elementType
    return [made(item, rng) for _ in range(rng.randrange(4))]


@pytest.mark.parametrize("strategy,kind", CASES, ids=lambda x: x if isinstance(x, str) else x.simpleString())
def test_long_running_and_so_far(spark, strategy, kind):
    rng = random.Random(str((strategy, kind)))
    rows = [(run, p, port, made(kind, rng)) for run in range(12) for p in rng.sample(range(-1, 8), rng.randrange(1, 6)) for port in range(rng.randrange(1, 4))]
    rng.shuffle(rows)
    schema = T.StructType([T.StructField("run", T.LongType()), T.StructField("p", T.LongType()), T.StructField("port", T.LongType()), T.StructField("v", kind)])
    df = spark.createDataFrame(rows, schema)

    def of(run, test):
        return fold(strategy, [v for r, p, port, v in sorted(rows, key=lambda x: x[:3]) if r == run and test(p)])

    got = {r.run: r.value for r in folds.fold_long(df, ["run"], ["p", "port"], "v", strategy).collect()}
    assert got == {run: of(run, lambda p: True) for run in {r[0] for r in rows}}
    readers = spark.createDataFrame([(r, p) for r in range(12) for p in range(9)], "run long, p long")
    for r in folds.fold_so_far(df, readers, ["run"], "p", "port", "v", strategy).collect():
        assert r.value == of(r.run, lambda p, at=r.p: p < at), r
    for r in folds.fold_running(df, ["run"], "p", "port", "v", strategy).collect():
        assert r.value == of(r.run, lambda p, at=r.p: p <= at), r


def test_many_folds_share_one_window(spark):
    rng = random.Random(9)
    rows = [(run, p, port, made(TEXT, rng), made(LIST, rng), None if rng.random() < 0.3 else "v") for run in range(8) for p in range(6) for port in range(rng.randrange(1, 3))]
    df = spark.createDataFrame(rows, "run long, p long, port long, t string, l array<string>, o string")
    asked = {"a": ("t", "last_present_wins"), "b": ("l", "append_list"), "c": ("l", "union_set"), "d": ("t", "concat_str"), "e": ("t", "first_wins"), "f": ("t", "last_wins")}
    together = {(r.run, r.p): r for r in folds.folds_running(df, ["run"], "p", "port", {**asked, "g": ("o", "concat_str")}).collect()}
    for out, (value, strategy) in asked.items():
        for r in folds.fold_running(df, ["run"], "p", "port", value, strategy, out).collect():
            assert together[r.run, r.p][out] == r[out]
    for (run, p), r in together.items():
        assert (r.g or "") == "".join(x[5] or "" for x in sorted(rows, key=lambda x: x[:3]) if x[0] == run and x[1] <= p)


def test_sets_and_maps_so_far_are_not_folded_anew_for_each_reader(spark):
    import time

    n = 10_000
    rows = spark.range(n).selectExpr("1 as run", "id as p", "0 as port", "array(cast(id % 50 as string)) as l", "map(cast(id % 50 as string), id) as m").coalesce(1)
    began = time.time()
    for value, strategy in (("l", "union_set"), ("m", "deep_merge_dict")):
        got = folds.fold_so_far(rows, rows.select("run", "p"), ["run"], "p", "port", value, strategy)
        sizes = got.select("p", F.size("value").alias("n"), F.when(F.lit(value == "m"), F.lit(1)).alias("x")).where("p > 0").agg(F.max("n"), F.min("n"), F.count("*")).first()
        assert tuple(sizes) == (50, 1, n - 1)
    assert time.time() - began < 120


@pytest.mark.parametrize("strategy,kind", CASES, ids=lambda x: x if isinstance(x, str) else x.simpleString())
def test_wide(spark, strategy, kind):
    rng = random.Random(7)
    rows = [tuple([k, *(made(kind, rng) for _ in range(3))]) for k in range(30)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("k", T.LongType()), *(T.StructField(c, kind) for c in "abc")]))
    out = df.select("k", folds.fold_wide(strategy, [F.col("a"), F.col("b"), F.col("c")], kind).alias("v")).collect()
    assert {r.k: r.v for r in out} == {r[0]: fold(strategy, list(r[1:])) for r in rows}


def test_deep_merge_keeps_a_present_null(spark):
    df = spark.sql("select map('a', 1, 'b', 2) a, map('a', cast(null as int)) b")
    out = df.select(folds.deep_merge(F.col("a"), F.col("b"), df.schema["a"].dataType).alias("v")).first().v
    assert out == {"a": None, "b": 2}


def test_every_strategy_says_what_it_accepts():
    for s in folds.STRATEGIES:
        assert folds.accepts(s, TEXT) == (s not in ("append_list", "union_set", "deep_merge_dict"))


def test_nested_maps_floats_and_maps_of_one_large_run(spark):
    """10,000 contributions to one run: the work follows the results, not the contributions' square."""
    import time

    n = 10_000
    rows = spark.range(n).selectExpr(
        "1 as run", "id as p", "0 as port", "array(id % 50 + 0.5D) as f", "array(map('k', id % 50)) as l", "map(cast(id % 5 as string), map(cast(id % 3 as string), map('x', id))) as m"
    ).coalesce(1)
    began = time.time()
    for value, strategy, most in (("f", "union_set", 50), ("l", "union_set", 50), ("m", "deep_merge_dict", 5)):
        got = folds.fold_so_far(rows, rows.select("run", "p"), ["run"], "p", "port", value, strategy)
        assert tuple(got.select("p", F.size("value").alias("n")).where("p > 0").agg(F.max("n"), F.min("n"), F.count("*")).first()) == (most, 1, n - 1)
    long = folds.fold_long(rows, ["run"], ["p", "port"], "m", "deep_merge_dict")
    assert long.first().value == {str(a): {str(b): {"x": max(k for k in range(n) if k % 5 == a and k % 3 == b)} for b in range(3)} for a in range(5)}
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(at" not in plan and time.time() - began < 120


@pytest.mark.parametrize("values", [[], [None], [1.0], [1.0, 2.0, 2.0, 3.0, 4.0, None, 1.0], [5.0, 4.0, 3.0]])
def test_reductions_merge_at_any_place(values):
    rise = reduce.longest_rise("v")

    def of(part):
        s = rise.start()
        for v in part:
            s = rise.step(s, {"v": v})
        return s

    whole = of(values)
    best = max((b - a for a in range(len(values)) for b in range(a + 1, len(values) + 1) if None not in values[a:b] and all(x < y for x, y in zip(values[a:b], values[a + 1 : b]))), default=0)
    assert rise.finish(whole) == best
    assert all(rise.merge(of(values[:k]), of(values[k:])) == whole for k in range(len(values) + 1))


def test_reductions_of_a_hot_run(spark):
    rng = random.Random(3)
    rows = [("hot" if k % 3 else None if k % 5 else "b", k, rng.choice([None, rng.random(), rng.randrange(3) * 1.0])) for k in range(6000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run string, p long, v double").repartition(7)
    rise = reduce.longest_rise("v")
    want = {}
    for run, _, v in sorted(rows, key=lambda r: r[1]):
        want[run] = rise.step(want.get(run, rise.start()), {"v": v})
    got = {r.run: r.value for r in reduce.reduce_runs(df, ["run"], ["v"], rise, ["p"]).collect()}
    assert got == {k: rise.finish(s) for k, s in want.items()}
    for r in reduce.reduce_runs(df, ["run"], ["v"], reduce.spread("v")).collect():
        mine = [v for run, _, v in rows if run == r.run and v is not None]
        mean = sum(mine) / len(mine)
        assert r.value.n == len(mine) and r.value.mean == pytest.approx(mean) and r.value.variance == pytest.approx(sum((v - mean) ** 2 for v in mine) / len(mine))
    assert reduce.reduce_runs(df.limit(0), ["run"], ["v"], rise, ["p"]).count() == 0
