"""Reductions of one's own: a start, a step, a merge and a finish, as partial and final aggregations.

Without an order the merge must be commutative and associative: every task reduces the rows that it
has to one state a run, and only states are exchanged.  With an order the merge need only be
associative: rows are dealt out by ranges of (run, order) and sorted within tasks, so that a state is
that of a stretch of its run, and the stretches are merged in their order.  Either way a run with most
of the rows is worked on by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: States that a task holds before it hands them on.
HELD = 50_000


@dataclass(frozen=True)
class Reduction:
    """A monoid over rows.  States are what ``state`` says, as Arrow gives it: structs are dicts.

    step(state, row): the state with one more row, a dict of the value columns; merge(a, b): the state of
    a's rows and then b's; finish(state): what ``result`` says.
    """

    state: str
    result: str
    start: Callable[[], Any]
    step: Callable[[Any, dict[str, Any]], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any] = lambda state: state


def reduce_runs(rows: DataFrame, run: Sequence[str], values: Sequence[str], by: Reduction, order: Sequence[str] = (), out: str = "value") -> DataFrame:
    """One row a run: its columns and the reduction of its rows.  order must be unique in a run; nulls are values."""
    run, values, order = list(run), list(values), list(order)
    state, result = T.StructType.fromDDL(f"s {by.state}")["s"].dataType, T.StructType.fromDDL(f"r {by.result}")["r"].dataType
    keys = rows.select(*run).schema
    places = rows.select(*order).schema if order else T.StructType([])
    partial = T.StructType([*keys, T.StructField("__at", places if order else T.IntegerType()), T.StructField("__state", state)])
    made, finished = to_arrow_type(state), to_arrow_type(result)
    n, m = len(run), len(run) + len(order)
    arrow_keys = [pa.field(f.name, to_arrow_type(f.dataType)) for f in keys]
    arrow_at = to_arrow_type(places) if order else pa.int32()

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}  # run -> where its stretch begins, state

        def flush() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], f.type) for i, f in enumerate(arrow_keys)]
            columns += [pa.array([at for at, _ in held.values()], arrow_at), pa.array([s for _, s in held.values()], made)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*run, "__at", "__state"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                key = row[:n]
                if key not in held:
                    if len(held) >= HELD:
                        yield flush()
                    held[key] = [dict(zip(order, row[n:m], strict=True)) if order else 0, by.start()]
                held[key][1] = by.step(held[key][1], dict(zip(values, row[m:], strict=True)))
        if held:
            yield flush()

    def merged(table: pa.Table) -> pa.Table:
        states = table.column("__state").to_pylist()
        if order:
            at = [tuple((x[c] is not None, x[c]) for c in order) for x in table.column("__at").to_pylist()]
            states = [states[k] for k in sorted(range(len(states)), key=lambda k: at[k])]
        total = states[0]
        for s in states[1:]:
            total = by.merge(total, s)
        return pa.table([*(table.column(c)[:1] for c in run), pa.array([by.finish(total)], finished)], names=[*run, out])

    given = rows.select(*run, *order, *values)
    if order:
        given = given.repartitionByRange(*run, *order).sortWithinPartitions(*run, *order)
    states = given.mapInArrow(reduced, partial)
    schema = T.StructType([*keys, T.StructField(out, result)])
    return states.groupBy(*run).applyInArrow(merged, schema).select(*(F.col(c) for c in [*run, out]))



def spread(value: str) -> Reduction:
    """(n, mean, variance) of a column's values that aren't null."""

    def step(s: dict, row: dict) -> dict:
        x = row[value]
        return s if x is None else merge(s, {"n": 1, "mean": x, "m2": 0.0})

    def merge(a: dict, b: dict) -> dict:
        n = a["n"] + b["n"]
        if not n:
            return a
        apart = b["mean"] - a["mean"]
        return {"n": n, "mean": a["mean"] + apart * b["n"] / n, "m2": a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n}

    def finish(s: dict) -> dict:
        return {"n": s["n"], "mean": s["mean"] if s["n"] else None, "variance": s["m2"] / s["n"] if s["n"] else None}

    return Reduction("struct<n:long,mean:double,m2:double>", "struct<n:long,mean:double,variance:double>", lambda: {"n": 0, "mean": 0.0, "m2": 0.0}, step, merge, finish)


def longest_rise(value: str) -> Reduction:
    """The length of the longest stretch of consecutive rows whose values rise; nulls end one."""

    def of(x: Any) -> dict:
        k = int(x is not None)
        return {"n": 1, "first": x, "last": x, "head": k, "tail": k, "best": k}

    def merge(a: dict, b: dict) -> dict:
        if not a["n"] or not b["n"]:
            return b if not a["n"] else a
        rises = a["last"] is not None and b["first"] is not None and a["last"] < b["first"]
        joined = a["tail"] + b["head"] if rises else 0
        return {
            "n": a["n"] + b["n"], "first": a["first"], "last": b["last"], "head": joined if rises and a["head"] == a["n"] else a["head"],
            "tail": joined if rises and b["tail"] == b["n"] else b["tail"], "best": max(a["best"], b["best"], joined),
        }

    start = {"n": 0, "first": None, "last": None, "head": 0, "tail": 0, "best": 0}
    state = "struct<n:long,first:double,last:double,head:long,tail:long,best:long>"
    return Reduction(state, "long", lambda: dict(start), lambda s, row: merge(s, of(row[value])), merge, lambda s: s["best"])
