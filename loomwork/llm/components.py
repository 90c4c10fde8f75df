"""Connected components of a graph that is held as a DataFrame of edges.

Alternating large-star and small-star rounds: every round is two partial aggregations and two
equality joins, so no neighbourhood is collected, and the number of rounds is logarithmic.  Each
round is checkpointed in the shared folder.  As soon as no more than ``ONE_TASK`` edges are left,
by their count, one task on an executor finishes them: its arrays are bounded by that number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import cut_narrow
from loomwork.llm.tokens import trimmed

#: Edges of 64-bit nodes that one task takes; some 60 bytes each while it works.
ONE_TASK = 1 << 20


def spanning_forest(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the pairs that join two trees; as many links as members at most."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    kept = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different nodes of the edges (a, b) in rising order, and the smallest node in reach of each."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    parent = np.arange(len(nodes))
    while len(a):
        roots = parent[a], parent[b]
        low, high = np.minimum(*roots), np.maximum(*roots)
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(parent, high[apart], low[apart])  # the larger root hangs under the smaller
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return nodes, nodes[parent]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if held:
            node, root = least_reachable(*(np.concatenate(c) for c in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])

    return edges.select("u", "v").coalesce(1).mapInArrow(trimmed(run), "node long, root long")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) of one orderable type -> (node, root): root is the smallest node in reach.

    Nodes without an edge to another node don't appear.  Nulls, loops and repeated edges are
    ignored; no edges give no rows.
    """
    now = cut_narrow(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    long = dict(now.dtypes)["u"] == "bigint"
    before = _digest(now)
    for _ in range(most_rounds):
        if long and before[0] <= ONE_TASK:
            return _in_one_task(now)
        if before[0] == 0:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        now = cut_narrow(linked.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        after = _digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components still changed after {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
