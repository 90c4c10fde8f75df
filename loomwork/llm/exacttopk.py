"""Exact top-k search by the three phases of the uniform threshold algorithm.

A score is a sum of parts: the components are cut into ``PARTS`` ranges, and the inner product over
one range is a part's local score.  A block of vectors holds each part's columns apart, and so gives a
list of local scores of every part for every query.

1. Every part hands on its lists' first entries.  The candidates among them are scored exactly, and
   the (k+1)-th best of all blocks' scores is a safe cutoff: that many vectors reach it, and one of
   them at most is the query's own.
2. The cutoff goes out to all parts with the queries.  What scores below cutoff / parts in every part
   is below the cutoff in sum, so each part hands on its entries from there up.
3. The scores that an entry lacks are fetched from the other parts, and what is below the cutoff in
   sum goes.

So every result is exact, ties included, whatever the data; they decide only how many entries are
handed on.  The parts of a block lie in one task, so entries and fetches stay there; what is exchanged
for a query is at most k + 1 scores of each block in phase 1, and k + 1 candidates of each in phase 3.
Queries and vectors meet block by block, as the query set is a share of the table.

Vectors are integers; those of equal components are searched once, with their smallest k + 1 ids,
which are all that can be among the k best under ties to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import bounded_batches, cut, no_clash, partition_count
from loomwork.llm.innerproduct import BLOCK, LARGEST_BLOCK, different, usable
from loomwork.llm.tokens import trimmed

PARTS = 2
#: Entries of a part's list in a block that it hands on first.
LISTED = 32
#: Queries of a block at most, 16 MB or less at 64 components.
QUERY_BLOCK = 1 << 16
#: Vectors of a list that are scored together, and local scores that a task holds at once, which stay in the cache.
WIDE, _AT_ONCE = 4096, 1 << 20
_RUN = 32
_NOTHING = -(1 << 62)  # a cutoff that all reach


def _fitting(peak_q: int, peak_v: int, dims: int) -> type:
    """The fastest type of numbers that holds all sums of such products exactly."""
    most = peak_q * peak_v * dims
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def local_scores(queries: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, exact local scores of some queries with the whole block); vectors are rows."""
    peak = [int(np.abs(x).max(initial=0)) for x in (queries, block)]
    kind = _fitting(*peak, queries.shape[1])
    turned = np.ascontiguousarray(block.T).astype(kind)
    step = max(1, _AT_ONCE // max(1, len(block)))
    for at in range(0, len(queries), step):
        yield at, queries[at : at + step].astype(kind) @ turned


def first_entries(scores: np.ndarray, listed: int) -> np.ndarray:
    """The columns of each row's largest scores, as many as are asked for or there are."""
    n, runs = scores.shape[1], scores.shape[1] // _RUN
    if n <= listed:
        return np.broadcast_to(np.arange(n), scores.shape)
    if n % _RUN or runs <= 2 * listed:
        return np.argpartition(scores, n - listed, axis=1)[:, n - listed :]
    # they lie in those runs, of every so many columns, whose largest scores are first
    run = first_entries(scores.reshape(-1, _RUN, runs).max(axis=1), listed)
    column = (run[:, :, None] + np.arange(0, n, runs)).reshape(len(scores), -1)
    place = np.argpartition(np.take_along_axis(scores, column, axis=1), column.shape[1] - listed, axis=1)[:, -listed:]
    return np.take_along_axis(column, place, axis=1)


def _taking_part(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    rows = usable(vectors, id_col, vec_col, zeros=True)
    whole = F.transform("vec", lambda x: F.floor(x.cast("double") * scale))
    large = F.exists("vec", lambda x: F.abs(x.cast("double") * scale) >= 2.0**31 - 1)
    told = F.raise_error(F.format_string("a component of vector %d has no 32-bit integer", "id")).cast("array<int>")
    return rows.select("id", F.when(large, told).otherwise(whole.cast("array<int>")).alias("vec")).distinct()


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _reaching(parts: int):
    """The entries of a part's list from the cutoffs' share up: (row, column, zero)."""

    def entries(scores: np.ndarray, rest: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        least = -(-rest[0] // parts)  # the least whole local score from the cutoff's share up
        if scores.dtype == np.float32:  # its numbers are below 2^24
            least = np.clip(least, -(1 << 24), 1 << 24)
        row, column = np.divmod(np.flatnonzero(scores >= least.astype(scores.dtype)[:, None]), scores.shape[1])
        return row, column, np.zeros(len(row), np.int64)

    return entries


def _lists(queries: list[np.ndarray], have: list[np.ndarray]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first query, first vector, each part's local scores), for some queries and vectors at a time."""
    queries = [x.astype(np.int64) for x in queries]
    for at in range(0, len(have[0]), WIDE):
        each = (local_scores(q, x[at : at + WIDE].astype(np.int64)) for q, x in zip(queries, have, strict=True))
        for found in zip(*each, strict=True):
            yield found[0][0], at, [scores for _, scores in found]


def listed_best(queries: list[np.ndarray], have: list[np.ndarray], most: int) -> np.ndarray:
    """(queries, most): the best whole scores among the first entries of all parts' lists; phase 1."""
    best = np.full((len(queries[0]), most), _NOTHING)
    listed = max(most, -(-LISTED // max(1, -(-len(have[0]) // WIDE))))
    for of, _, scores in _lists(queries, have):
        column = np.sort(np.concatenate([first_entries(s, listed) for s in scores], axis=1), axis=1)
        whole = sum(np.take_along_axis(s, column, axis=1).astype(np.int64) for s in scores)
        whole[:, 1:][column[:, 1:] == column[:, :-1]] = _NOTHING  # it is in several lists
        both = np.concatenate([best[of : of + len(whole)], whole], axis=1)
        best[of : of + len(whole)] = np.partition(both, both.shape[1] - most, axis=1)[:, -most:]
    return best


def _first(row: np.ndarray, score: np.ndarray, least: np.ndarray, most: int) -> np.ndarray:
    """The places of each row's best scores, ties to the smaller id."""
    order = np.lexsort((least, -score, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < most]


def reaching_best(
    queries: list[np.ndarray], have: list[np.ndarray], least: np.ndarray, cutoffs: np.ndarray, most: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, whole score) of what reaches its query's cutoff, the best of a query only; phases 2 and 3."""
    entries, share = _reaching(len(have)), -(-cutoffs // len(have))
    kept = [(np.zeros(0, np.int64),) * 3]
    for of, at, scores in _lists(queries, have):
        cutoff, found = cutoffs[of : of + len(scores[0])], []
        for p, s in enumerate(scores):
            row, column, _ = entries(s, [cutoff])
            local = [t[row, column].astype(np.int64) for t in scores]
            right = sum(local) >= cutoff[row]
            for before in local[:p]:  # a part before has handed it on
                right &= before < share[of + row]
            found.append((of + row[right], at + column[right], sum(local)[right]))
        row, column, score = map(np.concatenate, zip(*found, strict=True))
        best = _first(row, score, least[column], most)
        kept.append((row[best], column[best], score[best]))
    row, column, score = map(np.concatenate, zip(*kept, strict=True))
    best = _first(row, score, least[column], most)
    return row[best], column[best], score[best]


class _Search:
    """The packed blocks of one search, and its scans."""

    def __init__(self, apart: DataFrame, asked: DataFrame, dims: int, peak: int, parts: int):
        self.tasks = partition_count(apart.sparkSession)
        n = apart.count()
        size = min(LARGEST_BLOCK, max(BLOCK, -(-n // self.tasks)))
        self.n_have, self.n_asked = max(1, -(-n // size)), max(1, -(-asked.count() // QUERY_BLOCK))
        self.edges = np.linspace(0, dims, parts + 1).astype(int).tolist()
        self.kind = "<i2" if peak < 1 << 15 else "<i4"
        # a block's columns; ids of its vectors for ties
        self.blocks = cut(self.packed(apart.withColumn("least", F.col("ids")[0]), self.n_have, ["key", "least"]))

    def packed(self, rows: DataFrame, n: int, numbers: list[str]) -> DataFrame:
        """A row for each block: (block, the numbers, the parts' columns one part after the other)."""
        edges, kind = self.edges, self.kind

        def pack(table: pa.Table) -> pa.Table:
            x = _rows(table.column("vec").combine_chunks(), edges[-1]).astype(kind)
            shared = [table.column(c).to_numpy().astype("<i8").tobytes() for c in numbers]
            columns = b"".join(np.ascontiguousarray(x[:, a:b]).tobytes() for a, b in zip(edges, edges[1:], strict=False))
            names = ["block", *(f"b{k}" for k in range(len(shared))), "x"]
            return pa.table([table.column("block")[:1], *(pa.array([b], pa.binary()) for b in (*shared, columns))], names=names)

        schema = ", ".join(["block int", *(f"b{k} binary" for k in range(len(numbers))), "x binary"])
        rows = rows.select(F.pmod(F.xxhash64(numbers[0]), F.lit(n)).cast("int").alias("block"), *numbers, "vec")
        return rows.groupBy("block").applyInArrow(pack, schema)

    def scan(self, asked: DataFrame, numbers: list[str], result, schema: str) -> DataFrame:
        """``result`` of every block of queries with every block of vectors.

        It gets the queries' numbers and parts, then the vectors' keys, least ids and parts.
        """
        edges, kind = self.edges, self.kind
        left = self.blocks.select("block", F.col("b0").alias("keys"), F.col("b1").alias("least"), F.col("x").alias("have"))
        left = left.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(self.n_asked - 1))))
        right = self.packed(asked, self.n_asked, numbers).withColumnRenamed("block", "of")
        right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.n_have - 1))))
        # few bytes and much work: adaptive execution would join them in few tasks
        left, right = (side.repartition(self.tasks, "block", "of") for side in (left, right))
        met = left.join(right, ["block", "of"]).select("keys", "least", "have", "x", *(f"b{k}" for k in range(len(numbers))))

        def apart(packed: pa.Buffer, n: int) -> list[np.ndarray]:
            x = np.frombuffer(packed, kind)
            return [x[n * a : n * b].reshape(n, b - a) for a, b in zip(edges, edges[1:], strict=False)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    keys, least, have, x, *rest = (batch.column(c)[r].as_buffer() for c in range(batch.num_columns))
                    keys, least, *rest = (np.frombuffer(b, "<i8") for b in (keys, least, *rest))
                    yield result(rest, apart(x, len(rest[0])), keys, least, apart(have, len(keys)))

        return met.mapInArrow(trimmed(run), schema)


def _phase_1(most: int):
    def result(rest, queries, keys, least, have) -> pa.RecordBatch:
        best = listed_best(queries, have, most)
        ends = pa.array(np.arange(0, best.size + 1, most), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(rest[0]), pa.ListArray.from_arrays(ends, pa.array(best.ravel()))], names=["query", "best"])

    return result


def _phases_2_and_3(most: int):
    def result(rest, queries, keys, least, have) -> pa.RecordBatch:
        row, column, score = reaching_best(queries, have, least, rest[1], most)
        return pa.RecordBatch.from_arrays([*map(pa.array, (rest[0][row], keys[column], least[column], score))], names=["query", "key", "least", "score"])

    return result


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, parts: int = PARTS, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the largest inner product, but the query's own id.

    is_query: a condition on the id, as column ``id``.  Component x counts as floor(scale * x), which
    must be a 32-bit integer.  Ties go to the smaller id; fewer candidates give fewer rows.  Null ids
    and vectors that are null, empty or hold a null or non-finite component take no part, nor do
    vectors of another than the most frequent length, for which no inner product is defined.  Rows
    that repeat an id and a vector count once; an id with several vectors asks once for each and is
    no neighbour of its own.  An empty table gives no rows.  Other columns are not read.
    """
    no_clash(id_col, "query", "key", "vec")
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = cut(_taking_part(vectors, scale, id_col, vec_col))
    peak = F.max(F.greatest(F.abs(F.array_max("vec").cast("long")), F.abs(F.array_min("vec").cast("long"))))
    known = rows.agg(F.max(F.size("vec")).alias("dims"), peak.alias("peak")).first()
    if known.dims is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    if known.dims * known.peak**2 >= 1 << 62:
        raise ValueError("scores of these vectors go beyond 64 bits")
    # numbers for vectors, fixed by the checkpoint
    apart = cut(different(rows, k + 1).withColumn("key", F.monotonically_increasing_id()))
    asked = cut(rows.where(is_query).select("vec").distinct().withColumn("query", F.monotonically_increasing_id()))
    search = _Search(apart, asked, known.dims, known.peak, min(parts, known.dims))

    # 1: the lists' first entries, and the cutoff that they make
    seen = search.scan(asked, ["query"], _phase_1(k + 1), "query long, best array<long>")
    cutoff = F.sort_array(F.flatten(F.collect_list("best")), False)[k]
    told = cut(asked.join(seen.groupBy("query").agg(cutoff.alias("cutoff")), "query"))

    # 2 and 3: all entries from the cutoff's share up, scored exactly
    scored = search.scan(told, ["query", "cutoff"], _phases_2_and_3(k + 1), "query long, key long, least long, score long")

    # no id of a vector behind k + 1 others can be among the best
    ahead = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least", "key"))
    scored = scored.withColumn("ahead", ahead).where(F.col("ahead") <= k + 1)
    each = scored.join(apart.select("key", "ids"), "key").select("query", "score", F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    lists = each.withColumn("place", place).where(F.col("place") <= k + 1)
    lists = lists.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))  # k + 1 of them
    askers = rows.where(is_query).select(F.col("id").alias("query_id"), "vec").join(asked, "vec").join(lists, "query")
    others = F.slice(F.filter("near", lambda x: x.vec_id != F.col("query_id")), 1, k)
    ranked = F.transform(others, lambda x, i: F.struct((i + 1).alias("rank"), x.vec_id.alias("vec_id"), x.score.alias("score")))
    return askers.select("query_id", F.explode(ranked).alias("x")).select("query_id", "x.rank", "x.vec_id", "x.score")


def op12_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


SQL = """
with part as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, v.vec_id, list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2]))::bigint as score
  from part q, part v where q.vec_id % 50 = 0 and v.vec_id <> q.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify rank <= 5"""
