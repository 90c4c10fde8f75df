"""Approximate maximum inner product search with score-aware quantisation and exact reranking.

Quantisation
    Directions are cut into subspaces of two dimensions with 16 centres each, so four bits a
    subspace.  For inner products the error along a vector matters more than the error across it:
    centres and codes minimise |r|^2 + (eta - 1) (r . x)^2 / |x|^2 for residuals r, which couples the
    subspaces; codes are found by coordinate descent and centres by weighted least squares.  The
    centres are fitted on at most ``SAMPLE`` vectors; every vector is coded.

Search
    Every vector is coded once, and what goes to the queries is its codes, its length and the length
    of what the codes leave out: a tenth of the vector.  Codes and queries are packed into blocks;
    each pair of blocks is one task of bounded memory: lookup tables of a query's products with all
    centres, joined by pairs to 256 entries, are summed over the codes.  A sum is off by the product
    of the query with the residual, of which ``SPREAD`` standard deviations (in random directions)
    make a lower and an upper bound.  A vector is a candidate of a query if its upper bound reaches
    the k-th largest lower bound, of its block and then of all blocks.  So how many are kept follows
    from the data, and thousands of near copies are all kept.
    Original vectors are fetched for the candidates only, and scored exactly.

Equal vectors
    They share a code and a score.  The search is over different vectors; each carries its smallest
    k + 1 ids, which are all that can be among the k nearest under ties to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import cut, partition_count
from loomwork.llm.tokens import trimmed

SAMPLE = 8_000
THRESHOLD = 0.2
#: Standard deviations of a quantised score that its bounds are away from it.
SPREAD = 1.25
#: Vectors of a block, at least and at most; a table that makes few blocks has smaller ones.
BLOCK, LARGEST_BLOCK = 1024, 1 << 18
#: Codes that are summed at once, which stay in the cache.
_CACHED = 4096
QUERY_BLOCK = 2048
_LANES = 64


def eta(dims: int, threshold: float = THRESHOLD) -> float:
    """The weight of parallel against orthogonal error for scores at or over the threshold (as a cosine)."""
    return max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))


class Quantizer:
    """Centres (subspace, 16, 2) for unit vectors of ``dims`` dimensions, padded to an even number of pairs."""

    def __init__(self, dims: int, weight: float | None = None):
        self.dims, self.parts = dims, -(-dims // 4) * 2
        self.weight = eta(dims) if weight is None else weight
        self.centres = np.zeros((self.parts, 16, 2), np.float32)

    def _split(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), self.parts * 2), np.float32)
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        padded[:, : self.dims] = x / np.maximum(norms, 1e-30)
        return padded.reshape(len(x), self.parts, 2)

    def fit(self, x: np.ndarray, rounds: int = 6, seed: int = 5) -> Quantizer:
        v = self._split(x.astype(np.float64))
        rng = np.random.default_rng(seed)
        pick = rng.choice(len(v), 16, replace=len(v) < 16)
        self.centres = v[pick].transpose(1, 0, 2).copy()
        extra = self.weight - 1
        for _ in range(rounds):
            codes = self._codes(v)
            near = self.centres[np.arange(self.parts), codes]
            along = ((v - near) * v).sum(axis=2)
            total = along.sum(axis=1)
            for m in range(self.parts):
                x_m, rest = v[:, m], total - along[:, m]
                aim = rest + (x_m * x_m).sum(axis=1)
                for c in range(16):
                    mine = codes[:, m] == c
                    if mine.any():
                        y = x_m[mine].astype(np.float64)
                        a = mine.sum() * np.eye(2) + extra * y.T @ y
                        b = y.sum(axis=0) + extra * (aim[mine, None] * y).sum(axis=0)
                        self.centres[m, c] = np.linalg.solve(a, b)
                now = ((x_m - self.centres[m, codes[:, m]]) * x_m).sum(axis=1)
                total += now - along[:, m]
                along[:, m] = now
        return self

    def _codes(self, v: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes (n, parts): nearest centres, then coordinate descent on the weighted error."""
        n, extra = len(v), self.weight - 1
        codes = np.zeros((n, self.parts), np.uint8)
        along = np.zeros((n, self.parts), np.float32)
        for step in range(passes + 1):
            total = along.sum(axis=1)
            for m in range(self.parts):
                r = v[:, m, None, :] - self.centres[m]
                loss = (r * r).sum(axis=2)
                par = (r * v[:, m, None, :]).sum(axis=2)
                if step:
                    loss = loss + extra * ((total - along[:, m])[:, None] + par) ** 2
                codes[:, m] = loss.argmin(axis=1)
                new = par[np.arange(n), codes[:, m]]
                total = total + (new - along[:, m] if step else 0)
                along[:, m] = new
        return codes

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Two four-bit codes a byte: (n, parts / 2)."""
        codes = self._codes(self._split(x))
        return codes[:, ::2] * 16 + codes[:, 1::2]

    def left_out(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The lengths of the vectors' residuals."""
        both = np.stack([codes >> 4, codes & 15], axis=2).reshape(len(x), self.parts)
        near = self.centres[np.arange(self.parts), both]
        norms = np.linalg.norm(x, axis=1)
        return np.sqrt(((self._split(x) - near) ** 2).sum(axis=(1, 2))) * norms

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, parts / 2, 256) products of queries with every pair of centres."""
        padded = np.zeros((len(q), self.parts * 2), np.float32)
        padded[:, : self.dims] = q
        one = np.einsum("qmd,mcd->qmc", padded.reshape(len(q), self.parts, 2), self.centres.astype(np.float32))
        return (one[:, ::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), self.parts // 2, 256)


def candidates(
    quantizer: Quantizer, codes: np.ndarray, norms: np.ndarray, rest: np.ndarray, q: np.ndarray, k: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, vector row, upper bound, lower bound) of all that can be among each query's k best.

    codes: a column a vector; rest: the residuals' lengths.  Queries come one at a time.
    """
    lengths = np.linalg.norm(q, axis=1).astype(np.float32)
    doubt = rest.astype(np.float32) * np.float32(SPREAD / np.sqrt(max(1, quantizer.dims)))
    for at in range(0, len(q), _LANES):
        part = q[at : at + _LANES]
        tables = quantizer.tables(part)
        scores = np.zeros((len(part), codes.shape[1]), np.float32)
        for lo in range(0, codes.shape[1], _CACHED):
            for m in range(len(codes)):
                scores[:, lo : lo + _CACHED] += tables[:, m].take(codes[m, lo : lo + _CACHED], axis=1)
        scores *= norms
        for row in range(len(part)):
            off = doubt * lengths[at + row]
            low = scores[row] - off
            floor = np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf
            top = scores[row] + off
            near = np.flatnonzero(top >= floor)
            yield np.full(len(near), at + row), near, top[near], low[near]


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", zeros: bool = False) -> DataFrame:
    """(id, vec): rows that take part, each once.  Vectors keep their 32-bit or 64-bit components.

    Null ids, and vectors that are null, empty, zero (unless ``zeros``) or hold a null or non-finite
    component, take no part; neither do vectors of another than the most frequent length.
    """
    v = F.col("vec")
    fine = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & (F.size(v) > 0 if zeros else F.exists(v, lambda c: c != 0))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & v.isNotNull()).where(fine)
    top = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (top.n if top else 0))


def different(rows: DataFrame, most_ids: int) -> DataFrame:
    """(vec, ids): each different vector with its smallest ids in rising order.

    The limit of the window works before the exchange, so equal vectors cost a task that many rows.
    """
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = rows.select("vec", "id", place.alias("place")).where(F.col("place") <= most_ids)
    # rows of one id and one vector count once
    return few.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))


_PACKED = "ids binary, codes binary, norms binary, rest binary"
_PAIRS = "query long, key long, top float, low float"


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the largest inner product, but the query's own id.

    is_query: a condition on the id, as column ``id``.  Scores are sums of double products of the
    original components.  Ties go to the smaller id; fewer candidates give fewer rows.  Rows that
    repeat an id and a vector count once; an id with several vectors asks once for each and is no
    neighbour of its own.  An empty table, and one of unusable rows, gives no rows.  Other columns,
    whatever their names, are not read.
    """
    rows = cut(usable(vectors, id_col, vec_col).distinct())
    first = rows.select(F.size("vec").alias("n")).first()
    if first is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    dims = first.n
    spark = rows.sparkSession
    # copies would draw the centres to themselves; the checkpoint fixes the numbers
    apart = cut(different(rows, k + 1).withColumn("key", F.monotonically_increasing_id()))
    drawn = apart.select("vec").orderBy(F.xxhash64("vec"), F.col("ids")[0]).limit(sample).toArrow().column(0).combine_chunks()
    quantizer = Quantizer(dims).fit(drawn.values.to_numpy(zero_copy_only=False).reshape(-1, dims))
    kept = spark.sparkContext.broadcast(quantizer)

    n = apart.count()
    asked = cut(rows.where(is_query).select("vec").distinct().withColumn("query", F.monotonically_increasing_id()))
    size = min(LARGEST_BLOCK, max(BLOCK, -(-n // partition_count(spark))))
    n_have, n_asked = -(-n // size), max(1, -(-asked.count() // QUERY_BLOCK))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            codes = kept.value.encode(x)
            columns = [codes, np.linalg.norm(x, axis=1).astype("<f4"), kept.value.left_out(x, codes).astype("<f4")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), *map(pa.array, columns[1:])], names=["key", "code", "norm", "rest"])

    def pack(table: pa.Table) -> pa.Table:
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        numbers = [table.column(c).to_numpy() for c in ("key", "norm", "rest")]
        blobs = [numbers[0].astype("<i8"), np.ascontiguousarray(codes.T), numbers[1].astype("<f4"), numbers[2].astype("<f4")]
        return pa.table([table.column("block")[:1], *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names=["block", "ids", "codes", "norms", "rest"])

    def pack_queries(table: pa.Table) -> pa.Table:
        blobs = [table.column("query").to_numpy().astype("<i8"), _matrix(table.column("vec"), dims).astype("<f8")]
        return pa.table([table.column("part")[:1], *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names=["part", "queries", "vectors"])

    coded = apart.select("key", "vec").mapInArrow(trimmed(code), "key long, code binary, norm float, rest float")
    coded = coded.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_have)).cast("int"))
    blocks = coded.groupBy("block").applyInArrow(pack, f"block int, {_PACKED}")
    parts = asked.withColumn("part", F.pmod(F.xxhash64("vec"), F.lit(n_asked)).cast("int"))
    parts = parts.groupBy("part").applyInArrow(pack_queries, "part int, queries binary, vectors binary")
    # each pair of a packed block and packed queries meets once, by equality
    left = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    right = parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_have - 1))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, codes, norms, rest, queries, q = (batch.column(c)[r].as_buffer() for c in range(6))
                ids, queries = np.frombuffer(ids, "<i8"), np.frombuffer(queries, "<i8")
                codes = np.frombuffer(codes, np.uint8).reshape(-1, len(ids))
                q = np.frombuffer(q, "<f8").reshape(len(queries), dims)
                for of, near, top, low in candidates(kept.value, codes, np.frombuffer(norms, "<f4"), np.frombuffer(rest, "<f4"), q, k + 1):
                    yield pa.RecordBatch.from_arrays([pa.array(queries[of]), pa.array(ids[near]), pa.array(top, pa.float32()), pa.array(low, pa.float32())], names=["query", "key", "top", "low"])

    met = left.join(right, ["block", "part"]).select("ids", "codes", "norms", "rest", "queries", "vectors")
    found = met.mapInArrow(trimmed(scan), _PAIRS)
    # the floor over all blocks; with fewer vectors than are asked for there is none
    of_query = Window.partitionBy("query")
    ranked = found.withColumn("place", F.row_number().over(of_query.orderBy(F.desc("low"), "key")))
    floor = F.min(F.when(F.col("place") == k + 1, F.col("low"))).over(of_query)
    best = ranked.withColumn("floor", floor).where("floor is null or top >= floor").select("query", "key")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, q = (_matrix(batch.column(c), dims).astype(np.float64) for c in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((x * q).sum(axis=1)), batch.column(3)], names=["query", "score", "ids"])

    pairs = best.join(asked.select("query", F.col("vec").alias("q")), "query").join(apart.select("key", "vec", "ids"), "key")
    scored = pairs.select("query", "vec", "q", "ids").mapInArrow(trimmed(score), "query long, score double, ids array<long>")
    each = scored.select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    lists = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    # every id that asks with this vector, without itself
    askers = rows.where(is_query).select(F.col("id").alias("query_id"), "vec").join(asked.select("vec", "query"), "vec").join(lists, "query")
    own = F.filter("near", lambda x: x.vec_id != F.col("query_id"))
    rest_of = F.transform(F.slice(own, 1, k), lambda x, i: F.struct((i + 1).alias("rank"), x.vec_id.alias("vec_id"), x.score.alias("score")))
    return askers.select("query_id", F.explode(rest_of).alias("x")).select("query_id", "x.rank", "x.vec_id", "x.score")


def op4_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("id") % 20 == 0)
