"""Centroid clustering in exact integers, screened by float32 products with error intervals.

Vectors are turned into integers, centroids are integers too, and all that decides is an integer.
The squared distance of x and c is |x|^2 + |c|^2 - 2 x.c, of which the first term is the same for all
centroids.  x.c comes from one float32 matrix product.  Whatever the order of its d products and sums,
fused or not, and with both factors rounded to float32 first, it is off by at most

    g |x| |c|,   g = (d + 2) u / (1 - (d + 2) u),   u = 2^-24

since the sum of |x_i c_i| is at most |x| |c|.  Integers leave no room for underflow, and components
are bounded, so that nothing overflows.  So every centroid has an interval for its distance; those
that reach the least upper end are the shortlist.  Where that is more than one, their distances are
computed anew as integers, and ties go to the lowest number.

Each round is one pass: a task adds up its vectors by centroid and hands on one row for each centroid
and component.  Sums and the floor of their means are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import bounded_batches, cut, no_clash
from loomwork.llm.tokens import trimmed

#: Components up to this are screened; 64-bit integers hold their squared distances for up to 127 of them.
SCREENED = 1 << 27
#: Intervals of a slice of vectors with all centroids, and components of pairs that are computed anew at once.
_AT_ONCE = 1 << 20
_WIDER = 1 + 1e-6  # for the float64 roundings of norms and of the interval's own sums


class Screen:
    """Centroids as numbers, ready to be compared with vectors."""

    def __init__(self, centroids: list[list[int]]):
        self.rows = centroids
        dims = len(centroids[0]) if centroids else 0
        self.plain = dims <= 127 and all(abs(x) <= SCREENED for c in centroids for x in c)
        self.whole = np.array(centroids, np.int64 if self.plain else object).reshape(len(centroids), dims)
        if self.plain:
            self.squares = (self.whole * self.whole).sum(axis=1).astype(np.float64)
            self.norms = np.sqrt(self.squares)
            self.single = self.whole.astype(np.float32)
            u = (dims + 2) * 2.0**-24
            self.error = u / (1 - u)

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of |c|^2 - 2 x.c, a row a vector."""
        products = (x.astype(np.float32) @ self.single.T).astype(np.float64)
        norms = np.sqrt((x * x).sum(axis=1).astype(np.float64))
        off = (2 * self.error * _WIDER) * norms[:, None] * self.norms + 2.0**-50 * (self.squares + 2 * np.abs(products))
        middle = self.squares - 2 * products
        return middle - off, middle + off

    def exact(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Squared distances of the vectors to the centroid of each, as integers."""
        apart = x - self.whole[of]
        return (apart * apart).sum(axis=1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The number of each vector's nearest centroid."""
        if not self.plain or x.dtype == object:
            return np.array([min(range(len(self.rows)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, self.rows[c], strict=True)), c)) for v in x.tolist()], np.int64)
        out = np.empty(len(x), np.int64)
        step = max(1, _AT_ONCE // len(self.rows))
        for a in range(0, len(x), step):
            out[a : a + step] = self._of_slice(x[a : a + step])
        return out

    def _of_slice(self, x: np.ndarray) -> np.ndarray:
        low, high = self.intervals(x)
        short = low <= high.min(axis=1, keepdims=True)
        out = short.argmax(axis=1)
        unsure = np.flatnonzero(short.sum(axis=1) > 1)
        step = max(1, _AT_ONCE // (len(self.rows) * x.shape[1] or 1))
        for a in range(0, len(unsure), step):
            some = unsure[a : a + step]
            row, centroid = np.nonzero(short[some])
            distance = np.full((len(some), len(self.rows)), np.iinfo(np.int64).max)
            distance[row, centroid] = self.exact(x[some[row]], centroid)
            out[some] = distance.argmin(axis=1)  # the first of equals
        return out


def _integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of all components: 64-bit integers, or Python's where one is too large to be screened."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(-1, dims)
    if not len(x) or np.abs(x).max() <= SCREENED:
        return x.astype(np.int64)
    return np.array([[int(c) for c in row] for row in x.tolist()], object)


def clusters(
    vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, salt: str = "1", id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256): each vector's centroid after ``rounds`` rounds.

    Only vectors of exactly ``dims`` components, none null or non-finite, and with an id take part;
    component x counts as floor(scale * x).  Centroids start as the k vectors with the least SHA-256 of
    ``salt:id``, ties by the vector.  With fewer vectors there are fewer centroids; none give no rows.
    A centroid without vectors stays; of equal ones the lowest number gets all.  Repeated rows and ids
    count each by themselves.  A distance or inertia beyond 64 bits is an error.  Other columns,
    whatever their names, are not read.
    """
    no_clash(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    if dims < 1 or k < 1:
        raise ValueError("clusters need a component and a centroid at least")
    spark = vectors.sparkSession
    bounded_batches(spark)
    v = F.col("vec")
    broken = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & (F.size(v) == dims) & ~broken)
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = rows.select(hashed.alias("h"), "vec").orderBy("h", "vec").limit(k).toArrow().column("vec").combine_chunks()
    now = _integers(first, dims, scale).tolist()
    for _ in range(rounds if now else 0):
        now = _means(rows, Screen(now), dims, scale)
    screen = Screen(now)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch.column(1), dims, scale)
            found = screen.nearest(x)
            distance = pa.array(screen.exact(x, found).tolist(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32()), distance], names=["id", "cluster", "distance"])

    given = cut(rows.mapInArrow(trimmed(assign), f"id {dict(rows.dtypes)['id']}, cluster int, distance long"))
    sums = given.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows at most
    sums = {r.cluster: int(r.s) for r in sums}
    told = [(c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(now)]
    each = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = given.join(F.broadcast(each), "cluster")  # as many rows as centroids
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _means(rows: DataFrame, screen: Screen, dims: int, scale: int) -> list[list[int]]:
    """The centroids after one round: floors of the exact means of their vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        count: dict[int, int] = {}
        for batch in batches:
            x = _integers(batch.column(1), dims, scale)
            found = screen.nearest(x)
            for c in np.unique(found).tolist():
                mine = x[found == c]
                total[c] = [a + b for a, b in zip(total.get(c, [0] * dims), mine.sum(axis=0).tolist(), strict=True)]
                count[c] = count.get(c, 0) + len(mine)
        for c, sums in total.items():
            columns = [pa.array([c] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0)), pa.array([count[c]] * dims, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "dim", "total", "n"])

    partial = rows.mapInArrow(trimmed(add), "cluster int, dim int, total decimal(38,0), n long")
    now = [list(c) for c in screen.rows]
    # a row for each centroid and component
    for r in partial.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        now[r.cluster][r.dim] = int(r.total) // r.n
    return now


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64) -> str:
    """DuckDB's clustering of the whole table: all distances of each round, computed as integers."""
    steps = [
        f"""kept as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * {scale})::bigint) as v from embeddings
  where vec_id is not null and len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims})""",
        f"""c0 as (
  select (row_number() over (order by h) - 1)::int as cluster, v as m from (select v, sha256('1:' || vec_id) as h from kept order by h limit {k}))""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} as (
  select vec_id, v, cluster, distance from (
    select vec_id, v, cluster, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance from kept, c{r})
  qualify row_number() over (partition by vec_id order by distance, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""c{r + 1} as (
  select c.cluster, coalesce(s.m, c.m) as m from c{r} c left join (
    select cluster, list(mean order by i) as m from (
      select cluster, i, floor(sum(x)::double / count(*))::bigint as mean from (
        select cluster, unnest(v) as x, unnest(range({dims})) as i from a{r}) group by cluster, i) group by cluster) s using (cluster))""")
    return "with " + ",\n".join(steps) + f"""
select vec_id, cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
  sha256(array_to_string(m, ',')) as centroid_sha256
from a{rounds} join c{rounds} using (cluster)"""


SQL = _sql()
