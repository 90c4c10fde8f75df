"""Session settings and lineage cuts that the operators of this subpackage share."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the session names none it is set to a temporary folder, which is right for a local
    master only; on a cluster its absence is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="loomwork-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return known


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return posixpath.join(shared_dir(spark), f"loomwork-{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_narrow(df: DataFrame) -> DataFrame:
    """As ``cut``, for the few bytes a row that an exchange leaves: in an eighth of its partitions.

    A task takes them one after the other, so its memory is that of one; tables of documents make
    so many partitions that as many small files would cost more than their rows.
    """
    return cut(df.coalesce(max(1, partition_count(df.sparkSession) // 8)))


def stored(df: DataFrame, name: str) -> DataFrame:
    """As ``cut``, as a compressed columnar table: for large rows that are read more than once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Removes the table that ``stored`` wrote, once nothing will read it again."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if not path.getName().startswith("loomwork-"):
            raise ValueError(f"{path} is no table that was stored here")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_ours = {"67108864b", "64m"}  # Spark's default, and what operators set


def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """Bounds the Arrow batches between the JVM and Python by bytes, not by rows alone, as texts are long.

    The last operator's wish holds in a session; a setting of the session's own stays.
    """
    if spark.conf.get(_BATCH_BYTES, "64m") in _ours:
        _ours.add(most)
        spark.conf.set(_BATCH_BYTES, most)


def allow_hash_joins(spark: SparkSession, most: str = "64m") -> None:
    """Lets adaptive execution join by a hash table where every partition of one side is small.

    The sizes are those of the partitions as shuffled; beyond ``most`` bytes, or by its default,
    Spark sorts both sides, and can spill.  A setting of the session's own stays.
    """
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    if spark.conf.get(name, "0").rstrip("bB") == "0":
        spark.conf.set(name, most)


def partition_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def no_clash(id_col: str, *results: str) -> None:
    """An error where the id column has the name of a result, which would make two columns of it."""
    if id_col.lower() in {r.lower() for r in results}:
        raise ValueError(f"the id column may not be called {id_col!r}, which is a result's name")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with a suffix where df has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
