"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder that ``shared_path`` named, once nothing will read it again."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getName().startswith("loomwork-"):
        raise ValueError(f"{path} is no folder that was made here")
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
