"""Cutting lineage with tables written to the checkpoint folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting for shuffle files of finished queries.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written on the way to each table that is being settled.
_ON_THE_WAY: list[list[str]] = []


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(folder)


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """Spark deletes the shuffle files of every query started inside when it ends, not once its plan is collected as
    garbage. For queries that run once, such as those that write a table."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute once into a table beside the checkpoints and read it back; the shuffle files of the query go when it ends.

    Survives lost executors. Unlike an RDD checkpoint the last stage runs only once, and later
    scans read just the columns they need.
    """
    path = scratch_path(df.sparkSession, "stage")
    if _ON_THE_WAY:
        _ON_THE_WAY[-1].append(path)
    with dropping_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """`checkpointed` of what ``build`` returns. Tables written inside are deleted then, so nothing else may read them."""
    _ON_THE_WAY.append([])
    try:
        df = build()
        passed = _ON_THE_WAY.pop()
    except BaseException:
        _ON_THE_WAY.pop()
        raise
    out = checkpointed(df)
    for path in passed:
        delete(df.sparkSession, path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, reachable by every executor."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
