"""Cutting lineage between the rounds of an iterative operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("iterative operators need spark.checkpoint.dir on a cluster")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/rastertab-{label}-{uuid.uuid4().hex}"


@contextmanager
def _freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE) if before is None else spark.conf.set(FREE, before)


def settle(df: DataFrame, label: str = "round") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike a cached or local checkpoint the result survives the loss of executors; being Parquet it
    keeps column pruning and a real size, so the planner can still pick a broadcast when it is small.
    The shuffle files of the write go as soon as it is done: nothing reads them again, and left to the driver's garbage
    collection those of a whole run of steps pile up on the executors' disks.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with _freeing_shuffles(spark):
        df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.settled_path = path
    return kept


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast, whatever its files seem to be worth.

    Sorted keys pack so well in Parquet that millions of rows stay under the planner's limit, which goes by the size of
    the files; the driver would then hold them unpacked, as a hash table.
    """
    return df.hint("merge")


def discard(settled: DataFrame) -> None:
    """Delete what :func:`settle` wrote for a frame that nothing will read again, so that rounds don't pile up."""
    spark = settled.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(settled.settled_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
