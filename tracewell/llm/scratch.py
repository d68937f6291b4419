"""Shared scratch space: tables that executors and driver can all read.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only where that
setting is absent and the master is local (tests on one machine) a temporary folder is made and set.
"""

from __future__ import annotations

import gc
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


#: Spark's own setting: what an execution shuffled is deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's bound of the bytes of a batch for Python, and what it is set to: a few blocks of text at most.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches for Python tasks of at most BATCH_BYTES or one row, unless the session has a bound of its own.

    Spark cuts batches at 10,000 rows whatever they hold: with whole texts or compressed blobs that is all of a partition,
    which the executor has twice outside its heap, and half as much again while buffers grow.  The bound stays
    with the session, as results are computed after the operator has returned.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


#: Partitions that a task takes one after the other, so that as many fewer files are written.
TOGETHER = 4


def tasks(parts: int, buckets: int, cores: int) -> int:
    """Tasks for partitions of sorted buckets: one for ``TOGETHER``, but two for each core where there are so many.

    Partitions of several buckets each are large enough for tasks of their own.
    """
    return parts if parts < buckets else max(min(parts, 2 * cores), math.ceil(parts / TOGETHER))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a re-read of a file and no recomputation.  What the job
    shuffled is no longer needed, and Spark deletes it as the job ends.  What it broadcast stays in the
    memory of executors until the driver's collector has seen that nothing refers to it, so that is asked for:
    without it the stages of the pipeline add up to some 200 MB more of an executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(CLEANUP, before)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate of ``df`` (for scans, the size of the files)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
