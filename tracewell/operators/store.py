"""Intermediate tables in the folder that driver and executors share.

Like checkpoint() this cuts lineage, so a lost executor costs a re-read; unlike it, Spark then knows
the size of the table and picks its joins by it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """stored(df) where a folder is set; else ``df`` itself, which is then made again for each use."""
    return stored(df) if _folder(df.sparkSession) else df


def stored(df: DataFrame) -> DataFrame:
    """``df`` written below spark.checkpoint.dir and read back; the files go when the application ends."""
    spark = df.sparkSession
    folder = _folder(spark)
    if not folder:
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
