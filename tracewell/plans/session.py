"""Session helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def registry() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str], Callable]:
    """(queries, their SQL, a decorator that registers a query under its function's name)."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracle: dict[str, str] = {}

    def query(sql: str):
        def add(f):
            queries[f.__name__], oracle[f.__name__] = f, sql
            return f

        return add

    return queries, oracle, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointing(spark: SparkSession) -> None:
    """Make checkpoint() work where the cluster names no folder (tests on one machine).

    With executors elsewhere there is no folder that could be made for them, which is an error.
    """
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracewell-"))
