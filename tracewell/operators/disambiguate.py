"""Unique or refused (J3-J9): an answer only where exactly one candidate is left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_or_refuse(df: DataFrame, by: Sequence[str], candidate: str, narrow: Column) -> DataFrame:
    """One row per key: verdict, reason and the single candidate, if there is one.

    A sole candidate is taken as it is; among several, one that alone satisfies ``narrow`` is.
    Conditional aggregates do it in one pass with map-side combine.
    """
    hits = F.count_if(narrow)
    g = df.groupBy(*by).agg(F.count("*").alias("n"), hits.alias("n_narrow"), F.min(candidate).alias("_any"), F.min(F.when(narrow, F.col(candidate))).alias("_narrow"))
    sole, narrowed = F.col("n") == 1, F.col("n_narrow") == 1
    return g.select(
        *by,
        "n",
        F.when(sole, F.col("_any")).when(narrowed, F.col("_narrow")).alias("pick"),
        F.when(sole | narrowed, "EXACT").otherwise("UNRESOLVED").alias("verdict"),
        F.when(sole, "single candidate").when(narrowed, "narrowed to one").when(F.col("n_narrow") == 0, "several candidates, none narrowed").otherwise("ambiguous after narrowing").alias("reason"),
    )
