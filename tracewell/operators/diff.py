"""Snapshot differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def removed(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys of ``old`` that ``new`` lacks."""
    return old.select(*key).distinct().join(new.select(*key).distinct(), list(key), "left_anti")


def anchors(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys on both sides."""
    return old.select(*key).distinct().join(new.select(*key).distinct(), list(key), "left_semi")


def member_diff(old: DataFrame, new: DataFrame, owner: str = "owner", name: str = "name", desc: str = "desc") -> DataFrame:
    """Rows (list, owner, name, desc, new_desc) for owners on both sides.

    Where a name occurs once on each side and its descriptors differ, that is one row
    descChanged and neither added nor removed.  One aggregation by (owner, name) decides all:
    a full outer join per key is not needed.
    """
    tag = lambda df, side: df.select(F.col(owner).alias("owner"), F.col(name).alias("name"), F.col(desc).alias("desc"), F.lit(side).alias("side")).distinct()
    both = anchors(old, new, [owner]).withColumnRenamed(owner, "owner")
    rows = tag(old, 0).unionByName(tag(new, 1)).join(both, "owner", "left_semi")
    keys = rows.groupBy("owner", "name", "desc").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    w = Window.partitionBy("owner", "name")
    is_old, is_new = F.col("lo") == 0, F.col("hi") == 1
    keys = keys.withColumns({
        "n_old": F.count_if(is_old).over(w), "n_new": F.count_if(is_new).over(w),
        "other": F.max(F.when(F.col("lo") == 1, F.col("desc"))).over(w),
    })
    changed = (F.col("n_old") == 1) & (F.col("n_new") == 1)
    one_sided = keys.where("lo = hi")
    kind = F.when(changed & (F.col("lo") == 0), "descChanged").when(changed, None).when(F.col("lo") == 0, "removed").otherwise("added")
    out = one_sided.withColumn("list", kind).where("list is not null")
    return out.select("list", "owner", "name", "desc", F.when(F.col("list") == "descChanged", F.col("other")).alias("new_desc"))


def summary(delta: DataFrame, lists: Sequence[str]) -> DataFrame:
    """Rows (list, n) for every list, zeros included."""
    spark = delta.sparkSession
    names = spark.createDataFrame([(x,) for x in lists], "list string")
    return names.join(delta.groupBy("list").agg(F.count("*").alias("n")), "list", "left").select("list", F.coalesce("n", F.lit(0)).alias("n"))


def capped(delta: DataFrame, order: Sequence[str], cap: int) -> DataFrame:
    """The first ``cap`` rows of each list with the list's true total and whether it was cut."""
    w = Window.partitionBy("list").orderBy(*order)
    totals = delta.groupBy("list").agg(F.count("*").alias("total"))
    top = delta.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= cap)
    out = top.join(F.broadcast(totals), "list")  # a row per list
    return out.withColumn("returned", F.least("total", F.lit(cap))).withColumn("truncated", F.col("total") > cap)


def churn(keys: DataFrame, group: str, n: int) -> DataFrame:
    """The groups with the most rows, ties by name."""
    return keys.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(n)


def desc_frequency(old: DataFrame, new: DataFrame, desc: str = "desc") -> DataFrame:
    """Rows (desc, n_old, n_both): how often a descriptor occurs among the members of the old side, and of both."""
    both = old.select(F.col(desc).alias("desc"), F.lit(1).alias("_o")).unionByName(new.select(F.col(desc).alias("desc"), F.lit(0).alias("_o")))
    return both.groupBy("desc").agg(F.sum("_o").alias("n_old"), F.count("*").alias("n_both"))
