"""Edits of texts: which are allowed, and all of a file's or none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spans import splice

WITHHELD = "withheld: another edit of this file is refused"


def judged(files: DataFrame, ops: DataFrame) -> DataFrame:
    """``ops`` with ``reason``, null where the edit may be made.

    ``files(file, text)``, ``ops(file, id, start, end, before, after)``; spans are half-open, in
    characters from 0.  A span out of bounds, a text that is not what ``before`` says, and spans that
    overlap are reasons of an edit itself; they come before the reason of the other edits of its
    file, none of which is made either.  An edit of an unknown file is refused.
    """
    met = ops.join(files.select("file", F.col("text").alias("_text"), F.lit(True).alias("_file")), "file", "left")
    text = F.coalesce("_text", F.lit(""))
    bad = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("end") > F.length(text))
    found = F.substr(text, F.col("start") + 1, F.col("end") - F.col("start"))
    own = F.when(F.col("_file").isNull(), "no such file").when(bad, "span out of bounds").when(~found.eqNullSafe(F.col("before")), "text differs from what the edit expects")
    order = Window.partitionBy("file").orderBy("start", "end", "id", "after")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # an earlier edit is at fault with the first later one that begins before its end
    after = F.min("start").over(order.rowsBetween(1, Window.unboundedFollowing))
    clash = F.coalesce(F.col("start") < before, F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    one = met.withColumn("_own", own).withColumn("_clash", clash).withColumn("_own", F.coalesce("_own", F.when(F.col("_clash"), "overlaps another edit")))
    refused = F.count("_own").over(Window.partitionBy("file")) > 0
    return one.select(*ops.columns, F.coalesce("_own", F.when(refused, WITHHELD)).alias("reason"))


def apply_ops(files: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with text, applied and refused, the judged edits): each file's edits are all made or none.

    The edits of a file are collected into one row, as its text is one.
    """
    verdicts = judged(files, ops)
    op = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "after")
    per = verdicts.groupBy("file").agg(F.count("reason").alias("refused"), F.count_if(F.col("reason").isNull()).alias("applied"), F.collect_list(F.when(F.col("reason").isNull(), op)).alias("_ops"))
    out = files.join(per, "file", "left").withColumn("text", F.when(F.size("_ops") > 0, splice(F.col("text"), F.col("_ops"))).otherwise(F.col("text")))
    zero = F.lit(0).cast("long")
    return out.drop("_ops").withColumn("applied", F.coalesce("applied", zero)).withColumn("refused", F.coalesce("refused", zero)), verdicts


def eligible(findings: DataFrame) -> DataFrame:
    """``findings(confidence, class_name, from_owner, from_kind, to_owner)`` with the reason not to patch, null for none.

    Only EXACT findings are patched, and only where the resolution is that of the class found.
    """
    key = lambda c: F.translate(F.col(c), ".$", "//")
    reason = (
        F.when(F.col("confidence").isNull() | (F.col("confidence") != "EXACT"), "only EXACT resolutions are patched")
        .when(F.coalesce("from_owner", F.lit("")).isin("") | ~F.col("from_kind").eqNullSafe(F.lit("class")), "the resolution is not of a class")
        .when(F.coalesce("to_owner", F.lit("")) == "", "the resolution has no target")
        .when(F.col("class_name").isNotNull() & (key("class_name") != key("from_owner")), "the resolution is of another class")
    )
    return findings.withColumn("reason", reason)
