"""Interval logic (J32-J38, W6) and splicing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running


def overlap_flags(df: DataFrame, by: str, start: str, end: str, tie: str, hot: int | None = None) -> DataFrame:
    """Adds ``overlaps``: whether a half-open span overlaps an earlier or later one of its group.

    The maximum of the ends before it tells the later span; the next start tells the earlier one.  Two sorts and no
    self join, and a group with more than ``hot`` rows is split (see running).
    """
    order = [F.col(start), F.col(end), F.col(tie)]
    back = [F.desc(start), F.desc(end), F.desc(tie)]
    out = running(df, by, order, {"_before": ("max", F.col(end))}, inclusive=False, hot=hot)
    out = running(out, by, back, {"_after": ("last", F.col(start))}, inclusive=False, hot=hot)
    return out.withColumn("overlaps", F.coalesce(F.col(start) < F.col("_before"), F.lit(False)) | F.coalesce(F.col("_after") < F.col(end), F.lit(False))).drop("_before", "_after")


def uncovered(points: DataFrame, spans: DataFrame, by: str, at: str, start: str, end: str, hot: int | None = None) -> DataFrame:
    """Points that lie in no half-open span of their group.

    Points and spans are put in one order; the running maximum of the ends of spans that began
    at or before a point says whether one still holds it.  One shuffle, no range join, and a group with more
    than ``hot`` rows is split (see running).
    """
    a = spans.select(F.col(by).alias("_g"), F.col(start).alias("_t"), F.lit(0).alias("_o"), F.col(end).alias("_e"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns])
    b = points.select(F.col(by).alias("_g"), F.col(at).alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast(spans.schema[end].dataType).alias("_e"), *points.columns)
    out = running(a.unionByName(b), "_g", [F.col("_t"), F.col("_o")], {"_r": ("max", F.col("_e"))}, hot=hot).where("_o = 1")
    return out.where(F.col("_r").isNull() | (F.col("_r") <= F.col("_t"))).select(*points.columns)


def splice(text: Column, ops: Column) -> Column:
    """``text`` with ops array<struct<start, end, after>> applied, offsets from 0, last first."""
    last_first = F.reverse(F.array_sort(ops))
    return F.aggregate(last_first, text, lambda t, o: F.concat(F.substr(t, F.lit(1), o["start"]), o["after"], F.substr(t, o["end"] + 1)))


def token_positions(tokens: DataFrame, by: str, order: list[str], at: str, gap, step: Column, hot: int | None = None) -> DataFrame:
    """``tokens`` with ``begins`` and ``depth``.

    begins: whether ``gap(place, place of the token before)`` holds; depth: the running sum of
    ``step``, the token's own included.  A group with more than ``hot`` tokens is split (see running).
    """
    along = [F.col(c) for c in order]
    out = running(tokens, by, along, {"_last": ("last", F.struct(F.col(at).alias("at")))}, inclusive=False, hot=hot)
    out = running(out, by, along, {"depth": ("sum", step)}, hot=hot)
    return out.withColumn("begins", gap(F.col(at), F.col("_last.at"))).drop("_last")
