"""Running values along an order, and as-of joins, with keys of any size.

A key with few rows is one window.  A key with more than ``HOT`` rows is dealt by ranges of the order to
many tasks: each adds up its own range, the few totals of the ranges before it are added to that, and so
no task has all rows of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

#: Rows of a key that one task may have.
HOT = 1 << 20


def _over(kind: str, value: Column, w) -> Column:
    return {"max": lambda: F.max(value), "sum": lambda: F.sum(value), "last": lambda: F.last(value, ignorenulls=True)}[kind]().over(w)


def _both(kind: str, before: Column, here: Column) -> Column:
    if kind == "max":
        return F.greatest(before, here)
    return F.coalesce(before + here, before, here) if kind == "sum" else F.coalesce(here, before)


def running(df: DataFrame, by: str, order: Sequence[Column], values: dict[str, tuple[str, Column]], inclusive: bool = True, hot: int | None = None) -> DataFrame:
    """``df`` with, for each name of ``values``, the max, sum or last non-null value of the rows of its key up to it.

    ``values`` has (kind, column); ``inclusive`` counts the row itself.  The order must be total where the
    result depends on it.  Null keys are one key.
    """
    hot = HOT if hot is None else hot
    end = 0 if inclusive else -1
    plain = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    with_plain = lambda rows: rows.withColumns({n: _over(k, v, plain) for n, (k, v) in values.items()})
    large = df.groupBy(F.col(by).alias("_k")).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select("_k")
    if large.isEmpty():
        return with_plain(df)
    large = stored(large)
    same = F.col(by).eqNullSafe(F.col("_k"))
    # a file of the range is a part of the key; written, so that its number stays what it is
    parts = df.join(large, same, "left_semi").repartitionByRange(F.col(by), *order).withColumn("_part", F.spark_partition_id())
    parts = stored(parts.withColumns({f"_v_{n}": v for n, (_, v) in values.items()}))
    inner = Window.partitionBy(by, "_part").orderBy(*order)
    local = parts.withColumns({f"_l_{n}": _over(k, F.col(f"_v_{n}"), inner.rowsBetween(Window.unboundedPreceding, end)) for n, (k, _) in values.items()})
    numbered = parts.withColumn("_at", F.row_number().over(inner)) if any(k == "last" for k, _ in values.values()) else parts
    total = {"max": lambda n: F.max(f"_v_{n}"), "sum": lambda n: F.sum(f"_v_{n}"), "last": lambda n: F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("_at")))}
    totals = numbered.groupBy(F.col(by).alias("_k"), F.col("_part").alias("_p")).agg(*[total[k](n).alias(f"_t_{n}") for n, (k, _) in values.items()])
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    totals = totals.select("_k", "_p", *[_over(k, F.col(f"_t_{n}"), before).alias(f"_b_{n}") for n, (k, _) in values.items()])
    met = local.join(totals, same & (F.col("_part") == F.col("_p")), "left")
    split = met.select(*df.columns, *[_both(k, F.col(f"_b_{n}"), F.col(f"_l_{n}")).alias(n) for n, (k, _) in values.items()])
    return with_plain(df.join(large, same, "left_anti")).unionByName(split)


def asof(points: DataFrame, steps: DataFrame, by: str, at: str, start: str, value: str, hot: int | None = None) -> DataFrame:
    """``points(by, at, ..)`` with ``value`` of the last of ``steps(by, start, value)`` not beyond them, or null.

    Both go through one order, steps first where they meet, in one pass; of steps that start at one place the
    greatest value counts.  Points without a place or key have none.
    """
    s = steps.select(F.col(by).alias("_g"), F.col(start).alias("_t"), F.lit(0).alias("_o"), F.col(value).alias("_s"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns])
    p = points.select(F.col(by).alias("_g"), F.col(at).alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast(steps.schema[value].dataType).alias("_s"), *points.columns)
    rows = s.where("_g is not null and _t is not null").unionByName(p)
    order = [F.col("_t").asc_nulls_first(), F.col("_o"), F.col("_s")]
    out = running(rows, "_g", order, {"_r": ("last", F.col("_s"))}, hot=hot).where("_o = 1")
    known = F.col("_g").isNotNull() & F.col("_t").isNotNull()
    return out.select(*points.columns, F.when(known, F.col("_r")).alias(value))


def line_starts(texts: DataFrame, key: str, text: str, hot: int | None = None) -> DataFrame:
    """Rows (key, line, start): where each line of a text begins, in characters from 0; lines are counted from 1."""
    lines = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "_line")).select(key, "pos", (F.length("_line") + 1).cast("long").alias("_n"))
    out = running(lines, key, [F.col("pos")], {"start": ("sum", F.col("_n"))}, inclusive=False, hot=hot)
    return out.select(key, (F.col("pos") + 1).cast("long").alias("line"), F.coalesce("start", F.lit(0).cast("long")).alias("start"))
