"""Multi-hop name resolution with a reason and an audit trail."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running


@dataclass(frozen=True)
class Hop:
    """One mapping relation: ``key`` is looked up, ``value`` continues the chain."""

    name: str
    table: DataFrame
    key: str
    value: str
    miss: str


def unique_on(table: DataFrame, key: str, order: str, keep: str = "last") -> DataFrame:
    """One row per key: the last (a map that is overwritten) or first (a search) by ``order``.

    An aggregation with map-side combine, so a frequent key costs a task one row.
    """
    pick = F.max_by if keep == "last" else F.min_by
    return table.groupBy(key).agg(pick(F.struct(*table.columns), order).alias("_r")).select("_r.*")


def hop_chain(df: DataFrame, start: str, hops: Sequence[Hop]) -> DataFrame:
    """``df`` with ``resolved``, ``reason`` and ``chain``.

    Every hop is a left join, so no row is lost.  The first hop without a match sets the
    reason; later hops add nothing.  A null start is a miss of the first hop.  Build sides
    must be unique on their key (see unique_on); Spark broadcasts the small ones by size.
    """
    now, reason, lines = F.col(start), F.lit(None).cast("string"), []
    for i, hop in enumerate(hops):
        side = hop.table.select(F.col(hop.key).alias(f"_k{i}"), F.col(hop.value).alias(f"_v{i}"), F.lit(True).alias(f"_m{i}"))
        probe = f"_p{i}"
        df = df.withColumn(probe, now).join(side, F.col(probe) == F.col(f"_k{i}"), "left")
        found = F.col(f"_m{i}").isNotNull()
        reason = F.coalesce(reason, F.when(~found, F.lit(hop.miss)))
        lines.append(F.when(found, F.concat(F.lit(f"{hop.name}:"), F.col(f"_v{i}").cast("string"))))
        now = F.col(f"_v{i}")
    out = df.withColumn("reason", reason).withColumn("chain", F.array_join(F.array(*lines), " > ")).withColumn("resolved", now)
    return out.drop(*[f"{c}{i}" for c in ("_k", "_v", "_m", "_p") for i in range(len(hops))])


def verdict(reason: Column, grounded: Column | None = None) -> Column:
    """EXACT without a reason and with the target in place, else UNRESOLVED."""
    ok = reason.isNull() if grounded is None else reason.isNull() & grounded
    return F.when(ok, "EXACT").otherwise("UNRESOLVED")


def carry_forward(df: DataFrame, partition: str, order: str, column: str, when: Column, name: str, hot: int | None = None) -> DataFrame:
    """The last value of ``column`` where ``when`` held, up to and including each row.

    Nulls are passed over.  A partition with more than ``hot`` rows is split (see running).
    """
    return running(df, partition, [F.col(order)], {name: ("last", F.when(when, F.col(column)))}, hot=hot)
