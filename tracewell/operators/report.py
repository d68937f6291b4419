"""Reporting aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERDICTS = ("EXACT", "CANDIDATE", "UNRESOLVED")


def verdict_summary(findings: DataFrame, kind: str, verdict: str = "verdict") -> DataFrame:
    """Counts of verdicts for each kind and for all, in one pass over both grouping sets."""
    counts = [F.count_if(F.col(verdict) == v).alias(v.lower()) for v in VERDICTS]
    out = findings.rollup(kind).agg(F.grouping(kind).alias("_g"), F.count("*").alias("total"), *counts)
    return out.select(F.when(F.col("_g") == 1, "(all)").otherwise(F.col(kind)).alias(kind), "total", *[v.lower() for v in VERDICTS])


def decisions(df: DataFrame, by: Sequence[str], item: str, shown: int = 10) -> DataFrame:
    """Groups with their true count and their first items as text, ``(+k more)`` at the end.

    The first items are found by rank inside the group, which Spark keeps bounded with a
    group limit; no group is collected whole.
    """
    top = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(item))).where(F.col("_r") <= shown)
    listed = top.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.cast("string")), ", ").alias("_s"))
    counts = df.groupBy(*by).agg(F.count("*").alias("n"), F.min(item).alias("first"))
    more = F.when(F.col("n") > shown, F.concat(F.lit(" (+"), (F.col("n") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    # a null is a value of a group like any other
    listed = listed.withColumnsRenamed({c: f"_{k}" for k, c in enumerate(by)})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(by)])
    return counts.join(listed, same).select(*by, "n", "first", F.concat("_s", more).alias("sites"))


def annotate(findings: DataFrame, fixes: DataFrame, reasons: DataFrame, key: str, exact: Column) -> DataFrame:
    """Findings with the fix, else, where the verdict is exact, the reason of not being fixed."""
    out = findings.join(fixes.select(key, "fix"), key, "left").join(reasons.select(key, "reason"), key, "left")
    return out.withColumn("withheld", F.when(F.col("fix").isNull() & exact, F.col("reason"))).drop("reason")


def apply_summary(findings: DataFrame, by: str) -> DataFrame:
    """Rows (by, total, applied, left_for_review) of annotated findings; the last two add up to the first."""
    return findings.groupBy(by).agg(F.count("*").alias("total"), F.count("fix").alias("applied"), F.count_if(F.col("fix").isNull()).alias("left_for_review"))


def withheld_by_file(findings: DataFrame, file: str, line: str) -> DataFrame:
    """Rows (file, items) of annotated findings that were withheld: structs (line, reason) in that order, no line as 0."""
    item = F.struct(F.coalesce(line, F.lit(0)).alias("line"), F.col("withheld").alias("reason"))
    kept = findings.where("withheld is not null")
    return kept.groupBy(F.coalesce(file, F.lit("")).alias("file")).agg(F.array_sort(F.collect_list(item)).alias("items"))


def newest(builds: DataFrame, by: str, at: str, key: str) -> DataFrame:
    """Rows (by, key, at): the latest build of each, ties by the least key."""
    best = builds.groupBy(by).agg(F.max(at).alias(at), F.max(F.struct(at, (-F.col(key)).alias("k"))).alias("x"))
    return best.select(by, (-F.col("x.k")).alias(key), at)


def plan_rules(edits: DataFrame) -> DataFrame:
    """Rows (rule, n) of the edits that are certain; rules without any are left out (A4)."""
    return edits.where("level = 'EXACT'").groupBy("rule").agg(F.count("*").alias("n"))


def first_wins(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of sources where the earlier source wins a key; an aggregation, not a window."""
    ranked = None
    for i, p in enumerate(parts):
        p = p.withColumn("source", F.lit(i))
        ranked = p if ranked is None else ranked.unionByName(p)
    columns = [c for c in ranked.columns if c != key]
    return ranked.groupBy(key).agg(F.min(F.struct("source", *[c for c in columns if c != "source"])).alias("_r")).select(key, "_r.*")


def tally(rows: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows (column, n) for each of ``values``, zeros included (A3)."""
    names = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return names.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def audit_chains(findings: DataFrame, item: str) -> DataFrame:
    """Unique (file, from, reason, chain) with how often they occur and their first finding."""
    return findings.groupBy("file", "from", "reason", "chain").agg(F.count("*").alias("n"), F.min(item).alias("first"))


def plan_summary(edits: DataFrame) -> DataFrame:
    """One row of ``edits(level, file, rule)``: exact and review edits, distinct files, distinct decisions under review."""
    exact = F.col("level") == "EXACT"
    return edits.agg(F.count_if(exact).alias("exact"), F.count_if(~exact).alias("review"), F.countDistinct("file").alias("files"), F.countDistinct(F.when(~exact, F.col("rule"))).alias("decisions"))


def in_order(rows: DataFrame, by: str, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``pos``, their place within a group."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def as_json(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``json``, an object of ``keys`` in that order without those that are null (K2)."""
    return rows.withColumn("json", F.to_json(F.struct(*keys), {"ignoreNullFields": "true"}))


def delta_markdown(delta: DataFrame, hot: int = 10, shown: int = 80, renames: DataFrame | None = None, named: int = 60, prefixes: Sequence[str] = ()) -> DataFrame:
    """Rows (section, pos, line) of a report on ``delta(list, owner, name, desc, new_desc)``.

    summary: the length of each list; churn: the packages that lost most; renames: the first of ``renames(from, to,
    score)``; changed and removed: the first descriptor changes and removed members; where a list is longer, how
    many more there are.  With ``prefixes`` only owners that begin with one count.  Lists are cut by rank, which
    Spark bounds before it sorts.
    """
    if prefixes:
        delta = delta.where(reduce(or_, [F.col("owner").startswith(p) for p in prefixes]))
    dotted = lambda c: F.translate(c, "/", ".")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    lists = tally(delta, "list", ["added", "removed", "descChanged"])
    order = Window.partitionBy(F.lit(0))
    summary = lists.withColumn("pos", F.row_number().over(order.orderBy("list"))).select(F.lit("summary").alias("section"), "pos", text("| ", F.col("list"), " | ", F.col("n"), " |").alias("line"))
    lost = delta.where("list = 'removed'").groupBy(dotted(F.regexp_extract("owner", "^(.*)/", 1)).alias("pkg")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pkg").limit(hot)
    churn = lost.withColumn("pos", F.row_number().over(order.orderBy(F.desc("n"), "pkg"))).select(F.lit("churn").alias("section"), "pos", text("- `", F.col("pkg"), "` - ", F.col("n"), " removed").alias("line"))
    changes = delta.where("list = 'descChanged'")
    first = changes.orderBy("owner", "name", "desc").limit(shown).withColumn("pos", F.row_number().over(order.orderBy("owner", "name", "desc")))
    changed = first.select(F.lit("changed").alias("section"), "pos", text("- `", dotted(F.col("owner")), "#", F.col("name"), "` was `", F.col("desc"), "` now `", F.col("new_desc"), "`").alias("line"))

    def more(rows: DataFrame, section: str, cap: int) -> DataFrame:
        return rows.agg((F.count("*") - cap).alias("k")).where("k > 0").select(F.lit(section).alias("section"), F.lit(cap + 1).alias("pos"), text("- and ", F.col("k"), " more").alias("line"))

    gone = delta.where("list = 'removed'")
    top = gone.orderBy("owner", "name", "desc").limit(shown).withColumn("pos", F.row_number().over(order.orderBy("owner", "name", "desc")))
    removed = top.select(F.lit("removed").alias("section"), "pos", text("- `", dotted(F.col("owner")), "#", F.col("name"), F.col("desc"), "`").alias("line"))
    out = summary.unionByName(churn).unionByName(changed).unionByName(more(changes, "changed", shown)).unionByName(removed).unionByName(more(gone, "removed", shown))
    if renames is not None:
        best = renames.orderBy("from", "to").limit(named).withColumn("pos", F.row_number().over(order.orderBy("from", "to")))
        lines = best.select(F.lit("renames").alias("section"), "pos", text("| `", dotted(F.col("from")), "` | `", dotted(F.col("to")), "` | ", F.col("score"), " |").alias("line"))
        out = out.unionByName(lines).unionByName(more(renames, "renames", named))
    return out
