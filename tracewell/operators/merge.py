"""Reports that can be merged in any order (A6, A7), and their Markdown (K3).

Every part of a merged report is one keyed aggregate with map-side combine: findings by id, of which the earliest
report's counts, edits by rule, items for review and files as sets, totals that must agree.  How reports are dealt
to tasks, or merged in steps, makes no difference.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .report import VERDICTS
from .running import running

#: What must be equal for reports to be of one kind.
SAME = ("from_version", "to_version", "namespace")


@dataclass(frozen=True)
class Reports:
    """meta(report, rank, version, from_version, to_version, namespace, generated_for), the other tables by report.

    findings(report, id, ..), edits(report, level, rule, file), manual(report, file, line, reason), totals(report,
    list, n).  rank gives the order of reports and is unique.
    """

    meta: DataFrame
    findings: DataFrame
    edits: DataFrame
    manual: DataFrame
    totals: DataFrame


@dataclass(frozen=True)
class Merged:
    """meta: one row; findings: one row for each id, with ``reports`` that have it and whether they ``agree``;
    rules(rule, exact, review); files(file); manual(file, line, reason); totals(list, n); errors(what, key, error)."""

    meta: DataFrame
    findings: DataFrame
    rules: DataFrame
    files: DataFrame
    manual: DataFrame
    totals: DataFrame
    errors: DataFrame


def merge_reports(r: Reports) -> Merged:
    """One report of many (A7), with what does not fit as error rows.

    The report of the least rank says which versions and namespace are meant; another that differs is an error and
    takes no part.  A finding that several reports have is that of the least rank.  A total that differs
    between reports is an error and is null.  Without reports all tables are empty.
    """
    first = r.meta.agg(F.min(F.struct("rank", *SAME)).alias("f")).select(*[F.col(f"f.{c}").alias(f"_{c}") for c in SAME])
    judged = r.meta.crossJoin(F.broadcast(first)).withColumn("fits", F.expr(" and ".join(f"{c} <=> _{c}" for c in SAME)))  # one row
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("?")) for p in parts])
    name = lambda p: text(F.col(f"{p}from_version"), " > ", F.col(f"{p}to_version"), " (", F.col(f"{p}namespace"), ")")
    refused = judged.where(~F.col("fits")).select(F.lit("meta").alias("what"), F.col("report").cast("string").alias("key"), text(name(""), " instead of ", name("_")).alias("error"))
    use = judged.where("fits").select("report", "rank")
    own = lambda df: df.join(use, "report")
    meta = r.meta.join(use.select("report"), "report", "left_semi").agg(
        F.min_by("version", "rank").alias("version"), *[F.min(c).alias(c) for c in SAME], F.array_join(F.array_sort(F.collect_set("generated_for")), " + ").alias("generated_for"), F.count("*").alias("reports")
    ).where("reports > 0")
    content = [c for c in r.findings.columns if c not in ("report", "id")]
    body = F.struct(*content)
    findings = own(r.findings).groupBy("id").agg(F.min_by(body, "rank").alias("_f"), F.array_sort(F.collect_set("report")).alias("reports"), (F.min(F.xxhash64(body)) == F.max(F.xxhash64(body))).alias("agree"))
    findings = findings.select("id", *[F.col(f"_f.{c}").alias(c) for c in content], "reports", "agree")
    edits, manual = own(r.edits), own(r.manual).select("file", "line", "reason").distinct()
    exact = F.col("level") == "EXACT"
    rules = edits.groupBy("rule").agg(F.count_if(exact).alias("exact"), F.count_if(~exact).alias("review"))
    files = edits.select("file").unionByName(manual.select("file")).distinct()
    both = own(r.totals).groupBy("list").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    differs = both.where("lo <> hi").select(F.lit("totals").alias("what"), F.col("list").alias("key"), text(F.col("lo"), " and ", F.col("hi")).alias("error"))
    totals = both.select("list", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("n"))
    return Merged(meta, findings, rules, files, manual, totals, refused.unionByName(differs))


def _numbered(rows: DataFrame, order: list[Column], hot: int | None) -> DataFrame:
    """Rows (section, pos, line) with the place in the section; a long section is numbered by many tasks."""
    return running(rows, "section", order, {"pos": ("sum", F.lit(1).cast("long"))}, hot=hot).select("section", "pos", "line")


def report_markdown(findings: DataFrame, hot: int | None = None) -> DataFrame:
    """Rows (section, pos, line) of a report on ``findings(id, verdict, kind, file, line, symbol, target, reason)`` (K3).

    summary: verdicts by kind, all kinds there; candidates: one row for each symbol and target with its first
    ten places and how many more there are; exact and unresolved: one row for each finding, by file, line, symbol and
    id, those without a file first.  Bars and line ends in texts are escaped.
    """
    from ..functions.grammar import md_code, md_text
    from .report import decisions

    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    n = lambda k: F.count_if(F.col("kind") == k)
    kinds = ("class", "method", "field")
    found = findings.groupBy("verdict").agg(*[n(k).alias(k) for k in kinds], F.count("*").alias("total"))
    names = findings.sparkSession.createDataFrame([(i, v) for i, v in enumerate(VERDICTS)], "_o int, verdict string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    summary = names.join(found, "verdict", "left").select(F.lit("summary").alias("section"), (F.col("_o") + 1).cast("long").alias("pos"), text("| ", F.col("verdict"), *[x for k in (*kinds, "total") for x in (" | ", zero(k))], " |").alias("line"))
    where = F.when(F.col("file").isNull(), "(no source location)").otherwise(F.concat_ws(":", "file", F.col("line").cast("string")))
    candidates = decisions(findings.where("verdict = 'CANDIDATE'").withColumn("_w", where), ["symbol", "target"], "_w").withColumns({"section": F.lit("candidates"), "line": text("| ", md_code(F.col("symbol")), " | ", md_code(F.coalesce("target", F.lit("none"))), " | ", md_text(F.col("sites")), " |")})
    candidates = _numbered(candidates, [F.col("first"), F.col("symbol"), F.col("target")], hot)
    rows = findings.where("verdict <> 'CANDIDATE'")
    rows = rows.select(F.lower("verdict").alias("section"), F.coalesce("file", F.lit("")).alias("_f"), F.coalesce("line", F.lit(0)).alias("_l"), "symbol", "id", text("| ", md_text(where), " | ", md_code(F.col("symbol")), " | ", md_text(F.coalesce("target", "reason", F.lit(""))), " |").alias("line"))
    return summary.unionByName(candidates).unionByName(_numbered(rows, [F.col("_f"), F.col("_l"), F.col("symbol"), F.col("id")], hot))
