"""Token counts from an exact histogram of encoded lengths.

Documents are encoded and aggregated by length alone; everything else follows from the
histogram by suffix sums, for every context limit at once: documents and tokens at or beyond
a limit, tokens that remain when each document is cut at the limit, and the length at any
quantile.

Scale.  The aggregation combines map-side, so a task sends a row per distinct length.  Suffix
sums are taken in two levels, inside ranges of ``SPAN`` lengths and over the totals of those
ranges, so no single task has the whole histogram.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .block import extended, slices
from .bpe import encoding
from .scratch import materialise

SPAN = 1024


def _lengths(column: str, path: str, pattern: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in slices(batches, column, 2 << 20):
            out = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(column).to_pylist()]
            yield batch.drop_columns([column]).append_column("n_tokens", pa.array(out, pa.int64()))

    return run


def token_lengths(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` in place of the text; a null text has none."""
    docs = docs.drop("n_tokens")
    schema = extended(docs.drop(text_col).schema, n_tokens="long")
    return docs.mapInArrow(_lengths(text_col, path, pattern), schema)


def histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """Rows (n_tokens, n_docs): how many documents have each length.  Null lengths are left out."""
    return lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """A histogram with, at each length L that occurs, what a context limit of L gives.

    docs_at_least, tokens_at_least: documents of L tokens or more, and their tokens.
    truncated_tokens: the sum over all documents of min(length, L).
    docs_at_most: documents of at most L tokens; with the total it gives every quantile.
    An empty histogram gives no rows.
    """
    hist = materialise(hist, "lengths")  # read twice below; a row per distinct length
    hist = hist.withColumn("span", F.floor(F.col("n_tokens") / SPAN)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    spans = hist.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(F.lit(0))
    spans = spans.select(
        "span",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(total).alias("total_docs"),
        F.sum("t").over(total).alias("total_tokens"),
    )
    inside = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(spans, "span").withColumns({
        "docs_at_least": F.col("docs_above") + F.sum("n_docs").over(inside),
        "tokens_at_least": F.col("tokens_above") + F.sum("tokens").over(inside),
    })
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        "total_docs",
        "total_tokens",
    )


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """One row for a context limit, whether or not a document has that length."""
    reach = sums.where(F.col("n_tokens") >= limit)
    nearest = reach.agg(F.min_by("docs_at_least", "n_tokens").alias("d"), F.min_by("tokens_at_least", "n_tokens").alias("t"))
    whole = sums.agg(F.max("total_docs").alias("n"), F.max("total_tokens").alias("s"))
    zero = F.lit(0).cast("long")
    d, t, n, s = (F.coalesce(F.col(c), zero) for c in ("d", "t", "n", "s"))
    return nearest.crossJoin(whole).select(
        F.lit(limit).cast("long").alias("context_limit"), d.alias("docs_at_least"), t.alias("tokens_at_least"), (s - t + limit * d).alias("truncated_tokens"), n.alias("total_docs")
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row with the smallest length that at least the share ``q`` of documents does not exceed."""
    share = F.lit(Decimal(str(q))) * F.col("total_docs").cast("decimal(20,0)")  # exact, where doubles round
    return sums.where(F.col("docs_at_most") >= F.ceil(share)).agg(F.min("n_tokens").alias("n_tokens"))
