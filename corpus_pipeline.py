"""The corpus pipeline: five stages over ``documents``, each the next one's input.

Quality rules drop documents, the Jaccard join keeps one document of each group, substring
dedup cuts repeated passages out of the texts, decontamination drops documents with test
items, and byte-level BPE encodes what is left.  All but the last return the columns of
``documents``; further columns go along, whatever their names.  SQL cannot express the trees of
the first stage, so there is no ORACLE_SQL; the stages are tested against brute force.

Null and empty texts fail the quality rules.  Rows are judged, not ids: of rows that are alike in id
and text one stays, and a row that shares an id with a copy but has another text is kept.  A null
id is the largest.  A text that loses words in substring dedup is what is left, its words joined by
one space, and its n_chars follows; other texts stay as they are.  An empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontaminate, jaccard_join, quality
from tracewell.llm.queries import PATTERN, ranks, table
from tracewell.llm.scratch import materialise, small_batches
from tracewell.llm.substring_dedup import cut_repeats

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep."""
    small_batches(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return jaccard_join.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows that an earlier document has; untouched texts stay as they are."""
    return cut_repeats(docs, length_col="n_chars")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, lossless): the ids of each text, and whether they decode to it."""
    both = bpe.round_trip(docs.select("doc_id", "text"), ranks(), PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("lossless"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE encoding and decoding", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
