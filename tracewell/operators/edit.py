"""Edit-distance join by segment signatures (T16, X-s7).

A name of length n is cut into ``most + 1`` segments.  Within ``most`` edits one segment of it stands unchanged in
the other name, at most ``most`` places from its own (pigeonhole), so names meet on the length, the number and
the text of a segment and only those that meet are compared.  Names are distinct before they meet; nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _segments(n: str, parts: int) -> str:
    """SQL for an array of (i, start, size) that cuts a length evenly, later segments the longer ones."""
    size = f"(({n} div {parts}) + if(i >= {parts} - {n} % {parts}, 1, 0))"
    start = f"(i * ({n} div {parts}) + greatest(0, i - ({parts} - {n} % {parts})))"
    return f"transform(sequence(0, {parts - 1}), i -> named_struct('i', i, 'start', cast({start} as int), 'size', cast({size} as int)))"


def edit_pairs(left: DataFrame, right: DataFrame, name: str = "name", most: int = 2) -> DataFrame:
    """Rows (l, r, dist): the distinct names of both sides that are at most ``most`` edits apart.

    Null names are in no pair.
    """
    a, b = (df.select(F.col(name).alias("x")).where("x is not null").distinct().withColumn("n", F.length("x")) for df in (left, right))
    parts = most + 1
    cut = b.select(F.col("x").alias("r"), "n", F.explode(F.expr(_segments("n", parts))).alias("s")).select("r", "n", "s.i", F.expr("substring(r, s.start + 1, s.size)").alias("seg"))
    # every place where a segment of a name of length m may stand
    asked = a.withColumn("m", F.explode(F.expr(f"sequence(greatest(0, n - {most}), n + {most})")))
    asked = asked.select(F.col("x").alias("l"), F.col("n").alias("ln"), "m", F.explode(F.expr(_segments("m", parts))).alias("s"))
    places = F.expr(f"filter(sequence(greatest(0, s.start - {most}), greatest(0, s.start - {most}, s.start + {most})), p -> p + s.size <= ln)")
    asked = asked.select("l", F.col("m").alias("n"), "s.i", F.explode(F.array_distinct(F.transform(places, lambda p: F.col("l").substr(p + 1, F.col("s.size"))))).alias("seg"))
    met = asked.join(cut, ["n", "i", "seg"]).select("l", "r").distinct()
    dist = F.levenshtein("l", "r")
    return met.withColumn("dist", dist).where(F.col("dist") <= most)


def suggestions(asked: DataFrame, known: DataFrame, name: str = "name", most: int = 2) -> DataFrame:
    """Rows (l, suggestion, dist): for each name asked for the nearest known one, ties by name.

    There is none beyond ``most`` edits, nor where the nearest is no longer than its distance, as that is
    coincidence.
    """
    best = edit_pairs(asked, known, name, most).groupBy("l").agg(F.min(F.struct("dist", "r")).alias("b"))
    return best.where(F.col("b.dist") < F.length("b.r")).select("l", F.col("b.r").alias("suggestion"), F.col("b.dist").alias("dist"))
