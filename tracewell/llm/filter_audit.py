"""Filter interaction audit: which filter removes what, in every order, from packed bitmaps (11).

Each partition packs its rows into bitmaps: one for each filter (a set bit fails it), one for
each label, one for each part.  Rows are sorted by part first, so the bitmap of a part is ones in one
run of bytes and is kept as that run; a partition's index is a row for each of its parts, with the
runs of all bitmaps.

An order of filters needs no more than the sets it goes through: what filter f removes after the
filters S depends on S as a set.  So for every S and f outside it, AND-NOT and a popcount give the
rows that f removes, those it would remove again, and the labelled among them, and counts are summed
over partitions.  Orders, their steps and Shapley values are looked up in these sums.

Scale: one pass over the texts makes a short row each; equal texts are found by digest with map-side
combine, and only digests that occur twice are joined back, so a text that a third of all rows share
is one entry that Spark's skew join splits around.  The sums have filters x 2^filters rows for each
part and task.

Null texts are empty, a null part is the empty string, a null label counts for nothing, several label rows of an id
count as one with any of their ones.  A null doc_id is the largest and has no label; rows that
share an id and a text are none of them smaller.  An empty table gives no parts and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block import Block, flat, give_back, slices
from .scratch import materialise

#: Bytes of text in a block, rows in a bitmap.
BLOCK, BITMAP_ROWS = 2 << 20, 1 << 18
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"#$%&*|")] = True


def text_failures(texts: pa.Array) -> dict[str, np.ndarray]:
    """Failing rows by filter: A few words, B repetitive, C upper case, D signs."""
    block = Block(texts)
    _, offsets = flat(texts)
    per_doc = lambda hits: np.add.reduceat(np.append(hits, 0), offsets[:-1]) * (np.diff(offsets) > 0)
    words = np.diff(block.first)
    pairs = np.stack((block.doc.astype(np.uint64), block.hashes()))
    order = np.lexsort(pairs[::-1])
    doc, value = pairs[:, order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    distinct = np.bincount(doc[new].astype(np.int64), minlength=block.n_docs)
    points = per_doc(((block.data & 0xC0) != 0x80).astype(np.int64))
    upper = per_doc(_UPPER[block.data].astype(np.int64))
    return {"A": words < 200, "B": 100 * distinct < 50 * words, "C": 100 * upper > 3 * points, "D": per_doc(_SIGNS[block.data].astype(np.int64)) > 0}


def _facts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", BLOCK):
        fails = text_failures(batch.column("text"))
        data, offsets = flat(batch.column("text"))
        raw = memoryview(data)
        digest = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "part": batch.column("part"), "digest": pa.array(digest, pa.binary()), **{k: pa.array(v) for k, v in fails.items()}})


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, A, B, C, D, E, good, toxic) of documents (doc_id, text, lang); E is a copy of a smaller doc_id's text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    facts = materialise(rows.mapInArrow(_facts, "doc_id long, part string, digest binary, A boolean, B boolean, C boolean, D boolean"), "filter-facts")
    least = facts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null")
    twice = materialise(least.select("digest", "least"), "repeated-texts")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    copy = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    out = facts.join(twice, "digest", "left").join(marks, "doc_id", "left")
    return out.select("part", "A", "B", "C", "D", copy.alias("E"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def bitmap_index(rows: DataFrame, filters: Sequence[str], labels: Sequence[str], part: str = "part") -> DataFrame:
    """Rows (part, n, one binary for each filter and label): the bitmaps of the rows that a partition has of a part.

    ``rows`` has a boolean column for each filter (true fails it) and each label.
    """
    names = [*filters, *labels]

    def pack(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        codes = table.column("part").combine_chunks().dictionary_encode()
        at = np.asarray(codes.indices)
        order = np.argsort(at, kind="stable")
        counts = np.bincount(at, minlength=len(codes.dictionary))
        ends = np.cumsum(counts)
        out = {"part": codes.dictionary, "n": pa.array(counts, pa.int64())}
        for name in names:
            bits = np.asarray(table.column(name).combine_chunks().to_numpy(zero_copy_only=False), bool)[order]
            out[name] = pa.array([np.packbits(bits[e - c : e]).tobytes() for c, e in zip(counts, ends)], pa.binary())
        return pa.record_batch(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BITMAP_ROWS:
                yield pack(held)
                held, size = [], 0
        if size:
            yield pack(held)
        give_back()

    flags = [F.coalesce(F.col(n).cast("boolean"), F.lit(False)).alias(n) for n in names]
    rows = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *flags)
    return rows.mapInArrow(run, "part string, n long, " + ", ".join(f"`{n}` binary" for n in names))


def _subset_counts(filters: Sequence[str], labels: Sequence[str]):
    """For each part, prefix set and further filter: the counts of a task's bitmaps."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(filters)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("n")[i].as_py()
                bits = {name: np.frombuffer(batch.column(name)[i].as_buffer(), np.uint8) for name in (*filters, *labels)}
                here = np.packbits(np.ones(n, bool))
                fails = [bits[f] for f in filters]
                seen = [np.zeros_like(here)]  # what the filters of a set fail together, by the set's bits
                for s in range(1, 1 << k):
                    low = (s & -s).bit_length() - 1
                    seen.append(seen[s & (s - 1)] | fails[low])
                count = lambda x: int(np.bitwise_count(x).sum())
                part = batch.column("part")[i].as_py()
                total = sums.setdefault(part, np.zeros((1 << k, k, 4 + len(labels)), np.int64))
                for s in range(1 << k):
                    for f in range(k):
                        if s >> f & 1:
                            continue
                        removed = fails[f] & ~seen[s]
                        others = seen[((1 << k) - 1) ^ (1 << f)]
                        total[s, f] += [count(here & ~(seen[s] | fails[f])), count(removed), count(fails[f] & seen[s]), count(fails[f] & ~others), *(count(removed & bits[name]) for name in labels)]
        names = ["kept", "removed", "redundant", "unique_fails", *(f"{name}_lost" for name in labels)]
        pairs = [(s, f) for s in range(1 << k) for f in range(k) if not s >> f & 1]
        for part, total in sums.items():
            rows = np.array([total[s, f] for s, f in pairs])
            yield pa.record_batch({"part": pa.array([part] * len(pairs)), "before": pa.array([s for s, _ in pairs], pa.int32()), "filter": pa.array([f for _, f in pairs], pa.int32()), **{c: pa.array(rows[:, j]) for j, c in enumerate(names)}})

    return run


def subset_counts(index: DataFrame, filters: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Rows (part, before, filter, kept, removed, redundant, unique_fails, <label>_lost ..), summed over partitions.

    ``before`` is the set of filters applied earlier, a bit for each position in ``filters``, and
    ``filter`` the position of the one applied next.
    """
    counts = ["kept", "removed", "redundant", "unique_fails", *(f"{name}_lost" for name in labels)]
    schema = "part string, before int, filter int, " + ", ".join(f"`{c}` long" for c in counts)
    rows = index.mapInArrow(_subset_counts(filters, labels), schema)
    return rows.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in counts])


def audit(index: DataFrame, filters: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Rows (part, filter_order, step, counts .., shapley) of a bitmap index: every order of the filters, every step.

    shapley: what the step's filter removes, added up over all orders.  There are ``len(filters)!`` orders,
    so at most eight filters are taken.
    """
    k = len(filters)
    if not 0 < k <= 8:
        raise ValueError("one to eight filters")
    spark = index.sparkSession
    sums = materialise(subset_counts(index, filters, labels), "subset-counts")
    weights = [(sum(1 << j for j in c), factorial(len(c)) * factorial(k - 1 - len(c))) for r in range(k) for c in combinations(range(k), r)]
    weight = F.broadcast(spark.createDataFrame(weights, "before int, weight long"))  # 2^k rows
    shapley = sums.join(weight, "before").groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("weight")).alias("shapley"))
    steps = [("".join(filters[j] for j in p), i + 1, sum(1 << j for j in p[:i]), p[i]) for p in permutations(range(k)) for i in range(k)]
    order = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, before int, filter int"))  # k! k rows
    out = sums.join(shapley, ["part", "filter"]).join(order, ["before", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{n}_lost" for n in labels], "shapley")
