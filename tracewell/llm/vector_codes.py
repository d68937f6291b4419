"""Vector code compression: product codes found through segment-mean lower bounds (12).

A vector's components become integers, ``floor(scale * x)``, and the vector is cut into equal
parts.  Each position of a part has a codebook of a few entries; a vector's code is the index
of the nearest entry, part by part, and codebooks come from rounds of assigning all vectors and
averaging.

The nearest entry is found by filtering.  For a split of a part into blocks let P be the projection to
block means.  Then ``|x - c|^2 = |P(x - c)|^2 + |(x - c) - P(x - c)|^2``, the first term follows from the
block sums alone, and the second is at least ``(r(x) - r(c))^2`` with r the norm of what the
means leave.  One block is tried first, then two, then four: an entry whose bound is over the
exact distance to a likely entry is out.  Bounds are lowered by far more than their rounding, so the
true nearest always survives; survivors get their exact integer distance, ties go to the lower
index.

Scale: the integer vectors are written once and scanned once a round; a task adds up its
parts and sends one row for each entry, so a round shuffles entries times tasks.  The codebooks
(``entries`` x dimension integers) are the only thing sent to tasks.  Sums over tasks are decimals.

Left out are vectors that are null, empty, or hold null or non-finite components; as no exact
64-bit distance exists for them, also those with a component beyond ``limit()``, and those whose
length is not that of the least vec_id's vector or no multiple of ``parts``.  A null vec_id is the
largest, equal ids go by their vectors, repeated rows count each.  With fewer vectors than
entries, there are as many entries as vectors; without any, no rows.  Null labels are one label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block import give_back
from .scratch import materialise

#: Vectors that are compared at a time.
ROWS = 4096
#: Relative and absolute amount by which a bound is lowered before it may rule out an entry.
SLACK, LEAST = 1e-9, 1e-3


def limit(dim: int) -> int:
    """The largest component for which the squared distance of two vectors stays below 2 ** 62."""
    return isqrt((1 << 62) // max(dim, 1)) // 2


class Bounds:
    """Block sums and residual norms of rows at one level: ``blocks`` blocks of nearly equal length."""

    def __init__(self, x: np.ndarray, blocks: int):
        width = x.shape[1]
        edges = np.arange(blocks) * width // blocks
        lengths = np.diff(np.append(edges, width))
        self.means = np.add.reduceat(x, edges, axis=1) / np.sqrt(lengths)  # a mean times the root of its length
        whole = (x.astype(np.float64) ** 2).sum(axis=1)
        self.rest = np.sqrt(np.maximum(whole - (self.means**2).sum(axis=1), 0))

    def below(self, other: Bounds, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances of the pairs (row a, row b of other)."""
        coarse = ((self.means[a] - other.means[b]) ** 2).sum(axis=-1)
        # the squares are differences of large numbers: their rounding is in proportion to the norms
        size = (self.means[a] ** 2).sum(axis=-1) + (other.means[b] ** 2).sum(axis=-1) + self.rest[a] ** 2 + other.rest[b] ** 2
        return coarse + (self.rest[a] - other.rest[b]) ** 2 - SLACK * size - LEAST


def levels(width: int) -> list[int]:
    """Numbers of blocks, coarse to fine."""
    out = [1]
    while out[-1] * 2 < width:
        out.append(out[-1] * 2)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest row of ``book`` for each row of ``x``, both int64."""
    n, entries = len(x), len(book)
    exact = lambda a, b: ((x[a] - book[b]) ** 2).sum(axis=-1)
    rows = np.arange(n)
    ladder = levels(x.shape[1])
    mine, theirs = Bounds(x, ladder[0]), Bounds(book, ladder[0])
    first = mine.below(theirs, rows[:, None], np.arange(entries)[None, :])
    guess = first.argmin(axis=1)
    most = exact(rows, guess)
    a, b = np.nonzero(first <= most[:, None])
    for blocks in ladder[1:]:
        stay = Bounds(x, blocks).below(Bounds(book, blocks), a, b) <= most[a]
        a, b = a[stay], b[stay]
    d = exact(a, b)
    order = np.lexsort((b, d, a))
    best = order[np.searchsorted(a[order], rows)]  # the guess survives its own bound, so each row has a pair
    return b[best], d[best]


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, position]`` as integers, made from components times ``scale``."""

    entries: np.ndarray
    scale: int

    @property
    def dim(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances), a column for each part, of rows of integer vectors."""
        parts, _, width = self.entries.shape
        found = [nearest(v[:, p * width : (p + 1) * width], self.entries[p]) for p in range(parts)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes (a row of indexes for each vector) stand for, as floats."""
        picked = [self.entries[p][codes[:, p]] for p in range(len(self.entries))]
        return np.concatenate(picked, axis=1) / self.scale


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, dim)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def integers(vectors: DataFrame, parts: int = 8, scale: int = 4096, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, int]:
    """(rows (vec_id, label, v) with integer vectors in shared storage, their dimension)."""
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    # an id that is null comes last; of equal ids the shorter vector decides
    first = rows.agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", F.size("v").alias("n"))).alias("f")).first()["f"]
    dim = first["n"] if first is not None else 0
    if not dim or dim % parts:
        return rows.limit(0).withColumn("v", F.col("v").cast("array<int>")), 0
    bound = limit(dim)
    fits = F.forall("v", lambda x: (x < bound / scale) & (x > -bound / scale))
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("int"))
    return materialise(rows.where((F.size("v") == dim) & fits).withColumn("v", whole), "integer-vectors"), dim


def _sums(books: Codebooks):
    """One row (part, entry, n, sums) for each used entry of a task's vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.entries.shape
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in _cut(batches):
            v = _matrix(batch.column("v"), books.dim)
            codes, _ = books.assign(v)
            for p in range(parts):
                n[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(sums[p], codes[:, p], v[:, p * width : (p + 1) * width])
        p, e = np.nonzero(n)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(sums[p, e].ravel()))
        yield pa.record_batch({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(n[p, e]), "sums": rows})
        give_back()

    return run


def train(ints: DataFrame, dim: int, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks:
    """Codebooks of integer vectors (see integers): the vectors of the least ids, then ``rounds`` of averaging.

    An entry becomes the componentwise ``floor(sum / count)`` of its parts; an unused one stays.
    """
    width = dim // parts if dim else 0
    start = ints.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect() if dim else []  # at most ``entries`` rows
    book = np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(start) else 0):
        partial = ints.select("v").mapInArrow(_sums(Codebooks(book, scale)), "part int, entry int, n long, sums array<long>")
        added = [F.sum(F.col("sums")[k].cast("decimal(19,0)")).alias(f"s{k}") for k in range(width)]
        book = book.copy()
        for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # at most parts x entries rows
            book[r["part"], r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
    return Codebooks(book, scale)


def encode(ints: DataFrame, books: Codebooks) -> DataFrame:
    """Rows (vec_id, label, codes binary, error): a byte for each part, and the squared distances added up."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            codes, d = books.assign(_matrix(batch.column("v"), books.dim))
            packed = [row.tobytes() for row in codes.astype(np.uint8)]
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "codes": pa.array(packed, pa.binary()), "error": pa.array(d.sum(axis=1), pa.int64())})
        give_back()

    if books.entries.shape[1] > 256:
        raise ValueError("a code is a byte for each part: at most 256 entries")
    kinds = {f.name: f.dataType.simpleString() for f in ints.schema}
    return ints.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes binary, error long")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, **columns: str) -> tuple[DataFrame, Codebooks]:
    """(rows (vec_id, label, codes, error, label_error), the codebooks they refer to).

    label_error adds up the errors of all vectors with a row's label.
    """
    ints, dim = integers(vectors, parts, scale, **columns)
    books = train(ints, dim, parts, entries, rounds, scale)
    rows = materialise(encode(ints, books), "vector-codes")
    totals = rows.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error"))
    return rows.join(totals, F.col("label").eqNullSafe(F.col("_l")), "left").drop("_l"), books
