"""Vectorised words: blocks of documents as numpy arrays.

A block holds the concatenated UTF-8 bytes of some whole documents together with the
positions and 64-bit hashes of their words, a word being a maximal run of bytes other than
space and ``\\x09-\\x0D``.  All operators on words and shingles start from it, so a task never
holds a Python object per word.  Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

U64 = np.uint64
#: Of the C library where it has it: freed arrays otherwise stay with the process.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform.startswith("linux") else None
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
np.seterr(over="ignore")  # the hashes are arithmetic modulo 2 ** 64
_LOWER[65:91] += 32
_BASE = U64(0x9E3779B97F4A7C15)
_STEP = U64(0xD1342543DE82EF95)
_STEP_INVERSE = U64(pow(int(_STEP), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random 64-bit value for each byte, zero for white space, so that it adds nothing.
_VALUE = np.where(_WS, U64(0), mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F)))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary array, nulls as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, pa.scalar("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"", texts.type))
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Block:
    """Words of some documents.

    data, offsets: bytes of the texts; starts, ends: of each word; first: index of each
    document's first word, one more entry at the end; doc: document of each word.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.offsets = flat(texts)
        if lower:
            self.data = _LOWER[self.data]
        self.n_docs, n = len(self.offsets) - 1, len(self.data)
        space = _WS[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = edge[:n].copy()
        before[1:] |= space[: max(n - 1, 0)]
        after = edge[1:].copy()
        after[: max(n - 1, 0)] |= space[1:]
        self.starts = np.flatnonzero(before & ~space)
        self.ends = np.flatnonzero(after & ~space) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.n_words = len(self.starts)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def hashes(self, chunk: int = 1 << 18) -> np.ndarray:
        """A 64-bit hash of each word's bytes, in chunks so that memory stays bounded."""
        out = np.empty(self.n_words, U64)
        a = 0
        while a < self.n_words:
            b = max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + chunk, "right")))
            lo, hi = self.starts[a], self.ends[b - 1]
            at = self.starts[a:b] - lo
            length = np.diff(np.append(at, hi - lo))
            position = np.arange(hi - lo) - np.repeat(at, length)
            value = _VALUE[self.data[lo:hi]] * powers(_BASE, int(length.max()))[position]
            out[a:b] = mix(np.add.reduceat(value, at))
            a = b
        return out

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The words, a space after each, and where each begins (one more entry at the end)."""
        length = self.ends - self.starts
        at = np.concatenate(([0], np.cumsum(length + 1)))
        out = np.full(at[-1], 32, np.uint8)
        word = np.ones(at[-1], bool)
        word[at[1:] - 1] = False
        out[word] = self.data[~_WS[self.data]]
        return out, at

    def document(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


class Rolling:
    """Hashes of word sequences from prefix sums: any range in constant time."""

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        self.sums = np.zeros(n, U64)
        np.cumsum(words * powers(_STEP, n)[: n - 1], dtype=U64, out=self.sums[1:])
        self.back = powers(_STEP_INVERSE, n)

    def of(self, start: np.ndarray, end: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
        """Hashes of the words from each start to its end, in chunks so that only the result has its length."""
        start, end = np.asarray(start), np.asarray(end)
        if start.ndim and len(start) > chunk:
            out = np.empty(len(start), U64)
            for k in range(0, len(start), chunk):
                out[k : k + chunk] = self.of(start[k : k + chunk], end[k : k + chunk])
            return out
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U64))


def shingles(block: Block, words: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle of ``size`` words, repeats included.

    A document with fewer words has one shingle, its whole sequence; one without words none.
    """
    roll = Rolling(words)
    count = np.diff(block.first)
    start = np.arange(block.n_words)
    start = start[start + size <= block.first[1:][block.doc]]
    short = np.flatnonzero((count > 0) & (count < size))
    doc = np.concatenate((block.doc[start], short))
    value = np.concatenate((roll.of(start, start + size), roll.of(block.first[short], block.first[short + 1])))
    order = np.argsort(doc, kind="stable")
    return doc[order], value[order]


def give_back() -> None:
    """Returns freed memory to the system, as this worker may now wait while others work."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of whole documents of at most ``most`` bytes of text, or one longer document.

    Small Arrow batches are put together, large ones cut.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = int(np.searchsorted(offsets, offsets[a] + most - size, "right")) - 1
            b = min(batch.num_rows, max(b, a if held else a + 1))
            if b > a:
                held.append(batch.slice(a, b - a))
                size += int(offsets[b] - offsets[a])
            if b < batch.num_rows or size >= most:
                yield together(held)
                held, size = [], 0
            a = b
    if held:
        yield together(held)
    held, batch, offsets = [], None, None
    give_back()


def together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    table = pa.Table.from_batches(batches).combine_chunks()
    return table.to_batches()[0]


def extended(schema: T.StructType, **more: T.DataType | str) -> T.StructType:
    """A copy of ``schema`` with fields added at its end."""
    return T.StructType([*schema.fields, *(T.StructField(k, T.DataType.fromDDL(v) if isinstance(v, str) else v) for k, v in more.items())])


def free_names(taken: list[str], *names: str) -> list[str]:
    """``names``, each with underscores added until no column has it, whatever its case."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out
