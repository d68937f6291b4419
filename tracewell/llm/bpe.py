"""Byte-level BPE by monoid tree reduction.

The encoding of a text is reduced over a tree: leaves are encoded as they are, and two
neighbours are joined by encoding a window around their common edge again.  The window grows
on each side until its end is a place where the tokens outside provably stay: between a word
character and a following space or line feed.  No match of the pattern has white space after
another character, so both the pattern and the merges within its matches always break there,
with whatever text beyond.  What lies outside such places is therefore the same in the
encoding of the whole, and joining is associative: (ids, text) with this operation is a
monoid.  Where a half has no such place the window is the whole half.  Decoding concatenates
the bytes of both halves up the same tree.

A text is a row, so a task works on one text at a time and Spark spreads the texts; memory is
bounded by the longest text.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .block import extended, slices

LEAF = 1 << 14
_EDGE = re.compile(r"(?<=\w)[ \n]")
_WINDOW = 64


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a file of ranks, loaded once in each worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _last_edge(text: str) -> int:
    """Start of the part of ``text`` that may change when more text follows."""
    width = _WINDOW
    while True:
        at = max(0, len(text) - width)
        # the character before the window's first counts as well
        found = [m.start() for m in _EDGE.finditer(text, at)]
        if found:
            return found[-1]
        if not at:
            return 0
        width *= 2


def _first_edge(text: str) -> int:
    """End of the part of ``text`` that may change when more text precedes."""
    width = _WINDOW
    while True:
        m = _EDGE.search(text, 1, min(len(text), width))
        if m:
            return m.start()
        if width >= len(text):
            return len(text)
        width *= 2


def join(enc: tiktoken.Encoding, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
    """The monoid's operation on (text, ids)."""
    (a, ids_a), (b, ids_b) = left, right
    if not a or not b:
        return (a + b, ids_a or ids_b)
    i, j = _last_edge(a), _first_edge(b)
    drop_a, drop_b = len(enc.encode_ordinary(a[i:])), len(enc.encode_ordinary(b[:j]))
    return a + b, ids_a[: len(ids_a) - drop_a] + enc.encode_ordinary(a[i:] + b[:j]) + ids_b[drop_b:]


def encode(enc: tiktoken.Encoding, text: str, leaf: int = LEAF) -> list[int]:
    """Ids of ``text``, by halves of at most ``leaf`` characters."""

    def tree(a: int, b: int) -> tuple[str, list[int]]:
        if b - a <= leaf:
            return text[a:b], enc.encode_ordinary(text[a:b])
        mid = (a + b) // 2
        return join(enc, tree(a, mid), tree(mid, b))

    return tree(0, len(text))[1]


def decode(enc: tiktoken.Encoding, ids: list[int], leaf: int = LEAF) -> bytes:
    """Bytes of ``ids``: halves are decoded and concatenated."""
    if len(ids) <= leaf:
        return enc.decode_bytes(ids)
    mid = len(ids) // 2
    return decode(enc, ids[:mid], leaf) + decode(enc, ids[mid:], leaf)


def _encode_all(column: str, path: str, pattern: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in slices(batches, column, 2 << 20):
            ids, counts = [], [0]
            for text in batch.column(column).to_pylist():
                ids.append(np.array(encode(enc, text or ""), np.int32))
                counts.append(counts[-1] + len(ids[-1]))
            flat = pa.array(np.concatenate(ids)) if ids else pa.array([], pa.int32())
            yield batch.append_column("ids", pa.ListArray.from_arrays(pa.array(counts, pa.int32()), flat))

    return run


def id_arrays(lists: pa.ListArray) -> Iterator[np.ndarray]:
    """The ids of one row after another, without a Python list of all; null as empty."""
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    for k in range(len(lists)):
        yield values[offsets[k] : offsets[k + 1]]


def _decode_all(column: str, path: str, pattern: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            out = [decode(enc, ids.tolist()) for ids in id_arrays(batch.column(column))]
            yield batch.append_column("decoded", pa.array(out, pa.binary()))

    return run


def _both(column: str, path: str, pattern: str):
    encode_batches, decode_batches = _encode_all(column, path, pattern), _decode_all("ids", path, pattern)
    return lambda batches: decode_batches(encode_batches(batches))


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``decoded`` as encode_texts and decode_ids give them, in one worker for each task."""
    docs = docs.drop("ids", "decoded")
    return docs.mapInArrow(_both(text_col, path, pattern), extended(docs.schema, ids="array<int>", decoded="binary"))


def encode_texts(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids array<int>``, the tokens of each whole text; null encodes as empty.

    A column named ids is replaced.  Strings of special tokens are ordinary text.
    """
    docs = docs.drop("ids") if text_col != "ids" else docs
    return docs.mapInArrow(_encode_all(text_col, path, pattern), extended(docs.schema, ids="array<int>"))


def decode_ids(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``decoded binary``, the bytes of each row's ids; null decodes as empty."""
    docs = docs.drop("decoded") if ids_col != "decoded" else docs
    return docs.mapInArrow(_decode_all(ids_col, path, pattern), extended(docs.schema, decoded="binary"))
