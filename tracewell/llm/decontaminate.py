"""Benchmark decontamination: short test items found inside long documents.

Item and document are sets of distinct shingles of ``SIZE`` lower-cased words (with fewer
words, the whole sequence is the one shingle).  A document contains an item when it has at
least 80 % of the item's shingles.

Method.  Containment is asymmetric, so a sketch of the document would drown a short item.
Items are partitioned by set size instead, and each partition has its own sketch length: the
sketch of an item of at most u shingles has ``floor(u / 5) + 1`` of them.  It is a bottom-k MinHash
sketch weighted by rarity: shingles that fewer items have come first, equally rare ones in the
order of their hash, so a template that many items share is in no sketch as long as they have
words of their own.  A document may lack ``floor(n / 5)`` shingles of an item of n, so a
containing document has at least ``k - floor(n / 5)`` of the k sketch values, whichever they are:
the search loses no match.  Candidates are verified first by counting equal shingle hashes, and
what is left by exact shingle containment, comparing the shingles' words.

Scale.  Items with the same words are searched once.  They are read in groups whose shingles
number at most ``ITEM_SHINGLES``, held as arrays of hashes beside their text, so what a task is sent
is bounded whatever the size of the benchmark; every group meets every document in one scan
without a shuffle.  Sketch hits are counted for some documents of a block at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block import U64, Block, mix, slices
from .jaccard_join import sets

SIZE = 5
BLOCK_BYTES = 2 << 20
ITEM_SHINGLES = 2_000_000
#: Sketch hits that are counted at once, beyond those of one document.
HITS = 1 << 20
_MATCH = "item_id long, n_item_shingles long, n_shared long"


def size_partitions(largest: int) -> np.ndarray:
    """Upper set sizes of the partitions, each a quarter above the one before."""
    ends = [1]
    while ends[-1] < largest:
        ends.append((ends[-1] + 1) * 5 // 4)
    return np.array(ends, np.int64)


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingle_set(words: list[bytes], size: int = SIZE) -> set[tuple[bytes, ...]]:
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


class ItemIndex:
    """Some items, those with the same words as one: sets, sketches, and how many values must hit.

    ids: for each, the ids of the items that it stands for.  The set of item i is
    ``hashes[begin[i] : begin[i + 1]]``, in order.
    """

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        by_words: dict[bytes, list] = {}
        for i, text in zip(ids, texts, strict=True):
            by_words.setdefault(b" ".join(words_of(text)), []).append(i)
        self.ids, self.words = list(by_words.values()), pa.array(by_words, pa.binary())
        del by_words
        block = Block(self.words)
        doc, self.hashes, self.size = sets(block)
        self.begin = np.concatenate(([0], np.cumsum(self.size)))
        _, which, often = np.unique(self.hashes, return_inverse=True, return_counts=True)
        rarity = np.log2(often).astype(np.int64)[which]
        upper = size_partitions(int(self.size.max(initial=1)))
        length = np.minimum(upper[np.searchsorted(upper, self.size)] // 5 + 1, self.size)
        self.least = np.maximum(length - self.size // 5, 1)
        order = np.lexsort((mix(self.hashes), rarity, doc))
        place = np.arange(len(doc)) - self.begin[doc[order]]
        take = order[place < length[doc[order]]]
        by = np.argsort(self.hashes[take], kind="stable")
        self.value, self.item = self.hashes[take][by], doc[take][by]

    def _enough(self, doc: np.ndarray, value: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) with enough sketch hits whose sets share enough hashes; lo, n: hits of each (document, shingle)."""
        items = self.item[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        pair = (np.repeat(doc, n).astype(U64) << U64(32)) + items.astype(U64)
        pair, hits = np.unique(pair, return_counts=True)
        d, i = (pair >> U64(32)).astype(np.int64), (pair & U64(0xFFFFFFFF)).astype(np.int64)
        enough = hits >= self.least[i]
        d, i = d[enough], i[enough]
        first, last = np.searchsorted(doc, d), np.searchsorted(doc, d, "right")
        keep = np.zeros(len(d), bool)
        for k in range(len(d)):
            mine, have = self.hashes[self.begin[i[k]] : self.begin[i[k] + 1]], value[first[k] : last[k]]
            at = np.minimum(np.searchsorted(have, mine), len(have) - 1)
            keep[k] = 100 * int((have[at] == mine).sum()) >= 80 * len(mine)
        return d[keep], i[keep]

    def candidates(self, doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) that may match, from ordered distinct (document, shingle)."""
        if not len(self.value) or not len(value):
            return doc[:0], doc[:0]
        lo = np.searchsorted(self.value, value)
        n = np.searchsorted(self.value, value, "right") - lo
        ends = np.cumsum(np.bincount(doc, n, int(doc[-1]) + 1).astype(np.int64))  # hits of documents up to each
        out, a = [], 0
        while a < len(ends):
            before = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + HITS, "right")))
            if ends[b - 1] > before:
                i, j = np.searchsorted(doc, a), np.searchsorted(doc, b)
                out.append(self._enough(doc[i:j], value[i:j], lo[i:j], n[i:j]))
            a = b
        return tuple(np.concatenate([x[k] for x in out]) if out else doc[:0] for k in (0, 1))

    def shared(self, words: list[bytes], item: int) -> int:
        """How many shingles of an item a document of these words has, by their words."""
        mine = shingle_set(self.words[item].as_py().split())
        if len(words) < SIZE:
            return len(mine & shingle_set(words))
        found = {s for k in range(len(words) - SIZE + 1) if (s := tuple(words[k : k + SIZE])) in mine}
        return len(found)


def _matches(block: Block, index: ItemIndex) -> Iterator[tuple[int, int, int]]:
    """(document, item, shared shingles) of the documents of a block that contain an item."""
    doc, value, _ = sets(block)
    last, words = -1, []
    for d, i in zip(*(x.tolist() for x in index.candidates(doc, value)), strict=True):
        if d != last:
            last, words = d, block.document(d).split()
        shared = index.shared(words, i)
        if 100 * shared >= 80 * index.size[i]:
            yield d, i, shared


def _search(column: str, index: ItemIndex):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, BLOCK_BYTES):
            found = [(d, j, int(index.size[i]), n) for d, i, n in _matches(Block(batch.column(column), lower=True), index) for j in index.ids[i]]
            out = batch.drop_columns([column]).take(pa.array([f[0] for f in found], pa.int64()))
            for k, name in enumerate(("item_id", "n_item_shingles", "n_shared"), 1):
                out = out.append_column(name, pa.array([f[k] for f in found], pa.int64()))
            yield out

    return run


def _item_groups(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """(ids, texts) of the items, in groups with at most ITEM_SHINGLES words."""
    ids, texts, n = [], [], 0
    for row in items.select(id_col, text_col).toLocalIterator():
        words = len(words_of(row[1]))
        if words:
            if n and n + words > ITEM_SHINGLES:
                yield ids, texts
                ids, texts, n = [], [], 0
            ids.append(row[0])
            texts.append(row[1])
            n += words
    yield ids, texts


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, n_item_shingles, n_shared): each item in each row of ``docs`` that contains it.

    Null, empty and blank texts, on either side, match nothing.  Repeated items and repeated
    documents each give their own rows; null ids are carried through.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    out = None
    for ids, texts in _item_groups(items, item_id, item_text):
        found = slim.mapInArrow(_search("_text", ItemIndex(ids, texts)), "doc_id long, " + _MATCH)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, columns unchanged."""
    for ids, texts in _item_groups(items, item_id, item_text):
        docs = docs.mapInArrow(_clean(text_col, ItemIndex(ids, texts)), docs.schema)
    return docs


def _clean(column: str, index: ItemIndex):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, BLOCK_BYTES):
            block = Block(batch.column(column), lower=True)
            keep = np.ones(block.n_docs, bool)
            for d, _, _ in _matches(block, index):
                keep[d] = False
            yield batch.filter(pa.array(keep))

    return run
