"""Substring dedup: repeated word windows found through super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document.  A window repeats if its word
sequence also starts in a document with a smaller id; every word that a repeating window
covers is removed.

Method.  The minimiser of a window is the least hash among its runs of ``MINIMISER`` words.
Equal windows have equal minimisers, so consecutive windows that share one travel together,
as one string of joined words (a super-k-mer), to the bucket of that minimiser.  In a bucket
the windows are sorted by hash, equal neighbours are compared byte by byte, and whatever does
not belong to the smallest document of its run is reported as a range of words.

Scale.  A task turns a block of documents into one compressed blob for each bucket, so the
shuffle has no row per word.  Equal super-k-mers of a block are settled before the shuffle:
only those of the smallest document travel, so a group of copies sends one for each block.
A minimiser with more super-k-mers than a quarter of an even bucket, or one in ``SHARE`` of
all, is not tied to one bucket: its windows go, one by one, to buckets chosen by the hash of
the whole window, which is as exact.  The number of such minimisers is at most ``2 * SHARE``,
which bounds what the driver sees.
The number of buckets follows the size of the input; a bucket has about ``BUCKET_BYTES``.  There
are at most ``PARTS`` partitions; beyond as many buckets a partition has several, which are cut
apart and sorted after the shuffle.  Partitions go to tasks by number, not by hash, so that a task has ``TOGETHER``
of them, sorted, and judges one after the other; batches for Python are bounded by bytes (``small_batches``).  A bucket that still grows beyond ``HOLD`` bytes, as they are once
unpacked, is judged in pieces of that size.  A piece settles what repeats inside it and sends, for each of its
windows, a fingerprint of 128 bits with the smallest document that has it there.  The least of these over all
pieces, found with map-side combine, answers the documents that asked.  So no text moves a second time,
and a window that is in every piece is one short row a piece.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block import U64, Block, Rolling, extended, free_names, give_back, mix, slices
from .scratch import materialise, small_batches, tasks

WINDOW = 13
MINIMISER = 3
SHARE = 8192
#: Level of compression of what is shuffled; the shuffle is the largest part of the disk used.
LEVEL = 9
BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 10 << 20
#: Partitions at most, and unpacked bytes that are judged at once, in some four times as much memory.
PARTS, HOLD = 16_384, 64 << 20
#: Rows that a judging task hands on at once, as the executor has them outside its heap.
FOUND_ROWS = 1 << 18
_LAST = np.iinfo(np.int64).max
_BLOBS = "bucket int, kind int, blob binary"
_RANGES = "id long, crc long, start int, stop int"
_FOUND = _RANGES + ", h1 long, h2 long"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` consecutive values."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = width - have
    if rest:
        out = np.minimum(out[:-rest], out[rest:]) if len(out) > rest else out[:0]
    return out


class _Runs:
    """The super-k-mers of a block: first word, number of windows and key of each."""

    def __init__(self, block: Block, window: int, hot: np.ndarray | None):
        self.window = window
        words = block.hashes()
        self.roll = Rolling(words)
        m = min(MINIMISER, window)
        n = block.n_words - window + 1
        if n <= 0:
            self.start = self.count = np.zeros(0, np.int64)
            self.key = np.zeros(0, U64)
            return
        at = np.arange(block.n_words - m + 1, dtype=np.int32)
        least = _sliding_min(self.roll.of(at, at + np.int32(m)), window - m + 1)
        valid = at[:n] + np.int32(window) <= block.first[1:].astype(np.int32)[block.doc[:n]]
        start, key = at[:n][valid], least[valid]
        del at, least, valid
        if not len(start):
            self.start, self.count, self.key = start, start, key
            return
        new = np.ones(len(start), bool)
        new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)
        if hot is not None and len(hot):
            place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
            is_hot = hot[place] == key
            new |= is_hot
            key = key.copy()
            key[is_hot] = self.roll.of(start[is_hot], start[is_hot] + window)
        first = np.flatnonzero(new)
        self.start, self.key = start[first], key[first]
        self.count = np.diff(np.append(first, len(start)))


def _survey(column: str, window: int):
    """Rows (key, super-k-mers) of the keys that are frequent in a block, and the sums.

    A key with a share above 1/SHARE of everything has that share in some block, so no
    such key is missed.
    """

    def frequent(batch: pa.RecordBatch) -> pa.RecordBatch:
        block = Block(batch.column(column))
        runs = _Runs(block, window, None)
        keys, counts = np.unique(runs.key, return_counts=True)
        keep = counts * 2 * SHARE > len(runs.key)
        packed = int((block.ends - block.starts).sum() + block.n_words) if block.n_words else 0
        return pa.record_batch({
            "kind": pa.array(np.concatenate(([0, 1], np.full(keep.sum(), 2))).astype(np.int32)),
            "key": pa.array(np.concatenate(([0, 0], keys[keep].view(np.int64))).astype(np.int64)),
            "n": pa.array(np.concatenate(([len(runs.key), packed], counts[keep])).astype(np.int64)),
        })

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, BLOCK_BYTES):
            yield frequent(batch)
            del batch

    return run


def _columns(arrays: list[np.ndarray], tail: bytes = b"") -> bytes:
    """Columns byte plane by byte plane, the first as differences, then ``tail``; compressed."""
    head = np.array([len(arrays[0])], np.int64).tobytes()
    arrays = [np.diff(arrays[0], prepend=arrays[0].dtype.type(0)), *arrays[1:]]
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + planes + tail)


def _unpacked(blob: bytes) -> int:
    """Bytes of a blob once unpacked, which its head tells."""
    return zstandard.frame_content_size(blob)


def _open(blob: bytes, kinds: list[type]) -> tuple[list[np.ndarray], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(kind))
        at += n * size
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out, np.frombuffer(raw, np.uint8, offset=at)


_RUN = [np.int64, np.uint32, np.int32, np.int32, np.int32]  # id, crc, first word, windows, bytes
_SEVERAL = [*_RUN, np.int32]  # and the bucket, where a blob is for a partition with several
_RANGE = [np.int64, np.uint32, np.int32, np.int32]


def _local(runs: _Runs, block: Block, ids: np.ndarray, text: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs to send, runs that an equal run of a smaller document in this block settles)."""
    n = len(runs.start)
    stop = runs.start + runs.count + runs.window - 1
    whole = runs.roll.of(runs.start, stop)
    doc_id = ids[block.doc[runs.start]] if n else ids[:0]
    order = np.lexsort((doc_id, whole))
    new = np.ones(n, bool)
    new[1:] = whole[order][1:] != whole[order][:-1]
    first = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))] if n else order
    later = doc_id[order] > doc_id[first]
    settled = np.zeros(n, bool)
    for a, b in zip(order[later].tolist(), first[later].tolist(), strict=True):
        settled[a] = text[at[runs.start[a]] : at[stop[a]]] == text[at[runs.start[b]] : at[stop[b]]]
    return np.flatnonzero(~settled), np.flatnonzero(settled)


def _send(id_column: str, column: str, window: int, buckets: int, parts: int, hot: np.ndarray):
    """Blobs: kind 0 holds super-k-mers for a bucket, kind 1 ranges already known to go."""

    def dealt(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        block = Block(batch.column(column))
        runs = _Runs(block, window, hot)
        if not len(runs.start):
            return None
        ids = pc.fill_null(batch.column(id_column).cast(pa.int64()), _LAST).to_numpy(zero_copy_only=False)
        crc = np.array([zlib.crc32(block.document(k)) for k in range(block.n_docs)], np.uint32)
        joined, at = block.joined()
        text = joined.tobytes()
        stop = runs.start + runs.count + window - 1
        doc = block.doc[runs.start]
        place = (runs.start - block.first[doc]).astype(np.int32)
        send, settled = _local(runs, block, ids, text, at)
        del joined, block
        runs.roll = None
        out: tuple[list, list, list] = ([], [], [])
        if len(settled):
            out[0].append(int(crc[0]) % parts)
            out[1].append(1)
            out[2].append(_columns([ids[doc[settled]], crc[doc[settled]], place[settled], (place[settled] + runs.count[settled] + window - 1).astype(np.int32)]))
        bucket = (mix(runs.key[send]) % U64(buckets)).astype(np.int64)
        part = bucket % parts
        order = np.lexsort((bucket, part)) if parts < buckets else np.argsort(part, kind="stable")
        send, bucket, part = send[order], bucket[order], part[order]
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for a, b in zip(cut, np.append(cut[1:], len(send)), strict=True):
            if a == b:
                continue
            pick = send[a:b]
            lo, hi = at[runs.start[pick]], at[stop[pick]]
            columns = [ids[doc[pick]], crc[doc[pick]], place[pick], runs.count[pick].astype(np.int32), (hi - lo).astype(np.int32)]
            if parts < buckets:
                columns.append(bucket[a:b].astype(np.int32))
            out[0].append(int(part[a]))
            out[1].append(0)
            out[2].append(_columns(columns, b"".join([text[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])))
        return pa.record_batch({"bucket": pa.array(out[0], pa.int32()), "kind": pa.array(out[1], pa.int32()), "blob": pa.array(out[2], pa.binary())})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, BLOCK_BYTES):
            out = dealt(batch)
            del batch
            give_back()  # the executor has little beside its heap, and a block leaves much behind
            if out is not None:
                yield out
            del out

    return run


def _pieces(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    raw = data.tobytes()
    return b"".join([raw[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])


def _cut_again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Super-k-mers of a partition with several buckets, cut by bucket; other blobs go on."""

    def cut(blobs: list[bytes]) -> pa.RecordBatch:
        parts = [_open(b, _SEVERAL) for b in blobs]
        columns = [np.concatenate([p[0][k] for p in parts]) for k in range(6)]
        data = np.concatenate([p[1] for p in parts])
        ends = np.cumsum(columns[4].astype(np.int64))
        order = np.argsort(columns[5], kind="stable")
        edge = np.flatnonzero(np.append(True, np.diff(columns[5][order]) != 0))
        rows = []
        for a, b in zip(edge, np.append(edge[1:], len(order)), strict=True):
            i = order[a:b]
            rows.append((int(columns[5][i[0]]), 0, _columns([c[i] for c in columns[:5]], _pieces(data, ends[i] - columns[4][i], ends[i]))))
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "blob"])

    held, size = [], 0
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        if (kind != 0).any():
            yield batch.filter(pa.array(kind != 0))
        for k in np.flatnonzero(kind == 0).tolist():
            held.append(batch.column("blob")[k].as_py())
            size += _unpacked(held[-1])
            if size > HOLD:
                yield cut(held)
                held, size = [], 0
    if held:
        yield cut(held)


def _judge(blobs: list[bytes], window: int, ask: bool = False) -> tuple[list[np.ndarray] | None, list[np.ndarray] | None]:
    """(ranges of the repeating windows of one bucket, with ``ask`` the windows that other pieces may repeat).

    The latter are (id, crc, start, stop, h1, h2): the windows that no smaller document among these has.
    """
    # words and hashes are made blob by blob, so that only what is kept of them has the length of the bucket
    parts, texts, words, values = [], [], [], []
    size = n_words = 0
    for blob in blobs:
        (ids, crc, place, count, length), data = _open(blob, _RUN)
        texts.append(data.tobytes())
        del data
        block = Block(pa.Array.from_buffers(pa.large_binary(), 1, [None, pa.py_buffer(np.array([0, len(texts[-1])], np.int64)), pa.py_buffer(texts[-1])]))
        first_word = np.searchsorted(block.starts, np.cumsum(length, dtype=np.int64) - length)
        roll = Rolling(block.hashes())
        word = np.arange(count.sum()) + np.repeat(first_word - (np.cumsum(count) - count), count)
        values.append(roll.of(word, word + window))
        words.append(block.starts.astype(np.int32) if size + len(texts[-1]) < 1 << 31 else block.starts)
        words[-1] += size
        parts.append((ids, crc, place, count, (first_word + n_words).astype(np.int32)))
        size, n_words = size + len(texts[-1]), n_words + block.n_words
    del block, roll, word
    ids, crc, place, count, first_word = (np.concatenate([p[k] for p in parts]) for k in range(5))
    words.append(np.array([size], words[-1].dtype))
    text, starts, value = b"".join(texts), np.concatenate(words), np.concatenate(values)
    del parts, texts, words, values
    ends = lambda w: starts[w + 1] - 1  # noqa: E731  one space follows each word
    order = np.argsort(ids, kind="stable").astype(np.int32)
    n = count[order]
    run = np.repeat(order, n)  # of each window, and the word it starts with
    word = np.arange(len(run), dtype=np.int32) - np.repeat(np.cumsum(n, dtype=np.int32) - n, n)
    value = value[word + (np.cumsum(count, dtype=np.int32) - count)[run]]
    word += first_word[run]
    by = np.argsort(value, kind="stable").astype(np.int32)  # among equal hashes the smallest document is first
    new = np.ones(len(by), bool)
    for k in range(1, len(by), 1 << 20):
        v = value[by[k - 1 : k + (1 << 20)]]
        new[k : k + len(v) - 1] = v[1:] != v[:-1]
    head = by[np.maximum.accumulate(np.where(new, np.arange(len(by), dtype=np.int32), np.int32(0)))] if len(by) else by
    del new
    later = ids[run[by]] > ids[run[head]]
    dup, of, open_ = by[later], head[later], by[~later]
    del by, head, later
    from_ = lambda w: place[run[w]] + (word[w] - first_word[run[w]])  # noqa: E731  the window's place in its document

    def asked() -> list[np.ndarray] | None:
        if not ask:
            return None
        h = np.empty((len(open_), 2), np.int64)
        view = memoryview(text)
        for k in range(0, len(open_), 1 << 16):
            w = word[open_[k : k + (1 << 16)]]
            lo, hi = starts[w].tolist(), ends(w + window - 1).tolist()
            h[k : k + len(w)] = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[p:q]) for p, q in zip(lo, hi, strict=True)]), np.int64).reshape(-1, 2)
        start = from_(open_).astype(np.int32)
        return [ids[run[open_]], crc[run[open_]], start, start + np.int32(window), h[:, 0], h[:, 1]]

    if not len(dup):
        return None, asked()
    back = np.argsort(dup)
    dup, of = dup[back], of[back]
    # stretches of consecutive windows of one run that repeat consecutive windows of another
    cut = np.ones(len(dup), bool)
    cut[1:] = (dup[1:] != dup[:-1] + 1) | (run[dup[1:]] != run[dup[:-1]]) | (of[1:] != of[:-1] + 1) | (run[of[1:]] != run[of[:-1]])
    a = np.flatnonzero(cut)
    length = np.diff(np.append(a, len(dup)))
    same = np.empty(len(a), bool)
    for k in range(0, len(a), 1 << 16):
        c, more = a[k : k + (1 << 16)], length[k : k + (1 << 16)] + window - 2
        x, y = word[dup[c]], word[of[c]]
        edges = (starts[x].tolist(), ends(x + more).tolist(), starts[y].tolist(), ends(y + more).tolist())
        same[k : k + len(c)] = [text[p:q] == text[r:s] for p, q, r, s in zip(*edges, strict=True)]
    who, start = run[dup[a]], from_(dup[a])
    found = [ids[who][same], crc[who][same], start[same].astype(np.int32), (start + length + window - 1)[same].astype(np.int32)]
    if not same.all():  # two word sequences with one hash: these groups are settled by their bytes
        bad = np.unique(np.concatenate([value[dup[i : i + k]] for i, k in zip(a[~same], length[~same], strict=True)]))
        least: dict[bytes, int] = {}
        rows = np.flatnonzero(np.isin(value, bad)).astype(np.int32)
        key = [text[starts[word[r]] : ends(word[r] + window - 1)] for r in rows]
        for r, k in zip(rows, key, strict=True):
            least[k] = min(least.get(k, _LAST), int(ids[run[r]]))
        pick = np.array([r for r, k in zip(rows, key, strict=True) if ids[run[r]] > least[k]], np.int64)
        start = from_(pick).astype(np.int32)
        found = [np.concatenate(x) for x in zip(found, [ids[run[pick]], crc[run[pick]], start, start + np.int32(window)], strict=True)]
        open_ = np.union1d(open_, rows)  # all of them ask, by their bytes
    return found, asked()


def _judge_all(window: int, hold: int):
    """Ranges of repeating windows; blobs come sorted by bucket, and a bucket beyond ``hold`` is judged in pieces that ask."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, size, several = None, [], 0, False

        def settle(ask: bool) -> Iterator[pa.RecordBatch]:
            if held:
                for rows in _judge(held, window, ask):
                    for k in range(0, len(rows[0]) if rows is not None else 0, FOUND_ROWS):
                        yield _found_batch([x[k : k + FOUND_ROWS] for x in rows])
                    rows = None
                give_back()

        for batch in batches:
            for k, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind:
                    yield _found_batch(_open(blob.as_py(), _RANGE)[0])
                    continue
                blob = blob.as_py()
                if k != bucket:
                    yield from settle(several)
                    bucket, held, size, several = k, [], 0, False
                elif held and size + _unpacked(blob) > hold:
                    yield from settle(True)
                    held, size, several = [], 0, True
                held.append(blob)
                size += _unpacked(blob)
        yield from settle(several)

    return run


def _found_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    """A range, or a window that asks, for each row."""
    n = len(found[0])
    h1, h2 = (pa.array(x) for x in found[4:]) if len(found) > 4 else (pa.nulls(n, pa.int64()),) * 2
    return pa.record_batch({"id": pa.array(found[0]), "crc": pa.array(found[1].astype(np.int64)), "start": pa.array(found[2]), "stop": pa.array(found[3]), "h1": h1, "h2": h2})


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (id, crc, start, stop): word ranges of documents that repeating windows cover.

    ``crc`` is the CRC-32 of the text; it tells apart rows that share an id.  A null id counts
    as the largest possible one.  Ranges of a document may overlap.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    survey = slim.select("text").mapInArrow(_survey("text", window), "kind int, key long, n long")
    rows = survey.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"))
    rows = rows.persist()
    total = {r["kind"]: r["n"] for r in rows.filter("kind < 2").collect()}
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(3.0 * total.get(1, 0) / BUCKET_BYTES))
    least = total.get(0, 0) / min(2 * SHARE, 4 * buckets)
    hot = np.sort(np.array([r["key"] for r in rows.filter((F.col("kind") == 2) & (F.col("n") > F.lit(least))).select("key").collect()], np.int64).view(U64))
    rows.unpersist()
    parts = min(buckets, PARTS)
    dealt = slim.mapInArrow(_send("id", "text", window, buckets, parts, hot), _BLOBS)
    dealt = dealt.repartitionById(tasks(parts, buckets, spark.sparkContext.defaultParallelism), F.col("bucket"))
    if parts < buckets:
        dealt = dealt.mapInArrow(_cut_again, _BLOBS)
    found = materialise(dealt.sortWithinPartitions("bucket").mapInArrow(_judge_all(window, HOLD), _FOUND), "ranges")
    ranges, asks = (found.where(f"h1 is {x}null") for x in ("", "not "))
    ranges = ranges.select("id", "crc", "start", "stop")
    if asks.isEmpty():
        return ranges
    least = asks.groupBy("h1", "h2").agg(F.min("id").alias("least"))
    late = asks.join(least, ["h1", "h2"]).where("id > least")
    return ranges.unionByName(late.select("id", "crc", "start", "stop"))


def _squeeze(column: str, packed: str):
    """Replaces the text by its compressed bytes, in which form it is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            out = [pack.compress(x.as_buffer()) if x.is_valid else None for x in batch.column(column).cast(pa.binary())]
            yield batch.drop_columns([column]).append_column(packed, pa.array(out, pa.binary()))

    return run


def _cut(column: str, packed: str, found: str, names: list[str]):
    """Adds kept_text, n_words and n_removed to rows with (text, ranges)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches, packed, BLOCK_BYTES // 3):
            texts = pa.array([unpack.decompress(x) if x is not None else None for x in batch.column(packed).to_pylist()], pa.binary()).cast(pa.string())
            block = Block(texts)
            joined, at = block.joined()
            text = joined.tobytes()
            ranges = batch.column(found)
            ranges = ranges.combine_chunks() if isinstance(ranges, pa.ChunkedArray) else ranges
            flat_ranges = ranges.flatten()
            owner = pc.list_parent_indices(ranges).to_numpy(zero_copy_only=False)
            edge = np.zeros(block.n_words + 1, np.int32)
            if len(owner):
                np.add.at(edge, block.first[owner] + flat_ranges.field("start").to_numpy(), 1)
                np.add.at(edge, block.first[owner] + flat_ranges.field("stop").to_numpy(), -1)
            gone = np.cumsum(edge[:-1]) > 0
            lost = np.concatenate(([0], np.cumsum(gone)))
            lost = lost[block.first[1:]] - lost[block.first[:-1]]
            flip = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True])).astype(np.int8)))  # keeps begin and end in turn
            opens, closes = flip[::2], flip[1::2]
            kept = []
            for k in range(block.n_docs):
                a, b = int(block.first[k]), int(block.first[k + 1])
                if not lost[k]:
                    kept.append(text[at[a] : at[b] - 1] if b > a else b"")
                    continue
                lo, hi = np.searchsorted(closes, a, "right"), np.searchsorted(opens, b)
                kept.append(b" ".join([text[at[max(o, a)] : at[min(c, b)] - 1] for o, c in zip(opens[lo:hi].tolist(), closes[lo:hi].tolist(), strict=True)]))
            out = batch.drop_columns([found, packed]).append_column(column, texts)
            out = out.select([n for n in names if n in out.schema.names])
            out = out.append_column("kept_text", pa.array(kept, pa.binary()).cast(pa.string()))
            out = out.append_column("n_words", pa.array(np.diff(block.first), pa.int64()))
            yield out.append_column("n_removed", pa.array(lost, pa.int64()))

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_words`` and ``n_removed`` added.

    kept_text: the words that no repeating window covers, joined by one space.  A null or
    empty text has no words; its kept_text is empty.  Texts with fewer words than a window
    lose nothing.  Rows that share an id are judged each for itself, and neither counts as
    smaller than the other; a row with a null id comes after all others.  Columns that have the
    names of the added ones are replaced.
    """
    if taken := {"kept_text", "n_words", "n_removed"} & set(docs.columns):
        docs = docs.drop(*taken)
    id_, crc, found, packed = free_names(docs.columns, "_id", "_crc", "_ranges", "_packed")
    ranges = repeated_ranges(docs, id_col, text_col, window)
    ranges = ranges.groupBy(F.col("id").alias(id_), F.col("crc").alias(crc)).agg(F.collect_list(F.struct("start", "stop")).alias(found))
    keyed = docs.withColumns({id_: F.coalesce(F.col(id_col).cast("long"), F.lit(int(_LAST))), crc: F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))})
    kept = keyed.select([c for c in keyed.columns if c != text_col])
    keyed = keyed.mapInArrow(_squeeze(text_col, packed), extended(kept.schema, **{packed: "binary"}))
    met = keyed.join(ranges, [id_, crc], "left").drop(id_, crc)
    schema = extended(docs.schema, kept_text="string", n_words="long", n_removed="long")
    return met.mapInArrow(_cut(text_col, packed, found, docs.columns), schema)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, window: int = WINDOW) -> DataFrame:
    """``docs`` with the words that repeating windows cover cut out of the text; the same columns.

    A text that loses words is its kept words joined by one space; others stay as they are, a null
    too.  length_col: a column that has the number of characters, and follows.
    """
    kept, n, words = free_names(docs.columns, "kept_text", "n_removed", "n_words")
    taken = {c: f"_{k}_{c}" for k, c in enumerate(docs.columns) if c in ("kept_text", "n_removed", "n_words")}
    cut = remove_repeats(docs.withColumnsRenamed(taken), id_col, text_col, window)
    cut = cut.withColumnsRenamed({"kept_text": kept, "n_removed": n, "n_words": words}).withColumnsRenamed({v: k for k, v in taken.items()})
    lost = F.col(n) > 0
    new = {text_col: F.when(lost, F.col(kept)).otherwise(F.col(text_col))}
    if length_col:
        new[length_col] = F.when(lost, F.length(kept).cast("long")).otherwise(F.col(length_col))
    return cut.withColumns(new).select(*docs.columns)
