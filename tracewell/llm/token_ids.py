"""Token ids in binary files: frequency-ranked, byte-aligned, control bytes apart.

Ids are replaced by their rank by frequency over all documents, so frequent ones take one
byte.  Four 2-bit lengths make a control byte; control bytes and data bytes are separate
streams.  Decoding looks the lengths of a control byte up in a numpy table, and positions in
the data are their running sum.

A file is ``MAGIC`` and blocks.  A block is a header (mark, documents, tokens, control bytes,
data bytes, CRC-32 of the body) and a body: document ids (int64), token counts (uint32),
control bytes (each document begins a new one), data bytes.  ``ranks.u32`` beside the files
has the id of each rank.  Files follow the order of document ids.

Encoding.  The normaliser and the pattern of the vocabulary never join or look across ASCII
white space, so a text's ids are those of its words one after another.  Each distinct word of
a block is encoded once by the tokenizers library, and remembered for later blocks.  The added
tokens of the vocabulary have their own ids wherever a text has them, as in the library.

Scale.  Documents are dealt into ranges of ids whose bounds come from the id column alone; an
id that fills several ranges is split by the hash of the text.  Compressed ids move to their
range once and are spooled there in order.  Counting reads the spool, at most one row per id
and task, and each spool file becomes one final file without another shuffle.  A task writes
files of its own and reports them; unreported files of failed attempts are never read.
"""

from __future__ import annotations

import functools
import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .block import Block, slices
from .scratch import input_bytes, materialise

END_ID = 1
BLOCK_BYTES = 6 << 20
FILE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
#: Ranges at most; a larger one is spooled as several files.
RANGES = 16_384
BLOCK_TOKENS = 1 << 20
REMEMBERED = 2_000_000
MAGIC = b"TWIDS\x00\x00\x01"
_HEAD = "<4sQQQQI"
_MARK = b"BLK1"
_LAST = np.iinfo(np.int64).max
#: Lengths of the four values of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def code(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(control bytes, data bytes, data bytes of each document) of unsigned 32-bit values."""
    values = values.astype("<u4")
    size = 1 + (values >= 1 << 8) + (values >= 1 << 16) + (values >= 1 << 24)
    groups = (counts + 3) // 4
    base = 4 * (np.cumsum(groups) - groups) - (np.cumsum(counts) - counts)
    lengths = np.zeros(4 * int(groups.sum()), np.uint8)
    lengths[np.arange(len(values)) + np.repeat(base, counts)] = size - 1
    lengths = lengths.reshape(-1, 4)
    control = lengths[:, 0] | lengths[:, 1] << 2 | lengths[:, 2] << 4 | lengths[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    ends = np.concatenate(([0], np.cumsum(size)))
    at = np.concatenate(([0], np.cumsum(counts)))
    return control, data, ends[at[1:]] - ends[at[:-1]]


def decode(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of some documents."""
    counts = counts.astype(np.int64)
    groups = (counts + 3) // 4
    base = 4 * (np.cumsum(groups) - groups) - (np.cumsum(counts) - counts)
    size = LENGTHS[control].reshape(-1)[np.arange(counts.sum()) + np.repeat(base, counts)]
    at = np.cumsum(size, dtype=np.int64) - size
    data = np.concatenate((data, np.zeros(4, np.uint8)))
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class WordEncoder:
    """Ids of texts by way of their distinct words.

    Words met before are remembered as sorted 64-bit hashes beside their ids in one flat array,
    so looking up a block is one search and a remembered word takes about 40 bytes.

    added: whether the vocabulary's added tokens in a text get their own ids, as the library has
    it by default; otherwise they are ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.start, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[bytes], step: int = 256) -> None:
        """Encode new words, ``step`` at a time with spaces between, and cut the ids at the words."""
        flat, starts, n = [self.flat], [], len(self.flat)
        lines = [b" ".join(words[i : i + step]).decode() for i in range(0, len(words), step)]
        for i in range(0, len(lines), 32):
            for line, e in zip(lines[i : i + 32], self.tokenizer.encode_batch(lines[i : i + 32], add_special_tokens=False), strict=True):
                size = [len(w) + 1 for w in line.split(" ")]
                at = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.offsets))
                starts.append(n + np.searchsorted(at, np.cumsum(size) - size))
                flat.append(np.array(e.ids, np.uint32))
                n += len(at)
        start = np.concatenate(starts)
        size = np.diff(np.append(start, n))
        at = np.searchsorted(self.hashes, hashes)
        self.flat = np.concatenate(flat)
        self.hashes, self.start, self.size = np.insert(self.hashes, at, hashes), np.insert(self.start, at, start), np.insert(self.size, at, size)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, hashes)
        inside = np.minimum(at, max(len(self.hashes) - 1, 0))
        return inside, self.hashes[inside] != hashes if len(self.hashes) else np.ones(len(hashes), bool)

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text), with the end id after each text."""
        block = Block(texts)
        value, first, which = np.unique(block.hashes(), return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED:
            self._forget()
        _, new = self._places(value)
        if new.any():
            data = block.data.tobytes()
            self._learn(value[new], [data[a:b] for a, b in zip(block.starts[first[new]].tolist(), block.ends[first[new]].tolist(), strict=True)])
        place, _ = self._places(value)
        size, start = self.size[place][which], self.start[place][which]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)] if len(which) else np.zeros(0, np.uint32)
        at = ends[block.first]
        counts = np.diff(at)
        if end is not None:
            ids = np.insert(ids, at[1:], np.uint32(end))
            counts = counts + 1
        return ids, counts


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path, added=True)


def _squeeze(ids: np.ndarray) -> bytes:
    """Ids of one document, for the spool: width, then compressed values."""
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\x02" if narrow else b"\x04") + zstandard.ZstdCompressor(level=3).compress(ids.astype("<u2" if narrow else "<u4").tobytes())


def _stretch(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), "<u2" if data[0] == 2 else "<u4").astype(np.uint32)


def _encode_all(path: str, end: int | None, deal):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK_BYTES):
            ids, counts = encoder(path).encode(batch.column("text"), end)
            ends = np.concatenate(([0], np.cumsum(counts)))
            packed = [_squeeze(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.record_batch({
                "range": pa.array(deal(batch.column("id").to_numpy(), batch.column("tie").to_numpy()), pa.int32()), "id": batch.column("id"), "tie": batch.column("tie"),
                "n": pa.array(counts, pa.int64()), "ids": pa.array(packed, pa.binary()),
            })

    return run


_FILES = "range int, seq int, file string, docs long, tokens long"
_ROW = "<qII"


def _files(done: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array([x[k] for x in done], t) for k, t in enumerate(kinds)], ["range", "seq", "file", "docs", "tokens"])


def _spool(folder: str):
    """Writes sorted rows to files, a new one for each range and after FILE_BYTES."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        done, out, now, seq, name = [], None, None, 0, ""
        docs = tokens = size = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("range", "id", "n", "ids")]
            for k in range(batch.num_rows):
                part, doc_id, n, ids = (c[k].as_py() for c in columns)
                if out is not None and (part != now or size >= FILE_BYTES):
                    out.close()
                    done.append((now, seq, name, docs, tokens))
                    out, seq = None, seq + 1 if part == now else 0
                if out is None:
                    now, name = part, f"{part:08d}-{uuid.uuid4().hex}.spool"
                    docs = tokens = size = 0
                    out = where.open_output_stream(f"{root}/{name}", compression=None)
                out.write(struct.pack(_ROW, doc_id, n, len(ids)) + ids)
                docs, tokens, size = docs + 1, tokens + n, size + len(ids)
        if out is not None:
            out.close()
            done.append((now, seq, name, docs, tokens))
        yield _files(done)

    return run


def _spooled(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, token counts, token ids) of a spool file, about BLOCK_TOKENS at a time."""
    rows, n = [], 0

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array([r[0] for r in rows], np.int64), np.array([len(r[1]) for r in rows], np.int64), np.concatenate([r[1] for r in rows])

    while head := stream.read(struct.calcsize(_ROW)):
        doc_id, _, size = struct.unpack(_ROW, head)
        rows.append((doc_id, _stretch(stream.read(size))))
        n += len(rows[-1][1])
        if n >= BLOCK_TOKENS:
            yield block()
            rows, n = [], 0
    if rows:
        yield block()


def _count(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        total = np.zeros(0, np.int64)
        for files in batches:
            for name in files.column(0).to_pylist():
                with where.open_input_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20) as stream:
                    for _, _, ids in _spooled(stream):
                        n = np.bincount(ids, minlength=len(total))
                        n[: len(total)] += total
                        total = n
        ids = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(ids, pa.int64()), "n": pa.array(total[ids], pa.int64())})

    return run


def frequency_ranks(files: DataFrame, folder: str) -> np.ndarray:
    """The id of each rank, most frequent first, ties by id; its length is at most the vocabulary's."""
    rows = files.select("file").mapInArrow(_count(folder), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = rows.toArrow().sort_by([("n", "descending"), ("id", "ascending")])
    return found["id"].to_numpy().astype(np.uint32)


def _rewrite(spool: str, folder: str, ids_by_rank: np.ndarray):
    """Each spool file as a file of coded ranks."""
    rank = np.zeros(int(ids_by_rank.max(initial=0)) + 1, np.uint32)
    rank[ids_by_rank] = np.arange(len(ids_by_rank), dtype=np.uint32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        _, source = fs.FileSystem.from_uri(spool)
        for files in batches:
            done = []
            for part, seq, old, docs, tokens in zip(*(files.column(c).to_pylist() for c in ("range", "seq", "file", "docs", "tokens")), strict=True):
                name = f"{part:08d}-{uuid.uuid4().hex}.ids"
                with where.open_input_stream(f"{source}/{old}", compression=None, buffer_size=1 << 20) as stream, where.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(MAGIC)
                    for doc_ids, counts, ids in _spooled(stream):
                        control, data, _ = code(rank[ids], counts)
                        body = b"".join((doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), control.tobytes(), data.tobytes()))
                        out.write(struct.pack(_HEAD, _MARK, len(doc_ids), len(ids), len(control), len(data), zlib.crc32(body)))
                        out.write(body)
                done.append((part, seq, name, docs, tokens))
            yield _files(done)

    return run


def _ranges(docs: DataFrame, n: int) -> tuple[list[int], list[int]]:
    """(upper bounds of id ranges, how many ranges in a row end at each)."""
    cuts = docs.where("id is not null").approxQuantile("id", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else []
    bounds: list[int] = []
    times: list[int] = []
    for c in sorted(int(c) for c in cuts):
        if bounds and bounds[-1] == c:
            times[-1] += 1
        else:
            bounds.append(c)
            times.append(1)
    return bounds, times


def write_ids(docs: DataFrame, folder: str, path: str, end: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs``, write their ids to ``folder`` in ascending order of id; rows (file, base, docs, tokens).

    base: tokens of all files before.  A null text has only the end id.  Rows with a null id
    come last.  Rows that share an id are in an order that depends on their texts alone.
    """
    spark = docs.sparkSession
    size = input_bytes(docs)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(RANGES, math.ceil(size / RANGE_BYTES)) if size < 1 << 55 else 1)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(_LAST))).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    bounds, times = _ranges(slim, n)
    encoded = slim.mapInArrow(_encode_all(path, end, _deal(bounds, times)), "range int, id long, tie long, n long, ids binary")
    spool = f"{folder}-spool"
    files = encoded.repartition(n, "range").sortWithinPartitions("range", "id", "tie").mapInArrow(_spool(spool), _FILES)
    files = materialise(files, "id-files")
    spread = files.repartition(max(1, files.count()))
    ids_by_rank = frequency_ranks(spread, spool)
    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)
    with where.open_output_stream(f"{root}/ranks.u32", compression=None) as f:
        f.write(ids_by_rank.astype("<u4").tobytes())
    files = materialise(spread.mapInArrow(_rewrite(spool, folder, ids_by_rank), _FILES), "id-files")
    old, spool_root = fs.FileSystem.from_uri(spool)
    if old.get_file_info(spool_root).type == fs.FileType.Directory:
        old.delete_dir(spool_root)
    before = Window.orderBy("range", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return materialise(files.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), "docs", "tokens"), "id-files")


def _deal(bounds: list[int], times: list[int]):
    """A function of (ids, ties) to ranges.  Ranges that end at one id share out its rows by their tie."""
    first = np.concatenate(([0], np.cumsum(times))).astype(np.int64)
    share = np.array([*times, 1], np.uint64)
    edges = np.array(bounds, np.int64)

    def deal(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
        at = np.searchsorted(edges, ids)
        # rows below the bound are in the first of its ranges, rows at the bound in any
        exact = (at < len(edges)) & (edges[np.minimum(at, len(edges) - 1)] == ids) if len(edges) else np.zeros(len(ids), bool)
        tie = ties.view(np.uint64) ^ np.uint64(1 << 63)  # unsigned, in signed order
        extra = ((tie >> np.uint64(32)) * share[at] >> np.uint64(32)).astype(np.int64)
        return first[at] + np.where(exact, extra, 0)

    return deal


def read_blocks(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, token counts, ranks) of each block of a file."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of token ids")
    while head := stream.read(struct.calcsize(_HEAD)):
        mark, n, tokens, n_control, n_data, crc = struct.unpack(_HEAD, head)
        body = stream.read(12 * n + n_control + n_data)
        if mark != _MARK or zlib.crc32(body) != crc:
            raise ValueError("a damaged block of token ids")
        ids, counts = np.frombuffer(body, "<i8", n), np.frombuffer(body, "<u4", n, 8 * n)
        values = decode(np.frombuffer(body, np.uint8, n_control, 12 * n), np.frombuffer(body, np.uint8, n_data, 12 * n + n_control), counts)
        if len(values) != tokens:
            raise ValueError("a block with another number of tokens than it says")
        yield ids, counts.astype(np.int64), values


def _read(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        with where.open_input_stream(f"{root}/ranks.u32", compression=None) as f:
            ids_by_rank = np.frombuffer(f.read(), "<u4")
        for files in batches:
            for name, base in zip(files.column(0).to_pylist(), files.column(1).to_pylist(), strict=True):
                with where.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for doc_ids, counts, values in read_blocks(stream):
                        ends = np.concatenate(([0], np.cumsum(counts)))
                        yield pa.record_batch({
                            "doc_id": pa.array(doc_ids, pa.int64(), mask=doc_ids == _LAST),
                            "start": pa.array(base + ends[:-1], pa.int64()),
                            "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids_by_rank[values].view(np.int32) if len(values) else np.zeros(0, np.int32))),
                        })
                        base += int(ends[-1])

    return run


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """Rows (doc_id, start, ids array<int>) of the files listed in ``files(file, base)``.

    start: number of ids of all documents before.
    """
    return files.select("file", "base").repartition(max(1, files.count())).mapInArrow(_read(folder), "doc_id long, start long, ids array<int>")
