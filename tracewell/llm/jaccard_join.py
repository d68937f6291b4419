"""N-gram Jaccard join with PartEnum signatures, and the classes that its links form.

The set of a document is its distinct shingles of ``SIZE`` lower-cased words; two documents
link when ``100 * intersection >= 80 * union``.

Method.  Sizes fall into bands whose upper end is 5/4 of their lower end, so linked sets lie
in one band or in neighbouring ones; a set takes part in the instance of its own band and of
the next.  In the instance whose largest size is r, linked sets differ in at most
``k = floor(2r / 9)`` shingles.  PartEnum then has two levels.  The domain of shingles is
partitioned by hash into ``n1 = floor(k / 2) + 1`` parts, and e more; with at most k differences
at least 1 + e of them have one difference or none.  Each part is partitioned again into
``n2 = 3``, and its subsets of ``n2 - 1`` second-level parts are enumerated: a signature is the
projection of the set to such a subset, and a part with one difference or none gives at least one
that linked sets share.  Empty projections are no signatures.  A part is thin for a set that is
empty on some of its subsets; a set with fewer than 1 + e thin parts shares a signature that is
not empty with each set it is linked with.  Sets with more also give the shingles of their
prefix under the hash order as signatures, so they meet each other.  No link is missed.

Equal sets are one node from the start: they have one 64-bit fingerprint, and nodes whose
members differ in a second fingerprint are taken apart.  A bucket of signatures gives groups of
nodes that share one.  Members are verified against the least node of their group, and the links
make components, so a group of many near copies costs one verification per member.  Where a group
still spans several components, its members outside the largest one are compared with the
others by parity sketches, in chunks of bounded size inside the tasks; no pair becomes a row
unless it links them.  A differing shingle changes one bit of a sketch, so more differing bits
than linked sets can have differences rule a link out for certain.  Members with a pair that
is left open meet once more with their whole sets, and pairs are verified by counting shingles
exactly, until links join what they can; no more links than that become rows.

Scale.  A signature that ``LOCAL`` nodes of one block share does not go to its bucket with them:
the bucket gets a mark, and the nodes leave as pieces of the group, rows of at most ``CHUNK``
nodes.  Groups that are larger than that anyhow, and buckets of more than ``HOLD`` bytes, become
pieces as well, so no task and no row has to hold a group.  Beyond ``PARTS`` buckets a partition
has several, which are cut apart and sorted after the shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block import U64, Block, free_names, mix, shingles, slices, together
from .components import components
from .scratch import input_bytes, materialise, small_batches, tasks

SIZE = 5
#: Bytes of text whose blobs leave together, and those of them whose sets are made at once, or one longer document.
BLOCK_BYTES, PART_BYTES = 6 << 20, 1 << 20
#: Signatures in a bucket, about how many a byte of stored input makes, and how many partitions there are at most.
BUCKET_SIGNATURES, PER_BYTE, PARTS = 1_000_000, 0.2, 16_384
#: Nodes of a block that share a signature from which on they leave as a piece, and bytes of a bucket that are held.
LOCAL, HOLD = 32, 128 << 20
#: Bits of the fingerprint of a set.
BITS = 64
#: Wanted nodes up to which their keys are broadcast (12 MB), so that no text is shuffled to find their sets.
BROADCAST_ROWS = 300_000
#: Members of a group that are compared at once, and numbers that they bring along.
CHUNK, CHUNK_LONGS = 2048, 1 << 20
_LAST = np.iinfo(np.int64).max
_SALT = U64(0x5851F42D4C957F2D)


def bands(largest: int) -> tuple[np.ndarray, np.ndarray]:
    """(upper ends of the bands up to one beyond ``largest``, differences allowed in each)."""
    ends = [0]
    while len(ends) < 3 or ends[-2] < largest:
        ends.append((ends[-1] + 1) * 5 // 4)
    upper = np.array(ends[1:], np.int64)
    return upper, 2 * upper // 9


def parts(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first-level parts for ``k`` differences, how many of them are more than it takes)."""
    least = k // 2 + 1
    more = least // 12  # about as many as it takes to make thin parts rare
    return least + more, more


def sets(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle) without repeats, in order, and the size of each document's set."""
    doc, value = shingles(block, block.hashes(), SIZE)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return doc, value, np.bincount(doc, minlength=block.n_docs)


def nodes_of(doc: np.ndarray, value: np.ndarray, n_docs: int, salt: np.uint64 = _SALT) -> np.ndarray:
    """A 64-bit fingerprint of each document's set."""
    out = np.zeros(n_docs, U64)
    np.add.at(out, doc, mix(value ^ salt))
    return mix(out).view(np.int64)


def checks_of(doc: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
    """A second fingerprint, independent of the first."""
    return nodes_of(doc, mix(value), n_docs, U64(0x9FB21C651E98DF25))


def signatures(doc: np.ndarray, value: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature of 48 bits) of sets given as ordered (document, shingle)."""
    out_doc, out_sig = [], []
    if not len(doc):
        return doc, value
    upper, allowed = bands(int(size.max()))
    own = np.searchsorted(upper, size)
    mixed, addend = mix(value), mix(value + _SALT)
    begin = np.cumsum(size) - size
    for step in (0, 1):
        k = allowed[own + step]
        n, more = parts(k)
        n = np.where((k > 0) & (size > 0), n, 0)  # without differences only equal sets link
        base = np.cumsum(n) - n
        use = np.flatnonzero(n[doc] > 0)
        slots = np.zeros(3 * int(n.sum()), U64)
        filled = np.zeros(len(slots), bool)
        at = 3 * base[doc[use]] + (mixed[use] % (3 * n[doc[use]]).astype(U64)).astype(np.int64)
        np.add.at(slots, at, addend[use])
        filled[at] = True
        slots, filled = slots.reshape(-1, 3), filled.reshape(-1, 3)
        owner = np.repeat(np.arange(len(n)), n)
        part = np.arange(len(slots)) - base[owner]
        held, total = filled.sum(1), slots.sum(1, dtype=U64)
        tag = ((own[owner] + step).astype(U64) << U64(34)) + (part.astype(U64) << U64(2))
        for left_out in range(3):
            some = np.flatnonzero(held > filled[:, left_out])
            out_doc.append(owner[some])
            out_sig.append(mix(total[some] - slots[some, left_out] + mix(tag[some] + U64(left_out))))
        thin = np.bincount(owner[held < 2], minlength=len(n))
        for d in np.flatnonzero((n > 0) & (thin > more)):
            own_values = np.sort(mixed[begin[d] : begin[d] + size[d]])[: size[d] // 5 + 1]
            out_doc.append(np.full(len(own_values), d))
            out_sig.append(mix(own_values ^ mix(np.array([own[d] + step + (1 << 44)], U64))))
    return np.concatenate(out_doc), np.concatenate(out_sig) >> U64(16)


def sketch_longs(size: np.ndarray) -> np.ndarray:
    """Length of a set's sketch: a power of two with at least a bit for each shingle."""
    words = np.maximum(1, (size + 63) // 64)
    return 1 << np.ceil(np.log2(words)).astype(np.int64)


def sketches(doc: np.ndarray, value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parity sketches of all sets, one after another: each shingle flips the bit of its hash."""
    n = sketch_longs(size)
    base = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), U64)
    bit = mix(value ^ U64(0x2545F4914F6CDD1D)) % (n[doc] * 64).astype(U64)
    np.bitwise_xor.at(out, base[doc] + (bit >> U64(6)).astype(np.int64), U64(1) << (bit & U64(63)))
    return out.view(np.int64)


#: What a blob has: entries of a bucket, signatures that are marked, or pieces of groups; a positive number counts documents.
_ENTRIES, _MARKS, _PIECES = 0, -1, -2


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal values."""
    start = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(x)))


def _pack_entries(sig: np.ndarray, node: np.ndarray) -> bytes:
    """Entries in the order of their signature: its differences in as many bytes as they need, then the nodes."""
    step = np.diff(sig, prepend=U64(0))
    width = max(1, (int(step.max(initial=0)).bit_length() + 7) // 8)
    return np.array([len(sig), width], np.int64).tobytes() + step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + node.tobytes()


def _entries(blobs: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, nodes) of blobs of entries."""
    sigs, nodes = [], []
    for blob in blobs:
        n, width = np.frombuffer(blob, np.int64, 2).tolist()
        step = np.zeros((n, 8), np.uint8)
        step[:, :width] = np.frombuffer(blob, np.uint8, n * width, 16).reshape(n, width)
        sigs.append(np.cumsum(step.view("<u8").reshape(-1), dtype=U64))
        nodes.append(np.frombuffer(blob, np.uint8, 8 * n, 16 + n * width).copy().view(np.int64))
    return np.concatenate(sigs), np.concatenate(nodes)


def _signed(texts: pa.Array, bits: int, most: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """([node, size, CRC-32, mark] of a block's documents, their sketches, signatures of its sets in order, their nodes).

    Equal sets are signed once.  Sets are made from ``most`` bytes of the text at a time, so what
    is held for the whole block is its results alone.
    """
    docs, drawn, seen, sigs, members = [], [], np.zeros(0, U64), [], []
    for part in slices([pa.record_batch({"text": texts})], "text", most):
        block = Block(part.column("text"), lower=True)
        doc, value, size = sets(block)
        node, mark = nodes_of(doc, value, block.n_docs) >> (64 - bits), checks_of(doc, value, block.n_docs)
        crc = np.array([zlib.crc32(block.document(k)) for k in range(block.n_docs)], np.int64)
        docs.append((node, size.astype(np.int64), crc, mark))
        drawn.append(sketches(doc, value, size))
        key = mix(node.view(U64)) + mark.view(U64)
        one = np.zeros(block.n_docs, bool)
        one[np.unique(key, return_index=True)[1]] = True
        one &= ~np.isin(key, seen)
        seen = np.concatenate((seen, key[one]))
        pick = one[doc]
        owner, sig = signatures(doc[pick], value[pick], np.where(one, size, 0))
        sigs.append(sig)
        members.append(node[owner])
    sig, member = np.concatenate(sigs), np.concatenate(members)
    order = np.argsort(sig)
    return [np.concatenate(x) for x in zip(*docs, strict=True)], np.concatenate(drawn), sig[order], member[order]


def _blobs(ids: np.ndarray, texts: pa.Array, buckets: int, parts: int, bits: int, local: int, most: int) -> pa.RecordBatch:
    """Blobs of one block for the buckets, one partition after another, and one of its documents."""
    docs, drawn, sig, member = _signed(texts, bits, most)
    to = int(mix(docs[0][:1].view(U64))[0] % U64(parts))
    out = ([to], [len(ids)], [np.concatenate((ids, *docs, drawn)).tobytes()])
    start, count = _runs(sig)
    often = count >= local
    hot = np.repeat(often, count)
    if often.any():
        out[0].append(to)
        out[1].append(_PIECES)
        out[2].append(np.concatenate(([often.sum()], sig[start[often]].view(np.int64), count[often], member[hot])).astype(np.int64).tobytes())
    marks = sig[start[often]]
    sig, member = sig[~hot], member[~hot]
    for kind, s, m in ((_ENTRIES, sig, member), (_MARKS, marks, None)):
        part = ((s % U64(buckets)) % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        for a, n in zip(*_runs(part[order]), strict=True):
            i = order[a : a + n]
            out[0].append(int(part[i[0]]))
            out[1].append(kind)
            out[2].append(s[i].tobytes() if m is None else _pack_entries(s[i], m[i]))
    return pa.record_batch({"bucket": pa.array(out[0], pa.int32()), "docs": pa.array(out[1], pa.int32()), "blob": pa.array(out[2], pa.binary())})


def _send(id_column: str, column: str, buckets: int, parts: int, bits: int = 64):
    """The blobs of each block of a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, BLOCK_BYTES):
            ids = pc.fill_null(batch.column(id_column).cast(pa.int64()), _LAST).to_numpy(zero_copy_only=False)
            yield _blobs(ids, batch.column(column), buckets, parts, bits, LOCAL, PART_BYTES)

    return run


def _cut_again(buckets: int, parts: int):
    """Entries and marks of a partition with several buckets, cut by bucket; other blobs go on."""

    def cut(kind: int, held: list[bytes]) -> pa.RecordBatch:
        sig, node = _entries(held) if kind == _ENTRIES else (np.concatenate([np.frombuffer(b, U64) for b in held]), None)
        bucket = (sig % U64(buckets)).astype(np.int64)
        order = np.lexsort((sig, bucket))
        rows = []
        for a, n in zip(*_runs(bucket[order]), strict=True):
            i = order[a : a + n]
            rows.append((int(bucket[i[0]]), kind, sig[i].tobytes() if node is None else _pack_entries(sig[i], node[i])))
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "docs", "blob"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {_ENTRIES: [], _MARKS: []}, 0
        for batch in batches:
            kinds = batch.column("docs").to_numpy()
            other = np.flatnonzero((kinds != _ENTRIES) & (kinds != _MARKS))
            if len(other):
                yield batch.take(pa.array(other))
            for k in np.flatnonzero((kinds == _ENTRIES) | (kinds == _MARKS)).tolist():
                held[int(kinds[k])].append(batch.column("blob")[k].as_py())
                size += len(held[int(kinds[k])][-1])
            if size > HOLD // 2:
                yield from (cut(kind, b) for kind, b in held.items() if b)
                held, size = {_ENTRIES: [], _MARKS: []}, 0
        yield from (cut(kind, b) for kind, b in held.items() if b)

    return run


def _pieces(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """Rows of kind 2 from entries in the order of their signature: its key and some of its nodes."""
    start, count = _runs(sig)
    rows = -(-count // CHUNK)
    at = np.repeat(start, rows) + CHUNK * (np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows))
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(sig)), pa.int32()), pa.array(node))
    return _batch(np.full(len(at), 2, np.int32), sig[at].view(np.int64), lists)


def _group(blobs: list[bytes], marks: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Groups of two nodes or more that share a signature; equal groups once, large and marked ones in pieces."""
    sig, node = _entries(blobs)
    marked = np.unique(np.concatenate([np.frombuffer(b, U64) for b in marks])) if marks else sig[:0]
    order = np.argsort(sig, kind="stable")
    sig, node = sig[order], node[order]
    same = np.zeros(len(sig) + 1, bool)
    same[1:-1] = sig[1:] == sig[:-1]
    pick = np.flatnonzero(same[1:] | same[:-1] | np.isin(sig, marked))
    sig, node = sig[pick], node[pick]
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[new], node[new]
    if not len(sig):
        return
    start, count = _runs(sig)
    large = (count > CHUNK) | np.isin(sig[start], marked)
    if large.any():
        yield _pieces(sig[np.repeat(large, count)], node[np.repeat(large, count)])
    weight = mix(node.view(U64))
    key = mix(np.add.reduceat(weight, start) + count.astype(U64))
    key[large | (count < 2)] = 0
    first = np.unique(key, return_index=True)[1]
    first = np.sort(first[key[first] != 0])
    if len(first):
        length = count[first]
        at = np.repeat(start[first], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        yield _batch(np.zeros(len(first), np.int32), key[first].view(np.int64), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(node[at])))


_OUT = "kind int, key long, nodes array<long>, doc_id long, size long, crc long, mark long"


def _batch(kind, key, nodes, *more) -> pa.RecordBatch:
    n = len(kind)
    out = {"kind": pa.array(kind, pa.int32()), "key": pa.array(key, pa.int64()), "nodes": nodes}
    for k, name in enumerate(("doc_id", "size", "crc", "mark")):
        out[name] = pa.array(more[k], pa.int64()) if more else pa.nulls(n, pa.int64())
    return pa.record_batch(out)


def _receive(batches: Iterable[pa.RecordBatch], hold: int = HOLD) -> Iterator[pa.RecordBatch]:
    bucket, held, marks, size, large = None, [], [], 0, False

    def settle() -> Iterator[pa.RecordBatch]:
        if held and large:
            yield from _whole_pieces(held)
        elif held:
            yield from _group(held, marks)

    for batch in batches:
        for k, count, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if count > 0:
                flat = np.frombuffer(blob.as_py(), np.int64)
                ids, node, sizes, crc, mark = flat[: 5 * count].reshape(5, count)
                ends = np.concatenate(([0], np.cumsum(sketch_longs(sizes))))
                yield _batch(np.ones(count, np.int32), node, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[5 * count :])), ids, sizes, crc, mark)
                continue
            if count == _PIECES:
                flat = np.frombuffer(blob.as_py(), np.int64)
                n = int(flat[0])
                yield _pieces(np.repeat(flat[1 : n + 1].view(U64), flat[n + 1 : 2 * n + 1]), flat[2 * n + 1 :])
                continue
            if k != bucket:
                yield from settle()
                bucket, held, marks, size, large = k, [], [], 0, False
            if count == _MARKS:
                marks.append(blob.as_py())
                continue
            held.append(blob.as_py())
            size += len(held[-1])
            if size > hold:  # from here on all of the bucket leaves in pieces
                yield from _whole_pieces(held)
                held, size, large = [], 0, True
    yield from settle()


def _whole_pieces(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    sig, node = _entries(blobs)
    order = np.argsort(sig)
    yield _pieces(sig[order], node[order])


def _lower(column: str):
    """A-Z in lower case, as blocks have it."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _difference(a, b):
    """Bits in which two sketches differ, the longer one folded first."""

    def fold(x):
        half = F.size(x) / 2
        return F.zip_with(F.slice(x, F.lit(1), half.cast("int")), F.slice(x, (half + 1).cast("int"), half.cast("int")), lambda p, q: p.bitwiseXOR(q))

    a, b = F.when(F.size(a) > F.size(b), fold(a)).otherwise(a), F.when(F.size(b) > F.size(a), fold(b)).otherwise(b)
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda x, y: x + y)


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave open."""
    of = lambda k: nodes.select(F.col("node").alias(k), F.col("size").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    met = pairs.join(of("b"), "b").join(of("a"), "a").where("4 * greatest(na, nb) <= 5 * least(na, nb)")
    return met.where(9 * _difference(F.col("sa"), F.col("sb")) <= F.col("na") + F.col("nb")).select("a", "b")


def _meetings(entries: DataFrame, roots: DataFrame, nodes: DataFrame, values: int, least: int) -> DataFrame:
    """Rows (key, lo, hi, chunk, node, root, main, data) of the groups in ``entries(key, node)`` that span components.

    Groups with fewer than ``least`` members do not meet: 3 where every member was already
    verified against the least one, 2 where ``entries`` has only some members of a group.
    ``nodes(node, weight, data)`` has what a member brings along.  Members of the largest
    component, and those of all others, are dealt by hash into chunks of about ``CHUNK`` members and
    of weights of about ``values``.  Each chunk of the others meets each chunk in one place, so
    neither a task nor a row ever has a whole group, and a large component is sent once for each
    chunk of the others.
    """
    placed = entries.join(roots, "node", "left").join(nodes.select("node", "weight"), "node").withColumn("root", F.coalesce("root", "node"))
    counts = placed.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    spans = counts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("roots"), F.max(F.struct("n", "root", "w")).alias("main")).where(f"roots > 1 and n >= {least}")
    chunks = lambda n, w: F.ceil(F.greatest(n / CHUNK, w / values)).cast("int")
    spans = spans.select("key", F.col("main.root").alias("main"), chunks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("rests"), chunks(F.col("main.n"), F.col("main.w")).alias("mains"))
    rows = placed.join(spans, "key").join(nodes.select("node", "data"), "node").withColumn("main", F.col("root") == F.col("main"))
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    chunk = F.when(F.col("main"), F.col("rests") + deal(F.col("mains"))).otherwise(deal(F.col("rests")))
    others = F.col("rests") + F.when(F.col("main"), 0).otherwise(F.col("mains")) - 1
    rows = rows.select("key", "node", "root", "main", "data", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), others)).alias("other"))
    rows = rows.select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "node", "root", "main", "data")
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def _fold(flat: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Sketches of one length, the longer ones folded; ``places`` has the start and length of each."""
    start, size = places
    out = np.zeros((len(start), length), U64)
    for n in np.unique(size):
        pick = np.flatnonzero(size == n)
        part = flat[start[pick][:, None] + np.arange(n)].reshape(len(pick), n // length, length)
        out[pick] = np.bitwise_xor.reduce(part, 1)
    return out


def _open_pairs(x: dict, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (p, q) of pairs from i and j of different components that may be linked."""
    step = max(1, (1 << 21) // max(1, len(j) * x["sketch"].shape[1]))
    for k in range(0, len(i), step):
        part = i[k : k + step]
        bits = np.bitwise_count(x["sketch"][part][:, None, :] ^ x["sketch"][j][None, :, :]).sum(2, dtype=np.int64)
        na, nb = x["size"][part][:, None], x["size"][j][None, :]
        may = (9 * bits <= na + nb) & (4 * np.maximum(na, nb) <= 5 * np.minimum(na, nb)) & (x["root"][part][:, None] != x["root"][j][None, :])
        p, q = np.nonzero(may)
        yield part[p], j[q]


def _compare(x: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Open pairs of the two chunks of a group, or inside its one chunk, some at a time."""
    first = np.flatnonzero(x["chunk"] == x["lo"])
    yield from _open_pairs(x, first, first if x["lo"] == x["hi"] else np.flatnonzero(x["chunk"] == x["hi"]))


def _meet(held: list[pa.RecordBatch]) -> tuple[dict, np.ndarray, np.ndarray]:
    """The members of two chunks, and the offsets and values of what they bring."""
    t = together(held)
    lists = t.column("data")
    x = {k: t.column(k).to_numpy(zero_copy_only=False) for k in ("chunk", "node", "root", "main")}
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy().view(U64)[offsets[0] : offsets[-1]]
    return x | {k: t.column(k)[0].as_py() for k in ("key", "lo", "hi")}, offsets - offsets[0], flat


def _open_members(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Members with an open pair, by their sketches; data is the size and the sketch."""
    x, offsets, flat = _meet(held)
    x["size"] = flat[offsets[:-1]].astype(np.int64)
    length = np.diff(offsets) - 1
    x["sketch"] = _fold(flat, np.stack((offsets[:-1] + 1, length)), int(length.min()))
    some = np.zeros(len(x["node"]), bool)
    for p, q in _compare(x):
        some[p] = some[q] = True
    node = x["node"][some]
    return pa.record_batch({"key": pa.array(np.full(len(node), x["key"], np.int64)), "node": pa.array(node)})


def _forest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Links that join components, no more than it takes; data is the set itself.

    A pair is verified by counting equal shingles unless links found before have joined its
    components already.
    """
    x, offsets, flat = _meet(held)
    x["size"] = np.diff(offsets).astype(np.int64)
    length = sketch_longs(x["size"])
    x["sketch"] = _fold(sketches(np.repeat(np.arange(len(x["size"])), x["size"]), flat, x["size"]).view(U64), np.stack((np.cumsum(length) - length, length)), int(length.min()))
    x["root"] = x["root"].copy()
    links = []
    for p, q in _compare(x):
        cut = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else []
        for a, b in zip(cut, np.append(cut[1:], len(p)), strict=True) if len(p) else ():
            one, others = int(p[a]), q[a:b]
            mine = flat[offsets[one] : offsets[one + 1]]
            while len(others := others[x["root"][others] != x["root"][one]]):
                other, others = int(others[0]), others[1:]
                both = np.concatenate((mine, flat[offsets[other] : offsets[other + 1]]))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= 80 * (len(both) - shared):
                    links.append((int(x["node"][one]), int(x["node"][other])))
                    x["root"][x["root"] == x["root"][other]] = x["root"][one]
    return pa.record_batch({"a": pa.array([min(x) for x in links], pa.int64()), "b": pa.array([max(x) for x in links], pa.int64())})


def _each_meeting(settle):
    """Applies ``settle`` to the rows of each two chunks, which come sorted by (key, lo, hi)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("key", "lo", "hi")], 1)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for a, b in zip(np.append(0, cut), np.append(cut, len(key)), strict=True):
                if a == b:
                    continue
                now = tuple(key[a].tolist())
                if now != last and held:
                    yield settle(held)
                    held = []
                last = now
                held.append(batch.slice(a, b - a))
        if held:
            yield settle(held)

    return run


def _across(entries: DataFrame, roots: DataFrame, nodes: DataFrame, slim: DataFrame) -> DataFrame:
    """Links (a, b) between components inside groups, at least as many as join what is linked.

    First sketches tell which members have an open pair with another component at all; only
    these meet again with their whole sets, and only links that join components become rows.
    """
    brief = nodes.select("node", F.size("sketch").alias("weight"), F.concat(F.array("size"), "sketch").alias("data"))
    some = _meetings(entries, roots, brief, CHUNK_LONGS, 3).mapInArrow(_each_meeting(_open_members), "key long, node long")
    some = materialise(_each_set_once(materialise(some.distinct(), "open-members")), "open-groups")
    if some.isEmpty():
        return entries.sparkSession.createDataFrame([], "a long, b long")
    whole = _sets_of(some, slim, nodes).select("node", F.size("shingles").alias("weight"), F.col("shingles").alias("data"))
    return materialise(_meetings(some, roots, whole, CHUNK_LONGS, 2).mapInArrow(_each_meeting(_forest), "a long, b long").distinct(), "links")


def _sets_of(wanted: DataFrame, slim: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (node, shingles) of the nodes in ``wanted(node)``."""
    keepers = nodes.join(wanted.select("node").distinct(), "node", "left_semi").select("node", "print", "row.doc_id", "row.crc", "row.mark")
    keepers = materialise(keepers, "keepers")
    few = keepers.count() <= BROADCAST_ROWS
    texts = slim.withColumn("doc_id", F.coalesce("doc_id", F.lit(int(_LAST)))).join(F.broadcast(keepers) if few else keepers, ["doc_id", "crc"]).select("node", "print", "mark", "text")
    held = materialise(texts.mapInArrow(_exact_sets(BITS), "node long, shingles array<long>"), "sets")
    return held.dropDuplicates(["node"])


def _verified(pairs: DataFrame, slim: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are at least 80 % similar."""
    held = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), slim, nodes)
    left = held.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = held.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    size_a, size_b = F.size("sa"), F.size("sb")
    met = pairs.join(right, "b").join(left, "a")
    return met.where(100 * both >= 80 * (size_a + size_b - both)).select("a", "b").distinct()


def _each_set_once(entries: DataFrame) -> DataFrame:
    """``entries(key, node)`` without the groups that have the same nodes as another one."""
    prints = [F.bit_xor(F.xxhash64("node", F.lit(k))) for k in (1, 2)]
    groups = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), *[p.alias(f"x{k}") for k, p in enumerate(prints)])
    once = groups.where("n > 1").groupBy("n", "lo", "hi", "x0", "x1").agg(F.min("key").alias("key"))
    return entries.join(once.select("key"), "key", "left_semi")


def _to_least(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of the least node of each group in ``entries(key, node)`` and every other one."""
    least = entries.groupBy("key").agg(F.min("node").alias("a"))
    return entries.join(least, "key").where("a <> node").select("a", F.col("node").alias("b"))


def _reached(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, crc, size, root), one for each row of ``docs``.

    crc: of the lower-cased text; a null id is the largest one; root: a node of the row's class.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim = slim.withColumn("crc", F.crc32(_lower("text").cast("binary")))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(docs)
    buckets = max(shuffles, math.ceil(size * PER_BYTE / BUCKET_SIGNATURES)) if size < 1 << 55 else shuffles
    parts = min(buckets, PARTS)
    dealt = slim.select("doc_id", "text").mapInArrow(_send("doc_id", "text", buckets, parts, BITS), "bucket int, docs int, blob binary")
    dealt = dealt.repartitionById(tasks(parts, buckets, spark.sparkContext.defaultParallelism), F.col("bucket"))  # by number: a hash leaves tasks empty and fills others
    if parts < buckets:
        dealt = dealt.mapInArrow(_cut_again(buckets, parts), dealt.schema)
    hold = HOLD
    found = materialise(dealt.sortWithinPartitions("bucket").mapInArrow(lambda batches: _receive(batches, hold), _OUT), "signature-groups")
    members = found.where("kind = 1").select("doc_id", "crc", "size", "mark", F.col("nodes").alias("sketch"), F.col("key").alias("print"), F.col("key").alias("node"))
    groups = materialise(found.where("kind = 0").groupBy("key").agg(F.first("nodes").alias("nodes")), "groups")
    pieces = found.where("kind = 2").select("key", F.explode("nodes").alias("node")).distinct()
    pieces = materialise(_each_set_once(pieces), "pieces")
    entries = groups.select("key", F.explode("nodes").alias("node")).unionByName(pieces)
    pairs = groups.select(F.col("nodes")[0].alias("a"), F.explode(F.slice("nodes", 2, 2147483647)).alias("b")).unionByName(_to_least(pieces))
    # fingerprints that sets of different documents share: such a node becomes one for each set
    clash = materialise(members.groupBy("node").agg(F.min("mark").alias("m"), F.max("mark").alias("n")).where("m <> n").select("node", "m"), "clashes")
    if not clash.isEmpty():
        real = F.when(F.col("m").isNull() | (F.col("mark") == F.col("m")), F.col("node")).otherwise(F.xxhash64("node", "mark"))
        members = members.join(clash, "node", "left").withColumn("node", real).drop("m")
        several = members.join(clash.withColumnRenamed("node", "print"), "print", "left_semi").select("print", F.col("node").alias("other")).distinct()
        entries = entries.join(several, entries["node"] == several["print"], "left").select("key", F.coalesce("other", "node").alias("node"))
        pairs = _to_least(entries)
    nodes = members.groupBy("node").agg(F.min(F.struct("doc_id", "crc", "mark")).alias("row"), F.first("print").alias("print"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    open_pairs = materialise(_possible(pairs.distinct(), nodes), "pairs")
    links = materialise(_verified(open_pairs, slim, nodes), "links")
    roots = components(links)
    late = _across(entries, roots, nodes, slim)
    if not late.isEmpty():
        roots = components(links.unionByName(late))
    return members.join(roots, "node", "left").select("doc_id", "crc", "size", F.coalesce("root", "node").alias("root"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of ``docs``.

    component_id is the smallest id that links reach, the row's own included.  A null, empty
    or blank text has no shingles and links with nothing.  Rows with a null id take part, but
    a null is never the smallest id unless the class has no other.  Rows that share an id are
    rows of their own.  Ids are whole numbers, or texts of such; others end with an error.
    """
    reached = _reached(docs, id_col, text_col)
    least = reached.where("size > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = reached.join(least, "root", "left")
    null = F.lit(None).cast("long")
    real = lambda c: F.when(c == F.lit(int(_LAST)), null).otherwise(c)
    return out.select(
        real(F.col("doc_id")).alias("doc_id"),
        F.col("size").alias("n_shingles"),
        real(F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each class of linked documents, columns unchanged.

    The row with the smallest id stays, a null id being the largest; of rows with that id the one
    whose text has the smallest CRC-32, and one of those that have both alike.  Rows are judged, not
    ids: a row that shares its id with a copy but has another text stays.  Rows without
    shingles all stay.
    """
    reached = materialise(_reached(docs, id_col, text_col).where("size > 0"), "reached")
    key = ["doc_id", "crc"]
    kept = reached.groupBy("root").agg(F.min(F.struct(*key)).alias("kept"))
    gone = reached.join(kept, "root").where(F.struct(*key) != F.col("kept")).select(*key).distinct()
    again = materialise(reached.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key).join(gone, key, "left_anti"), "again")
    names = free_names(docs.columns, "_id", "_crc")
    as_named = lambda df: df.toDF(*names)
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = docs.withColumns({names[0]: F.coalesce(F.col(id_col).cast("long"), F.lit(int(_LAST))), names[1]: F.crc32(_lower(text).cast("binary"))}).join(as_named(gone), names, "left_anti")
    if not again.isEmpty():
        left = left.join(as_named(again), names, "left_anti").unionByName(left.join(as_named(again), names, "left_semi").dropDuplicates(names))
    return left.select(*docs.columns)


def _exact_sets(bits: int):
    """(node, shingles) of the rows that have the fingerprints of the node that was asked for, once in a task.

    A row that only shares the id of the asked one has other fingerprints.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "text", PART_BYTES):
            block = Block(batch.column("text"), lower=True)
            doc, value, size = sets(block)
            asked, printed, mark = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("node", "print", "mark"))
            right = (nodes_of(doc, value, block.n_docs) >> (64 - bits) == printed) & (checks_of(doc, value, block.n_docs) == mark)
            for k in np.flatnonzero(right).tolist():
                right[k] = int(asked[k]) not in seen
                seen.add(int(asked[k]))
            value = value[right[doc]]
            ends = np.concatenate(([0], np.cumsum(size[right])))
            yield pa.record_batch({"node": pa.array(asked[right]), "shingles": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value.view(np.int64)))})

    return run
