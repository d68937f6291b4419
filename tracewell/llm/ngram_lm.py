"""LM scoring with an n-gram trie of order 3 in Elias-Fano levels.

The model is a word trigram model with Witten-Bell smoothing, learned from the documents whose
``crc32(doc_id as text) mod 10`` is not 0.  Tokens are lower-cased words and one end per
document.

Trie.  For each middle word the trie keeps its successors and its left contexts, for each
context its trigrams.  A trigram stores its last word not as a word id but as the rank of that
word among the successors of the middle word, found by successor search in the shorter context's
level.  Levels and pointers are monotone and held in Elias-Fano form; each entry has its
smoothed log10 probability, or backoff weight, in one byte, which is within ``0.5 / STEP`` of
its value.  An image is one file in shared storage, and is mapped into memory and queried in
place.

Scale.  The trie is sharded by middle word.  A block of documents sends each shard the
trigrams it has for it, as one compressed blob with training and scoring occurrences alike;
the shard counts, writes its image, answers from it, and returns a sum per document.  Nothing is
ever held whole.  A middle word with more than ``SPLIT`` training tokens is dealt over shards by
the hash of the last word.  That is placement only: tokens and types of such a word and of its
contexts are added up over the shards and sent back before the images are written, so a score is
a function of the documents, whatever the number of shards or partitions.  Beyond ``PARTS``
shards a partition has several: its blobs are cut again by shard and sorted, and one shard at a
time is in memory.

Tasks know the ``LISTED`` most frequent words and their counts (16 MB), which makes blobs small.
Other words travel as hashes with the blob, are as much a part of the model, and each shard is
sent the counts of those that it asks for.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block import U64, Block, give_back, mix, slices
from .elias_fano import EliasFano
from .scratch import materialise, new_path

BLOCK_BYTES = 4 << 20
BITS = 21
#: Words that tasks know.  Ids 0 and 1 are reserved; from RARE on an id is a place in a blob's own table.
LISTED = (1 << 20) - 8
START, END, FIRST, RARE = 0, 1, 2, 1 << 20
START_HASH, END_HASH = np.int64(0x0123456789ABCDEF), np.int64(0x2E3779B97F4A7C15)
#: Tokens that a shard should have.
SHARD_TOKENS = 1_200_000
#: Training tokens of a middle word beyond which it is dealt over several shards.
SPLIT = 375_000
#: Leading bits of a hash by which listed words are found.
TOP = 20
PARTS = 16_384
#: Bytes of blobs that are cut by shard at once where a partition has several.
CUT_BYTES = 8 << 20
STEP = 24.0  # codes of a byte are steps of 1 / STEP in -log10
_MASK = (1 << BITS) - 1
DOCS, PLAIN, SPREAD, SUMS, COUNTS = range(5)  # kinds of blobs


def _quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEP), 0, 255).astype(np.uint8)


def _value(code: np.ndarray) -> np.ndarray:
    return code / -STEP


class Vocabulary:
    """The listed words: sorted hashes and counts, and totals of all words.

    least: every word with at least so many training tokens is listed; 1 means all.
    docs: training documents, which is the count of ends.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, distinct: int, docs: int, least: int, split: int):
        self.given = hashes, counts, tokens, distinct, docs, least, split
        self.tokens, self.least = tokens, least
        self.z = tokens + 0.1 * (distinct + 1)
        self.hashes = np.concatenate(([START_HASH, END_HASH], hashes))
        self.counts = np.concatenate(([docs, docs], counts))
        self.classes = np.maximum(1, -(-self.counts // split))
        # where the listed hashes with each leading TOP bits begin
        self.begin = FIRST + np.searchsorted(hashes, np.arange((1 << TOP) + 1) << (62 - TOP))

    def __reduce__(self):
        return Vocabulary, self.given  # what follows from these is computed again where it arrives

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Id of each hash, -1 for words that are not listed."""
        out = np.full(len(hashes), -1, np.int32)
        top = hashes >> (62 - TOP)
        at, end = self.begin[top], self.begin[top + 1]
        open_ = np.flatnonzero(at < end)
        at, end = at[open_], end[open_]
        while len(open_):
            hit = self.hashes[at] == hashes[open_]
            out[open_[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            open_, at, end = open_[more], at[more] + 1, end[more]
        out[hashes == END_HASH] = END
        return out

    def log1(self, counts: np.ndarray) -> np.ndarray:
        """log10 probability of words with these counts."""
        return np.log10((counts + 0.1) / self.z)


class Trie:
    """The trigrams of some middle words, by word ids.

    Levels: rare (hashes of the words whose ids begin at RARE), middle (ids), successor (middle,
    last), context (middle, first), base (pointers), trigram (context, rank of the last word among
    the successors).
    """

    LEVELS = ("rare", "middle", "successor", "context", "base", "trigram")
    CODES = ("successor_backoff", "successor", "context_backoff", "trigram")

    def __init__(self, levels: dict[str, EliasFano], codes: dict[str, np.ndarray]):
        self.levels, self.codes = levels, codes
        self.bits = (RARE + levels["rare"].n).bit_length()

    @classmethod
    def build(cls, middle: np.ndarray, first: np.ndarray, last: np.ndarray, count: np.ndarray, log1: np.ndarray, rare: np.ndarray, whole=None) -> Trie:
        """From distinct trigrams in order of (middle, first, last), with the last word's log10 unigram probability.

        whole(middle, first) and whole(middle, None) give (places, tokens, types) of those of the
        contexts, or middle words, that have further trigrams elsewhere.
        """
        bits = (RARE + len(rare)).bit_length()
        middle, first, last = (x.astype(np.int64) for x in (middle, first, last))
        middles = np.unique(middle)
        pair, at, which = np.unique(middle << bits | last, return_index=True, return_inverse=True)
        c2 = np.bincount(which, count, len(pair))
        begin = np.searchsorted(pair, np.append(middles, 1 << bits) << bits)
        width = np.diff(begin)
        of = np.repeat(np.arange(len(middles)), width)
        total, types = np.bincount(of, c2, len(middles)), width.copy()
        key = middle << bits | first
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        context, size = key[start], np.diff(np.append(start, len(key)))
        c_total, c_types = np.add.reduceat(count, start) if len(start) else count[:0], size.copy()
        mine = np.searchsorted(middles, context >> bits)
        if whole is not None:
            place, n, t = whole(middles, None)
            total[place], types[place] = n, t
            place, n, t = whole(middle[start], first[start])
            c_total[place], c_types[place] = n, t
        p2 = (c2 + types[of] * 10.0 ** log1[at]) / (total + types)[of]
        owner = np.repeat(np.arange(len(context)), size)
        p3 = (count + c_types[owner] * p2[which]) / (c_total + c_types)[owner]
        base = np.concatenate(([0], np.cumsum(width[mine])))
        rank = which - begin[mine][owner]
        levels = {
            "rare": EliasFano.of(rare, 1 << 62), "middle": EliasFano.of(middles, 1 << bits), "successor": EliasFano.of(pair, 1 << 2 * bits), "context": EliasFano.of(context, 1 << 2 * bits),
            "base": EliasFano.of(base), "trigram": EliasFano.of(base[owner] + rank, int(base[-1]) + 1),
        }
        codes = {
            "successor_backoff": _quantise(np.log10(types / (total + types))), "successor": _quantise(np.log10(p2)),
            "context_backoff": _quantise(np.log10(c_types / (c_total + c_types))), "trigram": _quantise(np.log10(p3)),
        }
        return cls(levels, codes)

    def to_bytes(self) -> bytes:
        parts = [self.levels[k].to_bytes() for k in self.LEVELS]
        for k in self.CODES:
            parts += [struct.pack("<q", len(self.codes[k])), self.codes[k].tobytes()]
        return b"".join(parts)

    @classmethod
    def from_buffer(cls, buffer) -> Trie:
        at, levels, codes = 0, {}, {}
        for k in cls.LEVELS:
            levels[k], at = EliasFano.from_buffer(buffer, at)
        for k in cls.CODES:
            n = struct.unpack_from("<q", buffer, at)[0]
            codes[k] = np.frombuffer(buffer, np.uint8, n, at + 8)
            at += 8 + n
        return cls(levels, codes)

    @classmethod
    def open(cls, folder: str, shard: int) -> Trie:
        """The image of a shard: mapped where the file system is local to the task, else read.

        A shard without an image has no trigrams.
        """
        where, root = fs.FileSystem.from_uri(folder)
        path = f"{root}/{shard:08d}.trie"
        if where.get_file_info(path).type == fs.FileType.NotFound:
            none = np.zeros(0, np.int64)
            return cls.build(none, none, none, none, none.astype(np.float64), none)
        if where.type_name == "local":
            return cls.from_buffer(pa.memory_map(path).read_buffer())
        with where.open_input_file(path) as f:
            return cls.from_buffer(f.read_buffer())

    def save(self, folder: str, shard: int) -> None:
        """Write the image under its name at once, so that a task that runs again does no harm."""
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        name = f"{root}/{shard:08d}-{uuid.uuid4().hex}.tmp"
        with where.open_output_stream(name, compression=None) as f:
            f.write(self.to_bytes())
        where.move(name, f"{root}/{shard:08d}.trie")

    @staticmethod
    def remove(folder: str, shard: int) -> None:
        where, root = fs.FileSystem.from_uri(folder)
        where.delete_file(f"{root}/{shard:08d}.trie")

    def ids(self, rare: np.ndarray) -> np.ndarray:
        """The ids of words that are not listed, by their hashes; those unknown here get one beyond all ids."""
        at = self.levels["rare"].find(rare)
        return RARE + np.where(at < 0, self.levels["rare"].n, at)

    def score(self, middle: np.ndarray, first: np.ndarray, last: np.ndarray, log1: np.ndarray, elsewhere=None) -> np.ndarray:
        """log10 probability of each last word after (first, middle).

        elsewhere(places, with_first) gives the backoff weights of contexts, or of middle words, that
        have no trigram here; without it they have none anywhere.
        """
        level, code, bits = self.levels, self.codes, self.bits
        m, f, w = (x.astype(np.int64) for x in (middle, first, last))
        middles, which = np.unique(m, return_inverse=True)
        place = level["middle"].find(middles)
        begin = level["successor"].successor(np.where(place >= 0, middles, 0) << bits)
        bigram = level["successor"].find(m << bits | w)
        context = level["context"].find(m << bits | f)
        out = log1.copy()
        known = place[which]
        for at, codes, with_first in ((known, code["successor_backoff"], False), (context, code["context_backoff"], True)):
            weight = np.zeros(len(out))
            here = np.flatnonzero(at >= 0)
            weight[here] = _value(codes[at[here]])
            if elsewhere is not None:
                there = np.flatnonzero(at < 0)
                weight[there] = elsewhere(there, with_first)
            if with_first:
                seen = np.flatnonzero(bigram >= 0)
                out[seen] = _value(code["successor"][bigram[seen]])
            out += weight
        both = np.flatnonzero((context >= 0) & (bigram >= 0))
        rank = bigram[both] - begin[which[both]]
        trigram = level["trigram"].find(level["base"].get(context[both]) + rank)
        hit = trigram >= 0
        out[both[hit]] = _value(code["trigram"][trigram[hit]])
        return out


def held_out(ids: list) -> np.ndarray:
    """Whether each document is held out; a null id is taken as an empty text."""
    return np.array([zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0 for i in ids], bool)


def _tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(hash of 62 bits, document) of each token, with the end of each document."""
    value = np.insert((block.hashes() >> U64(2)).view(np.int64), block.first[1:], END_HASH)
    return value, np.repeat(np.arange(block.n_docs, dtype=np.int32), np.diff(block.first) + 1)


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 2 * BLOCK_BYTES):
        train = ~held_out(batch.column("doc_id").to_pylist())
        value, doc = _tokens(Block(batch.column("text"), lower=True))
        word, n = np.unique(value[train[doc]], return_counts=True)
        yield pa.record_batch({"word": pa.array(word), "n": pa.array(n)})


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (word, n): training tokens of each word, by the hash of the word."""
    rows = docs.mapInArrow(_count_words, "word long, n long")
    return materialise(rows.groupBy("word").agg(F.sum("n").alias("n")), "words")


def vocabulary(words: DataFrame, limit: int = LISTED) -> Vocabulary:
    """The words with at least so many tokens that no more than ``limit`` are listed."""
    by_count = words.groupBy("n").agg(F.count("*").alias("words"))
    # a row per distinct count: their number grows with the square root of the tokens
    table = by_count.toArrow().sort_by([("n", "descending")])
    n, size = table["n"].to_numpy(), table["words"].to_numpy()
    fits = np.cumsum(size) <= limit
    least = int(n[fits][-1]) if fits.any() else (int(n[0]) + 1 if len(n) else 1)
    if fits.all():
        least = 1
    listed = words.where((F.col("n") >= least) & (F.col("word") != int(END_HASH))).toArrow()
    order = np.argsort(listed["word"].to_numpy())
    hashes, counts = listed["word"].to_numpy()[order], listed["n"].to_numpy()[order]
    ends = words.where(F.col("word") == int(END_HASH)).first()
    return Vocabulary(hashes, counts, int((n * size).sum()), int(size.sum()), ends["n"] if ends else 0, least, SPLIT)


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Integers byte plane by byte plane, which is how sorted differences compress best."""
    head = struct.pack(f"<{len(arrays)}q", *map(len, arrays))
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in arrays))


def _unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * len(kinds), []
    for n, kind in zip(struct.unpack_from(f"<{len(kinds)}q", raw), kinds, strict=True):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(kind))
        at += n * size
    return out


_BLOBS = "shard int, kind int, block long, blob binary"
_DOC = [np.int64, np.uint8, np.int64, np.int64, np.float64]  # id, flags, tokens, known, base sum
#: Keys (differences), 2 * document + held out, place of the block, blocks, hashes of rare words, whether one is a last word; and the shard where a blob has several.
_OCCURRENCES = [np.int64, np.uint32, np.uint16, np.int64, np.int64, np.uint8, np.int32]


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["shard", "kind", "block", "blob"])


def _pack_occurrences(key: np.ndarray, owner: np.ndarray, block: np.ndarray, blocks: np.ndarray, rare: np.ndarray, shard: np.ndarray) -> bytes:
    """One blob; ``key`` is in order within each shard, ids from RARE on are places in ``rare``."""
    used, is_last = rare[:0], np.zeros(0, np.uint8)
    if len(rare):
        kinds, far = np.zeros(len(rare), np.uint8), []
        for role, s in enumerate((2 * BITS, BITS, 0)):
            w = key >> s & _MASK
            at = np.flatnonzero(w >= RARE)
            far.append((at, w[at] - RARE, s))
            kinds[far[-1][1]] |= 1 << role
        asked = np.flatnonzero(kinds)
        used, is_last = rare[asked], kinds[asked] >> 2
        kinds = np.zeros(len(rare), np.int64)
        kinds[asked] = np.arange(len(asked))
        for at, w, s in far:
            key[at] += kinds[w] - w << s
    several = len(shard) and shard[0] != shard[-1]
    return _pack([np.diff(key, prepend=0), owner, block.astype(np.uint16), blocks, np.diff(used, prepend=0), is_last, np.diff(shard, prepend=np.int32(0)) if several else shard[:0]])


@dataclass
class _Opened:
    """Occurrences of some blobs: word ids (from RARE on places in ``rare``), owners and blocks."""

    one: np.ndarray
    two: np.ndarray
    last: np.ndarray
    owner: np.ndarray
    block: np.ndarray
    blocks: np.ndarray
    rare: np.ndarray
    asked: np.ndarray  # the rare words that are last words
    shard: np.ndarray | None

    @classmethod
    def of(cls, blobs: Iterable[bytes]) -> _Opened:
        parts = [_unpack(b, _OCCURRENCES) for b in blobs]
        tables = [np.cumsum(p[4]) for p in parts]
        rare = np.unique(np.concatenate(tables))
        words: tuple[list, list, list] = ([], [], [])
        at, blocks = [], []
        for p, table in zip(parts, tables, strict=True):
            key, place = np.cumsum(p[0]), RARE + np.searchsorted(rare, table)
            for k, s in enumerate((2 * BITS, BITS, 0)):
                w = (key >> s & _MASK).astype(np.int32)
                if len(table):
                    far = np.flatnonzero(w >= RARE)
                    w[far] = place[w[far] - RARE]
                words[k].append(w)
            at.append(p[2].astype(np.int32) + sum(map(len, blocks)))
            blocks.append(p[3])
        shard = np.concatenate([np.cumsum(p[6], dtype=np.int32) for p in parts])
        asked = np.unique(np.concatenate([t[p[5] > 0] for p, t in zip(parts, tables, strict=True)]))
        return cls(*map(np.concatenate, words), np.concatenate([p[1] for p in parts]), np.concatenate(at), np.concatenate(blocks), rare, asked, shard if len(shard) else None)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words of the distinct trigrams in order, their training counts, trigram of each occurrence)."""
        if RARE + len(self.rare) <= 1 << BITS:
            key = self.one.astype(np.int64) << 2 * BITS | self.two.astype(np.int64) << BITS | self.last
            key, which = np.unique(key, return_inverse=True)
            one, two, last = (x.astype(np.int32) for x in (key >> 2 * BITS, key >> BITS & _MASK, key & _MASK))
        else:  # too many rare words for three ids in one number: contexts first
            pair, at = np.unique(self.one.astype(np.int64) << 31 | self.two, return_inverse=True)
            key, which = np.unique(at << 31 | self.last, return_inverse=True)
            one, two, last = (x.astype(np.int32) for x in (pair[key >> 31] >> 31, pair[key >> 31] & (1 << 31) - 1, key & (1 << 31) - 1))
        return one, two, last, np.bincount(which[(self.owner & 1) == 0], minlength=len(key)), which


def _send(vocab, shards: int, parts: int, learn: bool, ask: bool):
    """Blobs: occurrences of trigrams for a shard (or, of several, for a part), and the documents of a block.

    learn: without it all documents count as held out.  ask: without it held-out documents are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, "text", BLOCK_BYTES)):
            doc_ids = batch.column("doc_id").to_pylist()
            held = held_out(doc_ids)
            block = Block(batch.column("text"), lower=True)
            value, doc = _tokens(block)
            ids, n = v.ids(value), block.n_docs
            name = part << 32 | number
            counts = np.where(ids >= 0, v.counts[ids], 0)
            base = np.where(ids >= 0, v.log1(counts), 0.0 if v.least > 1 else v.log1(0))
            rows = [np.array([i or 0 for i in doc_ids], np.int64), held.astype(np.uint8) + np.uint8(2) * np.array([i is None for i in doc_ids], np.uint8), np.diff(block.first) + 1, np.bincount(doc, counts > 0, n).astype(np.int64), np.bincount(doc, base, n)]
            out = [(name % shards, DOCS, name, _pack(rows))]
            del counts, base
            rare = np.unique(value[ids < 0])
            last = ids.copy()
            last[ids < 0] = RARE + np.searchsorted(rare, value[ids < 0])
            start = block.first[:-1] + np.arange(n)
            one, two = np.roll(last, 1), np.roll(last, 2)
            one[start] = START
            two[start] = START
            two[np.minimum(start + 1, len(two) - 1)[np.diff(block.first) > 0]] = START
            before = np.concatenate(([START_HASH], value[:-1]))
            before[start] = START_HASH
            classes = np.where(one < RARE, v.classes[np.minimum(one, len(v.classes) - 1)], 1)
            shard = (mix(before.view(U64) + (mix(value.view(U64)) % classes.astype(U64)) * U64(0x9E3779B97F4A7C15)) % U64(shards)).astype(np.int32)
            spread = classes > 1
            del before, value, ids, classes
            flag = (doc.astype(np.uint32) << np.uint32(1)) | (held[doc] if learn else np.ones(len(doc), bool)).astype(np.uint32)
            use = np.arange(len(last)) if ask else np.flatnonzero(~held[doc])
            # a table has room for so many words as so many tokens may have
            step = len(use) if len(rare) < (1 << BITS) - RARE else 1 << 18
            for a in range(0, len(use), max(1, step)):
                some = use[a : a + step]
                table = rare
                o, t, w = one[some], two[some], last[some]
                if step < len(use):
                    table = np.unique(np.concatenate([x[x >= RARE] for x in (o, t, w)]))
                    o, t, w = (np.where(x >= RARE, RARE + np.searchsorted(table, x), x) for x in (o, t, w))
                    table = rare[table - RARE]
                key = o.astype(np.int64) << 2 * BITS | t.astype(np.int64) << BITS | w
                del o, t, w
                group = shard[some] % parts * 2 + spread[some]
                order = np.argsort(key)
                if parts < shards:
                    order = order[np.argsort(shard[some][order], kind="stable")]
                order = order[np.argsort(group[order].astype(np.uint16 if 2 * parts <= 1 << 16 else np.int32), kind="stable")]
                key, owner, group, mine = key[order], flag[some][order], group[order], shard[some][order]
                cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                for i, j in zip(cut, np.append(cut[1:], len(group)), strict=True):
                    blob = _pack_occurrences(key[i:j], owner[i:j], np.zeros(j - i, np.uint16), np.array([name]), table, mine[i:j])
                    out.append((int(mine[i]) if parts == shards else int(group[i]) >> 1, SPREAD if group[i] & 1 else PLAIN, name, blob))
            yield _blobs(out)

    return run


def _cut_again(parts: int):
    """Blobs of a part with several shards, to blobs of one shard each; other kinds go on."""

    def cut(kind: int, held: list[bytes], part: int) -> pa.RecordBatch:
        x = _Opened.of(held)
        shard = x.shard if x.shard is not None else np.full(len(x.one), part, np.int32)
        out = []
        # so many occurrences at once as a blob's table surely has room for
        order = np.lexsort((x.last, x.two, x.one, shard))
        edge = np.flatnonzero(np.append(True, shard[order][1:] != shard[order][:-1])).tolist()
        for a, b in zip(edge, [*edge[1:], len(order)], strict=True):
            for c in range(a, b, 1 << 18):
                i = order[c : min(b, c + (1 << 18))]
                words = [w[i].astype(np.int64) for w in (x.one, x.two, x.last)]
                asked = np.unique(np.concatenate([w[w >= RARE] for w in words]))
                one, two, last = (np.where(w >= RARE, RARE + np.searchsorted(asked, w), w) for w in words)
                names, at = np.unique(x.blocks[x.block[i]], return_inverse=True)
                for lo in range(0, len(names), 1 << 16):
                    some = (at >= lo) & (at < lo + (1 << 16))
                    key = (one << 2 * BITS | two << BITS | last)[some]
                    blob = _pack_occurrences(key, x.owner[i][some], at[some] - lo, names[lo : lo + (1 << 16)], x.rare[asked - RARE], shard[i][some])
                    out.append((int(shard[i[0]]), kind, int(names[lo]), blob))
        return _blobs(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[bytes]] = {}
        size = 0
        for batch in batches:
            for part, kind, block, blob in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if kind == DOCS:
                    yield _blobs([(part, kind, block, blob)])
                    continue
                held.setdefault((kind, part), []).append(blob)
                size += len(blob)
                if size > CUT_BYTES:
                    yield from (cut(k, v, p) for (k, p), v in held.items())
                    held, size = {}, 0
        yield from (cut(k, v, p) for (k, p), v in held.items())

    return run


def _added(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, their tokens, their types), in order; a type has tokens."""
    if not len(key):
        return key, count, count
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[start], np.add.reduceat(count, start), np.add.reduceat((count > 0).astype(np.int64), start)


def _context_key(middle: np.ndarray, first: np.ndarray | None) -> np.ndarray:
    """A 62-bit hash of a context, or of a middle word alone."""
    first = mix(first.view(U64)) if first is not None else U64(0x5851F42D4C957F2D)
    return (mix(middle.view(U64) ^ first) >> U64(2)).view(np.int64)


def _hashes(v: Vocabulary, rare: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = v.hashes[np.minimum(ids, len(v.hashes) - 1)]
    far = np.flatnonzero(ids >= RARE)
    out[far] = rare[ids[far] - RARE]
    return out


def split_contexts(v: Vocabulary, x: _Opened, one: np.ndarray, two: np.ndarray, last: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, tokens, types) of what distinct trigrams have of split middle words and their contexts.

    Those that only held-out documents have are named as well, without tokens.
    """
    pick = np.flatnonzero(one < RARE)
    pick = pick[v.classes[one[pick]] > 1]
    one, two, last, count = one[pick].astype(np.int64), two[pick], last[pick], count[pick]
    middle = _hashes(v, x.rare, one)
    context = _added(_context_key(middle, _hashes(v, x.rare, two)), count)
    pair, which = np.unique(one << 31 | last, return_inverse=True)
    word = _added(_context_key(_hashes(v, x.rare, pair >> 31), None), np.bincount(which, count, len(pair)).astype(np.int64))
    out = [np.concatenate(z) for z in zip(context, word, strict=True)]
    order = np.argsort(out[0])
    return out[0][order], out[1][order], out[2][order]


def _buckets(key: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions of its keys in order)."""
    bucket = (mix(key.view(U64)) % U64(parts)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(key) else np.zeros(0, np.int64)
    for a, b in zip(cut, np.append(cut[1:], len(key)), strict=True) if len(cut) else ():
        yield int(bucket[order[a]]), order[a:b]


def _by_shard(settle, kinds: tuple[int, ...]):
    """Applies ``settle(shard, blocks, blobs)`` to the rows of some kinds, which come sorted by shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for shard, kind, block, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if kind not in kinds:
                    continue
                if shard != now and held:
                    yield settle(now, *zip(*held, strict=True))
                    held = []
                now = shard
                held.append((block, blob.as_py()))
        if held:
            yield settle(now, *zip(*held, strict=True))
        held = []
        give_back()

    return run


def _ask_sums(vocab, parts: int):
    """What each shard has of the contexts of split words, to the bucket of each context."""

    def settle(shard: int, _, blobs: tuple) -> pa.RecordBatch:
        x = _Opened.of(blobs)
        key, tokens, types = split_contexts(vocab.value, x, *x.distinct()[:4])
        return _blobs([(b, SUMS, shard, _pack([np.diff(key[i], prepend=0), tokens[i], types[i]])) for b, i in _buckets(key, parts)])

    return _by_shard(settle, (SPREAD,))


def _add_up(bucket: int, askers: tuple, blobs: tuple) -> pa.RecordBatch:
    """The sums of a bucket, to each shard for the contexts that it named."""
    parts = [_unpack(b, [np.int64] * 3) for b in blobs]
    keys = [np.cumsum(p[0]) for p in parts]
    key, which = np.unique(np.concatenate(keys), return_inverse=True)
    tokens, types = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    np.add.at(tokens, which, np.concatenate([p[1] for p in parts]))
    np.add.at(types, which, np.concatenate([p[2] for p in parts]))
    ends = np.cumsum([len(k) for k in keys])
    mine = zip(askers, keys, np.split(which, ends[:-1]), strict=True)
    return _blobs([(shard, SUMS, bucket, _pack([np.diff(k, prepend=0), tokens[w], types[w]])) for shard, k, w in mine if shard >= 0])


def _ask_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, shard): the rare last words of each shard."""

    def settle(shard: int, _, blobs: tuple) -> pa.RecordBatch:
        words = np.unique(np.concatenate([np.cumsum(p[4])[p[5] > 0] for p in (_unpack(b, _OCCURRENCES) for b in blobs)]))
        return pa.record_batch({"word": pa.array(words, pa.int64()), "shard": pa.array(np.full(len(words), shard, np.int32))})

    yield from _by_shard(settle, (PLAIN, SPREAD))(batches)


def _pack_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, word, n) that come sorted to blobs, some at a time."""
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
        word, n = batch.column("word").to_numpy(), batch.column("n").to_numpy()
        yield _blobs([(int(shard[a]), COUNTS, 0, _pack([np.diff(word[a:b], prepend=0), n[a:b]])) for a, b in zip(cut, np.append(cut[1:], len(shard)), strict=True)])


def _answer(shard: int, blobs: list[bytes], told: list[tuple[int, bytes]], v: Vocabulary, folder: str, learn: bool, ask: bool, keep: bool) -> Iterator[tuple[int, bytes]]:
    """(block, sums by document), for each block that a shard has occurrences of."""
    x = _Opened.of(blobs)
    one, two, last, count, which = x.distinct()
    found = np.zeros(len(x.rare), np.int64)
    sums = [[np.zeros(0, np.int64)] * 3]
    for kind, blob in told:
        if kind == COUNTS:
            word, n = _unpack(blob, [np.int64] * 2)
            found[np.searchsorted(x.rare, np.cumsum(word))] = n
        else:
            key, tokens, types = _unpack(blob, [np.int64] * 3)
            sums.append([np.cumsum(key), tokens, types])
    counts = v.counts[np.minimum(last, len(v.counts) - 1)]
    far = np.flatnonzero(last >= RARE)
    counts[far] = found[last[far] - RARE]
    log1 = v.log1(counts)
    key, tokens, types = (np.concatenate(z) for z in zip(*sums, strict=True))
    order = np.argsort(key)
    key, tokens, types = key[order], tokens[order], types[order]

    def whole(m, f):
        """(places, tokens, types) of the split middle words among ``m``, or of their contexts."""
        some = np.flatnonzero((m < RARE) & (v.classes[np.minimum(m, len(v.classes) - 1)] > 1))
        want = _context_key(_hashes(v, x.rare, m[some]), None if f is None else _hashes(v, x.rare, f[some]))
        at = np.searchsorted(key, want)
        return some, tokens[at], types[at]

    if learn:
        seen = np.flatnonzero(count)
        Trie.build(one[seen], two[seen], last[seen], count[seen], log1[seen], x.rare, whole).save(folder, shard)
    if not ask:
        return
    trie = Trie.open(folder, shard)
    own = trie.ids(x.rare)
    score = np.empty(len(one))
    for a in range(0, len(one), 1 << 18):
        here = slice(a, a + (1 << 18))
        words = [w[here].copy() for w in (one, two, last)]

        def elsewhere(at, with_first, here=here):
            some, n, t = whole(one[here][at], two[here][at] if with_first else None)
            out = np.zeros(len(at))
            out[some[n > 0]] = _value(_quantise(np.log10((t / (n + t))[n > 0])))
            return out

        for w in words:
            far = np.flatnonzero(w >= RARE)
            w[far] = own[w[far] - RARE]
        score[here] = trie.score(*words, log1[here], elsewhere)
    del trie, one, two
    x.one = x.two = x.last = None
    if learn and not keep:
        Trie.remove(folder, shard)
    rare = last >= RARE
    more = [np.where(rare, log1, 0.0), (rare & (counts > 0)).astype(np.float64)] if v.least > 1 else []
    order = np.argsort(x.block, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(x.block[order]) != 0))
    for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
        i = order[a:b]
        docs, place = np.unique(x.owner[i] >> np.uint32(1), return_inverse=True)
        t = which[i]
        yield int(x.blocks[x.block[i[0]]]), _pack([np.diff(docs, prepend=np.uint32(0)).astype(np.uint32), *(np.bincount(place, y[t], len(docs)) for y in (score, *more))])


def _answer_all(vocab, folder: str, learn: bool, ask: bool, keep: bool):
    def run(here: pa.Table, told: pa.Table) -> pa.Table:
        kind, shard = here.column("kind").to_pylist(), here.column("shard").to_pylist()
        block, blob = here.column("block").to_pylist(), here.column("blob").to_pylist()
        out = [(0, 1, block[k], blob[k]) for k in range(len(kind)) if kind[k] == DOCS]
        mine = [blob[k] for k in range(len(kind)) if kind[k] != DOCS]
        if mine:
            of = list(zip(told.column("kind").to_pylist(), told.column("blob").to_pylist(), strict=True))
            out += [(0, 0, b, x) for b, x in _answer(shard[0], mine, of, vocab.value, folder, learn, ask, keep)]
            give_back()
        return pa.Table.from_batches([_blobs(out)])

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _gather(rare: bool):
    """Adds what the shards return for a block up; rows come sorted by block."""

    def settle(rows: list[np.ndarray], sums: list[bytes]) -> pa.RecordBatch:
        ids, flags, tokens, known, base = rows
        total, known, base = np.zeros(len(ids)), known.copy(), base.copy()
        for blob in sums:
            docs, part, *more = _unpack(blob, [np.uint32, *[np.float64] * (3 if rare else 1)])
            docs = np.cumsum(docs)
            total[docs] += part
            if rare:
                base[docs] += more[0]
                known[docs] += more[1].astype(np.int64)
        return pa.record_batch({
            "doc_id": pa.array(ids, mask=(flags & 2) > 0), "held_out": pa.array((flags & 1) > 0), "n_tokens": pa.array(tokens), "n_known": pa.array(known),
            "base_score": pa.array(base), "score": pa.array(total),
        })

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, sums = None, [], []
        for batch in batches:
            for _, kind, block, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if block != now and rows:
                    yield settle(rows, sums)
                    rows, sums = [], []
                now = block
                if kind:
                    rows = _unpack(blob.as_py(), _DOC)
                else:
                    sums.append(blob.as_py())
        if rows:
            yield settle(rows, sums)

    return run


@dataclass
class Model:
    """A trained model: its images are ``folder``/NNNNNNNN.trie, one for each shard that has trigrams."""

    folder: str
    shards: int
    vocab: object  # a broadcast Vocabulary
    words: DataFrame
    sums: DataFrame | None = None  # what shards have of the contexts of split words

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """As the function of this name, of any documents under this model."""
        return _scores(self, docs, id_col, text_col, False, True)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _prepare(docs: DataFrame, id_col: str, text_col: str, limit: int, folder: str | None) -> Model:
    spark = docs.sparkSession
    words = word_counts(_slim(docs, id_col, text_col))
    vocab = vocabulary(words, limit)
    # nine tenths of the tokens are learned from, all are asked about
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(vocab.tokens / 0.9 / SHARD_TOKENS))
    return Model(folder or new_path(spark, "ngram-trie"), shards, spark.sparkContext.broadcast(vocab), words)


def _scores(model: Model, docs: DataFrame, id_col: str, text_col: str, learn: bool, ask: bool, keep: bool = True) -> DataFrame:
    vocab, v, shards = model.vocab, model.vocab.value, model.shards
    parts = min(shards, PARTS)
    blobs = _slim(docs, id_col, text_col).mapInArrow(_send(vocab, shards, parts, learn, ask), _BLOBS).repartition(parts, "shard")
    if parts < shards:
        blobs = blobs.mapInArrow(_cut_again(parts), _BLOBS).repartition(parts, "shard")
    ordered = blobs.sortWithinPartitions("shard")
    told = docs.sparkSession.createDataFrame([], _BLOBS)
    if int(v.classes.max()) > 1:
        asked = ordered.mapInArrow(_ask_sums(vocab, parts), _BLOBS)
        if not ask:
            model.sums = asked = materialise(asked, "context-sums")
        elif not learn:
            asked = asked.unionByName(model.sums.withColumn("block", F.lit(-1).cast("long")))
        asked = asked.repartition(parts, "shard").sortWithinPartitions("shard")
        told = told.unionByName(asked.mapInArrow(_by_shard(_add_up, (SUMS,)), _BLOBS))
    if v.least > 1:
        asked = ordered.mapInArrow(_ask_counts, "word long, shard int").join(model.words.where(F.col("n") < v.least), "word")
        told = told.unionByName(asked.repartition(parts, "shard").sortWithinPartitions("shard", "word").mapInArrow(_pack_counts, _BLOBS))
    answers = blobs.groupBy("shard").cogroup(told.repartition(parts, "shard").groupBy("shard")).applyInArrow(_answer_all(vocab, model.folder, learn, ask, keep), _BLOBS)
    out = answers.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_gather(v.least > 1), _SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def train(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LISTED) -> Model:
    """A model of the training documents; its images are written to ``folder``, in shared storage."""
    model = _prepare(docs, id_col, text_col, limit, folder)
    _scores(model, docs, id_col, text_col, True, False).write.format("noop").mode("overwrite").save()
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LISTED, folder: str | None = None) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one per row of ``docs``.

    base_score: unigrams with 0.1 added to each count.  score: log10 probability by the trie.
    A null text is empty and has its end alone.  Rows that share an id are scored each for
    itself.  Without training documents every word is unknown.  ``limit`` is how many words tasks
    know; it changes what is sent, not the scores.  The images stay in ``folder``; without one
    each is in the scratch folder while its shard is scored.
    """
    return _scores(_prepare(docs, id_col, text_col, limit, folder), docs, id_col, text_col, True, True, folder is not None)
