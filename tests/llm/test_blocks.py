import random

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import bpe, decontaminate, jaccard_join, ngram_lm, quality, token_ids, warc
from tracewell.llm.block import Block, Rolling, slices
from tracewell.llm.elias_fano import EliasFano
from tracewell.llm.queries import PATTERN, ranks, word_vocabulary

TEXTS = ["a bb  ccc\n", None, "", " \t\x0b", "a", "bb a bb ccc", "é x y z", "x" * 5000, "<|endoftext|> it's 'll 12"]


def test_block_words_are_those_of_bytes_split():
    block = Block(pa.array(TEXTS))
    for k, t in enumerate(TEXTS):
        got = [block.data[a:b].tobytes() for a, b in zip(block.starts[block.first[k] : block.first[k + 1]], block.ends[block.first[k] : block.first[k + 1]])]
        assert got == (t or "").encode().split()
    joined, at = block.joined()
    assert joined.tobytes()[at[0] : at[3] - 1] == b"a bb ccc"


@pytest.mark.parametrize("chunk", [1, 7, 1 << 18])
def test_hashes_do_not_depend_on_chunks_or_place(chunk):
    block = Block(pa.array(TEXTS))
    h = block.hashes(chunk)
    assert (h == block.hashes()).all()
    words = [block.data[a:b].tobytes() for a, b in zip(block.starts, block.ends)]
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert (h[i] == h[j]) == (a == b)
    roll, first = Rolling(h), block.first[5]
    assert roll.of(1, 3) == roll.of(first + 2, first + 4)


def test_slices_keep_documents_whole():
    rng = random.Random(1)
    texts = ["x" * rng.randrange(0, 40) for _ in range(200)]
    batches = [pa.record_batch({"t": texts[i : i + 17]}) for i in range(0, 200, 17)]
    out = list(slices(batches, "t", 100))
    assert [t for b in out for t in b.column(0).to_pylist()] == texts
    assert all(sum(map(len, b.column(0).to_pylist())) <= 100 for b in out)


@pytest.mark.parametrize("seed", range(6))
def test_elias_fano(seed):
    rng = np.random.default_rng(seed)
    values = np.unique(rng.integers(0, [5, 100, 10**4, 10**7, 10**12, 3][seed], rng.integers(0, 2000)))
    if seed == 5:
        values = values[:0]
    top = int(values[-1]) + 1000 if len(values) else 1000
    ef = EliasFano.from_buffer(EliasFano.of(values, top).to_bytes())[0]
    if len(values):
        assert (ef.get(np.arange(len(values))) == values).all()
    asked = np.concatenate((values, rng.integers(0, top, 500)))
    assert (ef.successor(asked) == np.searchsorted(values, asked)).all()
    place = {int(v): i for i, v in enumerate(values)}
    assert ef.find(asked).tolist() == [place.get(int(x), -1) for x in asked]
    few = asked[:: max(1, len(asked) // 7)][: max(0, len(values) - 1)]  # fewer than values: by select
    assert ef.find(few).tolist() == [place.get(int(x), -1) for x in few] and (ef.successor(few) == np.searchsorted(values, few)).all()
    assert (ef.values() == values).all()


@pytest.fixture
def selects(monkeypatch):
    """How many selects each call made."""
    made, select = [], EliasFano._select
    monkeypatch.setattr(EliasFano, "_select", lambda self, k, *more: made.append(len(k)) or select(self, k, *more))
    return made


def test_close_questions_need_no_select_each(selects):
    rng = np.random.default_rng(7)
    values = np.unique(rng.integers(0, 10**12, 20_000))
    n, ef = len(values), EliasFano.of(values, 10**12 + 9)
    for a, b in ((0, 1), (0, 3000), (5003, 9001), (n - 4000, n), (n - 1, n)):
        x = rng.permutation(np.concatenate((values[a:b] - (values[a:b] > 0), values[a:b], values[a:b] + 1)))
        at = np.searchsorted(values, x)
        assert (ef.successor(x) == at).all()
        assert (ef.find(x) == np.where(values[np.minimum(at, n - 1)] == x, at, -1)).all()
        i = rng.permutation(np.arange(a, b))
        assert (ef.get(i) == values[i]).all()
    beyond = np.arange(values[-1] + 1, values[-1] + 4)
    assert (ef.successor(beyond) == n).all() and (ef.find(beyond) == -1).all()
    assert sum(selects) < 200
    assert len(ef.values(5, 5)) == 0 and (ef.values(5, 99) == values[5:99]).all()
    far = values[::100]
    assert (ef.find(far) == np.arange(0, n, 100)).all() and (ef.get(np.arange(0, n, 100)) == far).all()
    assert sum(selects) > 2 * len(far)


def test_trigrams_in_order_are_scored_without_a_select_each(selects):
    rng = np.random.default_rng(3)
    key = np.unique(rng.integers(0, 40, 30_000) << 42 | rng.integers(4, 60, 30_000) << 21 | rng.integers(1, 60, 30_000))
    middle, first, last = key >> 42, key >> 21 & ngram_lm._MASK, key & ngram_lm._MASK
    log1 = np.full(len(key), -2.0)
    trie = ngram_lm.Trie.build(middle, first, last, rng.integers(1, 5, len(key)), log1, key[:0])
    whole = trie.score(middle, first, last, log1)
    selects.clear()
    parts = [trie.score(*(x[a : a + 1000] for x in (middle, first, last, log1))) for a in range(0, len(key), 1000)]
    assert (np.concatenate(parts) == whole).all() and sum(selects) < len(key) / 10


def test_trie_is_a_distribution_and_opens_from_a_file(tmp_path):
    rng = np.random.default_rng(0)
    key = np.unique(rng.integers(0, 4, 300) << 42 | rng.integers(4, 9, 300) << 21 | rng.integers(1, 12, 300))
    count = rng.integers(1, 5, len(key))
    middle, first, last = key >> 42, key >> 21 & ngram_lm._MASK, key & ngram_lm._MASK
    log1 = np.full(len(key), np.log10(1 / 11))
    ngram_lm.Trie.build(middle, first, last, count, log1, np.array([5, 77])).save(f"file://{tmp_path}", 7)
    trie = ngram_lm.Trie.open(f"file://{tmp_path}", 7)
    assert (trie.ids(np.array([77, 6, 5])) == ngram_lm.RARE + np.array([1, 2, 0])).all()
    words = np.arange(1, 12)
    for m in (0, 1, 2, 3, 99):
        for f in (4, 6, 99):
            p = 10 ** trie.score(np.full(11, m), np.full(11, f), words, np.full(11, np.log10(1 / 11)))
            assert abs(p.sum() - 1) < 0.06  # one byte for each probability
    assert (ngram_lm.Trie.open(f"file://{tmp_path}", 8).score(words, words, words, log1[:11]) == log1[:11]).all()


@pytest.mark.parametrize("leaf", [1, 3, 8, 40])
def test_bpe_tree_equals_plain_encoding(leaf):
    enc = bpe.encoding(ranks(), PATTERN)
    rng = random.Random(leaf)
    alphabet = ["a", "Z", "é", "ß", " ", "  ", "\n", "\t", "'s", "'", "12", "!", " ", " ", "日本", "🙂", "\x1c", "the ", "\r\n"]
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 120)))
        ids = bpe.encode(enc, text, leaf)
        assert ids == enc.encode_ordinary(text)
        assert bpe.decode(enc, ids, leaf) == text.encode()


def test_bpe_join_is_associative():
    enc = bpe.encoding(ranks(), PATTERN)
    parts = [(t, enc.encode_ordinary(t)) for t in ("the qu", "ick  ", " brown\n", "'s", "")]
    left = right = None
    for p in parts:
        left = p if left is None else bpe.join(enc, left, p)
    for p in reversed(parts):
        right = p if right is None else bpe.join(enc, p, right)
    assert left == right


def test_part_enum_signatures_meet_for_every_linked_pair():
    rng = random.Random(3)
    for n in list(range(3, 40)) + [80, 200, 500]:
        for _ in range(12):
            a = {rng.getrandbits(63) for _ in range(n)}
            b = set(a)
            while True:  # change b until one more step would end the link
                c = set(b)
                kind = rng.random()
                if kind < 0.6:
                    c.discard(rng.choice(sorted(c)))
                if kind > 0.3:
                    c.add(rng.getrandbits(63))
                if not c or 100 * len(a & c) < 80 * len(a | c):
                    break
                b = c
            if a == b:
                continue
            found = []
            for s in (a, b):
                value = np.array(sorted(s), np.uint64)
                found.append(set(jaccard_join.signatures(np.zeros(len(s), np.int64), value, np.array([len(s)]))[1].tolist()))
            assert found[0] & found[1], (len(a), len(b))


def test_sketches_bound_differences():
    rng = random.Random(4)
    for n in (5, 60, 70, 129, 400):
        a = [rng.getrandbits(63) for _ in range(n)]
        b = a[: n - n // 10] + [rng.getrandbits(63)]
        out = []
        for s in (a, b):
            out.append(jaccard_join.sketches(np.zeros(len(s), np.int64), np.array(s, np.uint64), np.array([len(s)])).view(np.uint64))
        if len(out[0]) == len(out[1]):
            bits = sum(int(x ^ y).bit_count() for x, y in zip(*out))
            assert bits <= len(set(a) ^ set(b))


def test_item_sketches_lose_no_match():
    rng = random.Random(5)
    items = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    docs = []
    for k in range(120):
        words = items[k % 40].split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = "z"
        docs.append(" ".join(["p"] * rng.randrange(30) + words + ["q"] * rng.randrange(200)))
    index = decontaminate.ItemIndex(list(range(40)), items)
    block = Block(pa.array(docs), lower=True)
    doc, value, _ = jaccard_join.sets(block)
    found = set(zip(*(x.tolist() for x in index.candidates(doc, value))))
    for d, text in enumerate(docs):
        have = decontaminate.shingle_set(decontaminate.words_of(text))
        for i, text in enumerate(index.words.to_pylist()):
            s = decontaminate.shingle_set(text.split())
            if s and 100 * len(s & have) >= 80 * len(s):
                assert (d, i) in found


def test_monotone_trees():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] - x[:, 1] + rng.normal(0, 0.3, 2000)) > 0).astype(float)
    forest = quality.fit(x, y, np.array([1, -1, 0]), trees=30)
    assert ((forest.margin(x) > 0) == (y > 0)).mean() > 0.8
    grid = np.linspace(0, 1, 50)
    for _ in range(40):
        row = np.repeat(rng.random((1, 3)), 50, 0)
        for f, sign in ((0, 1), (1, -1)):
            z = row.copy()
            z[:, f] = grid
            assert (sign * np.diff(forest.margin(z)) >= -1e-9).all()


def test_flat_arrays_score_like_a_walk():
    rng = np.random.default_rng(1)
    x = rng.random((300, 3))
    forest = quality.fit(x, (x[:, 2] > 0.5).astype(float), np.zeros(3), trees=5, depth=3)
    for row, got in zip(x[:50], forest.margin(x[:50])):
        total = forest.base
        for root in forest.roots:
            node = root
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        assert abs(total - got) < 1e-9


def test_varint_round_trip():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 9, 50)
    values = rng.integers(0, 2**32, counts.sum(), dtype=np.uint64) >> rng.integers(0, 32, counts.sum(), dtype=np.uint64)
    control, data, size = token_ids.code(values.astype(np.uint32), counts)
    assert (token_ids.decode(control, data, counts) == values).all() and size.sum() == len(data)
    assert len(token_ids.decode(control[:0], data[:0], counts[:0])) == 0


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = word_vocabulary()
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = TEXTS + ["The  Quick brown\nfox's 123 é ́x ΣΣ İ ǅ don't!! 日本語🙂"]
    ids, counts = token_ids.WordEncoder(path).encode(pa.array(texts), 1)
    ends = np.concatenate(([0], np.cumsum(counts)))
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids + [1]


def test_word_encoder_gives_added_tokens_their_ids():
    from tokenizers import Tokenizer

    path = word_vocabulary()
    plain = Tokenizer.from_file(path)
    end, start = "<|endoftext|>", "<|startoftext|>"
    texts = [end, f"{start} a dog{end}", f"mid{end}dle it{start}'s {end}{end} x", f"<|ENDOFTEXT|> <|endoftext |> e{end}\u0301 {start}\u3000b", f"12{start[:-1]} {end}\n\tThe end", "no such token"]
    ids, counts = token_ids.encoder(path).encode(pa.array(texts), 1)
    ends = np.concatenate(([0], np.cumsum(counts)))
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids + [1]
    assert 49407 in ids and 49406 in ids


def test_warc_reader_checks_what_it_reads():
    import hashlib
    import io

    data = b"x" * 200000 + b"\r\n\r\n"
    digest = hashlib.sha256(data).hexdigest()
    two = warc.record(1, "http://a/\nb", data, digest, None) + warc.record(None, None, data, digest, 1)
    first, second = warc.read_records(io.BytesIO(two))
    assert (first["payload"], first["record_type"], first["page_id"]) == (data, "response", 1)
    assert (second["payload"], second["record_type"], second["refers_to"], second["payload_bytes"], second["page_id"]) == (None, "revisit", 1, len(data), None)
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(warc.record(1, None, data, "0" * 64, None))))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(two[:500])))


def test_word_encoder_remembers_and_forgets(monkeypatch):
    path = word_vocabulary()
    fresh, kept = token_ids.WordEncoder(path), token_ids.WordEncoder(path)
    monkeypatch.setattr(token_ids, "REMEMBERED", 5)
    rng = random.Random(0)
    for _ in range(12):
        texts = pa.array([" ".join(rng.choice(["ab", "Cd.", "e'f", " ", "12", "x-y"]) + str(rng.randrange(20)) for _ in range(rng.randrange(9))) for _ in range(4)])
        fresh._forget()
        assert all((a == b).all() for a, b in zip(fresh.encode(texts, 1), kept.encode(texts, 1)))
