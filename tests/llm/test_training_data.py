import hashlib
import re
import zlib
from collections import Counter
from math import log10

import pytest
from pyspark.sql import functions as F

from tracewell.llm import bpe, chat, decontaminate, jaccard_join, ngram_lm, quality, token_counts, token_ids, warc
from tracewell.llm.queries import PATTERN, ranks, word_vocabulary
from tracewell.llm.scratch import new_path
from tracewell.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Nulls, empty and blank texts, ties, repeated rows and ids, and a long text.
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
ROWS = [
    (1, BASE), (2, "zero " + BASE.upper() + " x"), (3, "zero " + BASE + " x"), (4, None), (5, ""), (6, " \n\t"), (7, "short text"), (7, "short text"),
    (8, BASE), (8, BASE + " more"), (None, BASE), (None, None), (9, ("lorem ipsum " * 3 + "\n") * 400), (10, "a b c"), (11, "A B c"), (12, BASE[:-8] + " changed end"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns have names that operators use too
    return spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in ROWS], "doc_id long, text string, n_words int, _id string, _ranges double").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def windows(rows, size):
    least = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            least[key] = min(least.get(key, 1 << 63), 1 << 63 if i is None else i)
    return least


@pytest.mark.parametrize("size, change", [(2, {}), (5, {"PARTS": 2, "BUCKET_BYTES": 2000}), (13, {}), (13, {"HOLD": 100}), (5, {"HOLD": 2000, "PARTS": 3, "BUCKET_BYTES": 500}), (2, {"HOLD": 1}), (13, {"HOLD": 4000, "BUCKET_BYTES": 1 << 20})])
def test_substring_dedup(docs, size, change, monkeypatch):
    from tracewell.llm import substring_dedup

    for name, value in change.items():
        monkeypatch.setattr(substring_dedup, name, value)
    least = windows(ROWS, size)
    want = []
    for i, t in ROWS:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if least[tuple(w[k : k + size])] < (1 << 63 if i is None else i):
                gone[k : k + size] = [True] * size
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    got = [tuple(r) for r in remove_repeats(docs, window=size).select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("ask", [False, True])
def test_windows_with_one_hash_are_told_apart(ask, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tracewell.llm import substring_dedup as sd

    texts = [t or "" for _, t in ROWS]
    batches = [pa.record_batch({"id": pa.array(np.arange(len(texts)) * 2 + k), "text": pa.array(texts)}) for k in (0, 1)]
    blobs = [b for x in batches for out in sd._send("id", "text", 3, 1, 1, np.zeros(0, np.uint64))([x]) for b, k in zip(out.column("blob").to_pylist(), out.column("kind").to_pylist()) if not k]
    want = sd._judge(blobs, 3, ask)
    real = sd.Rolling.of
    monkeypatch.setattr(sd.Rolling, "of", lambda self, a, b: real(self, a, b) % np.uint64(5))
    got = sd._judge(blobs, 3, ask)
    covered = lambda rows: {(i, c, k) for i, c, a, b in zip(*(x.tolist() for x in rows[:4])) for k in range(a, b)}
    assert covered(got[0]) == covered(want[0]) and len(covered(want[0])) > 50
    if ask:
        fingerprints = lambda rows: set(zip(*(x.tolist() for x in rows)))
        assert fingerprints(want[1]) <= fingerprints(got[1])


BOUND = """
import resource, sys, time
import numpy as np, pyarrow as pa
from tracewell.llm import substring_dedup as sd
from tracewell.llm.block import Block
rng = np.random.RandomState(3)
words = np.array([f"w{i:x}" for i in range(60000)])
blobs, size, n = [], 0, 0
while size < float(sys.argv[1]) * sd.HOLD:
    texts = pa.array([" ".join(words[rng.randint(0, 60000, 40000)]) for _ in range(8)])
    batch = pa.record_batch({"id": pa.array(np.arange(n, n + 8)), "text": texts})
    n += 8
    for out in sd._send("id", "text", 13, 1, 1, np.zeros(0, np.uint64))([batch]):
        blobs += [b for b, k in zip(out.column("blob").to_pylist(), out.column("kind").to_pylist()) if not k]
    size = sum(map(sd._unpacked, blobs))
before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
rows = pa.record_batch({"bucket": pa.array([0] * len(blobs), pa.int32()), "kind": pa.array([0] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})
asks = sum(out.num_rows for out in sd._judge_all(13, sd.HOLD)([rows]))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, time.time() - began, asks)
"""


def test_substring_dedup_deals_partitions_evenly_and_writes_few_files(spark, monkeypatch):
    """Hashed numbers left a third of the tasks empty and gave others up to five partitions; each task wrote a file."""
    import random

    from tracewell.llm import scratch
    from tracewell.llm import substring_dedup as sd

    found, keep = [], sd.materialise
    monkeypatch.setattr(sd, "materialise", lambda df, name: found.append((df, keep(df, name))) or found[-1][1])
    monkeypatch.setattr(sd, "BUCKET_BYTES", 2000)
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(100))) for i in range(40)]
    rows += [(i + 100, t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    n = {r["doc_id"]: r["n_removed"] for r in sd.remove_repeats(docs).collect()}
    assert n == {i: 100 * (i >= 100) for i, _ in rows}
    buckets = -(-3 * sum(len(t) + 1 for _, t in rows) // 2000)
    (judged, written), tasks = found[0], scratch.tasks(buckets, buckets, 4)
    assert tasks == -(-buckets // scratch.TOGETHER) and judged.rdd.getNumPartitions() == tasks
    assert len(written.inputFiles()) == tasks  # none is empty
    assert [scratch.tasks(*x) for x in ((50, 50, 6), (5, 5, 6), (211, 211, 6), (16384, 20000, 6))] == [13, 5, 53, 16384]


def test_batches_for_python_are_bounded_by_bytes(spark):
    import pyarrow as pa

    from tracewell.llm import scratch

    sizes = lambda: [r["b"] for r in docs.mapInArrow(lambda batches: (pa.record_batch({"b": [b.nbytes]}) for b in batches), "b long").collect()]
    docs = spark.range(0, 4000, 1, 1).selectExpr("id doc_id", "repeat(cast(id % 10 as string), 8000) text")
    before = spark.conf.get(scratch.BATCH, None)
    try:
        spark.conf.unset(scratch.BATCH)
        remove_repeats(docs.limit(0))
        got = sizes()
        assert len(got) > 1 and max(got) <= scratch.BATCH_BYTES + 10_000 and sum(got) >= 32_000_000
        spark.conf.set(scratch.BATCH, "1000000")  # a bound of the session's own stays
        scratch.small_batches(spark)
        assert max(sizes()) < 1_010_000
    finally:
        spark.conf.unset(scratch.BATCH) if before is None else spark.conf.set(scratch.BATCH, before)


def test_substring_dedup_is_bounded(spark):
    """Memory of a bucket at the bound, and of one three times as large, which is judged in pieces."""
    import subprocess
    import sys

    for times, most in ((0.8, 600), (3, 1000)):
        mb, seconds, asks = subprocess.run([sys.executable, "-c", BOUND, str(times)], capture_output=True, text=True, check=True, timeout=300).stdout.split()
        print(mb, seconds, asks)
        assert float(mb) < most and float(seconds) < 60 * times and (int(asks) > 0) == (times > 1)


def test_substring_dedup_holds_little_beside_its_block(monkeypatch):
    """What numpy and bytes take at once for a block that is dealt out and a bucket that is judged, and the rows handed on at once."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tracewell.llm import substring_dedup as sd

    rng = np.random.RandomState(5)
    words = np.array([f"w{i:x}" for i in range(60000)])
    texts = pa.array([" ".join(words[rng.randint(0, 60000, 400)]) for _ in range(2200)])
    batch = pa.record_batch({"id": pa.array(np.arange(len(texts))), "text": texts})

    def peak(work):
        tracemalloc.start()
        try:
            out = work()
            return out, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    send = sd._send("id", "text", 13, 1, 1, np.zeros(0, np.uint64))
    _, most = peak(lambda: list(send([batch])))
    assert most < 20 * texts.nbytes  # 27 before
    blobs = [b for k in range(0, len(texts), 100) for out in send([batch.slice(k, 100)]) for b in out.column("blob").to_pylist()]
    unpacked = sum(map(sd._unpacked, blobs))
    (_, asked), most = peak(lambda: sd._judge(blobs, 13))
    assert asked is None and most < 5.5 * unpacked  # 7.6 before
    monkeypatch.setattr(sd, "FOUND_ROWS", 1000)
    rows = pa.record_batch({"bucket": pa.array([0] * len(blobs), pa.int32()), "kind": pa.array([0] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})
    sizes = [x.num_rows for x in sd._judge_all(13, unpacked // 3)([rows])]
    assert max(sizes) == 1000 and sum(sizes) > 100_000


def test_jaccard_sets_are_made_a_part_of_a_block_at_a_time():
    """What numpy and bytes take at once for a block of six million bytes whose signatures are sent."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.RandomState(5)
    words = np.array([f"w{i:x}" for i in range(60000)])
    texts = pa.array([" ".join(words[rng.randint(0, 60000, 400)]) for _ in range(2600)])
    batch = pa.record_batch({"id": pa.array(np.arange(len(texts))), "text": texts})
    send = jaccard_join._send("id", "text", 50, 50)
    list(send([batch.slice(0, 9)]))
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in send([batch]))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 51 and most < 15 * texts.nbytes  # 24 before, 10 after


def test_empty_tables(spark, docs, empty, tmp_path):
    assert remove_repeats(empty).count() == 0
    assert jaccard_join.classes(empty).count() == 0
    assert ngram_lm.score(empty).count() == 0
    items = spark.createDataFrame([(1, BASE)], "item_id long, text string")
    assert decontaminate.contained_items(empty, items).count() == 0
    assert decontaminate.contained_items(docs, items.limit(0)).count() == 0
    assert bpe.encode_texts(empty, ranks(), PATTERN).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(empty, quality.train(empty, labels)).count() == 0
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.token_lengths(empty.select("text"), ranks(), PATTERN))).count() == 0
    folder = new_path(spark, "ids")
    assert token_ids.read_ids(token_ids.write_ids(empty, folder, word_vocabulary()), folder).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = new_path(spark, "warc")
    assert warc.read_archives(warc.write_archives(pages, folder), folder).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_turns(chat.turns_of_table(turns)).count() == 0


def shingle_sets(rows):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
    return out


def brute_classes(rows):
    sets = shingle_sets(rows)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)]


def test_jaccard_classes(docs):
    got = [tuple(r) for r in jaccard_join.classes(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_classes(ROWS), key=str)


def test_jaccard_chain_and_near_copies(spark):
    import random

    rng = random.Random(0)
    words = [f"w{k}" for k in range(60)]
    rows, now = [], list(words)
    for k in range(30):  # a chain: each like the one before, the ends unlike
        rows.append((100 + k, " ".join(now)))
        now = now[1:] + [f"n{k}"]
    for k in range(60):  # near copies of one text
        w = list(words)
        w[rng.randrange(60)] = f"v{k}"
        rows.append((1000 + k, " ".join(w)))
    passage = " ".join(f"p{k}" for k in range(20))
    rows += [(2000 + k, passage + " " + " ".join(f"q{k}_{j}" for j in range(rng.randrange(5, 60)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in jaccard_join.classes(df).collect()]
    assert sorted(got) == sorted(brute_classes(rows))


def test_jaccard_links_between_two_members_of_a_group(spark):
    import random

    rng = random.Random(3)
    rows = []
    for t in range(300):  # of three texts only two may be left open after the least one is verified
        one = [f"t{t}_{k}" for k in range(14 if t % 2 else rng.randrange(6, 21))]
        two = [f"t{t}_b", *one[1:]]
        three = [*two[:-1], f"t{t}_c"]
        if t % 3 == 0:
            three[rng.randrange(len(three))] = f"t{t}_d"
        rows += [(3 * t + k, " ".join(w)) for k, w in enumerate((one, two, three))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard_join.classes(df).collect()]
    assert sorted(got) == sorted(brute_classes(rows))


@pytest.mark.parametrize("limit", [3, 8, 1 << 20])
def test_lm_base_scores(docs, limit):
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in ROWS]
    count = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = [(i, held(i), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in tokens]
    out = ngram_lm.score(docs, limit=limit).collect()
    got = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r["score"] < 0 for r in out)


def test_lm_predicts_held_out_text(spark):
    rows = [(k, " ".join(f"{a}{(k + j) % 3}" for j, a in enumerate("the cat sat on the mat and the dog ran".split() * 3))) for k in range(400)]
    out = ngram_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.5 * out[1]


def jaccard_rows():
    import random

    rng = random.Random(11)
    words = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(words[j % 120] if rng.random() > 0.04 * (k % 4) else f"x{rng.randrange(999)}" for j in range(k % 7 * 17, k % 7 * 17 + 6 + k % 90))) for k in range(260)]
    return rows + [(k, " ".join(words[:40] + [f"y{k}"])) for k in range(300, 340)] + [(12, rows[3][1]), (None, rows[3][1]), (400, None), (401, " ")]


@pytest.mark.parametrize("change", [{"LOCAL": 2, "CHUNK": 3, "CHUNK_LONGS": 200}, {"PARTS": 2, "BUCKET_SIGNATURES": 40, "PER_BYTE": 1.0, "HOLD": 300, "BROADCAST_ROWS": 0}])
def test_jaccard_groups_in_pieces(spark, monkeypatch, change):
    for name, value in change.items():
        monkeypatch.setattr(jaccard_join, name, value)
    path = new_path(spark, "jaccard-rows")
    spark.createDataFrame(jaccard_rows(), "doc_id long, text string").repartition(3).write.parquet(path)
    got = [tuple(r) for r in jaccard_join.classes(spark.read.parquet(path)).collect()]
    assert sorted(got, key=str) == sorted(brute_classes(jaccard_rows()), key=str)


@pytest.mark.parametrize("most", [1, 3000])
def test_jaccard_parts_of_a_block_make_no_difference(monkeypatch, most):
    import pyarrow as pa

    batch = pa.record_batch({"id": pa.array([r[0] for r in jaccard_rows()], pa.int64()), "text": pa.array([r[1] for r in jaccard_rows()])})

    def sent():
        (out,) = jaccard_join._send("id", "text", 7, 7)([batch])
        rows = list(zip(*(c.to_pylist() for c in out.columns), strict=True))
        entries = [(k, sorted(zip(*(x.tolist() for x in jaccard_join._entries([blob])), strict=True))) for k, kind, blob in rows if kind == 0]
        return entries, [r for r in rows if r[1] not in (0, jaccard_join._PIECES)], sum(r[1] == jaccard_join._PIECES for r in rows)

    whole = sent()
    assert whole[2] == 1 and sum(len(e) for _, e in whole[0]) > 1000
    monkeypatch.setattr(jaccard_join, "PART_BYTES", most)
    assert sent() == whole


@pytest.mark.parametrize("change", [{"BITS": 4, "LOCAL": 3}])
def test_jaccard_fingerprints_that_clash(spark, monkeypatch, change):
    for name, value in change.items():
        monkeypatch.setattr(jaccard_join, name, value)
    df = spark.createDataFrame(jaccard_rows()[::3], "doc_id long, text string")
    got = [tuple(r) for r in jaccard_join.classes(df).collect()]
    assert sorted(got, key=str) == sorted(brute_classes(jaccard_rows()[::3]), key=str)


def test_one_row_of_each_class_stays(spark):
    other = BASE.replace("one", "uno").replace("seven", "siete").replace("twelve", "doce")
    rows = [(1, BASE), (5, BASE), (5, other), (7, BASE + " x"), (7, BASE + " x"), (None, BASE), (None, "a b"), (None, "a b"), (9, None), (9, None), (10, "A B c d e f"), (10, "a b c d e f"), (11, other)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, _id int").repartition(4)
    out = jaccard_join.one_of_each(df)
    assert out.columns == df.columns
    kept = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in out.collect()), key=str)
    assert kept == sorted([(1, BASE), (5, other), (None, "a b"), (9, ""), (9, ""), (10, "a b c d e f")], key=str)


def witten_bell(rows):
    """Scores by dictionaries, each stored probability and backoff weight rounded as a code is."""
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    tokens = [(i, [*(t or "").encode().lower().split(), "end"]) for i, t in rows]
    one, two, three = Counter(), Counter(), Counter()
    for i, ws in tokens:
        if not held(i):
            before = ["start", "start", *ws]
            one.update(ws)
            for k, w in enumerate(ws):
                two[before[k + 1], w] += 1
                three[before[k], before[k + 1], w] += 1
    total2, types2, total3, types3 = Counter(), Counter(), Counter(), Counter()
    for (b, _), n in two.items():
        total2[b] += n
        types2[b] += 1
    for (a, b, _), n in three.items():
        total3[a, b] += n
        types3[a, b] += 1
    z = sum(one.values()) + 0.1 * (len(one) + 1)
    code = lambda p: round(-log10(p) * ngram_lm.STEP) / -ngram_lm.STEP

    def log(a, b, w):
        p1 = (one[w] + 0.1) / z
        if b not in total2:
            return log10(p1)
        p2 = (two[b, w] + types2[b] * p1) / (total2[b] + types2[b])
        if three[a, b, w]:
            return code((three[a, b, w] + types3[a, b] * p2) / (total3[a, b] + types3[a, b]))
        out = code(p2) if two[b, w] else code(types2[b] / (total2[b] + types2[b])) + log10(p1)
        return out + (code(types3[a, b] / (total3[a, b] + types3[a, b])) if (a, b) in total3 else 0.0)

    return [(i, sum(log(a, b, w) for a, b, w in zip(["start", "start", *ws], ["start", *ws], ws, strict=False))) for i, ws in tokens]


def lm_rows():
    import random

    rng = random.Random(5)
    words = ["the"] * 40 + ["Of"] * 25 + ["and"] * 10 + [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for k in range(160)]
    return rows + [(300, None), (301, ""), (None, "the of w1"), (5, rows[5][1]), (5, "the the of"), (302, "the of and " * 300)]


@pytest.mark.parametrize("partitions, limit, split, parts, shard_tokens", [(1, 1 << 20, 1 << 20, 64, 10**6), (4, 20, 40, 64, 10**6), (64, 0, 3, 64, 10**6), (3, 20, 25, 3, 7), (2, 1 << 20, 40, 2, 30)])
def test_lm_scores_are_a_function_of_the_documents(spark, monkeypatch, partitions, limit, split, parts, shard_tokens):
    rows = lm_rows()
    monkeypatch.setattr(ngram_lm, "SPLIT", split)
    monkeypatch.setattr(ngram_lm, "PARTS", parts)
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", shard_tokens)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        path = new_path(spark, "lm-rows")  # a scan has a size
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
        docs = spark.read.parquet(path)
        found = sorted(((r["doc_id"], r["score"]) for r in ngram_lm.score(docs, limit=limit).collect()), key=str)
        model = ngram_lm.train(docs, limit=limit)
        ngram_lm.score(docs, limit=limit, folder=new_path(spark, "kept-trie")).count()
        again = sorted(((r["doc_id"], r["score"]) for r in model.score(docs).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = sorted(witten_bell(rows), key=str)
    for got in (found, again):
        assert [i for i, _ in got] == [i for i, _ in want]
        assert all(abs(a - b) < 1e-6 for (_, a), (_, b) in zip(got, want, strict=True))


def test_decontamination(spark, docs):
    items = [(1, BASE), (1, BASE), (2, None), (3, ""), (4, "a b c"), (None, BASE + " " + BASE[::-1]), (6, "zero " + BASE)]
    want = []
    for i, have in shingle_sets(ROWS):
        for j, s in shingle_sets(items):
            if s and 100 * len(s & have) >= 80 * len(s):
                want.append((i, j, len(s), len(s & have)))
    df = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in decontaminate.contained_items(docs, df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = decontaminate.drop_contaminated(docs, df)
    bad = [any(s and 100 * len(s & have) >= 80 * len(s) for _, s in shingle_sets(items)) for _, have in shingle_sets(ROWS)]
    assert kept.columns == docs.columns
    assert sorted([tuple(r)[:2] for r in kept.collect()], key=str) == sorted([r for r, b in zip(ROWS, bad) if not b], key=str)


def test_items_of_one_template_give_no_candidates():
    import numpy as np
    import pyarrow as pa

    from tracewell.llm.block import Block

    template = [f"t{k}" for k in range(30)]
    items = [" ".join([*template, *(f"i{n}_{k}" for k in range(10))]) for n in range(2000)]
    index = decontaminate.ItemIndex(list(range(2000)), items)
    docs = [" ".join([*template, *(f"d{n}_{k}" for k in range(10))]) for n in range(50)] + items[7:8] + [items[9] + " more words"]
    block = Block(pa.array(docs), lower=True)
    found = list(zip(*(x.tolist() for x in index.candidates(*jaccard_join.sets(block)[:2])), strict=True))
    assert found == [(50, 7), (51, 9)]
    same = decontaminate.ItemIndex([1, 2, None], [BASE, BASE.upper(), BASE + " x"])
    assert len(same.size) == 2 and [sorted(x, key=str) for x in same.ids] == [[1, 2], [None]] and np.array_equal(same.size, [11, 12])


def test_item_groups_are_bounded(spark, docs, monkeypatch):
    items = spark.createDataFrame([(k, BASE + f" {k}") for k in range(7)], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contained_items(docs, items).collect()), key=str)
    monkeypatch.setattr(decontaminate, "ITEM_SHINGLES", 30)
    assert sorted(map(tuple, decontaminate.contained_items(docs, items).collect()), key=str) == whole


def test_bpe_round_trip(docs):
    enc = bpe.encoding(ranks(), PATTERN)
    out = bpe.decode_ids(bpe.encode_texts(docs, ranks(), PATTERN), ranks(), PATTERN).collect()
    assert len(out) == len(ROWS)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, bpe.round_trip(docs, ranks(), PATTERN).collect()), key=str)
    for r in out:
        assert list(r["ids"]) == enc.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()


def brute_quality(t):
    w, c = WORD.findall(t), Counter()
    for k in range(len(w) - 7):
        c[tuple(w[k : k + 8])] += 1
    again = [False] * len(w)
    for k in range(len(w) - 7):
        if c[tuple(w[k : k + 8])] > 1:
            again[k : k + 8] = [True] * 8
    lines, seen = 0, set()
    for line in t.split("\n"):
        lines += line in seen and bool(WORD.search(line))
        seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), lines, sum(again), len(w) < 20 or 100 * sum(again) > 30 * len(w)


def test_quality_counts(docs):
    out = quality.judge(docs, quality.none()).collect()
    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out]
    assert sorted(got, key=str) == sorted([(i, *brute_quality(t or "")) for i, t in ROWS], key=str)
    assert all(r["kept"] == (not r["base_failed"]) for r in out)


def test_quality_learns_from_labels(spark):
    good = [(k, " ".join(f"word{(k * 7 + j) % 91}" for j in range(60)) + ".") for k in range(300)]
    bad = [(1000 + k, " ".join(f"word{(k * 5 + j) % 91}###" for j in range(60))) for k in range(300)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad] + [(None, 1), (1, None), (5, 0)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, quality.train(docs, labels)).collect()}
    assert sum(kept[i] for i, _ in good) >= 298 and sum(kept[i] for i, _ in bad) <= 2


def test_quality_with_few_labels(spark):
    docs = spark.createDataFrame([(k, ("good words here " if k % 2 else "bad ### words !!! ") * 9 + f"w{k}") for k in range(24)] + [(3, "other text"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(24)], "doc_id long, quality int")
    kept = quality.keep_good(docs, quality.train(docs, labels))
    assert kept.columns == docs.columns and all(r["text"].startswith("good") for r in kept.collect()) is True
    one = quality.train(docs, labels.where("quality = 1"))
    assert not len(one.roots)


def test_token_counts(docs):
    enc = bpe.encoding(ranks(), PATTERN)
    lengths = [len(enc.encode_ordinary(t or "")) for _, t in ROWS]
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.token_lengths(docs.select("text"), ranks(), PATTERN)))
    out = {r["n_tokens"]: r for r in sums.collect()}
    assert sorted(out) == sorted(set(lengths))
    for n, r in out.items():
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"]) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert (r["truncated_tokens"], r["docs_at_most"], r["total_docs"], r["total_tokens"]) == (sum(min(x, n) for x in lengths), sum(x <= n for x in lengths), len(lengths), sum(lengths))
    for limit in (1, 6, 100, 10**6):
        assert token_counts.at_limit(sums, limit).first()["truncated_tokens"] == sum(min(x, limit) for x in lengths)
    for q in (0.1, 0.5, 1.0):
        want = next(x for x in sorted(lengths) if sum(y <= x for y in lengths) >= q * len(lengths))
        assert token_counts.quantile(sums, q).first()["n_tokens"] == want


def test_quantiles_are_exact(spark):
    sums = token_counts.suffix_sums(spark.createDataFrame([(n, 1) for n in range(1, 101)], "n_tokens long, n_docs long"))
    for q, want in ((0.07, 7), (0.29, 29), (0.295, 30), (0.0, 1)):
        assert token_counts.quantile(sums, q).first()["n_tokens"] == want


@pytest.mark.parametrize("ranges", [1, 6])
def test_token_id_files(spark, docs, ranges, monkeypatch):
    from tokenizers import Tokenizer

    path = word_vocabulary()
    tokenizer = Tokenizer.from_file(path)
    monkeypatch.setattr(token_ids, "RANGE_BYTES", 1 << 62 if ranges == 1 else 64)
    folder = new_path(spark, "ids")
    out = token_ids.read_ids(token_ids.write_ids(docs, folder, path), folder).orderBy("start").collect()
    ids = [r["doc_id"] for r in out]
    assert ids == sorted((i for i, _ in ROWS if i is not None)) + [None, None]
    at = 0
    for r in out:
        assert r["start"] == at and r["ids"][-1] == 1
        at += len(r["ids"])
    want = Counter(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in ROWS)
    assert Counter(tuple(r["ids"]) for r in out) == want


def test_warc(spark):
    long = "<html>" + "é" * 200
    rows = [(3, "u", long), (1, "u", long), (2, None, "tiny"), (4, "u", "tiny"), (5, "u", None), (None, "u", long), (1, "u", long), (6, "u\r\nX: y", long + "!")]
    folder = new_path(spark, "warc")
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(df, folder), folder).collect()]
    want = []
    for i, _, t in rows:
        data = (t or "").encode()
        revisit = i == 3
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_chat_layouts(spark):
    records = [
        (1, '{"messages": [{"role": "user", "content": "hi"}, {"content": "yo", "role": "assistant"}]}'),
        (2, '{"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}'),
        (3, '{"prompt": "hi", "response": "yo"}'), (4, '{"input": "hi", "output": "yo", "instruction": "be"}'), (5, '{"completion": "yo", "prompt": null}'),
        (6, None), (7, "{broken"), (8, '{"other": 1}'), (9, '{"messages": []}'),
    ]
    df = spark.createDataFrame(records, "conv_id long, record string")
    got = {r["key"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in chat.turns_of_json(df, "record").collect()}
    pair = [("user", "hi"), ("assistant", "yo")]
    assert got[1] == ("messages", pair) and got[2] == ("conversations", pair) and got[3] == ("prompt_response", pair)
    assert got[4] == ("instruction", [("system", "be"), *pair]) and got[5] == ("prompt_completion", pair[1:])
    assert all(got[k] == (None, None) for k in (6, 7, 8, 9))
    table = spark.createDataFrame([(1, "hi", "yo", 9)], "conv_id long, prompt string, response string, extra int")
    assert [(r["role"], r["text"]) for r in chat.turns_of_table(table).orderBy("pos").collect()] == pair
    nested = spark.createDataFrame([(1, [("user", "hi"), ("assistant", "yo")]), (2, None)], "conv_id long, messages array<struct<role:string,content:string>>")
    assert chat.turns_of_table(nested).count() == 2


def test_chat_ignores_further_fields_and_loses_no_conversation(spark):
    records = [
        (1, '{"id": 7, "meta": {"a": {"b": [1]}}, "messages": [{"role": "user", "name": "n", "content": "{\\"x\\": [1]}"}, {"role": "gpt", "content": "yo", "tags": []}]}'),
        (2, '{"question": "q", "prompt": "hi", "system": null, "response": "yo", "tags": ["a"]}'), (3, '{"other": {"prompt": 1}}'), (4, None), (5, '{"conversations": [{"from": "gpt", "value": "[INST]", "w": 1}]}'),
    ]
    df = spark.createDataFrame(records, "conv_id long, record string")
    rows = chat.turns_of_json(df, "record")
    got = {r["key"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in rows.collect()}
    assert got[1] == ("messages", [("user", '{"x": [1]}'), ("gpt", "yo")])
    assert got[2] == ("system_prompt_response", [("user", "hi"), ("assistant", "yo")])
    assert got[3] == got[4] == (None, None) and got[5] == ("conversations", [("assistant", "[INST]")])
    out = {r["conv_id"]: (len(r["t"]), len(r["loss"])) for r in chat.format_turns(chat.exploded(rows)).withColumn("t", chat.parse(F.col("formatted"))).collect()}
    assert out == {1: (2, 0), 2: (2, 1), 3: (0, 0), 4: (0, 0), 5: (1, 1)}


def test_roles_of_turn_rows_stay(spark):
    df = spark.createDataFrame([(1, 0, "human", "a"), (1, 1, "gpt", "b")], "conv_id long, turn long, role string, text string")
    assert [r["role"] for r in chat.turns_of_table(df).orderBy("pos").collect()] == ["human", "gpt"]


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "~1 ~0 ~", "<<s>s>", "[INST", "", None, "a\n<s>é🙂", "[[INST]/INST]", "x" * 50000]
    rows = [(1, k, ["user", "assistant", "</s>", None][k % 4], t) for k, t in enumerate(hard)] + [(2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, None, "user", "n")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_turns(chat.turns_of_table(df)).select("conv_id", chat.parse(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("l")).collect()
    got = {r["conv_id"]: ([tuple(t) for t in r["t"]], r["l"]) for r in out}
    assert got[1][0] == [(["user", "assistant", "</s>", ""][k % 4], t or "") for k, t in enumerate(hard)]
    assert got[1][1] == "".join(t or "" for k, t in enumerate(hard) if k % 4 == 1)
    assert got[2] == ([("assistant", "a"), ("assistant", "a"), ("assistant", "b")], "aab") and got[None][0] == [("user", "n")]
