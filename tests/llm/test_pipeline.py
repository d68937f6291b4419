"""The five stages on a small fixture, each against brute force on its own input."""

import random

import corpus_pipeline
import pytest
from test_training_data import WORD, brute_classes, shingle_sets, windows

from tracewell.llm import bpe, quality
from tracewell.llm.queries import PATTERN, ranks, table
from tracewell.llm.scratch import new_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rng = random.Random(2)
    words = [f"word{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, text(rng.randrange(25, 90))) for k in range(60)]
    passage, item = text(60), text(40)
    rows += [(100 + k, text(80) + " " + passage + "\n" + text(80)) for k in range(5)]  # a shared passage
    rows += [(200 + k, rows[k][1].upper() + (" end" if k % 2 else "")) for k in range(10)]  # copies and near copies
    rows += [(300, text(60) + " " + item), (301, item), (5, rows[5][1]), (6, text(50)), (None, rows[7][1]), (None, text(30))]
    rows += [(400, None), (401, ""), (402, "short"), (403, "spam ### " * 40), (404, text(6000))]
    docs = [(i, t, "en", "web", len(t) if t is not None else None) for i, t in rows]
    labels = [(i, 1) for i, _ in rows[:60]] + [(403, 0), (402, 0)]
    return docs, labels, [(1, item), (2, None), (3, "a b c")]


@pytest.fixture(scope="module")
def folder(spark):
    docs, labels, items = fixture()
    path = new_path(spark, "pipeline")
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def key(row):
    return str(row)


def rows_of(df):
    return sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in df.collect()), key=key)


def keepers(rows):
    """Of each class the row with the least id; the fixture has no two texts of one id in a class."""
    classes = brute_classes([(i, t) for i, t, _ in rows])
    out, seen = [], set()
    for row, (i, n, least) in sorted(zip(rows, classes, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        if not n or (i == least and (least, n) not in seen):
            out.append(row)
            seen.add((least, n))
    return sorted(out, key=key)


def without_repeats(rows):
    least, out = windows([(i, t) for i, t, _ in rows], 13), []
    for i, t, n in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < (1 << 63 if i is None else i):
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, kept, len(kept)) if any(gone) else (i, t, n))
    return sorted(out, key=key)


def test_stages_against_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "byte-level BPE encoding and decoding"]
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "stage")
        stage(spark, found[-1], folder).write.parquet(path)
        found.append(spark.read.parquet(path))
        assert name[0] == "b" or found[-1].columns == docs.columns
    before, good, one, cut, clean = (rows_of(d) for d in found[:5])
    forest = quality.train(docs, table(spark, folder, "labels"))
    assert good == rows_of(quality.judge(docs, forest).where("kept"))
    assert {400, 401, 402, 403} & {i for i, _, _ in before} == {400, 401, 402, 403} and not {400, 401, 402, 403} & {i for i, _, _ in good}
    assert one == keepers(good) and len(one) < len(good)
    assert {5, 6} <= {i for i, _, _ in one} and sum(i == 6 for i, _, _ in one) == 2 and sum(i == 5 for i, _, _ in one) == 1
    assert cut == without_repeats(one) and sum(n for _, _, n in cut) < sum(n for _, _, n in one)
    items = [s for _, s in shingle_sets([(i, t) for i, t in fixture()[2]]) if s]
    assert clean == [r for r, (_, have) in zip(cut, shingle_sets([r[:2] for r in cut]), strict=True) if not any(100 * len(s & have) >= 80 * len(s) for s in items)]
    assert 300 not in {i for i, _, _ in clean}
    enc = bpe.encoding(ranks(), PATTERN)
    got = sorted(((r["doc_id"], list(r["ids"]), r["n_tokens"], r["lossless"]) for r in found[5].collect()), key=key)
    assert got == sorted(((i, ids, len(ids), True) for i, ids in ((i, enc.encode_ordinary(t)) for i, t, _ in clean)), key=key)
    whole = sorted(((r["doc_id"], list(r["ids"])) for r in corpus_pipeline.run(spark, folder).collect()), key=key)
    assert whole == sorted(((i, ids) for i, ids, _, _ in got), key=key)


def test_columns_of_any_name_go_along_and_empty_tables_stay_empty(spark, folder):
    docs = table(spark, folder, "documents").where("doc_id < 8")
    for name in ("kept", "n_words", "kept_text", "_crc", "ids"):
        docs = docs.withColumn(name, docs["doc_id"])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert all(r["kept"] == r["doc_id"] == r["n_words"] == r["kept_text"] for r in out.collect()), k
        assert stage(spark, docs.limit(0), folder).count() == 0
