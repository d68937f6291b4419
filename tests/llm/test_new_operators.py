"""Filter audit, vector codes and graph search against brute force."""

import hashlib
import math
import re
from itertools import permutations

import numpy as np
import pytest

from tracewell.llm import filter_audit, graph_search, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAN, INF = float("nan"), float("inf")


# -- filter audit ----------------------------------------------------------------------------

LONG = " ".join(f"word{i}" for i in range(250))
DOCS = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG.upper(), "de"), (4, "a b # c", "de"), (5, None, None), (6, "", None), (7, "same " * 300, ""), (7, "same " * 300, ""),
    (None, LONG, "en"), (None, LONG + " more", "en"), (8, "\t\n ", "fr"), (9, "é" * 40 + "ABC", "fr"), (10, LONG + " $", "en"), (11, LONG * 40, "de"), (12, LONG, "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (4, 0, 1), (None, 1, 1), (99, 1, 1), (8, 1, 0), (12, 1, None)]


def failures(rows, labels):
    out = []
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        smaller = any((x or "") == t and j is not None and (i is None or j < i) for j, x, _ in rows)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), smaller]
        mine = [x for x in labels if i is not None and x[0] == i]
        out.append((lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    return out


def brute_audit(rows):
    want = {}
    removed = {}
    parts = {r[0] for r in rows}
    for part in parts:
        own = [r for r in rows if r[0] == part]
        for order in permutations(range(5)):
            left = list(own)
            for step, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                before = order[:step]
                left = [r for r in left if not r[1][f]]
                want[part, "".join("ABCDE"[j] for j in order), step + 1] = [
                    len(left), len(gone), sum(r[1][f] and any(r[1][b] for b in before) for r in own), sum(r[1][f] and sum(r[1]) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
                removed[part, f] = removed.get((part, f), 0) + len(gone)
    return {k: (*v[:-1], removed[k[0], v[-1]]) for k, v in want.items()}


@pytest.mark.parametrize("partitions, rows", [(1, 1 << 18), (5, 1 << 18), (2, 3)])
def test_filter_audit(spark, partitions, rows, monkeypatch):
    monkeypatch.setattr(filter_audit, "BITMAP_ROWS", rows)
    monkeypatch.setattr(filter_audit, "BLOCK", 5000)
    docs = spark.createDataFrame([(i, t, lang, "x", 5) for i, t, lang in DOCS], "doc_id long, text string, lang string, part string, A int").repartition(partitions)
    labels = spark.createDataFrame([(*x, "y") for x in LABELS], "doc_id long, quality int, toxic int, text string")
    index = filter_audit.bitmap_index(filter_audit.document_failures(docs, labels), "ABCDE", ["good", "toxic"])
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in filter_audit.audit(index, "ABCDE", ["good", "toxic"]).collect()}
    assert got == brute_audit(failures(DOCS, LABELS))


def test_audit_of_no_rows_and_of_other_filters(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit.document_failures(docs, labels)
    assert filter_audit.audit(filter_audit.bitmap_index(rows, "ABCDE", ["good", "toxic"]), "ABCDE", ["good", "toxic"]).count() == 0
    # two filters without labels, a null flag passes
    rows = spark.createDataFrame([("p", True, None), ("p", True, True), ("q", False, True)], "part string, x boolean, y boolean")
    got = filter_audit.audit(filter_audit.bitmap_index(rows, ["x", "y"], []), ["x", "y"], []).where("filter_order = 'yx' and part = 'p'").orderBy("step").collect()
    assert [(r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in got] == [(1, 1, 0, 0, 1), (0, 1, 1, 1, 3)]
    with pytest.raises(ValueError):
        filter_audit.audit(rows, "ABCDEFGHI", [])


# -- vector codes ----------------------------------------------------------------------------

def brute_codes(rows, parts, entries, rounds, scale=4096):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    book = [[cut(r[2], p) for r in kept[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(cut(r[2], p), e)), k) for k, e in enumerate(book[p])) for p in range(parts)] for r in kept]

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for k in range(len(book[p])):
                mine = [cut(r[2], p) for r, a in zip(kept, at) if a[p][1] == k]
                if mine:
                    book[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    at = assign()
    errors = [sum(d for d, _ in a) for a in at]
    total = {}
    for r, e in zip(kept, errors):
        total[r[1]] = total.get(r[1], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in a), e, total[r[1]]) for r, a, e in zip(kept, at, errors)), key=str), digest


def vector_rows(n, dim, seed=1):
    rng = np.random.RandomState(seed)
    v = (rng.standard_normal((n, dim)) * rng.choice([0.01, 1.0, 30.0], (n, 1))).round(rng.randint(0, 4)).tolist()
    rows = [(i, int(rng.randint(3)) if i % 7 else None, x) for i, x in enumerate(v)]
    return rows + [(3, 1, v[5]), (3, 1, v[5]), (None, 2, v[1]), (900, 1, None), (901, 1, []), (902, 1, [NAN] + v[0][1:]), (903, 0, v[0][:-1] + [INF]), (904, 0, [None] + v[0][1:])]


@pytest.mark.parametrize("n, dim, parts, entries, rounds", [(60, 16, 8, 16, 6), (300, 40, 8, 16, 3), (7, 8, 8, 16, 6), (90, 24, 2, 5, 4), (80, 8, 1, 16, 2)])
def test_vector_codes(spark, n, dim, parts, entries, rounds):
    rows = vector_rows(n, dim, seed=n)
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "vec_id long, label int, embedding array<double>, code string, n int").repartition(3)
    got, books = vector_codes.compress(df, parts, entries, rounds)
    got = sorted(((r["vec_id"], r["codes"].hex(), r["error"], r["label_error"]) for r in got.collect()), key=str)
    want, digest = brute_codes(rows, parts, entries, rounds)
    assert got == want and books.sha256() == digest


def test_vectors_out_of_range_or_of_another_length(spark):
    rows = [(1, 0, [1.0] * 8), (2, 0, [2.0] * 8), (3, 0, [1e30] * 8), (4, 0, [1.0] * 16), (5, 0, [-1e300] + [0.0] * 7)]
    got, books = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    assert sorted(r["vec_id"] for r in got.collect()) == [1, 2]
    assert books.decode(np.array([[1] * 8])).tolist() == [[2.0] * 8]
    empty, books = vector_codes.compress(spark.createDataFrame(rows[:0], "vec_id long, label int, embedding array<double>"))
    assert empty.count() == 0 and books.sha256() == hashlib.sha256(b"").hexdigest()
    odd, _ = vector_codes.compress(spark.createDataFrame([(1, 0, [1.0] * 9)], "vec_id long, label int, embedding array<double>"))
    assert odd.count() == 0


@pytest.mark.parametrize("width", [1, 2, 3, 8, 13, 64])
def test_bounds_never_lose_the_nearest(width):
    rng = np.random.RandomState(width)
    for scale in (3, 1000, 1 << 20):
        book = rng.randint(-scale, scale + 1, (16, width))
        x = np.concatenate((rng.randint(-scale, scale + 1, (200, width)), book, book + rng.randint(-1, 2, book.shape), np.repeat(book[:1], 3, axis=0)))
        d = ((x[:, None] - book[None]) ** 2).sum(axis=-1)
        at, found = vector_codes.nearest(x, book)
        assert (at == d.argmin(axis=1)).all() and (found == d.min(axis=1)).all()
        for blocks in vector_codes.levels(width):
            below = vector_codes.Bounds(x, blocks).below(vector_codes.Bounds(book, blocks), np.arange(len(x))[:, None], np.arange(16)[None])
            assert (below <= d).all()


# -- graph search ----------------------------------------------------------------------------

def brute_nearest(rows, queries, k):
    use = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dim = len(min(use, key=lambda r: (r[0], len(r[1])))[1])
    use = [(i, np.array(v)) for i, v in sorted({(i, tuple(v)) for i, v in use if len(v) == dim})]
    out = {}
    for q in sorted({i for i, _ in use if i in queries}):
        v = min((tuple(x) for i, x in use if i == q))
        near = sorted((float(np.sqrt(((np.array(v) - x) ** 2).sum())), i) for i, x in use if i != q)
        out[q] = near[:k]
    return out


def searched(spark, rows, queries, k=10, shard_rows=graph_search.SHARD_ROWS):
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<double>, score double, rank int").repartition(3)
    index = graph_search.build(df, k, shard_rows=shard_rows)
    out = {}
    for r in graph_search.search(index, df.where(df["vec_id"].isin(sorted(queries))), k).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_graph_search_small_and_odd(spark):
    rows = [(i, [float(i), 1.0]) for i in range(40)] + [(100 + i, [3.0, 1.0]) for i in range(30)]
    rows += [(200, None), (201, []), (202, [NAN, 1.0]), (203, [0.0, 0.0]), (204, [None, 1.0]), (205, [INF, 1.0]), (206, [1.0, 2.0, 3.0]), (None, [3.0, 1.0]), (5, [9.0, 1.0]), (5, [9.0, 1.0]), (6, [6.0, 1.0])]
    queries = {0, 3, 5, 6, 105, 200, 203, 206}
    assert searched(spark, rows, queries) == brute_nearest(rows, queries, 10)
    assert searched(spark, rows, queries, k=3, shard_rows=7) == brute_nearest(rows, queries, 3)
    assert searched(spark, rows[:4], {0, 1}) == brute_nearest(rows[:4], {0, 1}, 10)  # fewer candidates than asked for
    assert searched(spark, rows[:1], {0}) == {}
    assert searched(spark, [], {0}) == {}


@pytest.mark.parametrize("n, dim, shard_rows, copies", [(3000, 24, 1 << 17, 0), (3000, 24, 700, 900), (1500, 3, 1 << 17, 300)])
def test_graph_search_recall(spark, n, dim, shard_rows, copies, monkeypatch):
    monkeypatch.setattr(graph_search, "BLOCK", 16)
    monkeypatch.setattr(graph_search, "WAVE", 2)
    rng = np.random.RandomState(n + dim)
    centres = rng.standard_normal((8, dim)) * 2
    v = (centres[rng.randint(8, size=n)] + rng.standard_normal((n, dim))).astype(np.float32).astype(float)
    v[n - copies :] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    queries = set(range(0, n, 20))
    got, want = searched(spark, rows, queries, shard_rows=shard_rows), brute_nearest(rows, queries, 10)
    assert got.keys() == want.keys() and all(len(got[q]) == 10 for q in got)
    # every score is that of its pair, and nearly all of the nearest are found
    assert all(abs(d - float(np.sqrt(((v[q] - v[i]) ** 2).sum()))) < 1e-12 for q in got for d, i in got[q])
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.98
    assert all(got[q][0] == want[q][0] for q in range(n - copies, n, 20) if q in want) or not copies
