"""Operators on small worlds whose results are derived by hand."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions import scalars as S
from tracewell.operators import chain, closure, diff, ground, members, patches, renames, report, similarity, spans
from tracewell.plans.session import checkpointing


@pytest.fixture(autouse=True)
def _checkpoints(spark):
    checkpointing(spark)


def test_first_miss_decides_the_reason(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "k string, v string")
    b = spark.createDataFrame([("1", "one")], "k string, v string")
    q = spark.createDataFrame([("x",), ("y",), ("z",), ("w",), (None,)], "name string")
    out = chain.hop_chain(q, "name", [chain.Hop("a", a, "k", "v", "no a"), chain.Hop("b", b, "k", "v", "no b")])
    got = {r["name"]: (r["resolved"], r["reason"], r["chain"]) for r in out.collect()}
    assert got == {"x": ("one", None, "a:1 > b:one"), "y": (None, "no b", "a:2"), "z": (None, "no b", ""), "w": (None, "no a", ""), None: (None, "no a", "")}


def test_first_and_last_win(spark):
    t = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b")], "k string, at int, v string")
    assert chain.unique_on(t, "k", "at").first()["v"] == "c"
    assert chain.unique_on(t, "k", "at", "first").first()["v"] == "a"


def test_change_kinds(spark):
    old = spark.createDataFrame([("K", "m", "(I)V"), ("K", "gone", "()V"), ("K", "sig", "(I)V"), ("Old", "x", "()V"), ("K", "two", "(I)V"), ("K", "two", "(J)V")], "owner string, name string, desc string")
    new = spark.createDataFrame([("K", "m", "(I)V"), ("K", "sig", "(J)V"), ("K", "fresh", "()V"), ("New", "x", "()V"), ("K", "two", "(F)V")], "owner string, name string, desc string")
    got = sorted(tuple(r) for r in diff.member_diff(old, new).collect())
    assert got == sorted([
        ("descChanged", "K", "sig", "(I)V", "(J)V"), ("removed", "K", "gone", "()V", None), ("added", "K", "fresh", "()V", None),
        ("removed", "K", "two", "(I)V", None), ("removed", "K", "two", "(J)V", None), ("added", "K", "two", "(F)V", None),
    ], key=str) or got


def test_closure_order_and_cycles(spark):
    edges = spark.createDataFrame([("a", 0, "b"), ("a", 1, "c"), ("b", 0, "d"), ("c", 0, "e"), ("c", 1, "d"), ("d", 0, "a")], "child string, ord int, parent string")
    out = closure.ordered_closure(edges, spark.createDataFrame([("a",), ("q",)], "n string"))
    walk = [r["node"] for r in out.where("root = 'a'").orderBy("depth", "path").collect()]
    assert walk == ["a", "b", "c", "d", "e"]
    assert [tuple(r)[:3] for r in out.where("root = 'q'").collect()] == [("q", "q", 0)]


def test_first_hits_are_made_inside_blocks(spark, monkeypatch):
    """A random hierarchy with cycles against the walk itself; nothing moves once roots and facts have met."""
    import random

    rng = random.Random(8)
    monkeypatch.setattr(closure, "BLOCK_ROOTS", 4)
    monkeypatch.setattr(closure, "BLOCK_ROWS", 30)
    edges = [(c, o, p) for c in range(60) for o, p in enumerate(rng.sample(range(60), rng.randrange(0, 3)))]
    facts = [(rng.randrange(70), rng.choice(["u", "v", None]), rng.randrange(3)) for _ in range(50)]
    frame = spark.createDataFrame(edges, "child int, ord int, parent int")
    roots = spark.createDataFrame([(n,) for n in [*range(0, 65, 2), None]], "root int")
    out = closure.first_hit(frame, roots, spark.createDataFrame(facts + facts[:9], "n int, a string, b int"), "n", ["a", "b"])
    want = {}
    for r in closure.ordered_closure(frame, roots).orderBy("root", "depth", "path").collect():
        for a, b in {(a, b) for n, a, b in facts if n == r["node"]}:
            want.setdefault((r["root"], a, b), (r["node"], r["depth"]))
    assert out.columns == ["root", "a", "b", "node", "depth"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str((*k, *v)) for k, v in want.items()) and want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("FlatMapCoGroupsInArrow") and "Aggregate" not in plan.split("\n")[0]


def test_ties_are_refused(spark):
    pairs = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.9), (2, 12, 0.8), (3, 12, 0.7), (4, 13, 0.6)], "l int, r int, s double")
    assert sorted((r["l"], r["r"]) for r in similarity.strict_mutual_best(pairs, "l", "r", ["s"]).collect()) == [(2, 12), (4, 13)]
    assert [tuple(r)[:3] for r in similarity.refused(pairs, "l", "s").collect()] == [(1, 0.9, 2)]


def test_jaccard_pairs_miss_nothing(spark):
    import random

    rng = random.Random(0)
    sides = [[(k, t) for k in range(40) for t in {rng.randrange(12) for _ in range(rng.randrange(1, 9))}] for _ in range(2)]
    frames = [spark.createDataFrame([(k, str(t)) for k, t in s], "id int, token string") for s in sides]
    sets = [{k: {t for j, t in s if j == k} for k, _ in s} for s in sides]
    for threshold in (0.3, 0.5, 0.8, 1.0):
        got = {(r["l"], r["r"]) for r in similarity.jaccard_pairs(*frames, threshold=threshold).collect()}
        assert got == {(a, b) for a, x in sets[0].items() for b, y in sets[1].items() if len(x & y) >= threshold * len(x | y)}
    copies = [f.unionByName(f.where("id < 9").withColumn("id", F.col("id") + 100)) for f in frames]
    want = similarity.strict_mutual_best(similarity.jaccard_pairs(*copies), "l", "r", ["jaccard"])
    assert sorted(map(tuple, similarity.best_pairs(*copies).select("l", "r", "overlap", "jaccard").collect())) == sorted(map(tuple, want.select("l", "r", "overlap", "jaccard").collect()))


def test_sets_meet_only_where_they_can_reach_the_threshold(spark):
    """A line that every set has, beside one of its own, brings no two of them together; repeats count once."""
    hot = lambda s: spark.range(60).select("id", F.explode(F.array(F.lit("all"), F.lit("all"), F.concat(F.lit(s), F.col("id").cast("string")))).alias("token"))
    other = lambda s: spark.range(60).select("id", F.concat(F.lit(s), F.col("id").cast("string")).alias("token"))
    left = hot("l").unionByName(other("r")).unionByName(spark.createDataFrame([(100, "all")], "id long, token string"))
    right = hot("r").unionByName(other("q")).unionByName(spark.createDataFrame([(100, "all")], "id long, token string"))
    met, made = [], similarity._meetings
    try:
        similarity._meetings = lambda each, threshold: met.append(made(each, threshold)) or met[-1]
        got = sorted(map(tuple, similarity.jaccard_pairs(left, right, threshold=0.5).select("l", "r", "overlap", "jaccard").collect()))
    finally:
        similarity._meetings = made
    # {all, l_i, r_i} and {all, r_i, q_i}: two of four
    assert got == [(i, i, 2, 0.5) for i in range(60)] + [(100, 100, 1, 1.0)]
    assert met[0].count() < 200


def test_copies_are_expanded_in_lots(spark, monkeypatch):
    monkeypatch.setattr(similarity, "LOT", 3)
    rows = lambda n, sets: spark.createDataFrame([(100 * k + c, t) for k, ts in enumerate(sets) for c in range(n) for t in ts], "id int, token string")
    sets = [["a", "b"], ["a"], ["a", "b", "c"], ["x"]]
    for n, m in ((7, 2), (2, 7), (3, 3)):
        got = sorted(map(tuple, similarity.jaccard_pairs(rows(n, sets), rows(m, sets)).select("l", "r", "overlap", "jaccard").collect()))
        each = [(j, k, len({*x} & {*y}), len({*x} & {*y}) / len({*x} | {*y})) for j, x in enumerate(sets) for k, y in enumerate(sets)]
        assert got == sorted((100 * j + a, 100 * k + b, o, s) for j, k, o, s in each if s >= 0.5 for a in range(n) for b in range(m))


def test_refused_owners_equal_refused_pairs(spark):
    import random

    rng = random.Random(4)
    side = lambda: spark.createDataFrame([(k, t) for k in range(60) for t in {rng.choice("abcdef") for _ in range(rng.randrange(1, 4))}], "id int, token string")
    left, right = side(), side()
    want = similarity.refused(similarity.jaccard_pairs(left, right), "l", "jaccard").select("l", "best", "ties", "reason")
    got = similarity.refused_owners(left, right).select("l", "best", "ties", "reason")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()


def test_spans(spark):
    s = spark.createDataFrame([(1, "u", 0, 5), (2, "u", 5, 6), (3, "u", 4, 5), (4, "v", 0, 9), (5, "v", 1, 2), (6, "v", 20, 21)], "id int, g string, a int, b int")
    assert {r["id"] for r in spans.overlap_flags(s, "g", "a", "b", "id").where("overlaps").collect()} == {1, 3, 4, 5}
    p = spark.createDataFrame([(1, "u", 4), (2, "u", 6), (3, "v", 9), (4, "v", 2), (5, "w", 0)], "id int, g string, t int")
    assert {r["id"] for r in spans.uncovered(p, s, "g", "t", "a", "b").collect()} == {2, 3, 5}
    ops = F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("AAAA").alias("after")), F.struct(F.lit(8).alias("start"), F.lit(11).alias("end"), F.lit("C").alias("after")))
    assert spark.range(1).select(spans.splice(F.lit("aaa bbb ccc"), ops)).first()[0] == "AAAA bbb C"


@pytest.mark.parametrize("hot", [1 << 20, 40, 3])
def test_running_values_of_a_hot_key(spark, hot):
    """One key with most of the rows, nulls among keys and values, against a loop."""
    import random

    from tracewell.operators import running

    rng = random.Random(hot)
    rows = [(i, rng.choice(["a"] * 8 + ["b", None]), rng.choice([None, *range(9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, v int").repartition(5)
    for inclusive in (True, False):
        for order, step in (([F.col("id")], 1), ([F.desc("id")], -1)):
            values = {"m": ("max", F.col("v")), "s": ("sum", F.col("v")), "l": ("last", F.col("v")), "w": ("last", F.struct("v"))}
            got = {r["id"]: (r["m"], r["s"], r["l"], r["w"] and (r["w"]["v"],)) for r in running.running(df, "g", order, values, inclusive, hot).collect()}
            want, seen = {}, {}
            for i, g, v in rows[::step]:
                old = seen.get(g, [])
                now = [*old, v]
                have = [x for x in (now if inclusive else old) if x is not None]
                last = now if inclusive else old
                want[i] = (max(have, default=None), sum(have) if have else None, have[-1] if have else None, (last[-1],) if last else None)
                seen[g] = now
            assert got == want
    tokens = [(i, "k", i * 3 % 17, rng.choice([-1, 0, 1])) for i in range(120)]
    out = spans.token_positions(spark.createDataFrame(tokens, "i int, g string, at int, step int"), "g", ["i"], "at", lambda now, last: last.isNull() | (now < last), F.col("step"), hot=hot)
    assert [(r["begins"], r["depth"]) for r in out.orderBy("i").collect()] == [(k == 0 or t[2] < tokens[k - 1][2], sum(x[3] for x in tokens[: k + 1])) for k, t in enumerate(tokens)]
    pieces = [(i, "f", (a := rng.randrange(500)), a + rng.randrange(1, 6)) for i in range(80)]
    flags = {r["i"] for r in spans.overlap_flags(spark.createDataFrame(pieces, "i int, f string, a int, b int"), "f", "a", "b", "i", hot=hot).where("overlaps").collect()}
    assert flags == {x[0] for x in pieces if any(x[0] != y[0] and x[2] < y[3] and y[2] < x[3] for y in pieces)}
    free = {r["p"] for r in spans.uncovered(spark.createDataFrame([(p, "f") for p in range(510)], "p int, f string"), spark.createDataFrame(pieces, "i int, f string, a int, b int"), "f", "p", "a", "b", hot=hot).collect()}
    assert free == {p for p in range(510) if not any(x[2] <= p < x[3] for x in pieces)}


@pytest.mark.parametrize("hot", [1 << 20, 2])
def test_lines_of_offsets(spark, hot):
    from tracewell.operators import running

    texts = {1: "one\ntwo\n\nfour", 2: "", 3: "\n\n", 4: None, 5: "é\r\nx"}
    docs = spark.createDataFrame(list(texts.items()), "d int, t string")
    points = [(d, p) for d, t in texts.items() for p in range(-1, len(t or "") + 2)] + [(None, 3), (1, None), (9, 0)]
    out = running.asof(spark.createDataFrame(points, "d int, p long"), running.line_starts(docs, "d", "t", hot), "d", "p", "start", "line", hot)
    want = [(d, p, None if d is None or p is None or p < 0 or texts.get(d) is None else texts[d][:p].count("\n") + 1) for d, p in points]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_edit_pairs_lose_none(spark, most):
    import random

    from tracewell.operators import edit

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(most)
    sides = [sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in range(90)}) for _ in range(2)]
    frames = [spark.createDataFrame([(x,) for x in s] + [(None,), (s[0],)], "name string") for s in sides]
    got = {tuple(r) for r in edit.edit_pairs(*frames, most=most).collect()}
    assert got == {(a, b, d) for a in sides[0] for b in sides[1] if (d := distance(a, b)) <= most}
    near = {r["l"]: (r["dist"], r["suggestion"]) for r in edit.suggestions(*frames, most=most).collect()}
    assert near == {a: b for a in sides[0] if (b := min((distance(a, x), x) for x in sides[1]))[0] <= most and b[0] < len(b[1])}


def test_closure_has_no_depth_limit_and_keeps_the_first_path(spark):
    edges = [(k, 0, k + 1) for k in range(150)] + [(0, 1, 2), (3, 1, 5), (4, 1, 5), (150, 0, 0)]
    out = closure.ordered_closure(spark.createDataFrame(edges, "child int, ord int, parent int"), spark.createDataFrame([(0,), (149,)], "n int"))
    want = {}
    for root in (0, 149):
        level, depth, seen = [(root, [])], 0, {root: (0, [])}
        while level:
            depth += 1
            reach = {}
            for node, path in level:
                for c, o, p in edges:
                    if c == node and p not in seen:
                        reach[p] = min(reach.get(p, [9] * 999), [*path, o])
            seen |= {p: (depth, path) for p, path in reach.items()}
            level = sorted(reach.items(), key=lambda x: x[1])
        want |= {(root, n): v for n, v in seen.items()}
    assert {(r["root"], r["node"]): (r["depth"], list(r["path"])) for r in out.collect()} == want


def test_members_across_versions(spark):
    old = spark.createDataFrame([("A", "method", "run", "(I)V"), ("A", "method", "run", "(J)V"), ("A", "field", "x", "I"), ("Base", "method", "up", "()V"), ("Base", "method", "two", "(I)V"), ("Base", "method", "two", "(J)V"), ("A", "method", "gone", "()V"), ("Base", "method", "moved", "()V")], "owner string, kind string, name string, desc string")
    classes = spark.createDataFrame([("A", "Base", []), ("Base", "java/lang/Object", [])], "owner string, super string, interfaces array<string>")
    new = _members(spark, [("A", "method", "run", "(I)V"), ("A", "method", "run", "(J)V"), ("A", "field", "x", "I"), ("Base", "method", "up", "()V"), ("A", "method", "moved", "()V"), ("Base", "method", "gone", "()V")])
    asked = [(1, "method", "A", "run", "(J)V", None), (2, "method", "A", "run", None, 1), (3, "method", "A", "run", None, 3), (4, "field", "A", "x", None, None), (5, "method", "A", "up", None, 0), (6, "method", "A", "two", None, 1), (7, "method", "A", "gone", None, None), (8, "method", "A", "none", None, None), (9, "method", "Q", "x", None, None)]
    q = spark.createDataFrame(asked, "qid int, kind string, owner string, name string, desc string, args int")
    got = {r["qid"]: (r["verdict"], r["to_owner"], r["reason"]) for r in members.bridge(q, old, classes, classes, new).collect()}
    assert got == {
        1: ("EXACT", "A", "declared"), 2: ("UNRESOLVED", None, "several overloads take that many arguments"), 3: ("UNRESOLVED", None, "no overload takes that many arguments"), 4: ("EXACT", "A", "declared"),
        5: ("EXACT", "Base", "inherited"), 6: ("UNRESOLVED", None, "several overloads take that many arguments"), 7: ("CANDIDATE", "Base", "found on a supertype"), 8: ("UNRESOLVED", None, "no member of that name"), 9: ("UNRESOLVED", None, "no member of that name"),
    }


def test_edits_are_all_made_or_none(spark):
    files = spark.createDataFrame([("a", "aaa bbb"), ("b", "xyz"), ("c", "same"), ("d", "")], "file string, text string")
    ops = [("a", "1", 0, 3, "aaa", "A"), ("a", "2", 4, 7, "bbb", "B"), ("b", "1", 0, 2, "xy", ""), ("b", "2", 1, 3, "yz", ""), ("d", "1", 0, 0, "", "new"), ("q", "1", 0, 0, "", "x"), ("c", "1", None, 3, "s", "t")]
    edits = spark.createDataFrame(ops, "file string, id string, start int, end int, before string, after string")
    out, judged = patches.apply_ops(files, edits)
    assert {r["file"]: (r["text"], r["applied"], r["refused"]) for r in out.collect()} == {"a": ("A B", 2, 0), "b": ("xyz", 0, 2), "c": ("same", 0, 1), "d": ("new", 1, 0)}
    reasons = {(r["file"], r["id"]): r["reason"] for r in judged.collect()}
    assert reasons["b", "1"] == reasons["b", "2"] == "overlaps another edit" and reasons["q", "1"] == "no such file" and reasons["c", "1"] == "span out of bounds" and reasons["a", "1"] is None


def test_broken_descriptors_are_not_renamed(spark):
    bad = spark.createDataFrame([("(La/B",)], "desc string")
    with pytest.raises(Exception, match="unterminated"):
        renames.canonical_desc(bad, spark.createDataFrame([("a/B", "c")], "from string, to string")).collect()


@pytest.mark.parametrize("desc, n", [("(La/B", -1), ("(I", 1), ("()V", 0), ("(I)V", 1), ("(La/B;I[Lc/D;)V", 3), ("([[J[I)V", 2), ("I", -1)])
def test_arity(spark, desc, n):
    assert spark.range(1).select(S.arity(F.lit(desc))).first()[0] == n


def test_scalars(spark):
    one = spark.range(1).select(
        S.name_similarity(F.lit("abc"), F.lit("abd")), S.name_similarity(F.lit(""), F.lit("a")), S.common_suffix(F.lit("xyzName"), F.lit("aName")), S.round_half_up(F.lit(1.0005), 3),
        S.to_binary_name(F.lit(" a.b.C ")), S.package_of(F.lit("a/b/C")), S.package_of(F.lit("C")), S.simple_name(F.lit("a/b/C")), S.wildcard(F.lit("a.c"), "a.*"), S.wildcard(F.lit("abc"), "a.*"),
        S.format_symbol(F.lit("method"), F.lit("o"), F.lit("n"), F.lit("()V")),
    ).first()
    assert abs(one[0] - 2 / 3) < 1e-12 and tuple(one)[1:] == (0.0, 4, 1.001, "a/b/C", "a/b", "", "C", True, False, "o#n()V")


def _members(spark, rows):
    return spark.createDataFrame(rows, "owner string, kind string, name string, desc string")


def test_rename_table(spark):
    old = _members(spark, [("p/Old", "method", "exotic", "(Lp/Old;)V"), ("p/Old", "field", "rare", "I"), ("p/Keep", "method", "m", "()V"), ("p/User", "method", "use", "(Lp/Old;)V"), ("p/User", "method", "go", "(Lp/Old;I)V"),
                           ("p/R1", "method", "same", "()V"), ("p/R2", "method", "same", "()V")])
    new = _members(spark, [("p/New", "method", "exotic", "(Lp/New;)V"), ("p/New", "field", "rare", "I"), ("p/Keep", "method", "m", "()V"), ("p/Uses", "method", "use", "(Lp/New;)V"), ("p/Uses", "method", "go", "(Lp/New;I)V"),
                           ("p/Winner", "method", "same", "()V")])
    got = {(r["from"], r["to"]) for r in renames.match_classes(old, new).collect()}
    # one shared member of three is not enough for Old, and User knows only Old by name
    assert ("p/Keep", "p/Keep") in got and not any(f in ("p/R1", "p/R2") for f, _ in got)
    old2 = old.unionByName(_members(spark, [("p/Old", "field", "f2", "J"), ("p/Old", "field", "f3", "J")]))
    new2 = new.unionByName(_members(spark, [("p/New", "field", "f2", "J"), ("p/New", "field", "f3", "J")]))
    out = {r["from"]: (r["to"], r["round"]) for r in renames.match_classes(old2, new2).collect()}
    assert out["p/Old"] == ("p/New", 1) and out["p/User"] == ("p/Uses", 2)  # the second round needs the first


def brute_renames(old, new):
    """The rounds of match_classes over Python sets."""
    import re

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    simple, package = (lambda n: n.rsplit("/", 1)[-1]), (lambda n: n.rsplit("/", 1)[0] if "/" in n else "")
    found = {o: (o, 0) for o in {r[0] for r in old} & {r[0] for r in new}}
    for n in range(1, 11):
        rename = lambda d: re.sub(r"L([^;]+);", lambda m: f"L{found.get(m[1], (m[1],))[0]};", d)
        sides = [{}, {}]
        for side, rows, taken in ((0, old, set(found)), (1, new, {t for t, _ in found.values()})):
            for owner, kind, name, desc in rows:
                if owner not in taken:
                    sides[side].setdefault(owner, set()).add((kind, name, rename(desc) if side == 0 else desc))
        pairs = []
        for a, x in sides[0].items():
            for b, y in sides[1].items():
                jaccard = len(x & y) / len(x | y)
                if jaccard >= 0.5:
                    longer = max(len(simple(a)), len(simple(b)))
                    pairs.append((a, b, (jaccard * (1.0 if package(a) == package(b) else 0.9), 1 - distance(simple(a), simple(b)) / longer)))
        best = {}
        for k in (0, 1):
            for p in pairs:
                best.setdefault((k, p[k]), []).append(p)
        fresh = {}
        for p in pairs:
            if p[2][0] >= 0.5 and all(sum(q[2] >= p[2] for q in best[k, p[k]]) == 1 for k in (0, 1)):
                fresh[p[0]] = (p[1], n)
        if not fresh:
            break
        found |= fresh
    return found


def test_renames_to_a_fixpoint(spark):
    import random

    rng = random.Random(4)
    owners = [f"{'pq'[k % 2]}/K{k}" for k in range(24)]
    old = [(o, "method", f"m{rng.randrange(14)}", f"(L{rng.choice(owners)};)V" if rng.random() < 0.6 else "()V") for o in owners for _ in range(5)]
    moved = {o: (o if k < 6 else o.replace("p/", "r/") if k % 5 == 0 else f"{o}x" if k % 3 else f"{o[:2]}N{k}") for k, o in enumerate(owners)}
    new = []
    for o, kind, name, desc in old:
        for a in sorted(moved, key=len, reverse=True):
            desc = desc.replace(f"L{a};", f"L#{moved[a]};")
        if rng.random() > 0.06:
            new.append((moved[o], kind, name, desc.replace("#", "")))
    got = {r["from"]: (r["to"], r["round"]) for r in renames.match_classes(_members(spark, old), _members(spark, new)).collect()}
    want = brute_renames(old, new)
    assert got == want and max(n for _, n in want.values()) >= 2


def test_member_matches_and_preferences(spark):
    classes = spark.createDataFrame([("a/A", "a/B", 0.9)], "from string, to string, score double")
    old = _members(spark, [("a/A", "method", "getFoo", "(La/A;)V"), ("a/A", "method", "stay", "()V")])
    new = _members(spark, [("a/B", "method", "getFood", "(La/B;)V"), ("a/B", "method", "stay", "()V")])
    got = [(r["from"], r["to"]) for r in renames.match_members(old, new, classes, new).collect()]
    assert got == [("getFoo", "getFood")]
    names = spark.createDataFrame([("a/A",), ("a/B",)], "owner string")
    said = spark.createDataFrame([("a/A", "a/B", "o"), ("a/A", "a/C", "o")], "from string, to string, source string")
    merged = renames.merge_asserted(classes, said, names.where("owner = 'a/A'"), names.where("owner = 'a/B'"))
    got = {(r["to"], r["provenance"]): (r["score"], r["agreement"]) for r in merged.collect()}
    assert got == {("a/B", "derived"): (0.9, "agrees"), ("a/B", "oracle:o"): (0.55, "agrees"), ("a/C", "oracle:o"): (0.1, "disagrees")}
    assert renames.preferred(merged, ["from"]).first()["provenance"] == "derived"
    inner = spark.createDataFrame([("o/X$A", "o/Y$A"), ("o/X$B", "o/Y$B"), ("o/Z$A", "o/Y$A"), ("o/Z$B", "o/W$B")], "from string, to string")
    outer = lambda *n: spark.createDataFrame([(x,) for x in n], "owner string")
    assert [(r["from"], r["to"], round(r["score"], 3)) for r in renames.inner_agreement(inner, outer("o/X", "o/Z"), outer("o/Y", "o/W")).collect()] == [("o/X", "o/Y", 0.9)]


CLASSES = [("E", "java/lang/Object", []), ("T", "java/lang/Object", []), ("M", "E", ["T"]), ("A", "java/lang/Object", []), ("V", "A", []), ("Mover", None, None), ("B", None, None), ("C", "B", [])]
MEMBERS = [("E", "method", "level", "()LLevel;"), ("T", "method", "getTarget", "()LLiving;"), ("M", "method", "tick", "()V"), ("A", "method", "add", "(DDD)LVec3;"), ("Mover", "method", "move", "(I)V"), ("Mover", "method", "move", "(II)V"),
           # a field and an overload below what is asked for on the class above
           ("B", "method", "run", "(J)V"), ("B", "method", "size", "()I"), ("C", "method", "run", "(I)V"), ("C", "field", "size", "I")]


def _world(spark):
    return spark.createDataFrame(CLASSES, "owner string, super string, interfaces array<string>"), _members(spark, MEMBERS)


def test_ground_members(spark):
    queries = [(1, "method", "M", "level", None, None, False), (2, "method", "M", "getTarget", None, 0, True), (3, "method", "Mover", "move", None, 2, None), (4, "method", "Mover", "move", None, None, False), (5, "method", "Mover", "move", None, 5, False),
               (6, "method", "V", "add", "(I)V", None, False), (7, "method", "Q", "x", None, None, False), (8, "method", "M", "nope", None, None, False), (9, "method", "C", "run", "(J)V", None, False), (10, "method", "C", "size", "()I", None, True),
               (11, "field", "C", "size", None, 3, False), (12, "field", "B", "size", None, None, False), (13, "method", None, "x", None, None, False)]
    q = spark.createDataFrame(queries, "qid int, kind string, owner string, name string, desc string, args int, inherited boolean")
    got = {r["qid"]: (r["verdict"], r["to_owner"], r["reason"]) for r in ground.ground_members(q, *_world(spark)).collect()}
    assert got == {
        1: ("CANDIDATE", "E", "found on a supertype"), 2: ("EXACT", "T", "inherited"), 3: ("EXACT", "Mover", "declared"), 4: ("UNRESOLVED", None, "several overloads"),
        5: ("UNRESOLVED", None, "no overload with that many arguments"), 6: ("UNRESOLVED", None, "descriptor differs"), 7: ("UNRESOLVED", None, "owner is not in the snapshot"), 8: ("UNRESOLVED", None, "no member of that name"),
        9: ("CANDIDATE", "B", "found on a supertype"), 10: ("EXACT", "B", "inherited"), 11: ("EXACT", "C", "declared"), 12: ("UNRESOLVED", None, "no member of that name"), 13: ("UNRESOLVED", None, "owner is not in the snapshot"),
    }


def test_walks_stop_where_they_are_decided(spark):
    """Brute force over random hierarchies with cycles, interfaces and a hub, with and without the owner itself."""
    import random

    rng = random.Random(7)
    edges = [(k, o, p) for k in range(60) for o, p in enumerate(rng.sample(range(60), rng.randrange(3)) + ([0] if rng.random() < 0.3 else []))] + [(k, 0, k + 1) for k in range(60, 90)]
    facts = {(rng.randrange(95), rng.choice("xy"), s): rng.randrange(9) for _ in range(60) for s in ("", "d1")}
    facts |= {(n, k, ""): v for (n, k, s), v in facts.items() if s}
    asks = [(r, k, s) for r in range(92) for k in "xyz" for s in ("", "d1", "d2")]
    up = {}
    for c, o, p in sorted(edges):
        up.setdefault(c, []).append(p)
    index = spark.createDataFrame([(*k, v) for k, v in facts.items()], "node int, key string, sel string, v int")
    asked = spark.createDataFrame(asks, "root int, key string, sel string")
    for own in (True, False):
        want = {}
        for root, key, sel in asks:
            queue, seen, hit, near = [root], set(), None, None
            while queue:
                at = queue.pop(0)
                if at in seen:
                    continue
                seen.add(at)
                if own or at != root:
                    near = at if near is None and (at, key, "") in facts else near
                    hit = at if hit is None and (at, key, sel) in facts else hit
                queue += up.get(at, [])
            # what is beyond the hit is not looked at
            want[root, key, sel] = hit, near
        out = closure.first_along(asked, closure.parents(spark.createDataFrame(edges, "child int, ord int, parent int")), index, ["key"], own=own)
        got = {(r["root"], r["key"], r["sel"]): (r["hit"] and r["hit"]["node"], r["near"] and r["near"]["node"]) for r in out.collect()}
        assert got == want
        assert all(r["hit"] is None or r["hit"]["v"] == facts[r["hit"]["node"], r["key"], r["sel"]] for r in out.collect())


def test_verdict_ladder(spark):
    classes, members = _world(spark)
    classes = classes.select(F.concat(F.lit("g/"), "owner").alias("owner"), F.when(F.col("super").contains("/"), F.col("super")).otherwise(F.concat(F.lit("g/"), "super")).alias("super"), F.transform("interfaces", lambda x: F.concat(F.lit("g/"), x)).alias("interfaces"))
    members = members.withColumn("owner", F.concat(F.lit("g/"), "owner"))
    checks = [(1, None, "x", None), (2, "java/util/Map", "get", None), (3, "g/Gone", None, None), (4, "g/M", None, None), (5, "g/M", "tick", None), (6, "g/M", "level", None), (7, "g/V", "add", "(DDD)LVec3;"), (8, "g/V", "add", "()V"), (9, "g/M", "toString", None), (10, "g/M", "nope", None)]
    out = ground.check_targets(spark.createDataFrame(checks, "check int, owner string, name string, desc string"), classes, members, "g/")
    got = {r["check"]: (r["status"], r["note"]) for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "unparseable", 2: "info", 3: "absent", 4: "present", 5: "present", 6: "present", 7: "present", 8: "absent", 9: "info", 10: "absent"}
    assert got[5][1] == "" and "g/E" in got[6][1] and "(DDD)LVec3;" in got[8][1]


def test_capped_lists_and_rollups(spark):
    delta = spark.createDataFrame([("a", k) for k in range(60)] + [("b", 1)], "list string, x int")
    out = diff.capped(delta, ["x"], 25).groupBy("list").agg(F.count("*").alias("n"), F.max("total").alias("t"), F.max("returned").alias("r"), F.max("truncated").alias("c"))
    assert {tuple(r) for r in out.collect()} == {("a", 25, 60, 25, True), ("b", 1, 1, 1, False)}
    sites = report.decisions(delta, ["list"], "x").where("list = 'a'").first()
    assert sites["n"] == 60 and sites["sites"].endswith("9 (+50 more)")
    assert {tuple(r) for r in report.verdict_summary(spark.createDataFrame([("c", "EXACT"), ("c", "UNRESOLVED")], "kind string, verdict string"), "kind").collect()} == {("(all)", 2, 1, 0, 1), ("c", 2, 1, 0, 1)}


def test_resolution_in_one_piece(spark):
    from tracewell.operators import resolve

    df = spark.createDataFrame
    cls = "owner string, super string, interfaces array<string>"
    w = resolve.World(
        named=df([("mod/Player", "c10"), ("mod/Food", "c11"), ("mod/Living", "c12"), ("mod/Gone", "c13"), ("mod/Half", "c14"), ("mod/Renamed", "c15"), ("mod/Stale", "c16"), ("mod/NoMid", None)], "named string, mid string"),
        between=df([("c10", "aa"), ("c11", "bb"), ("c12", "cc"), ("c13", "dd"), ("c15", "ee"), ("c16", "ff")], "mid string, obf string"),
        official=df([("aa", "real/Player"), ("bb", "real/Food"), ("cc", "real/Living"), ("ee", "real/Renamed"), ("ff", "real/Stale"), ("hh", "real/Mover"), ("ii", "real/Child"), ("jj", "real/Parent")], "obf string, source string"),
        named_members=df([("c10", "method", "getFood", "()Lc11;", "m1"), ("c10", "method", "setLevel", "(I)V", "m2"), ("c10", "method", "setLevel", "(J)V", "m3"), ("c12", "method", "getHealth", "()F", "m9"), ("c10", "method", "old", "()V", "m4"), ("c15", "method", "keep", "()V", "m5"), ("c10", "field", "lost", "I", "f1"), ("c16", "method", "x", "()V", "m6"), ("c10", "method", "up", "()V", "m7")], "owner string, kind string, name string, desc string, mid string"),
        between_members=df([("c10", "method", "m1", 0, "a", "()Lbb;"), ("c10", "method", "m2", 1, "b", "(I)V"), ("c10", "method", "m3", 2, "c", "(J)V"), ("c12", "method", "m9", 0, "h", "()F"), ("c10", "method", "m4", 3, "d", "()V"), ("c15", "method", "m5", 0, "e", "()V"), ("c10", "field", "f1", 4, "g", "I"), ("c16", "method", "m6", 0, "k", "()V"), ("c10", "method", "m7", 5, "u", "()V")], "owner string, kind string, mid string, ord int, obf string, desc_obf string"),
        official_members=df([("aa", "method", "a", "()Lbb;", "getFood", "()Lreal/Food;"), ("aa", "method", "b", "(I)V", "setLevel", "(I)V"), ("aa", "method", "c", "(J)V", "setLevel", "(J)V"), ("cc", "method", "h", "()F", "getHealth", "()F"), ("aa", "method", "d", "()V", "old", "()V"), ("ee", "method", "e", "()V", "keep", "()V"), ("aa", "field", "g", "I", "lost", "I"), ("ff", "method", "k", "()V", "x", "()V"), ("aa", "method", "u", "()V", "up", "()V"),
                              ("hh", "method", "m", "(I)V", "move", "(I)V"), ("hh", "method", "m", "(II)V", "move", "(II)V"), ("jj", "method", "p", "(I)V", "process", "(I)V"), ("jj", "method", "p", "(II)V", "process", "(II)V")], "owner string, kind string, obf string, desc_obf string, source string, desc string"),
        old_classes=df([("aa", "cc", []), ("bb", "java/lang/Object", []), ("cc", "java/lang/Object", []), ("ii", "jj", [])], cls),
        classes=df([("real/Player", "real/Living", []), ("real/Food", None, []), ("real/Living", None, []), ("real/New", None, []), ("real/Mover", None, []), ("real/Child", "real/Parent", []), ("real/Parent", None, [])], cls),
        members=df([("real/Player", "method", "getFood", "()Lreal/Food;"), ("real/Player", "method", "setLevel", "(I)V"), ("real/Player", "method", "setLevel", "(J)V"), ("real/Living", "method", "getHealth", "()F"), ("real/Living", "method", "newer", "(I)V"), ("real/New", "method", "keep", "()V"), ("real/New", "method", "kept", "()V"), ("real/Living", "method", "up", "()V"),
                    ("real/Mover", "method", "move", "(I)V"), ("real/Mover", "method", "move", "(II)V"), ("real/Parent", "method", "process", "(II)V")], "owner string, kind string, name string, desc string"),
        class_renames=df([("real/Renamed", "real/New", 0.8, "derived"), ("real/Stale", "real/Nowhere", 0.7, "derived")], "from string, to string, score double, provenance string"),
        member_renames=df([("real/Player", "method", "old", "()V", "newer", 0.6, "derived"), ("real/Renamed", "method", "keep", None, "kept", 0.9, "oracle:x"), ("real/Player", "field", "lost", "I", "nowhere", 0.6, "derived")], "owner string, kind string, from string, desc string, to string, score double, provenance string"),
        owned="mod/",
    )
    asked = [
        (1, "named", "class", "mod/Player", None, None, None), (2, "named", "method", "mod/Player", "getFood", None, None), (3, "named", "method", "mod/Player", "setLevel", None, None), (4, "named", "method", "mod/Player", "setLevel", None, 1),
        (5, "named", "method", "mod/Player", "getHealth", None, None), (6, "named", "class", "mod/DoesNotExist", None, None, None), (7, "named", "method", "mod/Player", "noSuch", None, None), (8, "source", "method", "real/Player", "getFood", None, None),
        (9, "named", "method", "mod/Player", "setLevel", "(J)V", None), (10, "named", "method", "mod/Player", "getFood", "()Lmod/Food;", None), (11, "named", "class", "mod/Gone", None, None, None), (12, "named", "class", "mod/Half", None, None, None), (13, "named", "class", "mod/Renamed", None, None, None),
        (14, "named", "class", "mod/Stale", None, None, None), (15, "named", "method", "mod/Player", "old", None, None), (16, "named", "method", "mod/Renamed", "keep", None, None), (17, "named", "field", "mod/Player", "lost", None, None), (18, "named", "method", "mod/Stale", "x", None, None),
        (19, "source", "method", "real/Mover", "move", None, 2), (20, "source", "method", "real/Mover", "move", None, None), (21, "source", "method", "real/Mover", "move", None, 5), (22, "source", "method", "real/Child", "process", None, 2), (23, "source", "method", "real/Child", "process", None, 7),
        (24, "named", "method", "mod/Player", None, None, None), (25, "named", "class", "mod/NoMid", None, None, None), (26, "source", "class", "no/Such", None, None, None), (27, "named", "method", "mod/Player", "up", None, None), (28, "named", "method", None, "x", None, None),
    ]
    out = {r["qid"]: r for r in resolve.resolve(df(asked, "qid int, ns string, kind string, owner string, name string, desc string, args int"), w).collect()}
    assert len(out) == len(asked)
    to = lambda k: out[k]["to"] and tuple(x for x in out[k]["to"] if x)
    best = lambda k: [(c["owner"], c["name"], c["desc"], c["score"], c["evidence"]) for c in out[k]["candidates"]]
    exact = {1: ("real/Player",), 2: ("real/Player", "getFood", "()Lreal/Food;"), 5: ("real/Living", "getHealth", "()F"), 8: ("real/Player", "getFood", "()Lreal/Food;"), 9: ("real/Player", "setLevel", "(J)V"), 10: ("real/Player", "getFood", "()Lreal/Food;"), 19: ("real/Mover", "move", "(II)V"), 22: ("real/Parent", "process", "(II)V")}
    assert {k: to(k) for k, r in out.items() if r["verdict"] == "EXACT"} == exact
    assert {k: best(k) for k, r in out.items() if r["verdict"] == "CANDIDATE"} == {
        13: [("real/New", None, None, 0.8, "class renamed")], 15: [("real/Living", "newer", "(I)V", 0.6, "member renamed, descriptor changed")],
        16: [("real/New", "kept", "()V", 0.9, "member renamed"), ("real/New", "keep", "()V", 0.8, "owner renamed")], 27: [("real/Living", "up", "()V", 0.9, "found on a supertype")],
    }
    assert {k: r["reason"] for k, r in out.items() if r["verdict"] == "UNRESOLVED"} == {
        3: "several overloads", 4: "several overloads", 6: "class is not among the named ones", 7: "no member of that name", 11: "official class is missing", 12: "intermediary class is missing", 14: "class is not in the new version",
        17: "member is not in the new version", 18: "member is not in the new version", 20: "several overloads", 21: "no overload takes that many arguments", 23: "no ancestor has that descriptor or number of arguments", 24: "no name", 25: "class has no intermediary name", 26: "class is not in the old version", 28: "class is not among the named ones",
    }
    assert out[14]["rejected"] == ["class real/Nowhere"] and out[17]["rejected"] == ["member nowhere"] and out[18]["rejected"] == ["class real/Nowhere"]
    assert out[5]["chain"] == ["named: mod/Player > c10", "intermediary: c10 > aa", "official: aa > real/Player", "old hierarchy: declared on cc", "named member > m9 by single", "intermediary member > h", "official member > getHealth()F by name and descriptor"]


def test_class_candidates_equal_the_pairwise_rule(spark):
    """Random snapshots with many copies against all pairs; and copies on both sides make linear rows."""
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(11)
    name = lambda side: f"{rng.choice(['p', 'q', 'r/s'])}/{''.join(rng.choice('ab') for _ in range(rng.randrange(1, 6)))}{side}"
    shapes = [{("method", f"m{k}", "()V") for k in rng.sample(range(9), rng.randrange(2, 5))} for _ in range(6)]
    sides = [{name(s): rng.choice(shapes) for _ in range(45)} for s in "xy"]
    sides[0]["p/keep"] = sides[1]["p/keep"] = shapes[0]
    simple, package = (lambda n: n.rsplit("/", 1)[-1]), (lambda n: n.rsplit("/", 1)[0])
    scores = {}
    for a, x in sides[0].items():
        for b, y in sides[1].items():
            score = len(x & y) / len(x | y) * (1.0 if package(a) == package(b) else 0.85)
            if "p/keep" not in (a, b) and score > 0.5:
                s, t = simple(a), simple(b)
                suffix = next((k for k in range(min(len(s), len(t))) if s[-1 - k] != t[-1 - k]), min(len(s), len(t)))
                scores[a, b] = (score, suffix, 1 - distance(s, t) / max(len(s), len(t)))
    best = lambda k, n: sorted((v, p) for p, v in scores.items() if p[k] == n)[-2:]
    sole = lambda k, n: (lambda t: t[-1][1] if t and (len(t) == 1 or t[0][0] != t[1][0]) else None)(best(k, n))
    want = {(a, b) for a, b in scores if sole(0, a) == (a, b) == sole(1, b)}
    flat = lambda side: _members(spark, [(o, *m) for o, ms in side.items() for m in ms])
    got = {(r["from"], r["to"]) for r in renames.class_candidates(flat(sides[0]), flat(sides[1])).collect()}
    assert got == want and want
    # 3000 copies on either side, each with a partner of its own name
    copies = [spark.range(3000).select(F.concat(F.lit(f"p/{s}"), F.format_string("%04d", "id")).alias("owner"), F.lit("method").alias("kind"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("name"), F.lit("()V").alias("desc")) for s in "OP"]
    out = renames.class_candidates(*copies)
    assert out.count() == 3000 and out.where("substr(from, 4) <> substr(to, 4)").count() == 0


def test_class_candidates_go_on_with_pairs_that_can_be_named(spark, monkeypatch):
    """Pairs at the threshold are not named, so neither they nor their owners are taken further."""
    tables = []
    monkeypatch.setattr(renames, "stored", lambda df: tables.append(df) or df)
    shape = lambda s, own: spark.range(30).select(F.concat(F.lit(f"p/{s}"), F.col("id").cast("string")).alias("owner"), F.lit("field").alias("kind"), F.explode(F.array(F.lit("a"), *([F.concat(F.lit(s), F.col("id").cast("string"))] if own else []))).alias("name"), F.lit("I").alias("desc"))
    twins = lambda s: spark.createDataFrame([(f"q/{s}", "field", "z", "I")], "owner string, kind string, name string, desc string")
    out = renames.class_candidates(shape("O", True).unionByName(twins("O")), shape("P", False).unionByName(twins("P")))
    assert [(r["from"], r["to"]) for r in out.collect()] == [("q/O", "q/P")]
    assert [t.count() for t in tables] == [1, 2]
