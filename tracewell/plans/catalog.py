"""The query catalogue: every operator on the given tables, with SQL that must agree.

Each query takes (spark, sf_dir) and reads whole tables.  ORACLE_SQL has the DuckDB form.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import chain, closure, diff, disambiguate, edit, ground, renames, report, running, similarity, spans
from ..operators.store import stored
from .session import checkpointing, registry, table

QUERIES, ORACLE_SQL, query = registry()


# -- name resolution -------------------------------------------------------------------------

_CHAIN = """
SELECT o_orderkey, o_orderpriority, r_name AS resolved,
  CASE WHEN c_custkey IS NULL THEN 'no customer entry' WHEN n_nationkey IS NULL THEN 'no nation entry' WHEN r_regionkey IS NULL THEN 'no region entry' END AS reason,
  concat_ws(' > ', CASE WHEN c_custkey IS NOT NULL THEN 'customer:' || c_nationkey END, CASE WHEN n_nationkey IS NOT NULL THEN 'nation:' || n_regionkey END,
    CASE WHEN r_regionkey IS NOT NULL THEN 'region:' || r_name END) AS chain,
  CASE WHEN r_regionkey IS NULL THEN 'UNRESOLVED' ELSE 'EXACT' END AS verdict
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) c ON o_custkey = c_custkey
LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""


@query(_CHAIN)
def chain_resolve(spark, d):
    """Orders through partial customer, nation and region maps."""
    hops = [
        chain.Hop("customer", table(spark, d, "customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')"), "c_custkey", "c_nationkey", "no customer entry"),
        chain.Hop("nation", table(spark, d, "nation").where("n_regionkey < 3"), "n_nationkey", "n_regionkey", "no nation entry"),
        chain.Hop("region", table(spark, d, "region"), "r_regionkey", "r_name", "no region entry"),
    ]
    out = chain.hop_chain(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_custkey", hops)
    return out.select("o_orderkey", "o_orderpriority", "resolved", "reason", "chain", chain.verdict(F.col("reason")).alias("verdict"))


@query(f"""
WITH r AS ({_CHAIN})
SELECT coalesce(o_orderpriority, '(all)') AS o_orderpriority, count(*) AS total, count(*) FILTER (verdict = 'EXACT') AS exact,
  count(*) FILTER (verdict = 'CANDIDATE') AS candidate, count(*) FILTER (verdict = 'UNRESOLVED') AS unresolved
FROM r GROUP BY GROUPING SETS ((), (o_orderpriority))""")
def verdict_summary(spark, d):
    """Verdict counts by priority and for all (A1, A2, A3)."""
    return report.verdict_summary(chain_resolve(spark, d), "o_orderpriority")


@query("""
SELECT o_custkey, o_orderstatus, count(*) AS n,
  CASE WHEN count(*) = 1 THEN min(o_orderkey) WHEN count(*) FILTER (o_orderpriority = '1-URGENT') = 1 THEN min(o_orderkey) FILTER (o_orderpriority = '1-URGENT') END AS pick,
  CASE WHEN count(*) = 1 OR count(*) FILTER (o_orderpriority = '1-URGENT') = 1 THEN 'EXACT' ELSE 'UNRESOLVED' END AS verdict,
  CASE WHEN count(*) = 1 THEN 'single candidate' WHEN count(*) FILTER (o_orderpriority = '1-URGENT') = 1 THEN 'narrowed to one'
    WHEN count(*) FILTER (o_orderpriority = '1-URGENT') = 0 THEN 'several candidates, none narrowed' ELSE 'ambiguous after narrowing' END AS reason
FROM orders GROUP BY o_custkey, o_orderstatus""")
def unique_or_refuse(spark, d):
    """A sole order per (customer, status), or one that urgency narrows to."""
    return disambiguate.unique_or_refuse(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey", F.col("o_orderpriority") == "1-URGENT")


# -- snapshot differences --------------------------------------------------------------------

WINDOWS = {"A": ("1996-01-01", "1996-02-01"), "B": ("1996-02-01", "1996-03-01")}
_SURFACE = """
surface AS (SELECT DISTINCT CASE WHEN l_shipdate < DATE '1996-02-01' THEN 'A' ELSE 'B' END AS snap, l_suppkey AS owner, p_brand AS name,
  CASE WHEN p_size <= 10 THEN p_type || '/*' ELSE p_type || '/' || p_size END AS "desc"
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-03-01')"""


def _shipped(spark, d, snap):
    lo, hi = WINDOWS[snap]
    return table(spark, d, "lineitem").where(f"l_shipdate >= timestamp_ntz'{lo}' and l_shipdate < timestamp_ntz'{hi}'")


def surface(spark, d, snap):
    """Distinct (owner, name, desc) of a snapshot; the date filter reaches the scan."""
    part = table(spark, d, "part")
    desc = F.when(F.col("p_size") <= 10, F.concat("p_type", F.lit("/*"))).otherwise(F.concat("p_type", F.lit("/"), F.col("p_size").cast("string")))
    met = _shipped(spark, d, snap).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return met.select(F.col("l_suppkey").alias("owner"), F.col("p_brand").alias("name"), desc.alias("desc")).distinct()


_PARTS = "(SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate >= DATE '{}' AND l_shipdate < DATE '{}')"
_A, _B = (_PARTS.format(*WINDOWS[k]) for k in "AB")


@query(f"{_A} EXCEPT {_B}")
def owners_removed(spark, d):
    """Keys of the old snapshot that the new one lacks."""
    return diff.removed(_shipped(spark, d, "A"), _shipped(spark, d, "B"), ["l_partkey"])


@query(f"{_B} EXCEPT {_A}")
def owners_added(spark, d):
    """Keys that are new."""
    return diff.removed(_shipped(spark, d, "B"), _shipped(spark, d, "A"), ["l_partkey"])


@query(f"{_A} INTERSECT {_B}")
def owners_anchor(spark, d):
    """Keys on both sides."""
    return diff.anchors(_shipped(spark, d, "A"), _shipped(spark, d, "B"), ["l_partkey"])


_DIFF = f"""{_SURFACE},
o AS (SELECT * FROM surface WHERE snap = 'A' AND owner IN (SELECT owner FROM surface WHERE snap = 'B')),
n AS (SELECT * FROM surface WHERE snap = 'B' AND owner IN (SELECT owner FROM surface WHERE snap = 'A')),
j AS (SELECT coalesce(o.owner, n.owner) AS owner, coalesce(o.name, n.name) AS name, o."desc" AS od, n."desc" AS nd
  FROM o FULL JOIN n ON o.owner = n.owner AND o.name = n.name AND o."desc" = n."desc"),
c AS (SELECT *, count(od) OVER w AS no, count(nd) OVER w AS nn, max(CASE WHEN od IS NULL THEN nd END) OVER w AS other FROM j WINDOW w AS (PARTITION BY owner, name)),
delta AS (SELECT CASE WHEN no = 1 AND nn = 1 THEN 'descChanged' WHEN nd IS NULL THEN 'removed' ELSE 'added' END AS list, owner, name, coalesce(od, nd) AS "desc",
  CASE WHEN no = 1 AND nn = 1 THEN other END AS new_desc FROM c WHERE (od IS NULL) <> (nd IS NULL) AND NOT (no = 1 AND nn = 1 AND od IS NULL))"""


@query(f'WITH {_DIFF} SELECT list, owner, name, "desc", new_desc FROM delta')
def member_diff(spark, d):
    """Members added, removed or with another descriptor, of owners on both sides."""
    return diff.member_diff(surface(spark, d, "A"), surface(spark, d, "B"))


@query(f"WITH {_DIFF} SELECT l.list, count(delta.list) AS n FROM (VALUES ('added'), ('removed'), ('descChanged')) l(list) LEFT JOIN delta ON l.list = delta.list GROUP BY l.list")
def delta_summary(spark, d):
    """Lengths of the lists, zeros included (A5)."""
    return diff.summary(member_diff(spark, d), ["added", "removed", "descChanged"])


@query(f'WITH {_SURFACE} SELECT "desc", count(*) FILTER (snap = \'A\') AS n_old, count(*) AS n_both FROM surface GROUP BY "desc"')
def desc_frequency(spark, d):
    """How often each descriptor occurs, in one snapshot and in both."""
    return diff.desc_frequency(surface(spark, d, "A"), surface(spark, d, "B"))


@query(f"""WITH {_DIFF}, p AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY owner, name, "desc") AS pos, count(*) OVER (PARTITION BY list) AS total FROM delta)
SELECT list, owner, name, "desc", new_desc, pos::INTEGER AS pos, total, least(total, 25) AS returned, total > 25 AS truncated FROM p WHERE pos <= 25""")
def delta_capped(spark, d):
    """The first 25 of each list with its true total."""
    return diff.capped(member_diff(spark, d), ["owner", "name", "desc"], 25)


@query(f"WITH {_DIFF} SELECT name, count(*) AS n FROM delta WHERE list = 'removed' GROUP BY name ORDER BY n DESC, name LIMIT 10")
def churn_topk(spark, d):
    """The ten names with most removed members."""
    return diff.churn(member_diff(spark, d).where("list = 'removed'"), "name", 10)


# -- similarity and renames ------------------------------------------------------------------

_TOKENS = """
tok AS (SELECT DISTINCT doc_id, CAST(substr(source, 4) AS INTEGER) % 2 AS side, token
  FROM (SELECT doc_id, source, unnest(string_split(lower(text), chr(10))) AS token FROM documents) WHERE length(token) > 0),
cnt AS (SELECT doc_id, side, count(*) AS n FROM tok GROUP BY doc_id, side),
pairs AS (SELECT a.doc_id AS l, b.doc_id AS r, count(*) AS overlap, count(*) / (max(ca.n) + max(cb.n) - count(*))::DOUBLE AS jaccard
  FROM tok a JOIN tok b ON a.token = b.token AND a.side = 0 AND b.side = 1 JOIN cnt ca ON ca.doc_id = a.doc_id JOIN cnt cb ON cb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING count(*) / (max(ca.n) + max(cb.n) - count(*))::DOUBLE >= 0.5)"""
_BEST = """
lb AS (SELECT l, max(jaccard) AS m FROM pairs GROUP BY l), rb AS (SELECT r, max(jaccard) AS m FROM pairs GROUP BY r),
lt AS (SELECT p.l, count(*) AS k FROM pairs p JOIN lb USING (l) WHERE p.jaccard = lb.m GROUP BY p.l),
rt AS (SELECT p.r, count(*) AS k FROM pairs p JOIN rb USING (r) WHERE p.jaccard = rb.m GROUP BY p.r),
best AS (SELECT p.* FROM pairs p JOIN lb USING (l) JOIN rb USING (r) JOIN lt USING (l) JOIN rt USING (r) WHERE p.jaccard = lb.m AND p.jaccard = rb.m AND lt.k = 1 AND rt.k = 1)"""


def line_tokens(spark, d):
    """Lower-cased lines of each document, repeats included, and the parity of its source."""
    docs = table(spark, d, "documents")
    lines = docs.select("doc_id", (F.substr("source", F.lit(4)).cast("int") % 2).alias("side"), F.explode(F.split(F.lower("text"), "\n", -1)).alias("token"))
    return lines.where(F.length("token") > 0)


@query(f"WITH {_TOKENS} SELECT l, r, overlap, jaccard FROM pairs")
def jaccard_pairs(spark, d):
    """Documents of the two sides that share at least half of their lines."""
    return similarity.jaccard_pairs(*_sides(spark, d))


def _sides(spark, d):
    checkpointing(spark)
    tokens = line_tokens(spark, d)
    return tuple(tokens.where(F.col("side") == k).select(F.col("doc_id").alias("id"), "token") for k in (0, 1))


@query(f"WITH {_TOKENS}, {_BEST} SELECT l, r, overlap, jaccard FROM best")
def mutual_best(spark, d):
    """Pairs that are each other's only best."""
    return similarity.best_pairs(*_sides(spark, d))


@query(f"WITH {_TOKENS}, {_BEST} SELECT l, m AS best, k AS ties, 'tied for the best score' AS reason FROM lb JOIN lt USING (l) WHERE k > 1")
def ambiguous_refused(spark, d):
    """Left sides whose best score is tied."""
    return similarity.refused_owners(*_sides(spark, d))


_FREQ = 'freq AS (SELECT "desc", count(*) AS f FROM surface WHERE snap = \'A\' GROUP BY "desc")'
_SOLE = f"""{_DIFF}, {_FREQ}, rem AS (SELECT owner, name, "desc" FROM delta WHERE list = 'removed'), adds AS (SELECT owner, name, "desc" FROM delta WHERE list = 'added')"""
_BLOCKS = f"""{_DIFF}, {_FREQ},
rem AS (SELECT owner, name, "desc" FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.owner = o.owner AND n.name = o.name)),
adds AS (SELECT owner, name, "desc" FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.owner = o.owner AND n.name = o.name))"""


def _frequency(spark, d):
    return surface(spark, d, "A").groupBy("desc").agg(F.count("*").alias("f"))


@query(f"""WITH {_SOLE}, r1 AS (SELECT owner, "desc", min(name) AS old_name FROM rem GROUP BY owner, "desc" HAVING count(*) = 1),
a1 AS (SELECT owner, "desc", min(name) AS new_name FROM adds GROUP BY owner, "desc" HAVING count(*) = 1)
SELECT owner, "desc", old_name, new_name, CASE WHEN f > 20 THEN 0.5 ELSE 0.8 END::DOUBLE AS score FROM r1 JOIN a1 USING (owner, "desc") JOIN freq USING ("desc") WHERE f <= 100""")
def member_pairing(spark, d):
    """The sole removed and the sole added member of an (owner, descriptor) block."""
    delta = member_diff(spark, d)
    return renames.pair_members(delta.where("list = 'removed'"), delta.where("list = 'added'"), _frequency(spark, d))


@query(f"""WITH {_BLOCKS}, x AS (SELECT owner, "desc", rem.name AS old_name, adds.name AS new_name,
  1.0 - levenshtein(rem.name, adds.name) / greatest(length(rem.name), length(adds.name))::DOUBLE AS sim,
  count(*) OVER (PARTITION BY owner, "desc") AS pairs FROM rem JOIN adds USING (owner, "desc")),
s AS (SELECT *, least(1.0, 0.3 + 0.25 * CASE WHEN pairs = 1 THEN 1.0 ELSE 0.0 END + 0.3 * (1.0 / (1.0 + log2(f))) + 0.15 * sim) AS raw FROM x JOIN freq USING ("desc")),
q AS (SELECT *, rank() OVER (PARTITION BY owner, "desc", old_name ORDER BY sim DESC) AS ra, rank() OVER (PARTITION BY owner, "desc", new_name ORDER BY sim DESC) AS rb FROM s),
t AS (SELECT *, count(*) FILTER (ra = 1) OVER (PARTITION BY owner, "desc", old_name) AS ka, count(*) FILTER (rb = 1) OVER (PARTITION BY owner, "desc", new_name) AS kb FROM q)
SELECT owner, "desc", old_name, new_name, floor(raw * 1000 + 0.5) / 1000 AS score FROM t WHERE ra = 1 AND rb = 1 AND ka = 1 AND kb = 1 AND raw >= 0.5""")
def member_scoring(spark, d):
    """Strict mutual best on name similarity inside blocks, with the weighted score (J26, X-s26, X-s27)."""
    side = lambda k: surface(spark, d, k).withColumn("kind", F.lit("member")).withColumn("desc", F.lower("desc"))
    old, new = side("A"), side("B")  # in lower case a descriptor has no class references
    owners = diff.anchors(old, new, ["owner"]).select(F.col("owner").alias("from"), F.col("owner").alias("to"))
    best = renames.match_members(old, new, owners, old)
    return best.select("owner", F.upper("desc").alias("desc"), F.col("from").alias("old_name"), F.col("to").alias("new_name"), "score")


_OUTER = f"""{_TOKENS}, {_BEST},
io AS (SELECT dl.source || '/' || dl.lang AS old_outer, dr.source || '/' || dr.lang AS new_outer FROM best JOIN documents dl ON dl.doc_id = l JOIN documents dr ON dr.doc_id = r),
ag AS (SELECT old_outer, min(new_outer) AS new_outer, count(*) AS n FROM io GROUP BY old_outer HAVING count(DISTINCT new_outer) = 1)"""


@query(f"""WITH {_OUTER} SELECT old_outer, new_outer, n, floor(least(0.95, 0.7 + 0.1 * n) * 1000 + 0.5) / 1000 AS score
FROM (SELECT *, row_number() OVER (PARTITION BY new_outer ORDER BY old_outer) AS k FROM ag) WHERE k = 1""")
def inner_agreement(spark, d):
    """Outer groups whose matched documents all point to one other group, one to one."""
    docs = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang").alias("outer"))
    met = mutual_best(spark, d).join(docs.toDF("l", "old"), "l").join(docs.toDF("r", "new"), "r")
    inner = lambda c: F.concat(c, F.lit("$In"))
    matched = met.select(inner("old").alias("from"), inner("new").alias("to"))
    owners = docs.select(F.col("outer").alias("owner"))
    found = renames.inner_agreement(matched, owners, owners)
    return found.select(F.col("from").alias("old_outer"), F.col("to").alias("new_outer"), F.col("n"), S.round_half_up(F.col("score"), 3).alias("score"))


_ORACLE = f"""{_TOKENS}, {_BEST},
said AS (SELECT a.doc_id AS l, min(b.doc_id) AS r FROM documents a JOIN documents b ON lower(a.text) = lower(b.text)
  WHERE CAST(substr(a.source, 4) AS INTEGER) % 2 = 0 AND CAST(substr(b.source, 4) AS INTEGER) % 2 = 1 GROUP BY a.doc_id)"""


@query(f"""WITH {_ORACLE} SELECT coalesce(best.l, said.l) AS l, best.r AS derived, said.r AS asserted,
CASE WHEN said.l IS NULL THEN 'derived only' WHEN best.l IS NULL THEN 'asserted only' WHEN best.r = said.r THEN 'agree' ELSE 'disagree' END AS agreement,
CASE WHEN said.l IS NULL THEN best.jaccard ELSE 0.55 END::DOUBLE AS score FROM best FULL JOIN said ON best.l = said.l""")
def oracle_merge(spark, d):
    """Derived pairs beside asserted ones (equal text): agreement noted on both."""
    docs = table(spark, d, "documents").select("doc_id", (F.substr("source", F.lit(4)).cast("int") % 2).alias("side"), F.sha2(F.lower("text"), 256).alias("h"))
    right = docs.where("side = 1").groupBy("h").agg(F.min("doc_id").alias("asserted"))
    said = docs.where("side = 0").join(right, "h").select(F.col("doc_id").alias("l"), "asserted")
    met = mutual_best(spark, d).select("l", F.col("r").alias("derived"), "jaccard").join(said, "l", "full")
    how = F.when(F.col("asserted").isNull(), "derived only").when(F.col("derived").isNull(), "asserted only").when(F.col("derived") == F.col("asserted"), "agree").otherwise("disagree")
    return met.select("l", "derived", "asserted", how.alias("agreement"), F.when(F.col("asserted").isNull(), F.col("jaccard")).otherwise(0.55).alias("score"))


@query("""WITH e AS (SELECT s_nationkey AS k, CAST(NULL AS VARCHAR) AS "desc", s_suppkey AS target, s_acctbal AS score, 1 AS rank FROM supplier
  UNION ALL SELECT c_nationkey, c_mktsegment, c_custkey, c_acctbal, 0 FROM customer),
q AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS "desc" FROM customer),
x AS (SELECT q.k, q."desc", e.target, e.score, e.rank, row_number() OVER (PARTITION BY q.k, q."desc" ORDER BY rank, score DESC, target) AS pos
  FROM q JOIN e ON q.k = e.k AND (e."desc" = q."desc" OR e."desc" IS NULL))
SELECT k, "desc", target, score, CASE WHEN rank = 0 THEN 'derived' ELSE 'oracle' END AS provenance FROM x WHERE pos = 1""")
def rename_fallback(spark, d):
    """Exact entries and wildcard ones (null descriptor) by preference."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("desc"), F.col("c_custkey").alias("target"), F.col("c_acctbal").alias("score"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("target"), F.col("s_acctbal").alias("score"))
    # the best of each arm first, so that an OR condition is never needed and no group is large
    exact = renames.preferred(c.withColumnRenamed("target", "to").withColumn("provenance", F.lit("derived")), ["k", "desc"])
    wild = renames.preferred(s.withColumnRenamed("target", "to").withColumn("provenance", F.lit("oracle")), ["k"])
    both = exact.unionByName(exact.select("k", "desc").join(wild, "k"))
    return renames.preferred(both, ["k", "desc"]).withColumnRenamed("to", "target")


@query(f"""WITH {_TOKENS}, {_BEST},
anchor AS (SELECT md5(lower(text)) AS h, min(doc_id) FILTER (CAST(substr(source, 4) AS INTEGER) % 2 = 0) AS l, min(doc_id) FILTER (CAST(substr(source, 4) AS INTEGER) % 2 = 1) AS r,
  count(*) FILTER (CAST(substr(source, 4) AS INTEGER) % 2 = 0) AS nl, count(*) FILTER (CAST(substr(source, 4) AS INTEGER) % 2 = 1) AS nr FROM documents GROUP BY 1),
one AS (SELECT l, r FROM anchor WHERE nl = 1 AND nr = 1),
rest AS (SELECT l, r, jaccard FROM pairs WHERE l NOT IN (SELECT l FROM one) AND r NOT IN (SELECT r FROM one)),
ql AS (SELECT *, rank() OVER (PARTITION BY l ORDER BY jaccard DESC) AS ra, rank() OVER (PARTITION BY r ORDER BY jaccard DESC) AS rb FROM rest),
qt AS (SELECT *, count(*) FILTER (ra = 1) OVER (PARTITION BY l) AS ka, count(*) FILTER (rb = 1) OVER (PARTITION BY r) AS kb FROM ql)
SELECT l, r, 1 AS round FROM one UNION ALL SELECT l, r, 2 FROM qt WHERE ra = 1 AND rb = 1 AND ka = 1 AND kb = 1""")
def fixpoint_rounds(spark, d):
    """Anchors by equal text first, then strict mutual best among the rest."""
    docs = table(spark, d, "documents").select("doc_id", (F.substr("source", F.lit(4)).cast("int") % 2).alias("side"), F.md5(F.lower("text").cast("binary")).alias("h"))
    per = docs.groupBy("h").agg(*[f(F.when(F.col("side") == k, F.col("doc_id"))).alias(n) for k, n, f in ((0, "l", F.min), (1, "r", F.min), (0, "nl", F.count), (1, "nr", F.count))])
    one = per.where("nl = 1 and nr = 1").select("l", "r")
    left, right = _sides(spark, d)
    one = stored(one)
    # lines are hashed before they move
    rest = lambda side, c: side.select("id", F.md5(F.col("token").cast("binary")).alias("token")).join(one.select(F.col(c).alias("id")), "id", "left_anti")
    two = similarity.best_pairs(rest(left, "l"), rest(right, "r")).select("l", "r")
    return one.withColumn("round", F.lit(1)).unionByName(two.withColumn("round", F.lit(2)))


# -- hierarchy -------------------------------------------------------------------------------

_CLOSURE = """walk AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS depth FROM part UNION ALL SELECT root, node // 2, depth + 1 FROM walk WHERE node // 2 > 0)"""
_WALK = "WITH RECURSIVE " + _CLOSURE


def _edges(spark, d):
    """The part tree: the parent of a part is half its key."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("child"))
    return part.select("child", F.lit(0).alias("ord"), F.expr("child div 2").alias("parent")).where("parent > 0")


def _closure(spark, d):
    checkpointing(spark)
    return closure.ordered_closure(_edges(spark, d), table(spark, d, "part").select("p_partkey"))


@query(f"{_WALK} SELECT root, node, depth FROM walk")
def ordered_closure(spark, d):
    """Every part with each of its ancestors."""
    return _closure(spark, d).select("root", "node", "depth")


@query(f"""{_WALK}, f AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
SELECT root, l_suppkey, arg_min(node, depth) AS node, min(depth) AS depth, CASE WHEN min(depth) = 0 THEN 'EXACT' ELSE 'CANDIDATE' END AS verdict,
  CASE WHEN min(depth) = 0 THEN 1.0 ELSE 0.9 END::DOUBLE AS score FROM walk JOIN f ON node = l_partkey GROUP BY root, l_suppkey""")
def inherited_lookup(spark, d):
    """For each part and supplier the nearest ancestor that the supplier has shipped."""
    facts = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    checkpointing(spark)
    hit = closure.first_hit(_edges(spark, d), table(spark, d, "part").select("p_partkey"), facts, "l_partkey", ["l_suppkey"])
    own = F.col("depth") == 0
    return hit.select("root", "l_suppkey", "node", "depth", F.when(own, "EXACT").otherwise("CANDIDATE").alias("verdict"), F.when(own, 1.0).otherwise(0.9).alias("score"))


@query(f"""{_WALK}, f AS (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem),
h AS (SELECT root, min(depth) AS depth FROM walk JOIN f ON node = l_partkey GROUP BY root)
SELECT root, node, depth, string_agg(l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM h JOIN walk USING (root, depth) JOIN f ON node = l_partkey GROUP BY root, node, depth""")
def name_only_ground(spark, d):
    """The nearest ancestor with any return flag, and all of its flags in order."""
    checkpointing(spark)
    facts = table(spark, d, "lineitem").select(F.col("l_partkey").alias("node"), "l_returnflag").distinct()
    listed = facts.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("l_returnflag")), ",").alias("flags")).withColumn("sel", F.lit(""))
    asks = table(spark, d, "part").select(F.col("p_partkey").alias("root"), F.lit("").alias("sel"))
    met = closure.first_along(asks, closure.parents(_edges(spark, d)), listed.checkpoint(), []).where("hit is not null")
    return met.select("root", "hit.node", "hit.depth", "hit.flags")


@query(f"""{_WALK}, s AS (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem), q AS (SELECT o_orderkey, (o_custkey * 7) % (SELECT max(p_partkey) + 50 FROM part) AS owner, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'O' THEN 'N' ELSE 'R' END AS member FROM orders),
h AS (SELECT root, l_returnflag, min(depth) AS depth FROM walk JOIN s ON node = l_partkey GROUP BY root, l_returnflag)
SELECT o_orderkey, CASE WHEN owner = 0 THEN 'unparseable' WHEN owner > (SELECT max(p_partkey) FROM part) THEN 'info' WHEN member IS NULL THEN 'present' WHEN depth = 0 THEN 'present' WHEN depth > 0 THEN 'present' ELSE 'absent' END AS status,
CASE WHEN owner = 0 THEN 'no owner' WHEN owner > (SELECT max(p_partkey) FROM part) THEN 'outside the snapshot' WHEN member IS NULL THEN 'class only' WHEN depth > 0 THEN 'inherited' WHEN depth IS NULL THEN 'no such member' ELSE '' END AS note
FROM q LEFT JOIN h ON owner = root AND member = l_returnflag""")
def verdict_ladder(spark, d):
    """Checks against the hierarchy, one status and note each."""
    parts = table(spark, d, "part").agg(F.max("p_partkey").alias("top"))
    status = F.col("o_orderstatus")
    checks = table(spark, d, "orders").crossJoin(F.broadcast(parts)).select(  # one row
        "o_orderkey", "top", ((F.col("o_custkey") * 7) % (F.col("top") + 50)).alias("owner"), F.when(status == "P", None).when(status == "O", "N").otherwise("R").alias("member")
    )
    checkpointing(spark)
    facts = table(spark, d, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_returnflag").alias("member")).distinct().withColumn("sel", F.lit(""))
    asks = checks.where("member is not null").select(F.col("owner").alias("root"), "member").distinct().withColumn("sel", F.lit(""))
    hit = closure.first_along(asks, closure.parents(_edges(spark, d)), facts.checkpoint(), ["member"]).select(F.col("root").alias("owner"), "member", F.col("hit.depth").alias("depth"))
    met = checks.join(hit, ["owner", "member"], "left")
    ladder = [(F.col("owner") == 0, "unparseable", "no owner"), (F.col("owner") > F.col("top"), "info", "outside the snapshot"), (F.col("member").isNull(), "present", "class only"),
              (F.col("depth") == 0, "present", ""), (F.col("depth") > 0, "present", "inherited")]
    state, note = F.lit("absent"), F.lit("no such member")
    for test, s, n in reversed(ladder):
        state, note = F.when(test, s).otherwise(state), F.when(test, n).otherwise(note)
    return met.select("o_orderkey", state.alias("status"), note.alias("note"))


PATTERNS = ("red*", "*bolt", "b*t")


@query("""WITH p(pattern, re) AS (VALUES ('red*', 'red.*'), ('*bolt', '.*bolt'), ('b*t', 'b.*t')),
x AS (SELECT pattern, p_partkey, p_name, row_number() OVER (PARTITION BY pattern ORDER BY p_partkey) AS pos, count(*) OVER (PARTITION BY pattern) AS total FROM p JOIN part ON regexp_full_match(p_name, re))
SELECT pattern, p_partkey, p_name, total FROM x WHERE pos <= 20""")
def wildcard_ground(spark, d):
    """Wildcard matches, the first 20 of each with the true count (J30, X-s23, T9)."""
    part = table(spark, d, "part").select("p_partkey", "p_name")
    hits = part.withColumn("pattern", F.explode(F.array_compact(F.array(*[F.when(S.wildcard(F.col("p_name"), p), F.lit(p)) for p in PATTERNS]))))
    top = hits.withColumn("pos", F.row_number().over(Window.partitionBy("pattern").orderBy("p_partkey"))).where("pos <= 20")
    return top.join(hits.groupBy("pattern").agg(F.count("*").alias("total")), "pattern").select("pattern", "p_partkey", "p_name", "total")


# -- ordering and sets -----------------------------------------------------------------------

@query("""SELECT c_nationkey, c_mktsegment, arg_min(c_custkey, (-c_acctbal, c_custkey)) AS c_custkey, max(c_acctbal) AS score FROM customer GROUP BY ALL""")
def dedupe_candidates(spark, d):
    """The best candidate per target, ties by key."""
    return renames.best_of(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], "c_acctbal", "c_custkey")


@query("""SELECT c_nationkey, segment, c_custkey, score FROM (SELECT c_nationkey, c_mktsegment AS segment, c_custkey, c_acctbal AS score,
row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_acctbal DESC, c_mktsegment, c_custkey) AS k FROM customer) WHERE k = 1""")
def preference_first(spark, d):
    """The preferred entry: source rank, then score, then name."""
    rank = F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1)
    best = table(spark, d, "customer").groupBy("c_nationkey").agg(F.min(F.struct(rank.alias("a"), (-F.col("c_acctbal")).alias("b"), F.col("c_mktsegment").alias("segment"), "c_custkey", F.col("c_acctbal").alias("score"))).alias("x"))
    return best.select("c_nationkey", "x.segment", "x.c_custkey", "x.score")


@query("SELECT o_custkey, arg_min(o_orderkey, (-epoch_us(o_orderdate), o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def newest_build(spark, d):
    """The latest order of each customer, ties by key."""
    return report.newest(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@query("""SELECT id, arg_min(name, source) AS name, min(source)::INTEGER AS source FROM (SELECT c_custkey AS id, c_name AS name, 0 AS source FROM customer
UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier) GROUP BY id""")
def union_first_wins(spark, d):
    """Two sources, the first wins a shared id."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return report.first_wins([c, s], "id").select("id", "name", "source")


@query("SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_orderkey) AS first FROM orders GROUP BY o_orderpriority")
def partial_final_merge(spark, d):
    """Summaries of two halves merged to the summary of the whole."""
    o = table(spark, d, "orders")
    half = lambda df: df.groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    both = half(o.where("o_orderdate < timestamp_ntz'1998-01-01'")).unionByName(half(o.where("o_orderdate >= timestamp_ntz'1998-01-01' or o_orderdate is null")))
    one = both.groupBy("o_orderpriority", "o_custkey").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return one.groupBy("o_orderpriority").agg(F.sum("n").alias("n"), F.count("*").alias("customers"), F.min("first").alias("first"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY event_type, user_id) AS n FROM events)
SELECT event_type, user_id, max(n) AS n, min(event_id) AS first, string_agg(event_id::VARCHAR, ', ' ORDER BY event_id) FILTER (k <= 10) || CASE WHEN max(n) > 10 THEN ' (+' || (max(n) - 10) || ' more)' ELSE '' END AS sites
FROM r GROUP BY event_type, user_id""")
def decision_rollup(spark, d):
    """Decisions with their true site count and the first ten sites."""
    return report.decisions(table(spark, d, "events"), ["event_type", "user_id"], "event_id")


@query("""SELECT o_orderkey, f.fix, CASE WHEN f.fix IS NULL AND o_orderstatus = 'F' THEN r.reason END AS withheld FROM orders
LEFT JOIN (SELECT l_orderkey, max(l_shipdate)::DATE::VARCHAR AS fix FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey) f ON o_orderkey = f.l_orderkey
LEFT JOIN (SELECT l_orderkey, 'returned by ' || min(l_suppkey) AS reason FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) r ON o_orderkey = r.l_orderkey""")
def apply_annotate(spark, d):
    """Findings with their fix, or the reason why an exact one has none."""
    items = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    fixes = items.where("l_returnflag = 'A'").groupBy("o_orderkey").agg(F.max("l_shipdate").cast("date").cast("string").alias("fix"))
    reasons = items.where("l_returnflag = 'R'").groupBy("o_orderkey").agg(F.concat(F.lit("returned by "), F.min("l_suppkey").cast("string")).alias("reason"))
    return report.annotate(table(spark, d, "orders"), fixes, reasons, "o_orderkey", F.col("o_orderstatus") == "F").select("o_orderkey", "fix", "withheld")


@query("""WITH a AS (SELECT o_orderkey, o_orderpriority, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AS applied FROM orders)
SELECT o_orderpriority, count(*) AS total, count(*) FILTER (applied) AS applied, count(*) FILTER (NOT applied) AS left_for_review FROM a GROUP BY o_orderpriority""")
def apply_summary(spark, d):
    """Applied and left add up to the total."""
    out = apply_annotate(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    return report.apply_summary(out, "o_orderpriority")


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority AS file, o_custkey % 10 AS line FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')),
w AS (SELECT r.*, 'returned by ' || min(l_suppkey) AS reason FROM r JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY r.o_orderkey, file, line)
SELECT file, string_agg(line || ':' || reason, ' ' ORDER BY line, reason) AS items FROM w GROUP BY file""")
def withheld_reasons(spark, d):
    """Why exact findings of each file were not applied."""
    where = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("file"), (F.col("o_custkey") % 10).alias("line"))
    rows = report.withheld_by_file(apply_annotate(spark, d).join(where, "o_orderkey"), "file", "line")
    return rows.select("file", F.array_join(F.transform("items", lambda x: F.concat(x["line"].cast("string"), F.lit(":"), x["reason"])), " ").alias("items"))


# -- spans and text --------------------------------------------------------------------------

@query("""WITH p AS (SELECT doc_id, text, unnest(range(0, length(text) + 1, 97)) AS p FROM documents)
SELECT doc_id, p AS "at", length(left(text, p)) - length(replace(left(text, p), chr(10), '')) + 1 AS line FROM p""")
def asof_line(spark, d):
    """The lines of many offsets of every text: the last line start not beyond each."""
    checkpointing(spark)
    docs = table(spark, d, "documents").select("doc_id", "text").where("text is not null")
    points = docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.length("text").cast("long"), F.lit(97).cast("long"))).alias("at"))
    return running.asof(points, running.line_starts(docs, "doc_id", "text"), "doc_id", "at", "start", "line")


@query("""SELECT event_id, coalesce(ts < max(e) OVER (PARTITION BY user_id ORDER BY ts, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
 OR coalesce(min(ts) OVER (PARTITION BY user_id ORDER BY ts, e, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) < e, false) AS overlaps
FROM (SELECT *, ts + to_microseconds(CAST(floor(value * 60000000) AS BIGINT)) AS e FROM events)""")
def span_overlap(spark, d):
    """Events, as spans of value minutes, that overlap another of their user."""
    checkpointing(spark)
    return spans.overlap_flags(_event_spans(spark, d), "user_id", "ts", "e", "event_id").select("event_id", "overlaps")


def _event_spans(spark, d):
    micros = F.floor(F.col("value") * 60000000).cast("long")
    return table(spark, d, "events").withColumn("e", F.expr("ts") + F.make_dt_interval(secs=(micros / F.lit(1000000)).cast("decimal(18,6)")))


@query("""WITH s AS (SELECT user_id, ts, ts + to_microseconds(CAST(floor(value * 60000000) AS BIGINT)) AS e FROM events WHERE event_type = 'click')
SELECT event_id FROM events v WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = v.user_id AND s.ts <= v.ts AND s.e > v.ts)""")
def coverage_anti(spark, d):
    """Errors inside no click span of their user."""
    checkpointing(spark)
    e = _event_spans(spark, d)
    return spans.uncovered(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'"), "user_id", "ts", "ts", "e").select("event_id")


@query("SELECT page_id, 'P' || substr(url, 2, 2) || '[' || page_id || ']' || substr(url, 6, 1) || '-' || substr(url, 8) AS url FROM pages")
def splice_apply(spark, d):
    """Three edits of each url, applied from the last to the first."""
    op = lambda a, b, t: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), t.alias("after"))
    ops = F.array(op(3, 5, F.concat(F.lit("["), F.col("page_id").cast("string"), F.lit("]"))), op(0, 1, F.lit("P")), op(6, 7, F.lit("-")))
    return table(spark, d, "pages").select("page_id", spans.splice(F.col("url"), ops).alias("url"))


@query("""WITH u AS (SELECT floor(c_acctbal) AS n, min(c_custkey) AS c_custkey FROM customer GROUP BY floor(c_acctbal) HAVING count(*) = 1)
SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM u)""")
def usage_binding(spark, d):
    """Usages bound by a declaration whose short name no other has."""
    declared = table(spark, d, "customer").select(F.floor("c_acctbal").alias("name"), F.col("c_custkey").alias("target"))
    return ground.bound(table(spark, d, "orders").withColumnRenamed("o_custkey", "target"), declared).select("o_orderkey")


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations""")
def carry_forward(spark, d):
    """The last user text carried to each turn."""
    checkpointing(spark)
    return chain.carry_forward(table(spark, d, "conversations"), "conv_id", "turn", "text", F.col("role") == "user", "asked").select("conv_id", "turn", "role", "asked")


@query("SELECT o_orderkey, left(sha256(o_orderkey || chr(0) || o_custkey || chr(0) || coalesce(NULLIF(o_orderstatus, 'O'), '') || chr(0) || o_orderpriority), 12) AS id FROM orders")
def finding_id(spark, d):
    """Stable ids over NUL-joined columns, nulls as '' (X-s13)."""
    status = F.when(F.col("o_orderstatus") == "O", None).otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", S.finding_id(F.col("o_orderkey"), F.col("o_custkey"), status, F.col("o_orderpriority")).alias("id"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?]*)', 1) AS path FROM pages)
SELECT page_id, path, replace(path, '/', '.') AS dotted, regexp_extract(path, '^(.*)/', 1) AS package, regexp_extract(path, '([^/]*)$', 1) AS simple FROM p""")
def name_functions(spark, d):
    """Package, simple and dotted names of url paths (X-s1, X-s11, X-s16)."""
    p = table(spark, d, "pages").withColumn("path", F.regexp_extract("url", "^[a-z]+://([^?]*)", 1))
    c = F.col("path")
    return p.select("page_id", "path", S.to_dotted_name(c).alias("dotted"), S.package_of(c).alias("package"), S.simple_name(c).alias("simple"))


@query("""SELECT page_id, pos - 1 AS ord, href FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))""")
def text_scan_links(spark, d):
    """Links of each page with their ordinal."""
    return table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("ord", "href")).withColumn("ord", F.col("ord").cast("long"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_scan(spark, d):
    """A field of JSON under an explicit schema (S6, X-s32)."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long", {"mode": "FAILFAST"})["k"].alias("k"))


@query("""WITH x AS (SELECT p_partkey, '(' || repeat('I', (p_size % 4)::INTEGER) || CASE WHEN p_size % 3 = 0 THEN '[[La/B;' ELSE '' END || repeat('Lc/D;', (p_size % 2)::INTEGER) || ')V' AS d, p_size FROM part)
SELECT p_partkey, d AS "desc", (p_size % 4 + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END + p_size % 2)::BIGINT AS n FROM x""")
def arity(spark, d):
    """Argument counts of method descriptors (X-s6)."""
    n = F.col("p_size")
    desc = F.concat(F.lit("("), F.repeat(F.lit("I"), n % 4), F.when(n % 3 == 0, "[[La/B;").otherwise(""), F.repeat(F.lit("Lc/D;"), n % 2), F.lit(")V"))
    return table(spark, d, "part").select("p_partkey", desc.alias("desc")).withColumn("n", S.arity(F.col("desc")))


@query("""WITH s AS (SELECT DISTINCT p_name FROM part ORDER BY p_name LIMIT 20),
h AS (SELECT count(*) AS n, count(*) FILTER (p_name IN (SELECT p_name FROM part WHERE p_size < 25)) AS a, count(*) FILTER (p_name IN (SELECT p_name FROM part WHERE p_brand = 'Brand#11')) AS b FROM s)
SELECT n, a, b, CASE WHEN n < 3 THEN 'too few' WHEN greatest(a, b) < 0.25 * n THEN 'no namespace fits' WHEN a >= 4 * b THEN 'named' WHEN b >= 4 * a THEN 'source' ELSE 'tie' END AS decision FROM h""")
def namespace_probe(spark, d):
    """A bounded sorted sample probed in two namespaces, and the decision."""
    part = table(spark, d, "part")
    spaces = {"a": part.where("p_size < 25"), "b": part.where("p_brand = 'Brand#11'")}
    hits = ground.probe(part, "p_name", spaces, 20)
    n, x, y = F.col("n"), F.col("a"), F.col("b")
    how = F.when(n < 3, "too few").when(F.greatest(x, y) < 0.25 * n, "no namespace fits").when(x >= 4 * y, "named").when(y >= 4 * x, "source").otherwise("tie")
    return hits.withColumn("decision", how)


@query("""WITH a AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)), b AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations)),
x AS (SELECT a.w AS l, b.w AS suggestion, levenshtein(a.w, b.w) AS dist, row_number() OVER (PARTITION BY a.w ORDER BY levenshtein(a.w, b.w), b.w) AS k FROM a, b WHERE abs(length(a.w) - length(b.w)) <= 2 AND levenshtein(a.w, b.w) <= 2)
SELECT l, suggestion, dist::INTEGER AS dist FROM x WHERE k = 1 AND dist < length(suggestion)""")
def suggest_nearest(spark, d):
    """For every word of the benchmark the nearest word of the conversations within two edits (T16, X-s7)."""
    words = lambda t: table(spark, d, t).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("name"))
    return edit.suggestions(words("benchmark"), words("conversations"))
