"""Queries of the mapping, member, rename and report operators, over worlds derived from the given tables.

A world is a handful of expressions over a table: owners, members and descriptors made from its
keys.  The queries call the library; ORACLE_SQL makes the same world and the expected answer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grammar as G
from ..functions import scalars as S
from ..operators import diff, ground, members, patches, renames, report
from ..sources import mappings
from .session import checkpointing, registry, table

QUERIES, ORACLE_SQL, query = registry()


# -- descriptors and members -----------------------------------------------------------------

@query("""WITH m AS (SELECT DISTINCT p_brand AS f, 'm/' || reverse(p_brand) AS t FROM part WHERE p_size > 47), x AS (SELECT p_partkey, p_type, p_size, p_brand, t FROM part LEFT JOIN m ON f = p_brand)
SELECT p_partkey, CASE WHEN p_size % 7 = 0 OR t IS NULL THEN NULL ELSE '(L' || t || ';[[Lx/' || p_type || ';' || repeat('I', p_size % 3) || ')L' || t || ';' END AS translated FROM x""")
def descriptor_translate(spark, d):
    """Descriptors in other names, null where a class of ours has none or the text is broken (X-s4)."""
    part = table(spark, d, "part")
    brand, type_, size = F.col("p_brand"), F.col("p_type"), F.col("p_size")
    whole = F.concat(F.lit("(Ls/"), brand, F.lit(";[[Lx/"), type_, F.lit(";"), F.repeat(F.lit("I"), size % 3), F.lit(")Ls/"), brand, F.lit(";"))
    names = part.where("p_size > 47").select(F.concat(F.lit("s/"), brand).alias("from"), F.concat(F.lit("m/"), F.reverse(brand)).alias("to")).distinct()
    parts = part.select("p_partkey", F.when(size % 7 == 0, F.concat(F.lit("(Ls/"), brand)).otherwise(whole).alias("desc"))
    return members.translate_desc(parts, names, "s/").select("p_partkey", "translated")


@query("""WITH m AS (SELECT DISTINCT p_brand AS f, 'new/' || lower(p_brand) AS t FROM part WHERE p_size > 47)
SELECT p_partkey, '(L' || coalesce(t, p_brand) || ';IL' || p_type || ';)[L' || coalesce(t, p_brand) || ';' AS "desc" FROM part LEFT JOIN m ON f = p_brand""")
def canonical_descriptors(spark, d):
    """Class names inside descriptors renamed where there is an entry (X-s5)."""
    part = table(spark, d, "part")
    names = part.where("p_size > 47").select(F.col("p_brand").alias("from"), F.concat(F.lit("new/"), F.lower("p_brand")).alias("to")).distinct()
    parts = part.select("p_partkey", F.concat(F.lit("(L"), "p_brand", F.lit(";IL"), "p_type", F.lit(";)[L"), "p_brand", F.lit(";")).alias("desc"))
    return renames.canonical_desc(parts, names).select("p_partkey", "desc")


_SOURCE = """m AS (SELECT 'n/' || c_nationkey AS owner, CASE WHEN c_custkey % 3 = 0 THEN 'field' ELSE 'method' END AS kind, 'm' || (c_custkey % 31) AS name,
  CASE WHEN c_custkey % 3 = 0 THEN 'I' ELSE '(' || repeat('I', (c_custkey % 4)::INTEGER) || ')V' END AS d, c_custkey AS value FROM customer WHERE c_custkey % 2 = 0),
q AS (SELECT o_orderkey AS qid, CASE WHEN o_orderstatus = 'F' THEN 'field' ELSE 'method' END AS kind, 'n/' || (o_custkey % 27) AS owner, 'm' || (o_orderkey % 35) AS name,
  CASE WHEN o_orderkey % 4 = 0 THEN '(II)V' END AS dq, CASE WHEN o_orderkey % 4 = 1 THEN (o_orderkey % 5)::INTEGER END AS args FROM orders),
g AS (SELECT qid, q.kind, dq, args, count(value) AS n, count(value) FILTER (d = dq) AS kd, min(value) FILTER (d = dq) AS vd,
  count(value) FILTER (length(d) - 3 = args) AS ka, min(value) FILTER (length(d) - 3 = args) AS va, min(value) AS v
  FROM q LEFT JOIN m ON m.owner = q.owner AND m.kind = q.kind AND m.name = q.name GROUP BY qid, q.kind, dq, args)"""


def _source_world(spark, d):
    c = F.col("c_custkey")
    field = c % 3 == 0
    desc = F.when(field, "I").otherwise(F.concat(F.lit("("), F.repeat(F.lit("I"), (c % 4).cast("int")), F.lit(")V")))
    pool = table(spark, d, "customer").where(c % 2 == 0).select(F.concat(F.lit("n/"), F.col("c_nationkey").cast("string")).alias("owner"), F.when(field, "field").otherwise("method").alias("kind"), F.concat(F.lit("m"), (c % 31).cast("string")).alias("name"), desc.alias("desc"), c.alias("value"))
    o = F.col("o_orderkey")
    asked = table(spark, d, "orders").select(
        o.alias("qid"), F.when(F.col("o_orderstatus") == "F", "field").otherwise("method").alias("kind"), F.concat(F.lit("n/"), (F.col("o_custkey") % 27).cast("string")).alias("owner"), F.concat(F.lit("m"), (o % 35).cast("string")).alias("name"),
        F.when(o % 4 == 0, "(II)V").alias("desc"), F.when(o % 4 == 1, (o % 5).cast("int")).alias("args"),
    )
    return asked, pool


@query(f"""WITH {_SOURCE}, r AS (SELECT *, CASE WHEN n = 0 THEN 'no member of that name'
  WHEN dq IS NOT NULL THEN CASE WHEN kd = 1 THEN NULL WHEN kd > 1 THEN 'several members share the descriptor' ELSE 'descriptor matches no declaration' END
  WHEN kind = 'method' AND args IS NOT NULL THEN CASE WHEN ka = 1 THEN NULL WHEN ka > 1 THEN 'several overloads take that many arguments' ELSE 'no overload takes that many arguments' END
  WHEN n > 1 THEN 'several overloads' END AS reason FROM g)
SELECT qid, n, CASE WHEN reason IS NULL THEN CASE WHEN dq IS NOT NULL THEN vd WHEN kind = 'method' AND args IS NOT NULL THEN va ELSE v END END AS pick, reason FROM r""")
def source_members(spark, d):
    """Members by descriptor, by number of arguments or by name alone, refused unless one is left."""
    return members.source_members(*_source_world(spark, d)).select("qid", "n", "pick", "reason")


_NAMED = """nm AS (SELECT 'n/' || c_nationkey AS owner, CASE WHEN c_custkey % 3 = 0 THEN 'field' ELSE 'method' END AS kind, 'm' || (c_custkey % 31) AS name,
  '(' || repeat('Lq/C' || (c_custkey % 3) || ';', (c_custkey % 4)::INTEGER) || ')V' AS d, c_custkey % 4 AS na, 'i' || lpad(c_custkey::VARCHAR, 9, '0') AS mid FROM customer),
q AS (SELECT o_orderkey AS qid, CASE WHEN o_orderstatus = 'F' THEN 'field' ELSE 'method' END AS kind, 'n/' || (o_custkey % 27) AS owner, 'm' || (o_orderkey % 35) AS name,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 END AS nd, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 3 END AS cd, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey % 5 END AS args FROM orders),
t AS (SELECT *, CASE WHEN nd IS NOT NULL AND (nd = 0 OR cd < 2) THEN '(' || repeat('Lq/C' || cd || ';', nd::INTEGER) || ')V' END AS tr FROM q),
g AS (SELECT qid, t.kind, t.owner, tr, nd, args, count(mid) AS n, count(mid) FILTER (d = tr) AS ke, min(mid) FILTER (d = tr) AS me, count(mid) FILTER (na = args) AS ka, min(mid) FILTER (na = args) AS ma,
  count(mid) FILTER (na = nd) AS ko, min(mid) FILTER (na = nd) AS mo, min(mid) AS any_mid FROM t LEFT JOIN nm ON nm.owner = t.owner AND nm.kind = t.kind AND nm.name = t.name GROUP BY qid, t.kind, t.owner, tr, nd, args),
h AS (SELECT *, CASE WHEN n = 0 THEN NULL WHEN tr IS NOT NULL THEN CASE WHEN ke = 1 THEN 'descriptor' END WHEN n = 1 THEN 'single'
  WHEN nd IS NULL AND args IS NOT NULL AND kind = 'method' AND ka = 1 THEN 'arguments of the call' WHEN nd IS NOT NULL AND ko = 1 THEN 'arguments of the descriptor' END AS how FROM g),
f AS (SELECT *, CASE how WHEN 'descriptor' THEN me WHEN 'single' THEN any_mid WHEN 'arguments of the call' THEN ma WHEN 'arguments of the descriptor' THEN mo END AS mid,
  CASE WHEN n = 0 THEN 'no member of that name' WHEN how IS NOT NULL THEN NULL WHEN tr IS NOT NULL THEN CASE WHEN ke = 0 THEN 'descriptor matches no declaration' ELSE 'several members share the descriptor' END
    WHEN nd IS NULL AND args IS NOT NULL AND kind = 'method' AND ka = 0 THEN 'no overload takes that many arguments' ELSE 'several overloads' END AS reason FROM h)"""


def _named_world(spark, d):
    asked, _ = _source_world(spark, d)
    o, k = F.col("qid"), F.col("o_custkey") % 3
    asked = asked.drop("desc", "args").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), "o_custkey"), "qid")
    desc = F.when(o % 3 == 0, F.concat(F.lit("("), F.repeat(F.concat(F.lit("Ls/C"), k.cast("string"), F.lit(";")), (o % 4).cast("int")), F.lit(")V")))
    asked = asked.withColumn("desc", desc).withColumn("args", F.when(o % 3 == 1, (o % 5).cast("int"))).drop("o_custkey")
    c = F.col("c_custkey")
    pool = table(spark, d, "customer").select(
        F.concat(F.lit("n/"), F.col("c_nationkey").cast("string")).alias("owner"), F.when(c % 3 == 0, "field").otherwise("method").alias("kind"), F.concat(F.lit("m"), (c % 31).cast("string")).alias("name"),
        F.concat(F.lit("("), F.repeat(F.concat(F.lit("Lq/C"), (c % 3).cast("string"), F.lit(";")), (c % 4).cast("int")), F.lit(")V")).alias("desc"), F.concat(F.lit("i"), F.lpad(c.cast("string"), 9, "0")).alias("mid"),
    )
    names = spark.range(2).select(F.format_string("s/C%d", "id").alias("from"), F.format_string("q/C%d", "id").alias("to"))
    return members.named_members(asked, pool, names, "s/")


@query(f"WITH {_NAMED} SELECT qid, mid, how, reason FROM f")
def named_members(spark, d):
    """Named members to intermediary ones by translated descriptor, sole name or arguments."""
    return _named_world(spark, d).select("qid", "mid", "how", "reason")


@query(f"""WITH {_NAMED}, b AS (SELECT 'n/' || c_nationkey AS owner, CASE WHEN c_custkey % 3 = 0 THEN 'field' ELSE 'method' END AS kind, 'i' || lpad(c_custkey::VARCHAR, 9, '0') AS mid, 'o' || (c_custkey % 50) AS obf, c_custkey % 3 AS dn FROM customer WHERE c_custkey % 7 <> 0),
e AS (SELECT 'n/' || c_nationkey AS owner, CASE WHEN c_custkey % 3 = 0 THEN 'field' ELSE 'method' END AS kind, 'o' || (c_custkey % 50) AS obf, CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE c_custkey % 3 END AS dn, 'src' || lpad(c_custkey::VARCHAR, 9, '0') AS source FROM customer WHERE c_custkey % 5 <> 0),
j AS (SELECT f.qid, f.mid, f.reason, f.kind, b.obf, b.dn FROM f LEFT JOIN b ON b.owner = f.owner AND b.kind = f.kind AND b.mid = f.mid),
o AS (SELECT j.qid, j.mid, j.reason, j.obf, count(e.source) AS n, count(e.source) FILTER (j.kind = 'field' OR e.dn = j.dn) AS k, min(e.source) FILTER (j.kind = 'field' OR e.dn = j.dn) AS s, min(e.source) AS a
  FROM j JOIN f USING (qid) LEFT JOIN e ON e.owner = f.owner AND e.kind = f.kind AND e.obf = j.obf GROUP BY j.qid, j.mid, j.reason, j.obf)
SELECT qid, obf, CASE WHEN k > 0 THEN s WHEN n = 1 THEN a END AS source, CASE WHEN k > 0 THEN 'name and descriptor' WHEN n = 1 THEN 'name only' END AS how_joined,
  coalesce(reason, CASE WHEN obf IS NULL THEN 'no official name' WHEN k = 0 AND n <> 1 THEN 'not among the official members' END) AS reason FROM o""")
def official_members(spark, d):
    """Intermediary members to official ones: by name, then by name and descriptor, or a sole name."""
    c = F.col("c_custkey")
    owner, kind, obf = F.concat(F.lit("n/"), F.col("c_nationkey").cast("string")).alias("owner"), F.when(c % 3 == 0, "field").otherwise("method").alias("kind"), F.concat(F.lit("o"), (c % 50).cast("string")).alias("obf")
    key, desc = F.lpad(c.cast("string"), 9, "0"), F.repeat(F.lit("Lz;"), (c % 3).cast("int"))
    customers = table(spark, d, "customer")
    between = customers.where(c % 7 != 0).select(owner, kind, F.concat(F.lit("i"), key).alias("mid"), c.alias("ord"), obf, desc.alias("desc_obf"))
    official = customers.where(c % 5 != 0).select(owner, kind, obf, F.when(c % 4 == 0, "other").otherwise(desc).alias("desc_obf"), F.concat(F.lit("src"), key).alias("source"))
    return members.through_official(_named_world(spark, d), between, official).select("qid", "obf", "source", "how_joined", "reason")


# -- grounding in a hierarchy ----------------------------------------------------------------

_TREE = """WITH RECURSIVE walk AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS depth FROM part UNION ALL SELECT root, node // 2, depth + 1 FROM walk WHERE node // 2 > 0),
mem AS (SELECT DISTINCT l_partkey AS o, CASE WHEN l_linenumber % 5 = 0 THEN 'field' ELSE 'method' END AS kind, l_returnflag || l_linestatus AS name, CASE WHEN l_linenumber % 5 = 0 THEN 'I' ELSE '(' || repeat('I', l_linenumber % 4) || ')V' END AS d,
  CASE WHEN l_linenumber % 5 = 0 THEN -1 ELSE l_linenumber % 4 END AS na FROM lineitem)"""
_ASKED = """q AS (SELECT o_orderkey AS qid, (o_custkey * 7) % ((SELECT max(p_partkey) FROM part) + 20) AS owner, CASE o_orderkey % 4 WHEN 0 THEN 'AF' WHEN 1 THEN 'NO' WHEN 2 THEN 'RF' ELSE 'NONE' END AS name,
  CASE WHEN o_orderkey % 6 = 0 THEN 'field' ELSE 'method' END AS kind, CASE WHEN o_custkey % 3 = 0 THEN CASE WHEN o_orderkey % 6 = 0 THEN 'I' ELSE '(' || repeat('I', (o_custkey % 4)::INTEGER) || ')V' END END AS dq,
  CASE WHEN o_custkey % 3 = 1 THEN o_custkey % 4 END AS args, o_custkey % 2 = 0 AS inherited FROM orders)"""


def _tree_world(spark, d):
    checkpointing(spark)
    p = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("t/P"), c.cast("string"))
    classes = table(spark, d, "part").select(name(p).alias("owner"), F.when(F.expr("p_partkey div 2") > 0, name(F.expr("p_partkey div 2"))).alias("super"), F.array().cast("array<string>").alias("interfaces"))
    params = lambda n: F.concat(F.lit("("), F.repeat(F.lit("I"), n.cast("int")), F.lit(")V"))
    own = F.col("l_linenumber") % 5 == 0
    pool = table(spark, d, "lineitem").select(
        name(F.col("l_partkey")).alias("owner"), F.when(own, "field").otherwise("method").alias("kind"), F.concat("l_returnflag", "l_linestatus").alias("name"), F.when(own, "I").otherwise(params(F.col("l_linenumber") % 4)).alias("desc")
    ).distinct()
    top = table(spark, d, "part").agg(F.max(p).alias("top"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    what = F.when(o % 4 == 0, "AF").when(o % 4 == 1, "NO").when(o % 4 == 2, "RF").otherwise("NONE")
    asked = table(spark, d, "orders").crossJoin(F.broadcast(top)).select(  # one row
        o.alias("qid"), F.when(o % 6 == 0, "field").otherwise("method").alias("kind"), name((c * 7) % (F.col("top") + 20)).alias("owner"), what.alias("name"),
        F.when(c % 3 == 0, F.when(o % 6 == 0, "I").otherwise(params(c % 4))).alias("desc"), F.when(c % 3 == 1, (c % 4).cast("int")).alias("args"), (c % 2 == 0).alias("inherited"),
    )
    return asked, classes, pool


@query(f"""{_TREE}, {_ASKED},
h AS (SELECT qid, w.node, w.depth, m.d, row_number() OVER (PARTITION BY qid ORDER BY w.depth) AS k, count(*) OVER (PARTITION BY qid, w.depth) AS n FROM q JOIN walk w ON w.root = q.owner JOIN mem m ON m.o = w.node AND m.kind = q.kind AND m.name = q.name
  WHERE CASE WHEN dq IS NOT NULL THEN m.d = dq WHEN args IS NOT NULL AND q.kind = 'method' THEN m.na = args ELSE true END),
f AS (SELECT * FROM h WHERE k = 1), e AS (SELECT DISTINCT qid FROM q JOIN walk w ON w.root = q.owner JOIN mem m ON m.o = w.node AND m.kind = q.kind AND m.name = q.name),
r AS (SELECT q.qid, CASE WHEN f.n = 1 AND (f.depth = 0 OR inherited) THEN 'EXACT' WHEN f.n = 1 THEN 'CANDIDATE' ELSE 'UNRESOLVED' END AS verdict, CASE WHEN f.n = 1 THEN 't/P' || f.node END AS to_owner, CASE WHEN f.n = 1 THEN f.d END AS to_desc,
  CASE WHEN p_partkey IS NULL THEN 'owner is not in the snapshot' WHEN f.n = 1 AND f.depth = 0 THEN 'declared' WHEN f.n = 1 AND inherited THEN 'inherited' WHEN f.n = 1 THEN 'found on a supertype' WHEN f.n > 1 THEN 'several overloads'
    WHEN e.qid IS NULL THEN 'no member of that name' WHEN dq IS NOT NULL THEN 'descriptor differs' ELSE 'no overload with that many arguments' END AS reason
  FROM q LEFT JOIN part ON owner = p_partkey LEFT JOIN f ON f.qid = q.qid LEFT JOIN e ON e.qid = q.qid)
SELECT qid, verdict, CASE verdict WHEN 'EXACT' THEN 1.0 WHEN 'CANDIDATE' THEN 0.9 END::DOUBLE AS score, to_owner, to_desc, reason FROM r""")
def ground_members(spark, d):
    """Members in a hierarchy by kind, name and descriptor or arguments: EXACT on the owner or if inherited before, CANDIDATE above."""
    return ground.ground_members(*_tree_world(spark, d)).select("qid", "verdict", "score", "to_owner", "to_desc", "reason")


@query(f"""{_TREE}, {_ASKED}, ex AS (SELECT root, name, d, min(depth) AS depth FROM walk JOIN mem ON node = o GROUP BY root, name, d), near AS (SELECT root, name, min(depth) AS depth FROM ex GROUP BY root, name),
l AS (SELECT o, name, string_agg(DISTINCT d, ', ' ORDER BY d) AS descs FROM mem GROUP BY o, name),
j AS (SELECT q.*, p_partkey IS NOT NULL AS known, near.depth AS nd_near, wn.node AS near_at, ex.depth AS ex_depth, we.node AS ex_at, descs FROM q LEFT JOIN part ON owner = p_partkey LEFT JOIN near ON near.root = owner AND near.name = q.name
  LEFT JOIN walk wn ON wn.root = owner AND wn.depth = near.depth LEFT JOIN ex ON ex.root = owner AND ex.name = q.name AND ex.d = q.dq LEFT JOIN walk we ON we.root = owner AND we.depth = ex.depth LEFT JOIN l ON l.o = wn.node AND l.name = q.name),
k AS (SELECT *, CASE WHEN dq IS NULL THEN nd_near ELSE ex_depth END AS far, CASE WHEN dq IS NULL THEN near_at ELSE ex_at END AS hit_at FROM j)
SELECT qid AS "check", CASE WHEN NOT known THEN 'absent' WHEN far IS NOT NULL THEN 'present' ELSE 'absent' END AS status,
 CASE WHEN NOT known THEN 'class is not in the snapshot; it may have been renamed' WHEN far = 0 THEN '' WHEN far > 0 THEN 'inherited from t/P' || hit_at WHEN near_at IS NOT NULL THEN 'has ' || descs ELSE 'no such member' END AS note FROM k""")
def check_targets(spark, d):
    """Targets with one status and one note each."""
    asked, classes, pool = _tree_world(spark, d)
    return ground.check_targets(asked.withColumnRenamed("qid", "check"), classes, pool, "t/").select("check", "status", "note")


@query(f"""{_TREE}, {_ASKED} SELECT s.status, count(x.owner) AS n FROM (VALUES ('present'), ('absent'), ('info'), ('unparseable')) s(status)
LEFT JOIN (SELECT owner, CASE WHEN p_partkey IS NULL THEN 'absent' WHEN EXISTS (SELECT 1 FROM walk JOIN mem ON node = o WHERE root = owner AND mem.name = q.name AND (dq IS NULL OR d = dq)) THEN 'present' ELSE 'absent' END AS status
  FROM q LEFT JOIN part ON owner = p_partkey) x ON x.status = s.status GROUP BY s.status""")
def target_tally(spark, d):
    """How many targets have each status, zeros included (A3)."""
    return report.tally(check_targets(spark, d), "status", ["present", "absent", "info", "unparseable"])


# -- renames ---------------------------------------------------------------------------------

_DOCS = """s AS (SELECT DISTINCT lang || '/D' || doc_id AS owner, doc_id, lang, CAST(substr(source, 4) AS INTEGER) % 2 AS side, token FROM (SELECT doc_id, lang, source, unnest(string_split(lower(text), chr(10))) AS token FROM documents) WHERE length(token) > 0),
c AS (SELECT owner, side, any_value(lang) AS lang, any_value('D' || doc_id) AS simple, count(*) AS n FROM s GROUP BY owner, side),
p AS (SELECT a.owner AS l, b.owner AS r, count(*) AS overlap FROM s a JOIN s b ON a.token = b.token AND a.side = 0 AND b.side = 1 GROUP BY a.owner, b.owner),
x AS (SELECT l, r, overlap, overlap / (cl.n + cr.n - overlap)::DOUBLE AS jaccard, overlap / (cl.n + cr.n - overlap)::DOUBLE * CASE WHEN cl.lang = cr.lang THEN 1.0 ELSE 0.85 END::DOUBLE AS score,
  list_max(list_filter(generate_series(0, least(length(cl.simple), length(cr.simple))), lambda i: right(cl.simple, i) = right(cr.simple, i))) AS suffix,
  1.0 - levenshtein(cl.simple, cr.simple) / greatest(length(cl.simple), length(cr.simple))::DOUBLE AS edit FROM p JOIN c cl ON cl.owner = l JOIN c cr ON cr.owner = r),
y AS (SELECT *, rank() OVER (PARTITION BY l ORDER BY score DESC, suffix DESC, edit DESC) AS ra, rank() OVER (PARTITION BY r ORDER BY score DESC, suffix DESC, edit DESC) AS rb FROM x WHERE score > 0.5),
z AS (SELECT *, count(*) FILTER (ra = 1) OVER (PARTITION BY l) AS ka, count(*) FILTER (rb = 1) OVER (PARTITION BY r) AS kb FROM y)"""


@query(f"""WITH {_DOCS} SELECT l AS "from", r AS "to", floor(score * 100 + 0.5) / 100 AS score, overlap, jaccard FROM z WHERE ra = 1 AND rb = 1 AND ka = 1 AND kb = 1""")
def class_candidates(spark, d):
    """Classes of two snapshots that are each other's only best by members, package and name."""
    checkpointing(spark)
    docs = table(spark, d, "documents")
    rows = docs.select(F.concat("lang", F.lit("/D"), F.col("doc_id").cast("string")).alias("owner"), F.lit("line").alias("kind"), F.explode(F.split(F.lower("text"), "\n", -1)).alias("name"), F.lit("").alias("desc"), (F.substr("source", F.lit(4)).cast("int") % 2).alias("side")).where("name <> ''")
    return renames.class_candidates(rows.where("side = 0"), rows.where("side = 1")).select("from", "to", "score", "overlap", "jaccard")


@query("""WITH said AS (SELECT DISTINCT 'c/' || c_custkey AS f, 'c/' || (c_custkey + c_custkey % 3) AS t FROM customer WHERE c_custkey % 2 = 0),
drv AS (SELECT 'c/' || c_custkey AS f, 'c/' || (c_custkey + 1) AS t, (c_custkey % 10) / 10.0::DOUBLE AS score FROM customer WHERE c_custkey % 4 = 0),
nn AS (SELECT 'c/' || c_custkey AS o FROM customer WHERE c_custkey % 5 <> 0), oo AS (SELECT 'c/' || c_custkey AS o FROM customer WHERE c_custkey % 7 <> 0)
SELECT drv.f AS "from", drv.t AS "to", drv.score, 'derived' AS provenance, CASE WHEN s.f IS NULL THEN 'alone' WHEN s.t = drv.t THEN 'agrees' ELSE 'disagrees' END AS agreement FROM drv LEFT JOIN (SELECT said.* FROM said JOIN oo ON oo.o = said.f) s ON s.f = drv.f
UNION ALL SELECT said.f, said.t, CASE WHEN nt.o IS NULL THEN 0.1 WHEN nf.o IS NOT NULL THEN 0.3 ELSE 0.55 END::DOUBLE, 'oracle:x', CASE WHEN drv.f IS NULL THEN 'alone' WHEN drv.t = said.t THEN 'agrees' ELSE 'disagrees' END
FROM said JOIN oo ON oo.o = said.f LEFT JOIN nn nt ON nt.o = said.t LEFT JOIN nn nf ON nf.o = said.f LEFT JOIN drv ON drv.f = said.f""")
def asserted_classes(spark, d):
    """Derived and asserted class renames in one table."""
    c = F.col("c_custkey")
    customers = table(spark, d, "customer").select(c)
    name = lambda x: F.concat(F.lit("c/"), x.cast("string"))
    said = customers.where(c % 2 == 0).select(name(c).alias("from"), name(c + c % 3).alias("to"), F.lit("x").alias("source"))
    derived = customers.where(c % 4 == 0).select(name(c).alias("from"), name(c + 1).alias("to"), ((c % 10) / 10.0).alias("score"))
    owners = lambda k: customers.where(c % k != 0).select(name(c).alias("owner"))
    return renames.merge_asserted(derived, said, owners(7), owners(5))


@query("""WITH said AS (SELECT 'k' || (s_suppkey % 20) AS owner, s_suppkey AS f, s_suppkey % 30 AS t FROM supplier), cls AS (SELECT 'k' || range AS f, 'w' || (range % 6) AS t FROM range(10)),
drv AS (SELECT 'k' || (s_suppkey % 20) AS owner, s_suppkey AS f, s_suppkey % 15 AS t FROM supplier WHERE s_suppkey % 3 = 0), tgt AS (SELECT 'w' || (c_custkey % 6) AS owner, c_custkey % 37 AS name, 'd' || c_custkey % 5 AS d FROM customer WHERE c_custkey < 120),
x AS (SELECT said.*, coalesce(cls.t, said.owner) AS o FROM said LEFT JOIN cls ON cls.f = said.owner), n AS (SELECT owner, name, count(*) AS n, min(d) AS d FROM tgt GROUP BY owner, name)
SELECT x.owner, 'm' || x.f AS "from", x.o AS to_owner, 'm' || x.t AS "to", CASE WHEN n.n = 1 THEN n.d END AS "desc", CASE WHEN n.n = 1 THEN 0.55 WHEN n.n > 1 THEN 0.4 ELSE 0.1 END::DOUBLE AS score,
  CASE WHEN drv.f IS NULL THEN 'alone' WHEN drv.t = x.t THEN 'agrees' ELSE 'disagrees' END AS agreement FROM x LEFT JOIN n ON n.owner = x.o AND n.name = x.t LEFT JOIN drv ON drv.owner = x.owner AND drv.f = x.f""")
def asserted_members(spark, d):
    """Asserted member renames grounded in the new owner."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    suppliers = table(spark, d, "supplier").select(s)
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    said = suppliers.select(text("k", s % 20).alias("owner"), F.lit("method").alias("kind"), text("m", s).alias("from"), text("m", s % 30).alias("to"))
    derived = suppliers.where(s % 3 == 0).select(text("k", s % 20).alias("owner"), F.lit("method").alias("kind"), text("m", s).alias("from"), text("m", s % 15).alias("to"))
    classes = spark.range(10).select(text("k", F.col("id")).alias("from"), text("w", F.col("id") % 6).alias("to"))
    target = table(spark, d, "customer").where("c_custkey < 120").select(text("w", c % 6).alias("owner"), F.lit("method").alias("kind"), text("m", c % 37).alias("name"), text("d", c % 5).alias("desc"))
    return renames.merge_asserted_members(said, classes, derived, target).drop("kind")


# -- mapping files ---------------------------------------------------------------------------

@query("""SELECT 'C' || c_nationkey AS owner, CASE WHEN c_custkey % 2 = 0 THEN 'method' ELSE 'field' END AS kind, '(I)V' AS "desc", 'i' || c_custkey AS mid, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'm' || c_custkey END AS name FROM customer""")
def tiny_members(spark, d):
    """Members of tiny v2 files, one for each nation, with the class they follow."""
    c = F.col("c_custkey")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    member = F.concat(F.lit("\t"), F.when(c % 2 == 0, "m").otherwise("f"), F.lit("\t(I)V\t"), text("i", c), F.lit("\t"), F.when(c % 4 == 0, "").otherwise(text("m", c)))
    customers = table(spark, d, "customer")
    rows = customers.select(text("f", F.col("c_nationkey")).alias("file"), (c + 2).alias("at"), member.alias("line"))
    nations = customers.select("c_nationkey").distinct()
    heads = nations.select(text("f", F.col("c_nationkey")).alias("file"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("at"), F.lit("tiny\t2\t0\tintermediary\tnamed").alias("line")), F.struct(F.lit(1).cast("long").alias("at"), F.concat(F.lit("c\tx\t"), text("C", F.col("c_nationkey"))).alias("line")))).alias("x")).select("file", "x.at", "x.line")
    classes, found, _ = mappings.tiny_v2(heads.unionByName(rows))
    met = found.join(classes.withColumnRenamed("names", "_c"), ["file", "class_at"])
    return met.select(F.col("_c")[1].alias("owner"), "kind", "desc", F.col("names")[0].alias("mid"), F.col("names")[1].alias("name"))


@query("""SELECT 'a/N' || c_nationkey AS owner, CASE WHEN c_custkey % 2 = 0 THEN 'method' ELSE 'field' END AS kind, 'get' || c_custkey AS name,
  CASE WHEN c_custkey % 2 = 0 THEN '(I[La/N' || c_nationkey || ';Lx/Y;)V' ELSE '[La/N' || c_nationkey || ';' END AS desc_source, CASE WHEN c_custkey % 2 = 0 THEN '(I[Lo' || c_nationkey || ';Lx/Y;)V' ELSE '[Lo' || c_nationkey || ';' END AS desc_obf, 'z' || c_custkey AS obf FROM customer""")
def proguard_members(spark, d):
    """Members of mapping files with descriptors on both sides (S20, S34, X-s3)."""
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    customers = table(spark, d, "customer")
    owner = F.concat(F.lit("a.N"), n.cast("string"))
    line = F.when(c % 2 == 0, F.concat(F.lit("    1:9:void get"), c.cast("string"), F.lit("(int,"), owner, F.lit("[],x.Y) -> z"), c.cast("string"))).otherwise(F.concat(F.lit("    "), owner, F.lit("[] get"), c.cast("string"), F.lit(" -> z"), c.cast("string")))
    rows = customers.select(F.concat(F.lit("f"), n.cast("string")).alias("file"), (c + 2).alias("at"), line.alias("line"))
    heads = customers.select("c_nationkey").distinct().select(F.concat(F.lit("f"), n.cast("string")).alias("file"), F.lit(1).cast("long").alias("at"), F.concat(owner, F.lit(" -> o"), n.cast("string"), F.lit(":")).alias("line"))
    classes, found = mappings.proguard(heads.unionByName(rows))
    met = found.join(classes, ["file", "class_at"])
    return met.select(F.col("source").alias("owner"), "kind", F.col("source_name").alias("name"), "desc_source", "desc_obf", F.col("obf_name").alias("obf"))


@query("""WITH l AS (SELECT s_nationkey AS file, s_suppkey AS "at", CASE WHEN s_suppkey % 5 = 0 THEN '# note' WHEN s_suppkey % 5 = 1 THEN 'key' || s_suppkey || ' = ' || s_name || '  ' ELSE 'key' || s_suppkey || ':' || s_name END AS line, s_name FROM supplier),
p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY file ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM l)
SELECT 'key' || "at" AS key, s_name AS value, (o + length('key' || "at") + CASE WHEN "at" % 5 = 1 THEN 3 ELSE 1 END)::BIGINT AS start, (o + length('key' || "at") + CASE WHEN "at" % 5 = 1 THEN 3 ELSE 1 END + length(s_name))::BIGINT AS "end" FROM p WHERE "at" % 5 <> 0""")
def properties_entries(spark, d):
    """Entries of properties files with their spans."""
    s = F.col("s_suppkey")
    key = F.concat(F.lit("key"), s.cast("string"))
    line = F.when(s % 5 == 0, "# note").when(s % 5 == 1, F.concat(key, F.lit(" = "), F.col("s_name"), F.lit("  "))).otherwise(F.concat(key, F.lit(":"), F.col("s_name")))
    entries, _ = mappings.properties(table(spark, d, "supplier").select(F.concat(F.lit("f"), F.col("s_nationkey").cast("string")).alias("file"), s.alias("at"), line.alias("line")))
    return entries.select("key", "value", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


# -- edits and reports -----------------------------------------------------------------------

_OPS = """f AS (SELECT page_id, url, length(url) AS n FROM pages), o AS (
  SELECT page_id, 'a' AS id, 0 AS s, 4 AS e, 'http' AS b, 'HTTP' AS a FROM f UNION ALL SELECT page_id, 'b', CASE WHEN page_id % 5 = 0 THEN 3 ELSE 5 END, CASE WHEN page_id % 5 = 0 THEN 5 ELSE 6 END, substr(url, CASE WHEN page_id % 5 = 0 THEN 4 ELSE 6 END, CASE WHEN page_id % 5 = 0 THEN 2 ELSE 1 END), '' FROM f
  UNION ALL SELECT page_id, 'c', n - 1, CASE WHEN page_id % 7 = 0 THEN n + 1 ELSE n END, CASE WHEN page_id % 11 = 0 THEN '??' ELSE right(url, 1) END, '!' FROM f),
v AS (SELECT o.*, CASE WHEN e > n THEN 'span out of bounds' WHEN substr(url, s + 1, e - s) <> b THEN 'text differs from what the edit expects' WHEN page_id % 5 = 0 AND id IN ('a', 'b') THEN 'overlaps another edit' END AS own FROM o JOIN f USING (page_id)),
r AS (SELECT *, count(own) OVER (PARTITION BY page_id) AS bad FROM v)"""


def _edits(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("file"), F.col("url").alias("text"))
    p, n, five = F.col("file"), F.length("text"), F.col("file") % 5 == 0
    op = lambda i, s, e, b, a: F.struct(F.lit(i).alias("id"), s.cast("int").alias("start"), e.cast("int").alias("end"), b.alias("before"), F.lit(a).alias("after"))
    start = F.when(five, 3).otherwise(5)
    size = F.when(five, 2).otherwise(1)
    ops = F.array(
        op("a", F.lit(0), F.lit(4), F.lit("http"), "HTTP"), op("b", start, start + size, F.substr("text", start + 1, size), ""),
        op("c", n - 1, F.when(p % 7 == 0, n + 1).otherwise(n), F.when(p % 11 == 0, "??").otherwise(F.right("text", F.lit(1))), "!"),
    )
    return pages, pages.select("file", F.explode(ops).alias("x")).select("file", "x.*")


@query(f"WITH {_OPS} SELECT page_id AS file, id, coalesce(own, CASE WHEN bad > 0 THEN 'withheld: another edit of this file is refused' END) AS reason FROM r")
def judged_edits(spark, d):
    """Every edit with the reason why it is refused, or none."""
    return patches.judged(*_edits(spark, d)).select("file", "id", "reason")


@query(f"""WITH {_OPS}, k AS (SELECT page_id, max(bad) AS bad, max(CASE WHEN id = 'b' THEN s END) AS s, max(CASE WHEN id = 'b' THEN e END) AS e FROM r GROUP BY page_id)
SELECT page_id AS file, CASE WHEN bad > 0 THEN url ELSE 'HTTP' || substr(url, 5, s - 4) || substr(url, e + 1, n - 1 - e) || '!' END AS text, CASE WHEN bad > 0 THEN 0 ELSE 3 END::BIGINT AS applied, CASE WHEN bad > 0 THEN 3 ELSE 0 END::BIGINT AS refused FROM k JOIN f USING (page_id)""")
def applied_edits(spark, d):
    """Texts after all of their edits or none."""
    return patches.apply_ops(*_edits(spark, d))[0].select("file", "text", "applied", "refused")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'only EXACT resolutions are patched' WHEN o_orderkey % 5 = 0 THEN 'the resolution is not of a class' WHEN o_orderkey % 7 = 0 THEN 'the resolution has no target'
  WHEN o_custkey % 3 = 0 THEN 'the resolution is of another class' END AS reason FROM orders""")
def patch_gate(spark, d):
    """Findings that may be patched, the others with their reason."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    owner = F.concat(F.lit("a/B$C"), c.cast("string"))
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "EXACT").otherwise("CANDIDATE").alias("confidence"), F.when(c % 3 == 0, "a.Other").otherwise(F.translate(owner, "/$", "..")).alias("class_name"), owner.alias("from_owner"),
        F.when(o % 5 == 0, "method").otherwise("class").alias("from_kind"), F.when(o % 7 != 0, owner).alias("to_owner"),
    )
    return patches.eligible(rows).select("o_orderkey", "reason")


@query("""SELECT o_orderpriority AS file, o_orderstatus AS "from", CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS reason, 'c' || (o_custkey % 3) AS chain, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY ALL""")
def audit_chains(spark, d):
    """Unique chains of each file with how often they occur."""
    c = F.col("o_custkey")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("file"), F.col("o_orderstatus").alias("from"), F.when(c % 2 == 0, "even").otherwise("odd").alias("reason"), F.concat(F.lit("c"), (c % 3).cast("string")).alias("chain"), F.col("o_orderkey").alias("id"))
    return report.audit_chains(rows, "id")


@query("""SELECT count(*) FILTER (l_returnflag = 'A') AS exact, count(*) FILTER (l_returnflag <> 'A') AS review, count(DISTINCT l_suppkey) AS files, count(DISTINCT CASE WHEN l_returnflag <> 'A' THEN l_linenumber END) AS decisions FROM lineitem""")
def plan_summary(spark, d):
    """Edits that are certain and those for review, distinct files and decisions."""
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", "EXACT").otherwise("REVIEW").alias("level"), F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("rule"))
    return report.plan_summary(rows)


@query("""SELECT l_linenumber AS rule, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_linenumber""")
def plan_rules(spark, d):
    """Certain edits by rule, rules without any left out (A4)."""
    return report.plan_rules(table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", "EXACT").otherwise("REVIEW").alias("level"), F.col("l_linenumber").alias("rule")))


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(event_type, ''), epoch_us(ts), CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, event_id)::INTEGER AS pos FROM events""")
def finding_order(spark, d):
    """Positions of findings in a report: file, line, symbol, confidence, id."""
    rank = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    return report.in_order(table(spark, d, "events").withColumn("_rank", rank), "user_id", [F.coalesce("event_type", F.lit("")), F.col("ts"), F.col("_rank"), F.col("event_id")]).select("event_id", "pos")


@query("""SELECT s_suppkey, '{"id":' || s_suppkey || ',"name":"' || s_name || '"' || CASE WHEN s_nationkey % 2 = 0 THEN ',"nation":' || s_nationkey ELSE '' END || '}' AS json FROM supplier""")
def report_json(spark, d):
    """Rows as JSON with keys in order and absent ones left out (K2)."""
    n = F.col("s_nationkey")
    return report.as_json(table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(n % 2 == 0, n).alias("nation")), ["id", "name", "nation"]).select("s_suppkey", "json")


@query("""WITH x AS (SELECT s_suppkey, CASE WHEN s_nationkey < 8 THEN 'added' WHEN s_nationkey < 20 THEN 'removed' ELSE 'descChanged' END AS list, 'p' || (s_nationkey % 4) || '/K' || s_suppkey AS owner FROM supplier),
h AS (SELECT replace(regexp_extract(owner, '^(.*)/', 1), '/', '.') AS pkg, count(*) AS n FROM x WHERE list = 'removed' GROUP BY 1),
c AS (SELECT *, row_number() OVER (ORDER BY owner, s_suppkey) AS k FROM x WHERE list = 'descChanged')
SELECT 'summary' AS section, row_number() OVER (ORDER BY l.list)::INTEGER AS pos, '| ' || l.list || ' | ' || count(x.list) || ' |' AS line FROM (VALUES ('added'), ('removed'), ('descChanged')) l(list) LEFT JOIN x ON x.list = l.list GROUP BY l.list
UNION ALL SELECT 'churn', row_number() OVER (ORDER BY n DESC, pkg)::INTEGER, '- `' || pkg || '` - ' || n || ' removed' FROM h QUALIFY row_number() OVER (ORDER BY n DESC, pkg) <= 3
UNION ALL SELECT 'changed', k::INTEGER, '- `' || replace(owner, '/', '.') || '#m` was `()V` now `(I)V`' FROM c WHERE k <= 5
UNION ALL SELECT 'changed', 6, '- and ' || (count(*) - 5) || ' more' FROM c HAVING count(*) > 5
UNION ALL SELECT 'removed', k::INTEGER, '- `' || replace(owner, '/', '.') || '#m()V`' FROM (SELECT *, row_number() OVER (ORDER BY owner) AS k FROM x WHERE list = 'removed') WHERE k <= 5
UNION ALL SELECT 'removed', 6, '- and ' || (count(*) - 5) || ' more' FROM x WHERE list = 'removed' HAVING count(*) > 5
UNION ALL SELECT 'renames', k::INTEGER, '| `r.' || n_name || '` | `s.' || n_name || '` | ' || n_regionkey || ' |' FROM (SELECT *, row_number() OVER (ORDER BY n_name) AS k FROM nation) WHERE k <= 4
UNION ALL SELECT 'renames', 5, '- and ' || (count(*) - 4) || ' more' FROM nation HAVING count(*) > 4""")
def delta_markdown(spark, d):
    """The lines of a delta report, capped, with what was left out."""
    n = F.col("s_nationkey")
    rows = table(spark, d, "supplier").select(
        F.when(n < 8, "added").when(n < 20, "removed").otherwise("descChanged").alias("list"), F.concat(F.lit("p"), (n % 4).cast("string"), F.lit("/K"), F.col("s_suppkey").cast("string")).alias("owner"), F.lit("m").alias("name"), F.lit("()V").alias("desc"),
        F.when(n >= 20, "(I)V").alias("new_desc"),
    )
    renamed = table(spark, d, "nation").select(F.concat(F.lit("r/"), "n_name").alias("from"), F.concat(F.lit("s/"), "n_name").alias("to"), F.col("n_regionkey").alias("score"))
    return report.delta_markdown(rows, hot=3, shown=5, renames=renamed, named=4, prefixes=["p"])


# -- grammars --------------------------------------------------------------------------------

_PARTS = """x AS (SELECT p_partkey, p_size % 3 > 0 AS owned, p_size % 5 = 0 AS typed, p_size % 7 = 0 AS again, p_size % 11 = 0 AS broken, p_size % 13 = 0 AS starred,
  'a/' || split_part(p_name, ' ', 1) AS o, split_part(p_name, ' ', 2) || p_size AS m, 'L' || lower(p_type) || ';' AS t, (p_partkey % 4)::INTEGER AS k FROM part)"""


@query(f"""WITH {_PARTS} SELECT p_partkey, CASE WHEN broken OR starred THEN 'unknown' WHEN typed THEN 'field' ELSE 'method' END AS kind, CASE WHEN NOT broken AND owned THEN o END AS owner, CASE WHEN broken THEN NULL WHEN starred THEN left(m, 2) || '*' ELSE m END AS name,
  CASE WHEN broken OR starred THEN NULL WHEN typed THEN t ELSE '(' || repeat(t, k) || 'I)V' END AS "desc", CASE WHEN broken THEN CASE WHEN typed THEN 'bad field type' ELSE 'bad method descriptor' END END AS error,
  CASE WHEN again THEN '{{' || k || '}}' END AS quantifier, starred AND NOT broken AS wildcard FROM x""")
def selectors(spark, d):
    """Selectors of members made of names and types of parts: owners, descriptors, quantifiers, wildcards and broken ends (X-s20, X-s21, X-s22)."""
    size, k = F.col("p_size"), (F.col("p_partkey") % 4).cast("int")
    first, second = (F.split_part(F.col("p_name"), F.lit(" "), F.lit(i)) for i in (1, 2))
    type_ = F.concat(F.lit("L"), F.lower("p_type"), F.lit(";"))
    name, starred, broken, typed = F.concat(second, size.cast("string")), size % 13 == 0, size % 11 == 0, size % 5 == 0
    tail = F.when(typed, F.concat(F.lit(":"), F.when(broken, F.substr(type_, F.lit(1), F.length(type_) - 1)).otherwise(type_))).otherwise(F.concat(F.lit("("), F.repeat(type_, k), F.lit("I)"), F.when(broken, "Q").otherwise("V")))
    raw = F.concat(
        F.when(size % 3 > 0, F.concat(F.lit("La/"), first, F.lit(";"))).otherwise(""), F.when(starred & ~broken, F.concat(F.left(name, F.lit(2)), F.lit("*"))).otherwise(F.concat(name, tail)), F.when(size % 7 == 0, F.concat(F.lit(" {"), k.cast("string"), F.lit("}"))).otherwise(""),
    )
    return table(spark, d, "part").select("p_partkey", G.method_spec(raw).alias("s")).select("p_partkey", "s.info.*", "s.quantifier", "s.wildcard")


@query(r"""WITH x AS (SELECT p_partkey, 'get' || p_brand AS a, 'invoke_' || p_brand AS b, 'a.b' || p_partkey || '.Outer.In' || p_size AS c, 'o/X$In$D' || p_size AS e, p_name || '|' || p_type || chr(10) || '`x`' AS f, 'a\nb\\' || p_size || '\q' AS g, '../' || p_name AS h FROM part)
SELECT p_partkey, CASE WHEN regexp_full_match(a, 'get[A-Z][A-Za-z0-9_$]*') THEN lower(substr(a, 4, 1)) || substr(a, 5) END AS bean, CASE WHEN regexp_full_match(b, 'invoke[A-Z].*') THEN '' END AS invoker, 'a/b' || p_partkey || '/Outer$In' || (regexp_extract(c, '(\d+)$', 1)) AS "binary", true AS assumed,
 'o/X$In' AS outer_name, 'D' || regexp_extract(e, '(\d+)$', 1) AS inner_name, '`' || replace(replace(replace(f, '`', ''''), '|', '\|'), chr(10), '<br>') || '`' AS code, 'a' || chr(10) || 'b\' || regexp_extract(g, '(\d+)', 1) || 'q' AS plain, regexp_replace(h, '[^A-Za-z0-9._+\- ]', '_', 'g') AS segment,
 starts_with(c, 'a.b1') OR starts_with(c, 'a.b2') AS ours FROM x""")
def name_rules(spark, d):
    """Rules on names and texts (F5, X-s12, X-s17, X-s19, X-s24, X-s30, X-s31)."""
    p, size = F.col("p_partkey"), F.col("p_size").cast("string")
    c = F.concat(F.lit("a.b"), p.cast("string"), F.lit(".Outer.In"), size)
    inner = G.split_inner(F.concat(F.lit("o/X$In$D"), size))
    return table(spark, d, "part").select(
        "p_partkey", G.bean_name(F.concat(F.lit("get"), F.col("p_brand"))).alias("bean"), G.bean_name(F.concat(F.lit("invoke_"), F.col("p_brand")), invoker=True).alias("invoker"), G.fqn_to_binary(c).getField("binary").alias("binary"), G.fqn_to_binary(c).getField("assumed").alias("assumed"),
        inner["outer"].alias("outer_name"), inner["inner"].alias("inner_name"), G.md_code(F.concat("p_name", F.lit("|"), "p_type", F.lit("\n`x`"))).alias("code"), G.unescape_tiny(F.concat(F.lit("a\\nb\\\\"), size, F.lit("\\q"))).alias("plain"),
        G.safe_segment(F.concat(F.lit("../"), F.col("p_name"))).alias("segment"), G.has_prefix(c, "a.b1", "a.b2").alias("ours"),
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'member' WHEN 3 THEN 'class' WHEN 4 THEN 'member' END AS route, CASE o_orderkey % 5 WHEN 0 THEN 'import' WHEN 1 THEN 'member-static' WHEN 2 THEN 'type-usage' WHEN 3 THEN 'fqn' END AS patch,
 CASE o_orderkey % 5 WHEN 0 THEN 'at-invoke' WHEN 1 THEN 'at-field' WHEN 2 THEN 'at-invoke' WHEN 3 THEN 'at-field' END AS surface, CASE o_orderkey % 5 WHEN 0 THEN 'kts' WHEN 1 THEN 'groovy' WHEN 2 THEN 'properties' WHEN 3 THEN 'mixin-json' ELSE 'unsupported' END AS file_kind FROM orders""")
def finding_rules(spark, d):
    """Where findings go: query, patch, surface and kind of file."""
    k = F.col("o_orderkey") % 5
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) if x is not None else F.lit(None).cast("string") for x in v]), (k + 1).cast("int"))
    return table(spark, d, "orders").select(
        "o_orderkey", G.route(pick("import", "member-static", "new", "fqn-reference", "import-static"), pick(None, "m", "m", "", "m")).alias("route"), G.patch_kind(pick("import", "member-static", "new", "fqn-reference", "import-static")).alias("patch"),
        G.at_surface(pick("INVOKE", "FIELD", "HEAD", None, "TAIL"), pick("field", "method", "method", "field", "unknown")).alias("surface"), G.file_kind(pick("a/b.gradle.kts", "B.Gradle", "x\\gradle.properties", "q.mixins.json", "readme.md")).alias("file_kind"),
    )


@query("""SELECT event_id, ts - lag(ts) OVER w > INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL AS begins, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS depth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def token_positions(spark, d):
    """The token before each one, and how deep brackets are there."""
    from ..operators import spans

    checkpointing(spark)
    rows = table(spark, d, "events")
    step = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    gap = lambda now, last: last.isNull() | (now - last > F.expr("interval 1 hour"))
    return spans.token_positions(rows, "user_id", ["ts", "event_id"], "ts", gap, step).select("event_id", "begins", "depth")


@query("""SELECT n_name, 'L' || n_nationkey || CASE WHEN n_regionkey % 2 = 0 THEN ':' || n_regionkey ELSE '' END AS loc, printf('%.3f', n_nationkey / 8.0) AS fixed, regexp_full_match(n_name, '[A-Z][A-Z0-9_]+') AS constant, false AS class_like, 1.0 - levenshtein(n_name, 'BRAZIL') / greatest(length(n_name), 6)::DOUBLE AS edit FROM nation""")
def text_rules(spark, d):
    """Locations, fixed decimals and tests of case (X-s10, X-s18, X-s29, X-s30)."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    return table(spark, d, "nation").select("n_name", G.loc_text(n, F.when(r % 2 == 0, r)).alias("loc"), G.fixed(n / 8.0, 3).alias("fixed"), G.is_constant_like(F.col("n_name")).alias("constant"), G.is_class_like(F.col("n_name")).alias("class_like"), G.edit_similarity(F.col("n_name"), F.lit("BRAZIL")).alias("edit"))


@query("""SELECT o_orderkey, count(l_orderkey)::BIGINT AS n, o_custkey % 5 > 0 AS valid FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey""")
def descriptor_rules(spark, d):
    """Argument counts and validity of descriptors with an argument for each line of an order, some without a return type (X-s6, X-s22)."""
    code = F.when(F.col("l_returnflag") == "A", "I").when(F.col("l_returnflag") == "N", "[[J").otherwise(F.concat(F.lit("Lx/S"), F.col("l_suppkey").cast("string"), F.lit(";")))
    args = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", code.alias("c")))), lambda x: x["c"]), "").alias("args"))
    desc = F.concat(F.lit("("), "args", F.when(F.col("o_custkey") % 5 == 0, ")").otherwise(")V"))
    return table(spark, d, "orders").join(args, "o_orderkey").select("o_orderkey", S.arity(desc).alias("n"), G.valid_method_desc(desc).alias("valid"))


def _rounds_sql(rounds: int = 4) -> str:
    """The rounds of the class matching, one after the other."""
    one = """p{n} AS (SELECT a.owner AS l, b.owner AS r, count(*) AS o FROM (SELECT DISTINCT l.owner, l.kind, l.name, coalesce(m.t, l.ref) AS ref FROM old l LEFT JOIN m{k} m ON m.f = l.ref WHERE l.owner NOT IN (SELECT f FROM m{k})) a
  JOIN new b ON a.name = b.name AND a.kind = b.kind AND a.ref = b.ref WHERE b.owner NOT IN (SELECT t FROM m{k}) GROUP BY a.owner, b.owner),
s{n} AS (SELECT l, r, o / (x.n + y.n - o)::DOUBLE * CASE WHEN split_part(l, '/', 1) = split_part(r, '/', 1) THEN 1.0 ELSE 0.9 END::DOUBLE AS score, o / (x.n + y.n - o)::DOUBLE AS jac,
  1.0 - levenshtein(split_part(l, '/', 2), split_part(r, '/', 2)) / greatest(length(split_part(l, '/', 2)), length(split_part(r, '/', 2)))::DOUBLE AS sim FROM p{n} JOIN cl x ON x.owner = l JOIN cr y ON y.owner = r),
b{n} AS (SELECT *, rank() OVER (PARTITION BY l ORDER BY score DESC, sim DESC) AS ra, rank() OVER (PARTITION BY r ORDER BY score DESC, sim DESC) AS rb FROM s{n} WHERE jac >= 0.5),
t{n} AS (SELECT *, count(*) FILTER (ra = 1) OVER (PARTITION BY l) AS ka, count(*) FILTER (rb = 1) OVER (PARTITION BY r) AS kb FROM b{n}),
f{n} AS (SELECT l AS f, r AS t, floor(score * 1000 + 0.5) / 1000 AS score, {n} AS round FROM t{n} WHERE ra = 1 AND rb = 1 AND ka = 1 AND kb = 1 AND score >= 0.5),
m{n} AS (SELECT * FROM m{k} UNION ALL SELECT * FROM f{n})"""
    side = """SELECT DISTINCT CASE WHEN k < 10 THEN 'g/K' || k ELSE CASE WHEN k % 4 = 0 THEN '{other}/' ELSE 'g/' END || '{s}' || k END AS owner, CASE WHEN p_size % 2 = 0 THEN 'method' ELSE 'field' END AS kind, p_brand || '_' || p_size || '_' || p_partkey AS name,
    CASE WHEN k < 25 THEN 'g/K' || (p_size % 10) WHEN k < 33 THEN CASE WHEN (k - 15) % 4 = 0 THEN '{other}/' ELSE 'g/' END || '{s}' || (k - 15) ELSE CASE WHEN (k - 8) % 4 = 0 THEN '{other}/' ELSE 'g/' END || '{s}' || (k - 8) END AS ref
    FROM (SELECT *, p_partkey % 40 AS k FROM part){where}"""
    steps = ",\n".join(one.format(n=n, k=n - 1) for n in range(1, rounds + 1))
    return f"""WITH old AS MATERIALIZED ({side.format(s='O', other='g', where='')}),
new AS MATERIALIZED ({side.format(s='N', other='h', where=' WHERE p_size % 11 <> 0')}),
cl AS (SELECT owner, count(*) AS n FROM old GROUP BY owner), cr AS (SELECT owner, count(*) AS n FROM new GROUP BY owner),
m0 AS (SELECT owner AS f, owner AS t, 1.0::DOUBLE AS score, 0 AS round FROM cl WHERE owner IN (SELECT owner FROM cr)),
{steps}
SELECT f AS "from", t AS "to", score::DOUBLE AS score, round::INTEGER AS round FROM m{rounds}"""


@query(_rounds_sql())
def class_renames(spark, d):
    """Class renames of two snapshots to a fixpoint: anchors, classes that name only them, and two layers above."""
    checkpointing(spark)
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", (F.col("p_partkey") % 40).alias("k"))
    k = F.col("k")

    def side(s, other):
        own = lambda c: F.concat(F.when(c % 4 == 0, other).otherwise("g/"), F.lit(s), c.cast("string"))
        anchor = lambda c: F.concat(F.lit("g/K"), c.cast("string"))
        ref = F.when(k < 25, anchor(F.col("p_size") % 10)).when(k < 33, own(k - 15)).otherwise(own(k - 8))
        return p.select(
            F.when(k < 10, anchor(k)).otherwise(own(k)).alias("owner"), F.when(F.col("p_size") % 2 == 0, "method").otherwise("field").alias("kind"), F.concat_ws("_", "p_brand", F.col("p_size").cast("string"), F.col("p_partkey").cast("string")).alias("name"),
            F.concat(F.lit("(L"), ref, F.lit(";)V")).alias("desc"), "p_size",
        )

    return renames.match_classes(side("O", "g/").drop("p_size"), side("N", "h/").where("p_size % 11 <> 0").drop("p_size"))
