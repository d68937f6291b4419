"""Queries of merged reports, their Markdown and the grounding of targets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import flatten, ground, merge
from ..sources import archives
from .domain import _ASKED, _TREE, _tree_world
from .session import checkpointing, registry, table

QUERIES, ORACLE_SQL, query = registry()


@query("""WITH meta AS (SELECT r_regionkey AS report, CASE WHEN r_regionkey = 3 THEN 'source' ELSE 'named' END AS ns, r_name FROM region), ok AS (SELECT report FROM meta WHERE ns = 'named'),
f0 AS (SELECT o_orderkey AS id, o_orderkey % 5 AS report, o_orderstatus AS verdict FROM orders UNION ALL SELECT o_orderkey, (o_orderkey + o_custkey) % 5, CASE WHEN o_custkey % 7 = 0 THEN 'Q' ELSE o_orderstatus END FROM orders WHERE o_custkey % 5 <> 0),
f1 AS (SELECT id, arg_min(verdict, report) AS verdict, string_agg(report::VARCHAR, ',' ORDER BY report) AS reports, min(verdict) = max(verdict) AS agree FROM f0 JOIN ok USING (report) GROUP BY id),
e AS (SELECT l_orderkey % 5 AS report, l_returnflag = 'A' AS exact, l_linenumber AS rule, 's' || l_suppkey AS file FROM lineitem WHERE (l_orderkey % 5) IN (SELECT report FROM ok)),
m AS (SELECT DISTINCT 'u' || user_id AS file, event_id % 10 AS line, event_type AS reason FROM events WHERE (user_id % 5) IN (SELECT report FROM ok)),
t AS (SELECT report, c_mktsegment AS list, count(*) + CASE WHEN report = 2 AND c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS n FROM customer, ok GROUP BY report, c_mktsegment), t1 AS (SELECT list, min(n) AS lo, max(n) AS hi FROM t GROUP BY list)
SELECT 'finding' AS what, id::VARCHAR AS key, verdict AS a, reports || ' ' || agree AS b FROM f1 UNION ALL SELECT 'rule', rule::VARCHAR, (count(*) FILTER (exact))::VARCHAR, (count(*) FILTER (NOT exact))::VARCHAR FROM e GROUP BY rule
UNION ALL SELECT 'file', file, NULL, NULL FROM (SELECT file FROM e UNION SELECT file FROM m) UNION ALL SELECT 'manual', file, line::VARCHAR, reason FROM m
UNION ALL SELECT 'total', list, CASE WHEN lo = hi THEN lo END::VARCHAR, NULL FROM t1 UNION ALL SELECT 'error', list, 'totals', lo || ' and ' || hi FROM t1 WHERE lo <> hi UNION ALL SELECT 'error', report::VARCHAR, 'meta', '1 > 2 (source) instead of 1 > 2 (named)' FROM meta WHERE ns <> 'named'
UNION ALL SELECT 'meta', 'v0', 'named', string_agg(r_name, ' + ' ORDER BY r_name) FROM meta WHERE ns = 'named'""")
def merged_reports(spark, d):
    """Five reports in one: findings by id, edits by rule, files, items for review, totals, and what does not fit."""
    r = F.col("r_regionkey")
    meta = table(spark, d, "region").select(r.cast("long").alias("report"), r.alias("rank"), F.concat(F.lit("v"), r.cast("string")).alias("version"), F.lit("1").alias("from_version"), F.lit("2").alias("to_version"), F.when(r == 3, "source").otherwise("named").alias("namespace"), F.col("r_name").alias("generated_for"))
    o = table(spark, d, "orders")
    findings = o.select((F.col("o_orderkey") % 5).alias("report"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("verdict"))
    again = o.where("o_custkey % 5 <> 0").select(F.expr("(o_orderkey + o_custkey) % 5").alias("report"), F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 7 == 0, "Q").otherwise(F.col("o_orderstatus")).alias("verdict"))
    edits = table(spark, d, "lineitem").select((F.col("l_orderkey") % 5).alias("report"), F.when(F.col("l_returnflag") == "A", "EXACT").otherwise("REVIEW").alias("level"), F.col("l_linenumber").alias("rule"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("file"))
    manual = table(spark, d, "events").select((F.col("user_id") % 5).alias("report"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), (F.col("event_id") % 10).alias("line"), F.col("event_type").alias("reason"))
    segments = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("list")).agg(F.count("*").alias("n"))
    totals = segments.withColumn("report", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(F.col("report").cast("long").alias("report"), "list", (F.col("n") + F.when((F.col("report") == 2) & (F.col("list") == "BUILDING"), 1).otherwise(0)).alias("n"))
    m = merge.merge_reports(merge.Reports(meta, findings.unionByName(again), edits, manual, totals))
    part = lambda df, what, key, a=None, b=None: df.select(F.lit(what).alias("what"), F.col(key).cast("string").alias("key"), *[(x if x is not None else F.lit(None)).cast("string").alias(n) for n, x in (("a", a), ("b", b))])
    c = F.col
    reports = F.concat_ws(" ", F.array_join(c("reports").cast("array<string>"), ","), c("agree").cast("string"))
    tables = [part(m.findings, "finding", "id", c("verdict"), reports), part(m.rules, "rule", "rule", c("exact"), c("review")), part(m.files, "file", "file"), part(m.manual, "manual", "file", c("line"), c("reason")), part(m.totals, "total", "list", c("n")),
              part(m.errors, "error", "key", c("what"), c("error")), part(m.meta, "meta", "version", c("namespace"), c("generated_for"))]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


@query("""WITH f AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'EXACT' WHEN 'O' THEN 'CANDIDATE' ELSE 'UNRESOLVED' END AS verdict, CASE o_orderkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'method' ELSE 'field' END AS kind,
  CASE WHEN o_custkey % 20 > 0 THEN 'src/f' || (o_custkey % 20) END AS file, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 100 END AS line, 'a/B#m' || (o_custkey % 50) AS symbol, CASE WHEN o_orderstatus <> 'P' AND o_custkey % 7 > 0 THEN 't|' || (o_custkey % 7) END AS target, o_orderpriority AS reason FROM orders),
w AS (SELECT *, CASE WHEN file IS NULL THEN '(no source location)' ELSE concat_ws(':', file, line::VARCHAR) END AS w FROM f),
s AS (SELECT v.k, v.verdict, count(*) FILTER (kind = 'class') AS c, count(*) FILTER (kind = 'method') AS m, count(*) FILTER (kind = 'field') AS fi, count(id) AS n FROM (VALUES (1, 'EXACT'), (2, 'CANDIDATE'), (3, 'UNRESOLVED')) v(k, verdict) LEFT JOIN f ON f.verdict = v.verdict GROUP BY v.k, v.verdict),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, target ORDER BY w) AS k, count(*) OVER (PARTITION BY symbol, target) AS n FROM w WHERE verdict = 'CANDIDATE'),
d AS (SELECT symbol, target, min(w) AS first, string_agg(w, ', ' ORDER BY w) FILTER (k <= 10) || CASE WHEN max(n) > 10 THEN ' (+' || (max(n) - 10) || ' more)' ELSE '' END AS sites FROM r GROUP BY symbol, target)
SELECT 'summary' AS section, k::BIGINT AS pos, '| ' || verdict || ' | ' || c || ' | ' || m || ' | ' || fi || ' | ' || n || ' |' AS line FROM s
UNION ALL SELECT 'candidates', row_number() OVER (ORDER BY first, symbol, target NULLS FIRST), '| `' || symbol || '` | ' || CASE WHEN target IS NULL THEN '`none`' ELSE '`' || replace(target, '|', '\\|') || '`' END || ' | ' || sites || ' |' FROM d
UNION ALL SELECT lower(verdict), row_number() OVER (PARTITION BY verdict ORDER BY coalesce(file, ''), coalesce(line, 0), symbol, id), '| ' || w || ' | `' || symbol || '` | ' || replace(coalesce(target, reason, ''), '|', '\\|') || ' |' FROM w WHERE verdict <> 'CANDIDATE'""")
def report_markdown(spark, d):
    """A report as Markdown lines: summary, decisions on candidates, exact and unresolved findings."""
    checkpointing(spark)
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    rows = table(spark, d, "orders").select(
        o.alias("id"), F.when(F.col("o_orderstatus") == "F", "EXACT").when(F.col("o_orderstatus") == "O", "CANDIDATE").otherwise("UNRESOLVED").alias("verdict"), F.when(o % 3 == 0, "class").when(o % 3 == 1, "method").otherwise("field").alias("kind"),
        F.when(c % 20 > 0, text("src/f", c % 20)).alias("file"), F.when(o % 9 > 0, o % 100).alias("line"), text("a/B#m", c % 50).alias("symbol"), F.when((F.col("o_orderstatus") != "P") & (c % 7 > 0), text("t|", c % 7)).alias("target"), F.col("o_orderpriority").alias("reason"),
    )
    return merge.report_markdown(rows)


@query(f"""{_TREE}, {_ASKED}, c AS (SELECT qid, owner, CASE WHEN qid % 5 = 0 THEN NULL ELSE kind END AS kind, CASE WHEN qid % 11 = 0 THEN NULL WHEN qid % 13 = 0 THEN left(name, 1) || '*' ELSE name END AS name, CASE WHEN qid % 5 > 0 THEN dq END AS dq FROM q),
h AS (SELECT c.qid, w.node, w.depth, m.kind, m.name, m.d FROM c JOIN walk w ON w.root = c.owner JOIN mem m ON m.o = w.node AND (c.kind IS NULL OR m.kind = c.kind)
  WHERE CASE WHEN c.name LIKE '%*%' THEN w.depth = 0 AND starts_with(m.name, left(c.name, 1)) ELSE m.name = c.name AND (dq IS NULL OR m.d = dq) END),
f AS (SELECT qid, min(depth) AS depth FROM h GROUP BY qid), g AS (SELECT h.*, row_number() OVER (PARTITION BY h.qid ORDER BY kind DESC, name, d) AS k, count(*) OVER (PARTITION BY h.qid) AS n FROM h JOIN f ON f.qid = h.qid AND f.depth = h.depth),
x AS (SELECT DISTINCT c.qid FROM c JOIN walk w ON w.root = c.owner JOIN mem m ON m.o = w.node AND (c.kind IS NULL OR m.kind = c.kind) AND m.name = c.name),
r AS (SELECT c.*, p_partkey IS NOT NULL AS known, coalesce(c.name LIKE '%*%', false) AS wild, coalesce(g.n, 0) AS n, g.depth, g.node, g.kind AS gk, g.name AS gn, g.d AS gd, x.qid IS NOT NULL AS near FROM c LEFT JOIN part ON owner = p_partkey LEFT JOIN g ON g.qid = c.qid AND g.k = 1 LEFT JOIN x ON x.qid = c.qid),
v AS (SELECT *, CASE WHEN known AND name IS NULL OR n = 1 AND depth = 0 AND NOT wild THEN 'EXACT' WHEN n > 0 THEN 'CANDIDATE' ELSE 'UNRESOLVED' END AS verdict FROM r)
SELECT qid AS "check", verdict, n AS matches, least(n, 20) AS shown, 't/P' || node || '#' || gn || gd AS first, CASE WHEN n = 0 THEN NULL WHEN verdict = 'EXACT' THEN 1.0 WHEN wild OR depth = 0 THEN 0.5 WHEN dq IS NOT NULL THEN 0.85 WHEN n = 1 THEN 0.7 ELSE 0.4 END::DOUBLE AS score,
  CASE WHEN NOT known THEN 'owner is not in the snapshot' WHEN verdict = 'EXACT' THEN NULL WHEN wild THEN CASE WHEN n > 0 THEN 'a wildcard is never one member' ELSE 'no declared member fits the wildcard' END WHEN n = 0 THEN CASE WHEN near THEN 'descriptor differs' ELSE 'no member of that name' END
    WHEN depth = 0 THEN 'several members of that name' ELSE 'inherited, not declared on the owner' END AS reason FROM v""")
def target_grounding(spark, d):
    """Classes, members, bare names and wildcards grounded in one version."""
    asked, classes, pool = _tree_world(spark, d)
    q = F.col("qid")
    checks = asked.select(
        q.alias("check"), "owner", F.when(q % 5 > 0, F.col("kind")).alias("kind"), F.when(q % 11 == 0, None).when(q % 13 == 0, F.concat(F.left("name", F.lit(1)), F.lit("*"))).otherwise(F.col("name")).alias("name"), F.when(q % 5 > 0, F.col("desc")).alias("desc")
    )
    best = F.get("candidates", 0)
    return ground.ground_targets(checks, classes, pool).select("check", "verdict", "matches", F.size("candidates").cast("long").alias("shown"), F.concat(best["owner"], F.lit("#"), best["name"], best["desc"]).alias("first"), best["score"].alias("score"), "reason")


@query("""WITH l AS (SELECT 'f' || l_orderkey AS file, l_linenumber AS line, l_returnflag AS flag, l_partkey AS p, l_suppkey AS s FROM lineitem)
SELECT file, line, CASE WHEN p % 7 > 0 THEN 'class' ELSE 'unparseable' END AS surface, CASE WHEN p % 7 > 0 THEN 'a/P' || p END AS owner, NULL AS name, NULL AS "desc", CASE WHEN p % 7 = 0 THEN 'class is not resolved' END AS note FROM l WHERE flag = 'A'
UNION ALL SELECT file, line, 'method-spec', NULL, 'm' || line, '(I)V', 'owner is the target' || CASE WHEN s % 2 = 0 THEN '; descriptor is the handler''s' ELSE '' END FROM l WHERE flag = 'N'
UNION ALL SELECT file, line, 'unparseable', NULL, NULL, NULL, CASE WHEN s % 2 = 0 THEN 'Overwrite' ELSE 'Inject' END || ': bad method descriptor' FROM l WHERE flag = 'N' AND p % 3 = 0
UNION ALL SELECT file, line + 100, 'at-invoke', 'a/P' || p, 'call', '()V', NULL FROM l WHERE flag = 'N' AND s % 4 = 0
UNION ALL SELECT file, line + 100, 'unparseable', NULL, 'bare', NULL, 'the kind of the point is open' FROM l WHERE flag = 'N' AND s % 4 = 1
UNION ALL SELECT file, line, CASE WHEN s % 3 = 0 THEN 'shadow' WHEN s % 3 = 1 THEN 'accessor' ELSE 'invoker' END, NULL, 'x' || line, NULL, 'owner is the target' || CASE WHEN s % 5 = 0 THEN '; guessed' ELSE '' END FROM l WHERE flag = 'R' AND p % 5 > 0""")
def flattened_checks(spark, d):
    """Nested scans of every order as one table of checks."""
    line, p, s, flag = (F.col(f"l_{c}") for c in ("linenumber", "partkey", "suppkey", "returnflag"))
    text = lambda a, b: F.concat(F.lit(a), b.cast("string"))
    specs = F.array_compact(F.array(F.concat(text("m", line), F.lit("(I)V")), F.when(p % 3 == 0, "bad(Q)V")))
    at = F.struct((line + 100).alias("line"), F.when(s % 4 == 0, "INVOKE").when(s % 4 == 1, "CUSTOM").otherwise("HEAD").alias("value"), F.when(s % 4 == 0, F.concat(text("La/P", p), F.lit(";call()V"))).when(s % 4 == 1, "bare").alias("target"))
    kind = F.when(s % 3 == 0, "Shadow").when(s % 3 == 1, "Accessor").otherwise("Invoker")
    rows = table(spark, d, "lineitem").groupBy(text("f", F.col("l_orderkey")).alias("file")).agg(
        F.collect_list(F.when(flag == "A", F.struct(line.alias("line"), F.when(p % 7 > 0, text("a/P", p)).alias("name"), F.lit(None).cast("string").alias("note")))).alias("targets"),
        F.collect_list(F.when(flag == "N", F.struct(line.alias("line"), F.when(s % 2 == 0, "Overwrite").otherwise("Inject").alias("annotation"), specs.alias("specs"), F.array(at).alias("ats")))).alias("injectors"),
        F.collect_list(F.when(flag == "R", F.struct(line.alias("line"), kind.alias("annotation"), F.when(p % 5 > 0, text("x", line)).alias("implied"), F.when(s % 5 == 0, "guessed").alias("note")))).alias("shadows"),
    )
    return flatten.target_checks(rows).drop("raw")


@query("""SELECT page_id, url, list_has_any(string_split(regexp_replace(url, '/[^/]*$', ''), '/'), ['shop', 'blog', 'p', 'wiki']) AND contains(url, '/') AS skipped FROM pages""")
def skipped_paths(spark, d):
    """Paths below folders that a walk leaves out."""
    return table(spark, d, "pages").select("page_id", "url", flatten.skipped(F.col("url"), ["shop", "blog", "p", "wiki"]).alias("skipped"))


def _zipped(batches):
    """An archive of every batch of (name, data, stored)."""
    import io
    import zipfile

    for batch in batches:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for name, data, stored in zip(*(c.to_pylist() for c in batch.columns)):
                z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
        if batch.num_rows:
            yield pa.record_batch({"path": pa.array([batch.column(0)[0].as_py()]), "content": pa.array([buffer.getvalue()], pa.binary())})


@query("""SELECT 'p/' || page_id || '.html' AS name, octet_length(encode(coalesce(html, '')))::BIGINT AS size, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 8 END::INTEGER AS method, sha256(coalesce(html, '')) AS digest FROM pages""")
def archive_entries(spark, d):
    """Pages written to zip archives, read back by their central directories and inflated by size."""
    page = F.col("page_id")
    rows = table(spark, d, "pages").select(F.concat(F.lit("p/"), page.cast("string"), F.lit(".html")).alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("data"), (page % 3 == 0).alias("stored"))
    files = rows.mapInArrow(_zipped, "path string, content binary")
    return archives.entries(files).select("name", "size", "method", F.sha2("data", 256).alias("digest"))


@query("""WITH x AS (SELECT o_custkey % 37 AS n0, o_orderkey % 29 AS a, o_orderkey % 31 AS b, o_orderkey FROM orders), y AS (SELECT o_orderkey, n0 AS n, least(a, n0) AS a, least(b, n0) AS b FROM x)
SELECT o_orderkey, CASE WHEN n >= 3 AND b >= 0.25 * n AND b > a THEN 'source' ELSE 'named' END AS namespace, n >= 3 AND b >= 0.25 * n AND b > a AS autodetected,
CASE WHEN n = 0 THEN NULL WHEN n >= 3 AND b >= 0.25 * n AND b > a THEN 'detected source: ' || b || '/' || n || ' names against ' || a || '/' || n || ' under named' WHEN a >= 0.25 * n AND a >= 4 * greatest(b, 1) THEN NULL
  WHEN a >= 0.25 * n THEN 'named by default: ' || a || '/' || n || ' names, but ' || b || '/' || n || ' are source names too' ELSE 'named by default, though only ' || a || '/' || n || ' names fit; source may be meant' END AS notice FROM y""")
def namespace_choice(spark, d):
    """Namespaces chosen from counts of hits, with the notice."""
    o, n = F.col("o_orderkey"), F.col("o_custkey") % 37
    probed = table(spark, d, "orders").select("o_orderkey", n.alias("n"), F.least(o % 29, n).alias("named"), F.least(o % 31, n).alias("source"))
    return ground.namespace_decision(probed).select("o_orderkey", "namespace", "autodetected", "notice")
