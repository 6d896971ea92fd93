"""Queries over runs, plans, result pages, behaviour and field speed."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import audit as D
from ..operators import behaviour as R
from ..operators import plan as P
from ..operators import runs as L
from ..operators import serp as Q
from ..session import stage_path
from ..sources import documents as SD
from ..sources import sinks
from . import adapters as A
from .registry import query
from .sql import CLUSTERS, RUNS, pct, rx
from .text_queries import behaviour_docs, field_docs, serp_pages

_DIFF = f"""{RUNS}, a AS (SELECT rf.site, rf.run_id, rule, r, severity, n_urls FROM rf JOIN rl USING (site, run_id) WHERE prev_id IS NOT NULL),
b AS (SELECT rl.site, rl.run_id, rule, r, severity, n_urls FROM rl JOIN rf ON rf.site = rl.site AND rf.run_id = rl.prev_id),
j AS (SELECT coalesce(a.site, b.site) AS site, coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.rule, b.rule) AS rule, a.r AS ar, b.r AS br, a.n_urls AS an, b.n_urls AS bn,
  a.severity AS severity, b.severity AS from_severity FROM a FULL JOIN b ON a.site = b.site AND a.run_id = b.run_id AND a.rule = b.rule),
df AS (SELECT *, 'appeared' AS change FROM j WHERE br IS NULL UNION ALL SELECT *, 'resolved' FROM j WHERE ar IS NULL
  UNION ALL SELECT *, 'worsened' FROM j WHERE ar < br UNION ALL SELECT *, 'grew' FROM j WHERE bn > 0 AND an >= bn * 2)"""


@query("snapshots", """SELECT 'run-1' AS snapshot, (SELECT count(*) FROM orders) AS n_rows, o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers
  FROM orders GROUP BY o_orderstatus""")
def snapshots(spark, sf):
    """A run saved twice under one name, listed and read back: the last write shows."""
    orders, root = A.table(spark, sf, "orders"), stage_path(spark)
    sinks.save_snapshot({"orders": orders.select("o_orderkey"), "customers": A.table(spark, sf, "customer")}, root, "run 1")
    sinks.save_snapshot({"orders": orders.select("o_orderkey", "o_custkey", "o_orderstatus")}, root, "run 1")
    listed = sinks.list_snapshots(spark, root, "orders").select("snapshot", F.col("rows").alias("n_rows"))
    per_status = sinks.load_snapshot(spark, root, "orders", "run 1").groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))
    return per_status.withColumn("snapshot", F.lit("run-1")).join(listed, "snapshot").select("snapshot", "n_rows", "status", "n", "customers")


def _diff(spark, sf):
    return L.diff_findings(A.run_findings(spark, sf), A.run_list(spark, sf))


@query("diff_findings", f"WITH {_DIFF} SELECT site, run_id, rule, change, coalesce(severity, '') AS severity, coalesce(from_severity, '') AS from_severity FROM df")
def diff_findings(spark, sf):
    e = F.lit("")
    return _diff(spark, sf).select("site", "run_id", "rule", "change", F.coalesce("severity", e).alias("severity"),
                                   F.coalesce("from_severity", e).alias("from_severity"))


@query("alertable", f"WITH {_DIFF} SELECT site, run_id, rule, change FROM df WHERE change IN ('appeared', 'worsened') AND severity IN ('Critical', 'High')")
def alertable(spark, sf):
    return L.alertable(_diff(spark, sf)).select("site", "run_id", "rule", "change")


_STRUCT = """st AS (SELECT 's' || CAST(floor(o_custkey / 50.0) AS BIGINT) AS site, CAST(year(o_orderdate) AS VARCHAR) AS run_id, count(*) AS crawled,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS noindex, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS errors, count(*) FILTER (WHERE o_orderstatus = 'O') AS indexable FROM orders GROUP BY ALL),
sp AS (SELECT *, lag(crawled) OVER w AS pc, lag(noindex) OVER w AS pn, lag(errors) OVER w AS pe, lag(indexable) OVER w AS pi FROM st WINDOW w AS (PARTITION BY site ORDER BY run_id)),
sx AS (SELECT site, run_id, 'pages fell' AS change, pc AS before, crawled AS after FROM sp WHERE pc > 10 AND crawled < pc * 0.8
  UNION ALL SELECT site, run_id, 'noindex rose', pn, noindex FROM sp WHERE noindex > pn UNION ALL SELECT site, run_id, 'errors rose', pe, errors FROM sp WHERE errors > pe
  UNION ALL SELECT site, run_id, 'indexable fell', pi, indexable FROM sp WHERE pi > 5 AND indexable < pi * 0.9)"""


@query("structural_changes", f"WITH {_STRUCT} SELECT site, run_id, change, before, after FROM sx")
def structural_changes(spark, sf):
    return L.structural_changes(A.run_stats(spark, sf), A.run_list(spark, sf))


@query("run_status", f"""WITH {_DIFF}, {_STRUCT}, al AS (SELECT site, run_id, count(*) AS n FROM df WHERE change IN ('appeared', 'worsened') AND severity IN ('Critical', 'High') GROUP BY ALL),
  sc AS (SELECT site, run_id, count(*) AS n FROM sx GROUP BY ALL) SELECT rl.site, rl.run_id, coalesce(al.n, 0) AS alerts, coalesce(sc.n, 0) AS structural,
  CASE WHEN prev_id IS NULL THEN 'baseline' WHEN al.n IS NULL AND sc.n IS NULL THEN 'quiet' ELSE 'changed' END AS status FROM rl LEFT JOIN al USING (site, run_id) LEFT JOIN sc USING (site, run_id)""")
def run_status(spark, sf):
    s = L.structural_changes(A.run_stats(spark, sf), A.run_list(spark, sf))
    return L.run_status(A.run_list(spark, sf), _diff(spark, sf), s).select("site", "run_id", "alerts", "structural", "status")


@query("run_log", f"WITH {RUNS} SELECT site, run_id FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY run_id DESC) AS r FROM rl) WHERE r <= 3")
def run_log(spark, sf):
    return L.run_log(A.run_list(spark, sf), 3).select("site", "run_id")


_SNAP = """sa AS (SELECT p_partkey AS k, 200 AS status, p_name AS title, FALSE AS noindex, CAST(p_size * 10 AS INTEGER) AS words FROM part WHERE p_partkey % 7 <> 0),
sb AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 404 ELSE 200 END AS status, CASE WHEN p_partkey % 13 = 0 THEN 'new' ELSE p_name END AS title, p_partkey % 17 = 0 AS noindex,
  CAST(CASE WHEN p_partkey % 19 = 0 THEN p_size * 10 + 101 ELSE p_size * 10 END AS INTEGER) AS words FROM part WHERE p_partkey % 5 <> 0)"""


@query("diff_pages", f"""WITH {_SNAP} SELECT coalesce(sa.k, sb.k) AS k, CASE WHEN sa.k IS NULL THEN 'added' WHEN sb.k IS NULL THEN 'removed' ELSE 'changed' END AS kind,
  coalesce(sa.k IS NOT NULL AND sb.k IS NOT NULL AND (sa.status <> sb.status OR sb.noindex), FALSE) AS severe FROM sa FULL JOIN sb ON sa.k = sb.k
  WHERE sa.k IS NULL OR sb.k IS NULL OR sa.status <> sb.status OR sa.title <> sb.title OR sa.noindex <> sb.noindex OR abs(sa.words - sb.words) > 100""")
def diff_pages(spark, sf):
    p = A.table(spark, sf, "part")
    k = F.col("p_partkey")
    common = [F.lit("s").alias("site"), k.cast("string").alias("url")]
    rest = [F.lit(None).cast("string").alias("canonical"), F.lit(0).alias("inbound_count")]
    before = p.filter(k % 7 != 0).select(*common, F.lit(200).alias("status"), F.col("p_name").alias("title"), F.lit(False).alias("noindex"),
                                         (F.col("p_size") * 10).alias("word_count"), *rest)
    after = p.filter(k % 5 != 0).select(
        *common, F.when(k % 11 == 0, 404).otherwise(200).alias("status"), F.when(k % 13 == 0, "new").otherwise(F.col("p_name")).alias("title"),
        (k % 17 == 0).alias("noindex"), (F.col("p_size") * 10 + F.when(k % 19 == 0, 101).otherwise(0)).alias("word_count"), *rest)
    return L.diff_pages(before, after).select(F.col("url").cast("bigint").alias("k"), "kind", "severe")


# --- planning --------------------------------------------------------------------------------

_PTS = "CASE effort WHEN 'S' THEN 1 WHEN 'M' THEN 3 ELSE 8 END"
_PLAN = f"""{RUNS}, it AS (SELECT site, run_id, rule, stage, severity, {_PTS} AS p, row_number() OVER (PARTITION BY site, run_id ORDER BY
  list_position(['eligibility','indexation','intent','onpage','linking','schema','performance','offpage'], stage), r, {_PTS}, rule) AS n FROM rf),
pl AS (SELECT site, run_id, rule, stage, severity, p, n, 1 AS week, p AS used FROM it WHERE n = 1
  UNION ALL SELECT it.site, it.run_id, it.rule, it.stage, it.severity, it.p, it.n, CASE WHEN pl.used + it.p > 10 THEN pl.week + 1 ELSE pl.week END,
  CASE WHEN pl.used + it.p > 10 THEN it.p ELSE pl.used + it.p END FROM pl JOIN it ON it.site = pl.site AND it.run_id = pl.run_id AND it.n = pl.n + 1)"""


def _plan(spark, sf):
    return P.build_plan(A.run_findings(spark, sf), by=["site", "run_id"])


@query("build_plan", f"WITH RECURSIVE {_PLAN} SELECT site, run_id, rule, CAST(n AS INTEGER) AS position, CAST(week AS INTEGER) AS week, strftime(DATE '2026-01-05' + CAST((week - 1) * 7 AS INTEGER), '%Y-%m-%d') AS week_start FROM pl")
def build_plan(spark, sf):
    return _plan(spark, sf).select("site", "run_id", "rule", "position", "week", "week_start")


@query("plan_stages", f"WITH RECURSIVE {_PLAN} SELECT site, run_id, stage, count(*) AS items, CAST(sum(p) AS BIGINT) AS points, CAST(min(week) AS INTEGER) AS first_week, CAST(max(week) AS INTEGER) AS last_week, bool_or(severity IN ('Critical', 'High')) AS blocking FROM pl GROUP BY ALL")
def plan_stages(spark, sf):
    return P.plan_stages(_plan(spark, sf), ["site", "run_id"])


_LOAD = f"""{RUNS}, o AS (SELECT CASE WHEN rule = '5-LOW' THEN NULL ELSE 'person-' || substr(rule, 1, 1) END AS person, {_PTS} AS p FROM rf),
ld AS (SELECT person, CAST(sum(p) AS BIGINT) AS points, count(*) AS items FROM o GROUP BY person)"""


def _people(spark, sf):
    return A.table(spark, sf, "region").select(
        F.concat(F.lit("person-"), (F.col("r_regionkey") + 1).cast("string")).alias("person"), (F.col("r_regionkey") * 10).alias("capacity"),
        F.when(F.col("r_regionkey") % 2 == 0, "dev").otherwise("content").alias("role"))


@query("workload", f"""WITH {_LOAD} SELECT p.person, coalesce(points, 0) AS points, coalesce(items, 0) AS items FROM (SELECT 'person-' || (r_regionkey + 1) AS person FROM region) p LEFT JOIN ld ON ld.person = p.person
  UNION ALL SELECT '', points, items FROM ld WHERE person IS NULL""")
def workload(spark, sf):
    f = A.run_findings(spark, sf)
    assigned = f.select("rule").distinct().filter("rule <> '5-LOW'").withColumn(
        "person", F.concat(F.lit("person-"), F.substring("rule", 1, 1)))
    return P.workload(f, assigned, _people(spark, sf)).select(F.coalesce("person", F.lit("")).alias("person"), "points", "items")


@query("suggest_assignee", f"WITH {RUNS} SELECT site, run_id, rule, CASE owner WHEN 'dev' THEN 'person-1' ELSE 'person-2' END AS person FROM rf")
def suggest_assignee(spark, sf):
    return P.suggest_assignee(A.run_findings(spark, sf), _people(spark, sf)).select("site", "run_id", "rule", "person")


_TPL = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(label || ' ' || intent), {rx(p)})" + (f" OR intent = '{i}'" if i else "") + f" THEN '{t}'"
    for t, p, i in V.CLUSTER_TEMPLATES) + " ELSE 'article' END"
_SLUG = "regexp_replace(regexp_replace(replace(lower(trim(label)), '&', 'and'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


@query("cluster_url_plan", f"""WITH {CLUSTERS}, c AS (SELECT label, {_TPL} AS template, greatest(1, pages) AS n, {_SLUG} AS slug FROM dc),
  b AS (SELECT *, CASE template WHEN 'location' THEN 'locations' WHEN 'article' THEN 'guides' ELSE '' END AS base FROM c),
  r AS (SELECT *, 'https://example.com' || CASE WHEN base = '' THEN '' ELSE '/' || base END || '/' || slug || '/' AS root FROM b)
  SELECT CASE WHEN i = 0 THEN root ELSE root || 'subtopic-' || i || '/' END AS url, template, CASE WHEN i > 0 THEN 'spoke' WHEN n > 1 THEN 'pillar' ELSE 'standalone' END AS role,
  CAST((CASE WHEN base = '' THEN 1 ELSE 2 END) + (CASE WHEN i > 0 THEN 1 ELSE 0 END) AS INTEGER) AS depth FROM r, LATERAL (SELECT unnest(range(0, n)) AS i)
  UNION ALL SELECT 'https://example.com/' || base || '/', template || '-index', 'section', 1 FROM b WHERE base <> '' GROUP BY template, base HAVING count(*) > 1""")
def cluster_url_plan(spark, sf):
    return P.cluster_url_plan(A.demand_clusters(spark, sf)).select("url", "template", "role", "depth")


@query("production_order", f"""WITH {CLUSTERS}, s AS (SELECT site, label, CASE WHEN pages = 0 THEN 1 ELSE pages END AS pages, winnability * 3 + value * 2 - difficulty AS score FROM dc),
  w AS (SELECT *, CAST(ceil(pages / 2.0) AS BIGINT) AS weeks FROM s)
  SELECT site, label, CAST(score AS BIGINT) AS score, CAST(sum(weeks) OVER (PARTITION BY site ORDER BY score DESC, label ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_week FROM w""")
def production_order(spark, sf):
    return P.production_order(A.demand_clusters(spark, sf), by=["site"]).select("site", "label", F.col("score").cast("bigint").alias("score"), "end_week")


# --- result pages --------------------------------------------------------------------------------

_KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower(path), {rx(p)}) THEN '{k}'" for k, p in V.PATH_KINDS) + " " + " ".join(
    f"WHEN regexp_matches(title || ' ' || url, {rx(p)}) THEN '{k}'" for k, p in V.RESULT_KINDS) + " ELSE 'other' END"
_SERP = f"""s0 AS (SELECT 'q' || l_orderkey AS query, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS position,
  CASE l_linenumber % 3 WHEN 0 THEN '/blog/' WHEN 1 THEN '/shop/' ELSE '/x/' END || l_partkey AS path,
  'https://r' || l_suppkey || '.example.com' AS host, CASE WHEN l_partkey % 2 = 0 THEN 'How to choose' ELSE 'Some page' END AS title FROM lineitem),
s1 AS (SELECT *, host || path AS url FROM s0), s2 AS (SELECT *, {_KIND} AS kind FROM s1)"""


def serp_results(spark, sf):
    from pyspark.sql import Window as W
    li = A.table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    path = F.concat(F.when(n % 3 == 0, "/blog/").when(n % 3 == 1, "/shop/").otherwise("/x/"), F.col("l_partkey").cast("string"))
    return li.select(F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("query"), F.row_number().over(w).alias("position"),
                     F.concat(F.lit("https://r"), F.col("l_suppkey").cast("string"), F.lit(".example.com"), path).alias("url"),
                     F.when(F.col("l_partkey") % 2 == 0, "How to choose").otherwise("Some page").alias("title"))


@query("classify_results", f"WITH {_SERP} SELECT kind, count(*) AS n FROM s2 GROUP BY kind")
def classify_results(spark, sf):
    r = serp_results(spark, sf)
    return r.groupBy(Q.classify_result(F.col("title"), F.col("url")).alias("kind")).agg(F.count("*").alias("n"))


@query("judge_intent", f"""WITH {_SERP}, k AS (SELECT query, kind, count(*) AS n, min(position) AS f FROM s2 WHERE position <= 10 GROUP BY ALL),
  d AS (SELECT query, arg_min(kind, (-n, f)) AS dominant, max(n) AS top, sum(n) AS n FROM k GROUP BY query),
  own AS (SELECT query, min(position) AS p FROM s2 WHERE host = 'https://r7.example.com' GROUP BY query)
  SELECT d.query, dominant, {pct('top', 'd.n')} AS share, {pct('top', 'd.n')} < 50 AS mixed, dominant = 'product' AS match,
  CASE WHEN {pct('top', 'd.n')} >= 50 AND dominant <> 'product' THEN 'High' ELSE '' END AS severity, coalesce(own.p, -1) AS own_position FROM d LEFT JOIN own ON own.query = d.query""")
def judge_intent(spark, sf):
    r = serp_results(spark, sf)
    targets = r.select("query").distinct().select("query", F.lit("https://www.r7.example.com/shop/target").alias("url"), F.lit("Buy").alias("title"))
    return Q.judge_intent(r, targets).select("query", "dominant", "share", "mixed", "match", F.coalesce("severity", F.lit("")).alias("severity"),
                                             F.coalesce("own_position", F.lit(-1)).alias("own_position"))


@query("rank_position", f"WITH {_SERP} SELECT query, bool_or(host = 'https://r7.example.com') AS found, coalesce(min(position) FILTER (WHERE host = 'https://r7.example.com'), -1) AS position FROM s2 GROUP BY query")
def rank_position(spark, sf):
    return Q.rank_position(serp_results(spark, sf), "https://www.r7.example.com/").select("query", "found", F.coalesce("position", F.lit(-1)).alias("position"))


@query("serp_feature_notes", """SELECT o_custkey AS k, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey""")
def serp_feature_notes(spark, sf):
    f = A.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("query"), F.element_at(F.array(
        F.lit("local"), F.lit("featured"), F.lit("paa"), F.lit("video"), F.lit("images")), F.substring("o_orderpriority", 1, 1).cast("int")).alias("feature"))
    return Q.serp_feature_notes(f).select(F.col("query").cast("bigint").alias("k"), F.size(F.split("features", ", ")).cast("bigint").alias("n"))


@query("serp_page_kinds", "SELECT 'other' AS kind, count(*) * 3 AS n FROM part")
def serp_page_kinds(spark, sf):
    r = SD.read_serp_pages(serp_pages(spark, sf))
    return r.groupBy(Q.classify_result(F.col("title"), F.col("url")).alias("kind")).agg(F.count("*").alias("n"))


# --- behaviour and speed ------------------------------------------------------------------------

@query("friction_signals", """SELECT 'site' || (user_id % 3) AS site, 'Dead Click Count' AS metric, 'High' AS severity, CAST(sum(event_id % 1500) AS DOUBLE) AS total,
  round(sum(event_id % 1500)::DOUBLE / sum(user_id) * 1000, 1) AS per_1000 FROM events GROUP BY ALL""")
def friction_signals(spark, sf):
    return R.friction_signals(SD.behaviour_rows(behaviour_docs(spark, sf)), ["site"]).drop("label")


@query("traffic_summary", f"SELECT 'site' || (user_id % 3) AS site, CAST(sum(user_id) AS DOUBLE) AS sessions, CAST(count(*) AS DOUBLE) AS bot_sessions, {pct('count(*)', '(sum(user_id) + count(*))')} AS bot_share FROM events GROUP BY ALL")
def traffic_summary(spark, sf):
    return R.traffic_summary(SD.behaviour_rows(behaviour_docs(spark, sf)), ["site"])


@query("field_trend", """SELECT 'https://c' || c_custkey AS site, 2000.0::DOUBLE + c_custkey % 900 AS first, 2000.0::DOUBLE + c_custkey % 2500 AS latest,
  CAST(floor(((2000.0::DOUBLE + c_custkey % 2500) - (2000.0::DOUBLE + c_custkey % 900)) / (2000.0::DOUBLE + c_custkey % 900) * 100 + 0.5::DOUBLE) AS BIGINT) AS change,
  CASE WHEN 2000 + c_custkey % 2500 <= 2500 THEN 'GOOD' WHEN 2000 + c_custkey % 2500 <= 4000 THEN 'NEEDS_IMPROVEMENT' ELSE 'POOR' END AS rating FROM customer""")
def field_trend(spark, sf):
    return R.field_trend(SD.field_rows(field_docs(spark, sf))).select("site", "first", "latest", "change", "rating")


@query("field_rating", """SELECT c_custkey AS k, (c_custkey * 13) % 5000 <= 2500 AS good, CASE WHEN (c_custkey * 13) % 5000 <= 2500 THEN 'GOOD' WHEN (c_custkey * 13) % 5000 <= 4000 THEN 'NEEDS_IMPROVEMENT' ELSE 'POOR' END AS rating FROM customer""")
def field_rating(spark, sf):
    c = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("LARGEST_CONTENTFUL_PAINT_MS").alias("metric"),
                                              ((F.col("c_custkey") * 13) % 5000).cast("double").alias("p75"))
    return R.field_rating(c).select("k", "good", "rating")


@query("lab_series", "SELECT 'u' || (o_custkey % 100) AS url, count(*) AS runs, count(*) AS points FROM orders GROUP BY ALL")
def lab_series(spark, sf):
    o = A.table(spark, sf, "orders").select(
        F.concat(F.lit("u"), (F.col("o_custkey") % 100).cast("string")).alias("url"), F.col("o_orderdate").alias("at"),
        F.col("o_totalprice").alias("performance"), F.lit("1 s").alias("lcp"), F.lit("0").alias("cls"), F.lit("0 ms").alias("tbt"))
    return R.lab_series(o).select("url", "runs", F.size("points").cast("bigint").alias("points"))


@query("validate_structured_data", """WITH k AS (SELECT p_partkey AS k FROM part) SELECT k, 'Product' AS type, 'offers' AS property FROM k WHERE k % 4 = 0 AND k % 3 <> 0 UNION ALL SELECT k, 'Event', 'startDate' FROM k WHERE k % 4 = 1
  UNION ALL SELECT k, 'Event', 'location.address' FROM k WHERE k % 4 = 1 UNION ALL SELECT k, 'FAQPage', 'mainEntity' FROM k WHERE k % 4 = 2 UNION ALL SELECT k, 'Article', 'author' FROM k WHERE k % 4 = 3
  UNION ALL SELECT k, 'Article', 'dateModified' FROM k WHERE k % 4 = 3""")
def validate_structured_data(spark, sf):
    from ..operators import artefacts as O
    k = F.col("p_partkey")
    doc = F.when(k % 4 == 0, F.when(k % 3 == 0, '{"@type":"Product","name":"x","offers":{"price":"1"}}').otherwise('{"@type":"Product","name":"x"}')).when(
        k % 4 == 1, '{"@type":"Event","name":"x","location":{"@type":"Place","name":"hall"}}').when(
        k % 4 == 2, '{"@type":"FAQPage","mainEntity":[{"@type":"Question"}]}').otherwise('{"@type":"Article","headline":"x"}')
    rows = A.table(spark, sf, "part").select(F.lit("r").alias("run_id"), F.lit("s").alias("site"), k.cast("string").alias("url"),
                                             F.lit(0).alias("block"), doc.alias("json")).withColumn("body", F.try_parse_json("json"))
    return O.validate_structured_data(rows).select(F.col("url").cast("bigint").alias("k"), "type", "property")


@query("order_findings", f"WITH {RUNS} SELECT site, run_id, rule, severity FROM rf")
def order_findings(spark, sf):
    return D.order_findings(A.run_findings(spark, sf)).select("site", "run_id", "rule", "severity")
