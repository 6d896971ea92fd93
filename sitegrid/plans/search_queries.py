"""Queries over search performance and demand."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import demand as I
from ..operators import search as H
from ..sources import search_exports as SE
from . import adapters as A
from .registry import query
from .sql import CLUSTERS, DAILY, PERF, SUGGEST, intent_case, rx


@query("search_totals", f"WITH {PERF} SELECT page, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, count(*) AS rows FROM perf GROUP BY page")
def search_totals(spark, sf):
    return H.search_totals(A.search_perf(spark, sf), ["page"]).drop("position")


@query("striking_distance", f"WITH {PERF} SELECT query, page, impressions, position, position <= 10 AS page_one FROM perf WHERE position BETWEEN 4 AND 20 AND impressions >= 30")
def striking_distance(spark, sf):
    return H.striking_distance(A.search_perf(spark, sf)).select("query", "page", "impressions", "position", "page_one")


_OPP = "CAST(floor(impressions * (0.10::DOUBLE - ctr) + 0.5::DOUBLE) AS BIGINT)"


@query("striking_distance_api", f"WITH {PERF} SELECT query, page, impressions, position, {_OPP} AS opportunity FROM perf WHERE position BETWEEN 5 AND 20 AND impressions >= 30 AND {_OPP} > 0")
def striking_distance_api(spark, sf):
    return H.striking_distance(A.search_perf(spark, sf), "api").select("query", "page", "impressions", "position", "opportunity")


@query("striking_top", f"""WITH {PERF} SELECT query, page, impressions, CAST(row_number() OVER (ORDER BY impressions DESC, query, page) AS INTEGER) AS rank FROM perf
  WHERE position BETWEEN 4 AND 20 AND impressions >= 30 ORDER BY rank LIMIT 40""")
def striking_top(spark, sf):
    return H.striking_distance(A.search_perf(spark, sf), k=40).select("query", "page", "impressions", "rank")


def _curve(curve):
    return "CASE CAST(floor(position + 0.5) AS INTEGER) " + " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in curve.items()) + " ELSE 0.02::DOUBLE END"


@query("ctr_gaps", f"""WITH {PERF}, e AS (SELECT *, {_curve(V.CTR_CURVE_EXPORT)} AS expected FROM perf WHERE impressions >= 100 AND position BETWEEN 1 AND 10),
  g AS (SELECT *, CAST(round((ctr - expected) / expected * 100) AS INTEGER) AS gap FROM e) SELECT query, page, gap FROM g WHERE gap <= -35""")
def ctr_gaps(spark, sf):
    return H.ctr_gaps(A.search_perf(spark, sf)).select("query", "page", "gap")


@query("ctr_gaps_api", f"""WITH {PERF}, e AS (SELECT *, {_curve(V.CTR_CURVE_API)} AS expected FROM perf WHERE impressions >= 100 AND position <= 10.5)
  SELECT query, page, CAST(floor(impressions * (expected - ctr) + 0.5::DOUBLE) AS BIGINT) AS missed_clicks FROM e
  WHERE floor((expected - ctr) * 100 * 10 + 0.5::DOUBLE) / 10 > 1.5::DOUBLE""")
def ctr_gaps_api(spark, sf):
    return H.ctr_gaps(A.search_perf(spark, sf), "api").select("query", "page", "missed_clicks")


_WIDE = PERF.replace("/ 4.0", "/ 40.0")


def _wide(spark, sf):
    """Fewer pages, so that pages compete on a query."""
    p = A.search_perf(spark, sf).withColumn("page", F.concat(F.lit("/p/"), F.floor(
        F.substring_index("page", "/", -1).cast("int") / 10).cast("string")))
    per = p.groupBy("query", "page").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
                                         F.min("position").alias("position"))
    return per.withColumn("ctr", F.col("clicks") / F.col("impressions"))


_WIDE = f"""{PERF}, wd AS (SELECT query, '/p/' || CAST(floor(CAST(split_part(page, '/', 3) AS INTEGER) / 10.0) AS BIGINT) AS page, CAST(sum(clicks) AS BIGINT) AS clicks,
  CAST(sum(impressions) AS BIGINT) AS impressions, min(position) AS position FROM perf GROUP BY ALL)"""


@query("cannibalisation", f"""WITH {_WIDE}, t AS (SELECT *, sum(impressions) OVER (PARTITION BY query) AS total, count(*) OVER (PARTITION BY query) AS n FROM wd),
  s AS (SELECT *, count(*) OVER (PARTITION BY query) AS competing FROM t WHERE total >= 60 AND n >= 2 AND impressions::DOUBLE / total::DOUBLE > 0.15::DOUBLE)
  SELECT query, page, CAST(total AS BIGINT) AS total_impressions, competing, CAST(floor(impressions::DOUBLE / total::DOUBLE * 100 + 0.5::DOUBLE) AS BIGINT) AS share FROM s WHERE competing >= 2""")
def cannibalisation(spark, sf):
    return H.cannibalisation(_wide(spark, sf)).select("query", "page", "total_impressions", "competing", "share")


@query("cannibalisation_api", f"""WITH {_WIDE}, t AS (SELECT *, sum(impressions) OVER (PARTITION BY query) AS total, count(*) OVER (PARTITION BY query) AS n,
  row_number() OVER (PARTITION BY query ORDER BY impressions DESC, page) AS r FROM wd),
  l AS (SELECT query, max(impressions) FILTER (WHERE r = 1) AS a, max(impressions) FILTER (WHERE r = 2) AS b FROM t GROUP BY query)
  SELECT query, page, CAST(r AS INTEGER) AS rank, CASE WHEN n > 2 OR b::DOUBLE / a > 0.6::DOUBLE THEN 'High' ELSE 'Medium' END AS severity
  FROM t JOIN l USING (query) WHERE total >= 50 AND n >= 2 AND b::DOUBLE / a > 0.2::DOUBLE AND r <= 5""")
def cannibalisation_api(spark, sf):
    return H.cannibalisation(_wide(spark, sf), "api").select("query", "page", "rank", "severity")


_CHG = "CASE WHEN {b} <> 0 THEN floor(({a} - {b})::DOUBLE / {b} * 100 * 10 + 0.5::DOUBLE) / 10 ELSE 0.0 END"


@query("traffic_triage", f"""WITH {DAILY}, s AS (SELECT site, CAST(coalesce(sum(clicks) FILTER (WHERE date BETWEEN DATE '2024-01-16' AND DATE '2024-01-30'), 0) AS BIGINT) AS cn,
  CAST(coalesce(sum(clicks) FILTER (WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-15'), 0) AS BIGINT) AS cb,
  CAST(coalesce(sum(impressions) FILTER (WHERE date BETWEEN DATE '2024-01-16' AND DATE '2024-01-30'), 0) AS BIGINT) AS im,
  CAST(coalesce(sum(impressions) FILTER (WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-15'), 0) AS BIGINT) AS ib FROM daily GROUP BY site),
  c AS (SELECT *, {_CHG.format(a='cn', b='cb')} AS cc, {_CHG.format(a='im', b='ib')} AS ic FROM s)
  SELECT site, cn AS clicks_now, cb AS clicks_before, im AS impr_now, ib AS impr_before, cc AS click_change, ic AS impr_change,
  CASE WHEN abs(0.0 - cc) < 10 THEN 'likely' ELSE 'unlikely' END AS seasonality, CASE WHEN ic > -8 AND cc < -15 THEN 'likely' ELSE 'unlikely' END AS layout_change FROM c""")
def traffic_triage(spark, sf):
    t = H.traffic_triage(A.daily_perf(spark, sf), ("2024-01-16", "2024-01-30"), ("2024-01-01", "2024-01-15"), ["site"])
    return t.drop("pos_now", "pos_before", "yoy_change")


@query("period_deltas", f"""WITH a AS (SELECT l_partkey AS key, CAST(sum(l_linenumber) AS BIGINT) AS c FROM lineitem WHERE year(l_shipdate) = 1998 GROUP BY ALL),
  b AS (SELECT l_partkey AS key, CAST(sum(l_linenumber) AS BIGINT) AS c FROM lineitem WHERE year(l_shipdate) = 1999 GROUP BY ALL)
  SELECT coalesce(a.key, b.key) AS key, coalesce(a.c, 0) AS clicks_before, coalesce(b.c, 0) AS clicks_after, coalesce(b.c, 0) - coalesce(a.c, 0) AS delta FROM a FULL JOIN b ON a.key = b.key""")
def period_deltas(spark, sf):
    li = A.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("page"), F.col("l_linenumber").cast("bigint").alias("clicks"),
        F.col("l_quantity").cast("bigint").alias("impressions"), F.lit(1.0).alias("position"), "l_shipdate")
    return H.period_deltas(li.filter(F.year("l_shipdate") == 1998), li.filter(F.year("l_shipdate") == 1999), "page").select(
        "key", "clicks_before", "clicks_after", "delta")


@query("landing_clusters", f"""WITH {PERF}, r AS (SELECT * FROM perf WHERE impressions >= 10) SELECT page, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions,
  count(*) AS query_count, arg_min(query, (-impressions, query)) AS primary_query, count(*) AS listed, string_agg(query, ',' ORDER BY impressions DESC, query) AS names FROM r GROUP BY page""")
def landing_clusters(spark, sf):
    c = H.cluster_by_landing_page(A.search_perf(spark, sf))
    return c.select("page", "clicks", "impressions", "query_count", "primary_query", F.size("queries").cast("bigint").alias("listed"),
                    F.array_join(F.transform("queries", lambda q: q["query"]), ",").alias("names"))


@query("trend_read", f"""WITH {DAILY}, p AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY date) AS rn, count(*) OVER (PARTITION BY site) AS n FROM daily),
  h AS (SELECT site, count(*) AS points, CAST(sum(clicks) AS BIGINT) AS clicks, sum(clicks) FILTER (WHERE rn <= floor(n / 2)) AS ca, sum(clicks) FILTER (WHERE rn > floor(n / 2)) AS cb,
  sum(impressions) FILTER (WHERE rn <= floor(n / 2)) AS ia, sum(impressions) FILTER (WHERE rn > floor(n / 2)) AS ib,
  round(avg(position) FILTER (WHERE rn > floor(n / 2)) - avg(position) FILTER (WHERE rn <= floor(n / 2)), 1) AS pos FROM p GROUP BY site),
  c AS (SELECT *, CAST(floor((cb - ca)::DOUBLE / ca * 100 + 0.5::DOUBLE) AS BIGINT) AS cc, CAST(floor((ib - ia)::DOUBLE / ia * 100 + 0.5::DOUBLE) AS BIGINT) AS ic FROM h)
  SELECT site, points, clicks, cc AS clicks_change, ic AS impr_change, CASE WHEN points < 14 THEN NULL WHEN cc <= -15 AND abs(ic) < 10 THEN 'ctr'
  WHEN cc <= -15 AND ic <= -15 AND pos > 1 THEN 'ranking' WHEN cc <= -15 AND ic <= -15 AND abs(pos) <= 1 THEN 'demand' WHEN cc >= 15 THEN 'up' ELSE 'flat' END AS reading FROM c""")
def trend_read(spark, sf):
    return H.trend_read(A.daily_perf(spark, sf), ["site"]).select("site", "points", "clicks", "clicks_change", "impr_change", "reading")


@query("triage_steps", f"""WITH {DAILY} SELECT DISTINCT site, unnest(['tracking','seasonality','layout_change','core_update','manual_action','regression','competitors']) AS step FROM daily""")
def triage_steps(spark, sf):
    t = H.traffic_triage(A.daily_perf(spark, sf), ("2024-01-16", "2024-01-30"), ("2024-01-01", "2024-01-15"), ["site"])
    return H.triage_steps(t, ["site"]).select("site", "step")


@query("index_status", """SELECT 'u' || o_orderkey AS url, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 2 = 0 END AS canonical_match FROM orders""")
def index_status(spark, sf):
    o = A.table(spark, sf, "orders")
    k = F.col("o_custkey")
    rows = o.select(F.lit("r1").alias("run_id"), F.lit("s").alias("site"), F.concat(F.lit("u"), "o_orderkey").alias("url"),
                    *[F.lit("x").alias(c) for c in ("verdict", "coverage_state", "robots_state", "indexing_state",
                                                    "fetch_state", "last_crawl_time")],
                    F.when(k % 3 != 0, F.lit("a")).alias("google_canonical"),
                    F.when(k % 2 == 0, F.lit("a")).otherwise("b").alias("user_canonical"))
    return H.index_status(rows).select("url", "canonical_match")


@query("sitemap_coverage", "SELECT 'sitemap-' || s_suppkey AS path, CAST(floor(s_nationkey * 100.0::DOUBLE / 25 + 0.5::DOUBLE) AS BIGINT) AS coverage FROM supplier")
def sitemap_coverage(spark, sf):
    s = A.table(spark, sf, "supplier").select(
        F.lit("r1").alias("run_id"), F.lit("s").alias("site"), F.concat(F.lit("sitemap-"), "s_suppkey").alias("path"),
        F.lit(0).alias("errors"), F.lit(0).alias("warnings"), F.lit(25).alias("submitted"), F.col("s_nationkey").alias("indexed"))
    return H.sitemap_coverage(s).select("path", "coverage")


@query("search_export_numbers", """SELECT 'k' || l_orderkey || '-' || l_linenumber AS key, CAST(l_quantity AS BIGINT) + 1000 AS clicks,
  (CAST(l_quantity AS BIGINT) + 1000) * 10 AS impressions, round(l_linenumber / 100.0::DOUBLE, 6) AS ctr, l_linenumber + 0.5::DOUBLE AS position FROM lineitem""")
def search_export_numbers(spark, sf):
    """Rows of an export as text, thousands separators and decimal commas included."""
    li = A.table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("bigint") + 1000
    n = F.col("l_linenumber")
    text = li.select(
        F.concat(F.lit("k"), "l_orderkey", F.lit("-"), n.cast("string")).alias("Requêtes les plus fréquentes"),
        F.format_number(q, 0).alias("Clics"), F.format_number(q * 10, 0).alias("Impressions"),
        F.concat(n.cast("string"), F.lit(",00%")).alias("CTR"), F.concat(n.cast("string"), F.lit(",5")).alias("Position"))
    return SE.typed_rows(text).select("key", "clicks", "impressions", F.round("ctr", 6).alias("ctr"), "position")


# --- demand -----------------------------------------------------------------------------------

_Q = "^(" + "|".join(V.QUESTION_WORDS) + ") "


@query("keyword_probes", """SELECT DISTINCT lower(p_brand) AS seed, n, CASE WHEN n = 0 THEN lower(p_brand) ELSE NULL END AS own FROM part, (SELECT unnest(range(0, 52)) AS n)""")
def keyword_probes(spark, sf):
    seeds = A.suggestions(spark, sf).select("seed").distinct()
    p = I.keyword_probes(seeds)
    return p.select("seed", F.col("n").cast("bigint").alias("n"), F.when(F.col("n") == 0, F.col("probe")).alias("own"))


@query("keyword_breadth", f"""WITH {SUGGEST} SELECT seed, trim(lower(suggestion)) AS keyword, count(*) AS breadth, least(min(rank), 99) AS best_rank,
  {intent_case('trim(lower(suggestion))')} AS intent, regexp_matches(trim(lower(suggestion)), '{_Q}') AS is_question,
  CAST(len(regexp_split_to_array(trim(lower(suggestion)), '\\s+')) AS INTEGER) AS words FROM sg GROUP BY seed, trim(lower(suggestion))""")
def keyword_breadth(spark, sf):
    return I.keyword_breadth(A.suggestions(spark, sf))


@query("question_set", f"WITH {SUGGEST} SELECT DISTINCT seed, lower(suggestion) AS question FROM sg WHERE regexp_matches(lower(suggestion), '{_Q}')")
def question_set(spark, sf):
    return I.question_set(A.suggestions(spark, sf))


@query("intent_counts", f"WITH {SUGGEST} SELECT {intent_case('suggestion')} AS intent, count(*) AS n FROM sg GROUP BY ALL")
def intent_counts(spark, sf):
    return A.suggestions(spark, sf).groupBy(I.classify_intent(F.col("suggestion")).alias("intent")).agg(F.count("*").alias("n"))


@query("topic_intents", f"""WITH {SUGGEST} SELECT suggestion, CASE {' '.join(f"WHEN regexp_matches(lower(suggestion), {rx(p)}) THEN '{i}'" for i, p in V.TOPIC_INTENTS)} ELSE 'informational' END AS intent FROM sg""")
def topic_intents(spark, sf):
    return A.suggestions(spark, sf).select("suggestion", I.classify_topic(F.col("suggestion")).alias("intent"))


_TOK = "list_filter(list_transform(regexp_split_to_array(keyword, '\\s+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: length(w) > 2 AND NOT list_contains([" + ",".join(f"'{w}'" for w in V.KEYWORD_STOP) + "], w))"


@query("keyword_tokens", f"WITH {SUGGEST}, k AS (SELECT lower(suggestion) AS keyword FROM sg) SELECT keyword, array_to_string({_TOK}, ' ') AS tokens FROM k")
def keyword_tokens(spark, sf):
    k = A.suggestions(spark, sf).select(F.lower("suggestion").alias("keyword"))
    return k.select("keyword", F.array_join(I.keyword_tokens(F.col("keyword")), " ").alias("tokens"))


@query("cluster_keywords")
def cluster_keywords(spark, sf):
    return I.cluster_keywords(I.keyword_breadth(A.suggestions(spark, sf)))


@query("cluster_keywords_graph", f"""WITH RECURSIVE {SUGGEST}, kw AS (SELECT DISTINCT seed, trim(lower(suggestion)) AS keyword FROM sg),
  t AS (SELECT seed, keyword, list_distinct({_TOK}) AS t FROM kw),
  e AS (SELECT a.seed, a.keyword AS x, b.keyword AS y FROM t a JOIN t b ON a.seed = b.seed WHERE len(a.t) > 0 AND len(b.t) > 0
    AND (len(list_intersect(a.t, b.t)) * 2 >= len(a.t) OR len(list_intersect(a.t, b.t)) * 2 >= len(b.t))),
  r AS (SELECT seed, keyword AS x, keyword AS y FROM kw UNION SELECT r.seed, r.x, e.y FROM r JOIN e ON e.seed = r.seed AND e.x = r.y),
  c AS (SELECT seed, x, min(y) AS head FROM r GROUP BY ALL) SELECT seed, head, count(*) AS size FROM c GROUP BY ALL""")
def cluster_keywords_graph(spark, sf):
    m = I.cluster_keywords_graph(I.keyword_breadth(A.suggestions(spark, sf)))
    return m.groupBy("seed", "cluster").agg(F.min("keyword").alias("head"), F.count("*").alias("size")).drop("cluster")


@query("keyword_url_map")
def keyword_url_map(spark, sf):
    kw = I.keyword_breadth(A.suggestions(spark, sf))
    members = I.cluster_members(kw)
    terms = I.cluster_terms(members, I.summarise_clusters(members))
    docs = A.table(spark, sf, "part").select(
        F.concat(F.lit("https://example.com/"), F.col("p_partkey").cast("string")).alias("url"),
        F.col("p_name").alias("title"), F.array().cast("array<string>").alias("h1s"),
        F.array().cast("array<struct<level:int,text:string>>").alias("headings"), F.lower("p_type").alias("body_text"),
        F.lit(200).alias("status"), F.lit(False).alias("noindex"))
    return I.keyword_url_map(terms, docs)


_BG = """bg AS (SELECT lang, w[i] || ' ' || w[i + 1] AS topic FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM
  (SELECT lang, string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') AS w FROM documents)) WHERE length(w[i]) >= 4 AND length(w[i + 1]) >= 4)"""


@query("topic_gap", f"""WITH {_BG} SELECT topic, count(*) AS their_pages FROM bg WHERE lang = 'en' AND topic NOT IN (SELECT topic FROM bg WHERE lang <> 'en')
  GROUP BY topic HAVING count(*) >= 2""")
def topic_gap(spark, sf):
    d = A.table(spark, sf, "documents")
    return I.topic_gap(d.filter(F.col("lang") != "en"), d.filter(F.col("lang") == "en"), k=None)
