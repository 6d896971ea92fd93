"""Queries over links, robots rules, sitemaps, redirects and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..operators import artefacts as O
from ..operators import audit as D
from ..operators import dedupe
from ..operators import links as L
from ..sources import robots as SR
from ..sources import sinks
from . import adapters as A
from .registry import query
from .sql import GRAPH, families, rx, text_of


@query("inbound_links", f"""WITH {GRAPH} SELECT site, resolved AS url, count(*) AS inbound_count, count(*) FILTER (WHERE NOT in_nav AND NOT in_footer) AS inbound_body_count,
  count(DISTINCT from_url) AS inbound_distinct FROM gl GROUP BY ALL""")
def inbound_links(spark, sf):
    return L.inbound_counts(A.graph_links(spark, sf)).drop("run_id", "inbound_others")


@query("external_links", f"""WITH {GRAPH}, x AS (SELECT site, 'https://out' || (pos % 50) || '.example.org/a' AS url, from_url, pos, anchor, nofollow FROM gl)
  SELECT site, url, regexp_extract(url, '^https://([^/]+)', 1) AS host, count(*) AS n, arg_min(nofollow, (from_url, pos)) AS nofollow, least(3, count(*)) AS n_anchors FROM x GROUP BY ALL""".replace("regexp_extract(url, '^https://([^/]+)', 1) AS host", "max(regexp_extract(url, '^https://([^/]+)', 1)) AS host").replace("GROUP BY ALL", "GROUP BY site, url"))
def external_links(spark, sf):
    off = A.graph_links(spark, sf).withColumn("resolved", F.concat(
        F.lit("https://out"), (F.col("pos") % 50).cast("string"), F.lit(".example.org/a")))
    return L.external_links(off).select("site", "url", "host", "n", "nofollow", F.size("anchors").cast("bigint").alias("n_anchors"))


@query("link_graph_report", f"""WITH {GRAPH}, i AS (SELECT site, resolved AS url, count(*) AS n, count(*) FILTER (WHERE NOT in_nav AND NOT in_footer) AS b, count(DISTINCT anchor) AS a FROM gl GROUP BY ALL),
  o AS (SELECT site, from_url AS url, count(*) AS n FROM gl GROUP BY ALL) SELECT gp.site, gp.url, title, depth, coalesce(i.n, 0) AS inbound, coalesce(i.b, 0) AS inbound_body,
  coalesce(o.n, 0) AS outbound, least(6, coalesce(i.a, 0)) AS n_anchors FROM gp LEFT JOIN i ON i.url = gp.url AND i.site = gp.site LEFT JOIN o ON o.url = gp.url AND o.site = gp.site
  WHERE status = 200 AND NOT noindex""")
def link_graph_report(spark, sf):
    r = L.link_graph_report(A.graph_pages(spark, sf), A.graph_links(spark, sf))
    return r.select("site", "url", "title", "depth", "inbound", "inbound_body", "outbound", F.size("anchors").cast("bigint").alias("n_anchors"))


_REACH = f"""WITH RECURSIVE {GRAPH}, e AS (SELECT DISTINCT site, from_url, resolved FROM gl),
reach AS (SELECT 's' || n || '.example.com' AS site, 'https://s' || n || '.example.com/p/0' AS url, 0 AS depth FROM (SELECT unnest([0, 1, 2]) AS n)
  UNION SELECT e.site, e.resolved, reach.depth + 1 FROM reach JOIN e ON e.site = reach.site AND e.from_url = reach.url),
r AS (SELECT site, url, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY ALL)"""


def _starts(spark, sf):
    return A.graph_pages(spark, sf).filter(F.col("url").endswith("/p/0"))


def _reach(spark, sf):
    return L.crawl_reach(A.graph_links(spark, sf), _starts(spark, sf))


def _graph_sitemap(spark, sf):
    return A.graph_pages(spark, sf).filter(F.col("p_size") < 25).select("run_id", "site", F.col("url").alias("loc"))


@query("crawl_reach", f"{_REACH} SELECT r.site, r.url, r.depth, CASE WHEN r.depth = 0 THEN '' ELSE (SELECT min(e.from_url) FROM e JOIN r q ON q.site = e.site AND q.url = e.from_url WHERE e.site = r.site AND e.resolved = r.url AND q.depth = r.depth - 1) END AS referrer FROM r")
def crawl_reach(spark, sf):
    return _reach(spark, sf).select("site", "url", "depth", F.coalesce("referrer", F.lit("")).alias("referrer"))


@query("reach_budget", f"{_REACH} SELECT site, least(count(*), 200) AS pages, count(*) >= 200 AS truncated, greatest(count(*) - 200, 0) AS queue_left FROM r GROUP BY site")
def reach_budget(spark, sf):
    return L.reach_budget(_reach(spark, sf), 200).drop("run_id")


@query("within_budget", f"{_REACH} SELECT site, url, depth FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY depth, url) AS n FROM r) WHERE n <= 200")
def within_budget(spark, sf):
    return L.within_budget(_reach(spark, sf), 200).select("site", "url", "depth")


@query("orphans", f"{_REACH} SELECT site, 'https://' || site || '/p/' || p_partkey AS loc FROM part, (SELECT DISTINCT site FROM gp) s WHERE p_size < 25 AND NOT EXISTS (SELECT 1 FROM r WHERE r.site = s.site AND r.url = 'https://' || s.site || '/p/' || p_partkey)")
def orphans(spark, sf):
    return L.orphans(_graph_sitemap(spark, sf), _reach(spark, sf)).drop("run_id")


@query("crawlable_links", f"""WITH {GRAPH}, x AS (SELECT site, from_url, resolved || (CASE pos % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '/feed/' WHEN 2 THEN '?a=1' ELSE '' END) AS resolved FROM gl)
  SELECT site, from_url, resolved FROM x WHERE NOT regexp_matches(resolved, {rx(V.ASSET_URL)}) AND NOT regexp_matches(resolved, {rx(V.FEED_URL)})""")
def crawlable_links(spark, sf):
    n = F.col("pos") % 5
    tail = F.when(n == 0, ".pdf").when(n == 1, "/feed/").when(n == 2, "?a=1").otherwise("")
    g = A.graph_links(spark, sf).withColumn("resolved", F.concat("resolved", tail))
    return L.crawlable_links(g).select("site", "from_url", "resolved")


@query("link_rules", f"""WITH {GRAPH}, f AS (SELECT * FROM gl WHERE from_url IN (SELECT url FROM gp WHERE status = 200)),
  h AS (SELECT site, 'internal-links-to-redirects' AS rule FROM f WHERE resolved IN (SELECT url FROM gp WHERE status = 301)
   UNION ALL SELECT site, 'generic-anchors' FROM f WHERE anchor = 'read more' AND NOT in_nav AND NOT in_footer
   UNION ALL SELECT site, 'links-to-noindex' FROM f WHERE NOT nofollow AND resolved IN (SELECT url FROM gp WHERE status = 200 AND noindex) GROUP BY site, from_url)
  SELECT site, rule, count(*) AS n FROM h GROUP BY ALL""")
def link_rules(spark, sf):
    p = A.graph_pages(spark, sf).withColumns({"hops": F.when(F.col("status") == 301, 1).otherwise(0),
                                              "x_robots_tag": F.lit(None).cast("string")})
    return D.link_hits(p, A.graph_links(spark, sf)).groupBy("site", "rule").agg(F.count("*").alias("n"))


@query("canonical_rules", f"""WITH {GRAPH}, c AS (SELECT site, url, status, noindex, 'https://' || site || '/p/' || (CAST(split_part(url, '/', 5) AS BIGINT) // 2) AS canonical FROM gp),
  x AS (SELECT * FROM c WHERE canonical <> url), j AS (SELECT x.*, t.status AS ts, t.noindex AS tn, t.canonical AS tc FROM x LEFT JOIN c t ON t.site = x.site AND t.url = x.canonical)
  SELECT site, 'canonical-cross' AS rule, count(*) AS n, count(*) FILTER (WHERE ts >= 300 OR tn) AS bad FROM j WHERE status = 200 AND NOT noindex GROUP BY site
  UNION ALL SELECT site, 'canonical-chain', count(*), 0 FROM j WHERE status = 200 AND ts = 200 AND tc <> canonical GROUP BY site""")
def canonical_rules(spark, sf):
    k = F.floor(F.substring_index("url", "/", -1).cast("bigint") / 2).cast("string")
    p = A.graph_pages(spark, sf).withColumn("canonical", F.concat(F.lit("https://"), "site", F.lit("/p/"), k))
    return D.canonical_hits(p).groupBy("site", "rule").agg(F.count("*").alias("n"), F.count_if("escalate").alias("bad"))


_LANG = "(['en', 'fr', 'de-DE', 'en-UK', 'e1', 'x-default'])[n % 6 + 1]"


@query("hreflang_rules", f"""WITH k AS (SELECT p_partkey AS n, 'https://h.example.com/p/' || p_partkey AS url FROM part),
  e AS (SELECT n, url, {_LANG} AS lang, 'https://h.example.com/p/' || (n // 3 * 3) AS href FROM k UNION ALL SELECT n, url, 'en', url FROM k WHERE n % 4 <> 0),
  h AS (SELECT 'hreflang-bad-code' AS rule, url FROM e WHERE lang IN ('en-UK', 'e1')
   UNION ALL SELECT 'hreflang-no-return', url FROM e WHERE href IN (SELECT url FROM k) AND NOT EXISTS (SELECT 1 FROM e b WHERE b.url = e.href AND b.href = e.url))
  SELECT rule, count(*) AS n FROM h GROUP BY rule""")
def hreflang_rules(spark, sf):
    n = F.col("p_partkey")
    base = F.lit("https://h.example.com/p/")
    url = F.concat(base, n.cast("string"))
    lang = F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de-DE", "en-UK", "e1", "x-default")]), (n % 6 + 1).cast("int"))
    pair = F.struct(lang.alias("lang"), F.concat(base, (F.floor(n / 3) * 3).cast("string")).alias("href"))
    own = F.struct(F.lit("en").alias("lang"), url.alias("href"))
    p = A.table(spark, sf, "part").select(
        F.lit("r1").alias("run_id"), F.lit("h.example.com").alias("site"), url.alias("url"), F.lit(200).alias("status"),
        F.lit("text/html").alias("content_type"), F.when(n % 4 != 0, F.array(pair, own)).otherwise(F.array(pair)).alias("hreflang"))
    return D.hreflang_hits(p).groupBy("rule").agg(F.count("*").alias("n"))


# --- robots and sitemaps ---------------------------------------------------------------------

_ROBOTS = """rb AS (SELECT 'site' || s_suppkey AS site, s_suppkey AS k FROM supplier)"""


def robots_docs(spark, sf):
    """One robots.txt per supplier."""
    k = F.col("s_suppkey").cast("string")
    body = F.concat(
        F.lit("# made for "), k, F.lit("\nUser-agent: *\nDisallow: /all/\nUser-agent: Googlebot\nUser-agent: other\n"
                                       "Disallow: /s"), k, F.lit("/\nAllow: /s"), k,
        F.lit("/open*\nDisallow: /*.php$\nCrawl-delay: 2\n\nSitemap: https://x.example.com/map"), k, F.lit(".xml\n"))
    return A.table(spark, sf, "supplier").select(
        F.lit("r1").alias("run_id"), F.concat(F.lit("site"), k).alias("site"), F.lit(200).alias("status"), body.alias("body"))


@query("read_robots", f"""WITH {_ROBOTS} SELECT site, 1 AS grp, '*' AS agent, 'disallow' AS type, '/all/' AS path FROM rb
  UNION ALL SELECT site, 2, a, t.type, t.path FROM rb, (SELECT unnest(['googlebot', 'other']) AS a) x,
   LATERAL (SELECT unnest(['disallow', 'allow', 'disallow']) AS type, unnest(['/s' || k || '/', '/s' || k || '/open*', '/*.php$']) AS path) t""")
def read_robots(spark, sf):
    rules, _ = SR.read_robots(robots_docs(spark, sf))
    return rules.select("site", F.col("grp").cast("int").alias("grp"), "agent", "type", "path")


@query("robots_sitemaps", f"WITH {_ROBOTS} SELECT site, 'https://x.example.com/map' || k || '.xml' AS sitemap FROM rb")
def robots_sitemaps(spark, sf):
    return SR.read_robots(robots_docs(spark, sf))[1].select("site", "sitemap")


_RP = """rp AS (SELECT 'site' || l_suppkey AS site, 'https://x.example.com/s' || (l_suppkey - l_linenumber % 2) ||
  (CASE l_linenumber % 4 WHEN 0 THEN '/open-' WHEN 1 THEN '/q-' WHEN 2 THEN '/closed-' ELSE '/open/a.php?x=' END) || l_orderkey ||
  (CASE WHEN l_linenumber = 6 THEN '.php' ELSE '' END) AS url, l_suppkey AS k FROM lineitem),
ru AS (SELECT site, url, regexp_extract(url, '^https?://[^/]+(.*)$', 1) AS p, k FROM rp),
rv AS (SELECT site, url, CASE WHEN starts_with(p, '/s' || k || '/open') THEN TRUE WHEN regexp_matches(p, '^/.*[.]php$') AND length('/*.php$') > (CASE WHEN starts_with(p, '/s' || k || '/') THEN length('/s' || k || '/') ELSE 0 END) THEN FALSE
  WHEN starts_with(p, '/s' || k || '/') THEN FALSE ELSE TRUE END AS allowed FROM ru)"""


def robots_pages(spark, sf):
    n = F.col("l_linenumber")
    k = F.col("l_suppkey")
    mid = F.when(n % 4 == 0, "/open-").when(n % 4 == 1, "/q-").when(n % 4 == 2, "/closed-").otherwise("/open/a.php?x=")
    return A.table(spark, sf, "lineitem").select(
        F.lit("r1").alias("run_id"), F.concat(F.lit("site"), k.cast("string")).alias("site"),
        F.concat(F.lit("https://x.example.com/s"), (k - n % 2).cast("string"), mid, F.col("l_orderkey").cast("string"),
                 F.when(n == 6, ".php").otherwise("")).alias("url"), n.alias("depth"), F.lit("").alias("referrer"),
        F.lit(True).alias("robots_allowed"), F.lit("").alias("robots_rule"))


@query("robots_allowed", f"WITH {_RP} SELECT site, allowed, count(*) AS n FROM rv GROUP BY ALL")
def robots_allowed(spark, sf):
    rules, _ = SR.read_robots(robots_docs(spark, sf))
    return L.robots_allowed(robots_pages(spark, sf), rules).groupBy("site", F.col("robots_allowed").alias("allowed")).agg(
        F.count("*").alias("n"))


@query("blocked_urls", f"WITH {_RP} SELECT site, url FROM rv WHERE NOT allowed")
def blocked_urls(spark, sf):
    rules, _ = SR.read_robots(robots_docs(spark, sf))
    return L.blocked_urls(robots_pages(spark, sf), rules).select("site", "url")


@query("robots_rules_audit", f"""WITH {_ROBOTS} SELECT site, 'robots-missing' AS rule FROM rb WHERE k % 3 = 0 UNION ALL SELECT site, 'no-https' FROM rb WHERE k % 2 = 0""")
def robots_rules_audit(spark, sf):
    k = F.col("s_suppkey")
    crawls = A.table(spark, sf, "supplier").select(
        F.lit("r1").alias("run_id"), F.concat(F.lit("site"), k.cast("string")).alias("site"),
        F.when(k % 2 == 0, "http://a.example.com").otherwise("https://a.example.com").alias("origin"),
        F.lit("https://a.example.com/").alias("start_url"), F.when(k % 3 == 0, 404).otherwise(200).alias("robots_status"),
        F.lit(False).alias("truncated"), F.lit(0).cast("bigint").alias("queue_left"))
    rules, _ = SR.read_robots(robots_docs(spark, sf))
    return D.crawl_hits(crawls, None, rules).select("site", "rule")


def sitemap_docs(spark, sf):
    """A root index per part brand, one url set per part, some as plain text."""
    k = F.col("p_partkey").cast("string")
    brand = F.regexp_replace(F.lower("p_brand"), "#", "")
    loc = F.concat(F.lit("https://"), brand, F.lit(".example.com/p/"), k)
    xml = F.concat(F.lit("<?xml version=\"1.0\"?><urlset><url><loc><![CDATA["), loc, F.lit("?utm_source=map]]></loc><lastmod>2026-01-0"),
                   (F.col("p_size") % 9 + 1).cast("string"), F.lit("</lastmod></url>\n<url>\n<loc> "), loc, F.lit("/b </loc></url></urlset>"))
    body = F.when(F.col("p_partkey") % 10 == 0, F.concat(loc, F.lit("\n"), loc, F.lit("/b\nnot a url"))).otherwise(xml)
    return A.table(spark, sf, "part").select(
        F.lit("r1").alias("run_id"), brand.alias("site"), F.concat(F.lit("https://x/map"), k).alias("url"), body.alias("body"))


@query("read_sitemaps", """WITH b AS (SELECT replace(lower(p_brand), '#', '') AS site, p_partkey AS k, p_size FROM part)
  SELECT site, 'https://' || site || '.example.com/p/' || k AS loc, CASE WHEN k % 10 = 0 THEN '' ELSE '2026-01-0' || (p_size % 9 + 1) END AS lastmod FROM b
  UNION ALL SELECT site, 'https://' || site || '.example.com/p/' || k || '/b', '' FROM b""")
def read_sitemaps(spark, sf):
    return SR.read_sitemaps(sitemap_docs(spark, sf)).select("site", "loc", F.coalesce("lastmod", F.lit("")).alias("lastmod"))


@query("read_sitemap_index", """SELECT replace(lower(p_brand), '#', '') AS site, count(*) * 2 AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL""")
def read_sitemap_index(spark, sf):
    """Indexes name every second set; the rest stays unreached."""
    docs = sitemap_docs(spark, sf)
    part = A.table(spark, sf, "part").filter(F.col("p_partkey") % 2 == 0)
    brand = F.regexp_replace(F.lower("p_brand"), "#", "")
    index = part.select(
        F.lit("r1").alias("run_id"), brand.alias("site"), F.concat(F.lit("https://x/index"), "p_partkey").alias("url"),
        F.concat(F.lit("<sitemapindex><sitemap><loc>https://x/map"), "p_partkey", F.lit("</loc></sitemap></sitemapindex>")).alias("body"))
    roots = index.select("run_id", "site", F.col("url").alias("sitemap"))
    return SR.read_sitemaps(docs.unionByName(index), roots).groupBy("site").agg(F.count("*").alias("n"))


# --- redirects --------------------------------------------------------------------------------

_HOPS = """hp AS (SELECT 'https://h.example.com/' || p_partkey AS f, 'https://h.example.com/' || (CASE WHEN p_partkey % 50 = 7 THEN p_partkey - 3 ELSE p_partkey + 1 END) AS t
  FROM part WHERE p_partkey % 12 <> 0 OR p_partkey % 50 = 7)"""


def hop_table(spark, sf):
    k = F.col("p_partkey")
    base = F.lit("https://h.example.com/")
    to = F.when(k % 50 == 7, k - 3).otherwise(k + 1)
    return A.table(spark, sf, "part").filter((k % 12 != 0) | (k % 50 == 7)).select(
        F.lit("r1").alias("run_id"), F.lit("h.example.com").alias("site"), F.concat(base, k.cast("string")).alias("from"),
        F.concat(base, to.cast("string")).alias("to"), F.lit(301).alias("status"))


_CHAIN = f"""WITH RECURSIVE {_HOPS}, w AS (SELECT f AS url, t AS cur, 1 AS n, [f] AS seen, t = f AS loop FROM hp
  UNION ALL SELECT w.url, hp.t, w.n + 1, list_append(w.seen, w.cur), list_contains(list_append(w.seen, w.cur), hp.t) FROM w JOIN hp ON hp.f = w.cur WHERE NOT w.loop AND w.n < 9),
  ch AS (SELECT url, arg_max(cur, n) AS cur, max(n) AS n, bool_or(loop) AS loop FROM w GROUP BY url)"""


@query("redirect_chain", f"{_CHAIN} SELECT url, CASE WHEN n <= 8 THEN CAST(n AS INTEGER) ELSE 8 END AS hops, CASE WHEN n <= 8 AND loop THEN 'redirect_loop' WHEN n > 8 THEN 'too_many_redirects' ELSE '' END AS error FROM ch")
def redirect_chain(spark, sf):
    c = L.redirect_chains(hop_table(spark, sf))
    return c.select("url", "hops", F.coalesce("error", F.lit("")).alias("error"))


@query("redirect_test", f"""{_CHAIN} SELECT url AS from_url, CASE WHEN n = 1 AND NOT loop THEN TRUE ELSE FALSE END AS ok FROM ch""")
def redirect_test(spark, sf):
    hops = hop_table(spark, sf)
    chains = L.redirect_chains(hops)
    pairs = hops.select("run_id", "site", F.col("from").alias("from_url"), F.lit(None).cast("string").alias("to_url"))
    landing = chains.select("run_id", "site", F.col("final_url").alias("url")).distinct().withColumn("status", F.lit(200))
    return D.redirect_test(pairs, chains, landing).select("from_url", "ok")


_RM = """nw AS (SELECT 'https://n.example.com/' || replace(p_name, ' ', '-') || '/' || lower(p_type) || '-' || p_partkey AS url,
  list_distinct(list_filter(regexp_split_to_array('/' || replace(p_name, ' ', '-') || '/' || lower(p_type) || '-' || p_partkey, '[^a-z0-9]+'), lambda t: length(t) > 2)) AS slug,
  list_distinct(list_filter(string_split(p_name, ' '), lambda t: t <> '')) AS words FROM part WHERE p_partkey % 40 = 0),
ol AS (SELECT DISTINCT 'https://o.example.com/old/' || replace(p_name, ' ', '_') || '/' || lower(p_type) || '.html' AS old,
  list_filter(regexp_split_to_array('/old/' || replace(p_name, ' ', '_') || '/' || lower(p_type) || '.html', '[^a-z0-9]+'), lambda t: length(t) > 2 AND t <> 'html') AS t FROM part),
sc AS (SELECT old, url, len(list_intersect(list_distinct(t), slug))::DOUBLE / greatest(1, len(list_distinct(list_concat(t, slug)))) * 0.7::DOUBLE
  + len(list_filter(t, lambda x: list_contains(words, x)))::DOUBLE / greatest(1, len(t)) * 0.3::DOUBLE AS score FROM ol, nw),
bs AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY score DESC, url) AS r FROM sc WHERE score > 0)"""


def _redirect_inputs(spark, sf):
    """New pages are every fortieth part, old addresses all part names."""
    p = A.table(spark, sf, "part")
    slug = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/"), F.lower("p_type"), F.lit("-"), "p_partkey")
    new = p.filter(F.col("p_partkey") % 40 == 0).select(
        F.lit("r1").alias("run_id"), F.lit("s").alias("site"), F.concat(F.lit("https://n.example.com/"), slug).alias("url"),
        F.col("p_name").alias("title"), F.array().cast("array<string>").alias("h1s"), F.lit(200).alias("status"), F.lit(False).alias("noindex"))
    old = p.select(F.lit("r1").alias("run_id"), F.lit("s").alias("site"), F.concat(
        F.lit("https://o.example.com/old/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("/"), F.lower("p_type"),
        F.lit(".html")).alias("url"))
    return old, new


@query("redirect_map", f"""WITH {_RM}, q AS (SELECT o.old, coalesce(score, 0.0::DOUBLE) AS score, url FROM (SELECT DISTINCT old FROM ol) o LEFT JOIN bs ON bs.old = o.old AND r = 1)
  SELECT old AS from_url, CASE WHEN score < 0.25 THEN '' ELSE url END AS to_url, CAST(floor(score * 100 + 0.5::DOUBLE) AS BIGINT) AS score,
  CASE WHEN score < 0.25 THEN 'none' WHEN score > 0.7::DOUBLE THEN 'high' WHEN score > 0.45::DOUBLE THEN 'medium' ELSE 'low' END AS confidence FROM q""")
def redirect_map(spark, sf):
    return O.redirect_map(*_redirect_inputs(spark, sf)).select("from_url", "to_url", "score", "confidence")


@query("redirect_rules", f"""WITH {_RM} SELECT 'rewrite ^' || regexp_extract(old, '^https://[^/]+(.*)$', 1) || '/?$ ' || url || ' permanent;' AS value FROM bs WHERE r = 1 AND score >= 0.25""")
def redirect_rules(spark, sf):
    return sinks.redirect_rules(O.redirect_map(*_redirect_inputs(spark, sf)), "nginx")


@query("link_opportunities")
def link_opportunities(spark, sf):
    """Targets: the first page of every site."""
    p = A.pages(spark, sf).filter(F.col("title").isNotNull())
    from ..sources.pages import links_of
    targets = p.groupBy("run_id", "site").agg(F.min("url").alias("url"))
    return L.link_opportunities(p, links_of(p), targets).select("site", "from_url", "to_url", "suggested_anchor", "score")


@query("render_gap", f"""WITH g AS (SELECT url, regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g') AS h, html FROM pages),
  t AS (SELECT url, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(h, '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[\\s\\x{{00a0}}]+'), lambda x: x <> '')) AS w,
  len(list_distinct(regexp_extract_all(h, '(?i)<a\\b[^>]*href\\s*=\\s*["'']([^"''#]+)'))) AS l FROM g)
  SELECT url, CAST(w AS INTEGER) AS raw_words, CAST(w AS INTEGER) AS rendered_words, CAST(l AS INTEGER) AS raw_links, CAST(l AS INTEGER) + 1 AS rendered_links,
  CASE WHEN l::DOUBLE / (l + 1) < 0.5 THEN TRUE ELSE FALSE END AS dependent FROM t""")
def render_gap(spark, sf):
    """Rendered pages: the source with one link added."""
    raw = A.table(spark, sf, "pages").select(F.lit("r1").alias("run_id"), F.lit("s").alias("site"), "page_id", "url", "html")
    rendered = raw.withColumn("html", F.concat("html", F.lit('<a href="/added"></a>')))
    return SR.render_gap(raw, rendered, "page_id").select("url", "raw_words", "rendered_words", "raw_links", "rendered_links", "dependent")


# --- duplicates over documents ---------------------------------------------------------------------

_DOCS = r"""dd AS (SELECT doc_id, 'doc' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS url, lang AS site, text, list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS w,
  sha1(regexp_replace(lower(trim(regexp_replace(text, '[\s\x{00a0}]+', ' ', 'g'))), '[^a-z0-9 ]+', '', 'g')) AS chash FROM documents)"""


def docs(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.select(F.lit("r1").alias("run_id"), F.col("lang").alias("site"), "doc_id", "lang",
                    F.concat(F.lit("doc"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("url"), "text",
                    X.content_hash(X.squash(F.col("text"))).alias("content_hash"))


@query("duplicate_docs", f"WITH {_DOCS} SELECT site, chash AS value, count(*) AS n, min(url) AS first_url FROM dd GROUP BY ALL HAVING count(*) >= 2")
def duplicate_docs(spark, sf):
    return dedupe.duplicate_sets(docs(spark, sf), "content_hash").drop("run_id")


@query("duplicate_members", f"WITH {_DOCS}, s AS (SELECT site, chash, count(*) AS n, min(url) AS first_url FROM dd GROUP BY ALL HAVING count(*) >= 2) SELECT site, url, n, first_url FROM dd JOIN s USING (site, chash)")
def duplicate_members(spark, sf):
    return dedupe.duplicate_members(docs(spark, sf), "content_hash").select("site", "url", "n", "first_url")


_SH = f"""{_DOCS}, d0 AS (SELECT url, site, chash, CASE WHEN len(w) < 5 THEN [] ELSE list_transform(range(0, (len(w) - 5) // 2 + 1), lambda i: array_to_string(w[2 * i + 1 : 2 * i + 5], ' ')) END AS a FROM dd),
d1 AS (SELECT url, site, chash, u.x, min(u.i) AS i FROM d0, LATERAL (SELECT unnest(a) AS x, unnest(range(len(a))) AS i) u GROUP BY url, site, chash, u.x),
d2 AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY i) - 1 AS k FROM d1), d3 AS (SELECT * FROM d2 WHERE k < 1600),
d4 AS (SELECT *, count(*) OVER (PARTITION BY url) AS n FROM d3), sh AS (SELECT url, site, chash, x FROM d4 WHERE k % greatest(1, CAST(ceil(n / 400.0) AS BIGINT)) = 0)"""


@query("shingles", f"WITH {_SH} SELECT url, count(*) AS n, md5(string_agg(x, '|' ORDER BY x)) AS digest FROM sh GROUP BY url")
def shingles(spark, sf):
    d = docs(spark, sf).select("url", X.shingles(F.col("text")).alias("s")).filter(F.size("s") > 0)
    return d.select("url", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join(F.array_sort("s"), "|")).alias("digest"))


_WHOLE_SH = f"""{_DOCS}, sh AS (SELECT DISTINCT url, site, chash, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS x FROM dd WHERE len(w) >= 5)"""


@query("near_duplicates", f"""WITH {_WHOLE_SH}, gr AS (SELECT site, chash, min(url) AS url, count(DISTINCT url) AS copies FROM sh GROUP BY ALL),
  gs AS (SELECT sh.* FROM sh JOIN gr USING (site, chash, url)), sz AS (SELECT site, chash, count(*) AS n FROM gs GROUP BY ALL),
  iv AS (SELECT a.site, a.url AS ua, b.url AS ub, a.chash AS ha, b.chash AS hb, count(*) AS i FROM gs a JOIN gs b ON a.site = b.site AND a.x = b.x AND a.url < b.url AND a.chash <> b.chash GROUP BY ALL)
  SELECT iv.site, ua AS url_a, ub AS url_b, round(i::DOUBLE / (x.n + y.n - i), 6) AS score, p.copies AS copies_a, q.copies AS copies_b FROM iv
  JOIN sz x ON x.site = iv.site AND x.chash = ha JOIN sz y ON y.site = iv.site AND y.chash = hb
  JOIN gr p ON p.site = iv.site AND p.chash = ha JOIN gr q ON q.site = iv.site AND q.chash = hb WHERE i::DOUBLE / (x.n + y.n - i) >= 0.85::DOUBLE""")
def near_duplicates(spark, sf):
    rows = docs(spark, sf).withColumn("shingles", X.whole_shingle_hashes(F.col("text")))
    return dedupe.near_duplicates(rows).select("site", "url_a", "url_b", F.round("score", 6).alias("score"), "copies_a", "copies_b")


@query("near_duplicate_families", f"""WITH RECURSIVE {_DOCS}, {families("SELECT site, url, chash, w FROM dd")}
  SELECT site, url, copies, representative, family_size, round(score, 6) AS score FROM ndf""")
def near_duplicate_families(spark, sf):
    rows = docs(spark, sf).withColumn("shingles", X.whole_shingle_hashes(F.col("text")))
    return dedupe.near_duplicate_families(rows).select("site", "url", "copies", "representative", "family_size", F.round("score", 6).alias("score"))
