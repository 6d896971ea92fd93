"""Queries over access logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as G
from ..sources import logs as SL
from ..streaming.jobs import windowed_waste
from . import adapters as A
from .registry import query
from .sql import HITS, pct

_GB = "bot = 'googlebot'"
_SEC = "regexp_extract(split_part(url, '?', 1), '^/*([^/]*)', 1)"


@query("bot_traffic", f"""WITH {HITS} SELECT site, coalesce(bot, 'human') AS bot, count(*) AS hits, CAST(sum(bytes) AS BIGINT) AS bytes,
  count(*) FILTER (WHERE verified) AS verified, count(*) FILTER (WHERE NOT verified) AS spoofed FROM hits GROUP BY ALL""")
def bot_traffic(spark, sf):
    return G.bot_traffic(A.hits(spark, sf), ["site"])


@query("log_span", f"""WITH {HITS}, s AS (SELECT site, min(seen) AS a, max(seen) AS b, count(*) FILTER (WHERE {_GB}) AS n FROM hits GROUP BY site),
  d AS (SELECT *, greatest(1, CAST(floor((floor(epoch(b)) - floor(epoch(a))) / 86400.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS days FROM s)
  SELECT site, strftime(a, '%Y-%m-%d') AS first_day, strftime(b, '%Y-%m-%d') AS last_day, days, n AS bot_hits, CAST(floor(n / days::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS per_day FROM d""")
def log_span(spark, sf):
    return G.log_span(A.hits(spark, sf), by=["site"])


@query("crawl_by_url", f"""WITH {HITS} SELECT site, url, count(*) AS hits, bool_or(status BETWEEN 400 AND 599) AS has_error, count(DISTINCT status) AS n_statuses
  FROM hits WHERE {_GB} GROUP BY ALL""")
def crawl_by_url(spark, sf):
    return G.crawl_by_url(A.hits(spark, sf), by=["site"]).select(
        "site", "url", "hits", "has_error", F.size("statuses").cast("bigint").alias("n_statuses"))


@query("crawl_by_status", f"WITH {HITS} SELECT status, count(*) AS hits FROM hits WHERE {_GB} GROUP BY status")
def crawl_by_status(spark, sf):
    return G.crawl_by_status(A.hits(spark, sf))


@query("crawl_by_section", f"WITH {HITS} SELECT site, {_SEC} AS section, count(*) AS hits FROM hits WHERE {_GB} GROUP BY ALL")
def crawl_by_section(spark, sf):
    return G.crawl_by_section(A.hits(spark, sf), by=["site"], k=None)


@query("crawl_budget_sets", f"""WITH {HITS}, h AS (SELECT status, {_SEC} AS section FROM hits WHERE {_GB}) SELECT status, section, count(*) AS hits FROM h
  GROUP BY GROUPING SETS ((status), (section))""")
def crawl_budget_sets(spark, sf):
    return G.crawl_budget_sets(A.hits(spark, sf))


_WASTE = f"""count(*) AS hits, count(*) FILTER (WHERE status BETWEEN 400 AND 599) AS errors, count(*) FILTER (WHERE status BETWEEN 300 AND 399) AS redirects,
  count(*) FILTER (WHERE has_q) AS params, {pct("count(*) FILTER (WHERE status BETWEEN 400 AND 599)", "count(*)")} AS error_share,
  {pct("count(*) FILTER (WHERE status BETWEEN 300 AND 399)", "count(*)")} AS redirect_share, {pct("count(*) FILTER (WHERE has_q)", "count(*)")} AS param_share,
  count(*) FILTER (WHERE ms > 1000) AS slow, count(*) FILTER (WHERE verified) AS verified, count(*) FILTER (WHERE NOT verified) AS spoofed"""


@query("crawl_waste", f"WITH {HITS} SELECT site, bot, {_WASTE} FROM hits WHERE bot IS NOT NULL GROUP BY site, bot")
def crawl_waste(spark, sf):
    return G.crawl_waste(A.hits(spark, sf), None, ["site"])


@query("windowed_waste", f"""WITH {HITS} SELECT strftime(time_bucket(INTERVAL '1 day', seen), '%Y-%m-%d %H:%M:%S') AS window_start, bot, {_WASTE} FROM hits WHERE bot IS NOT NULL GROUP BY ALL""")
def windowed(spark, sf):
    w = windowed_waste(A.hits(spark, sf), "1 day")
    return w.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")).drop("window_end")


_NEVER = f"""nv AS (SELECT site, path, inbound, depth FROM lp WHERE status = 200 AND NOT noindex
  AND NOT EXISTS (SELECT 1 FROM hits WHERE {_GB} AND hits.site = lp.site AND hits.url = lp.path)),
uk AS (SELECT site, url, count(*) AS hits FROM hits WHERE {_GB} AND NOT has_q AND NOT EXISTS (SELECT 1 FROM lp WHERE lp.site = hits.site AND lp.path = hits.url) GROUP BY ALL)"""


@query("never_crawled", f"WITH {HITS}, {_NEVER} SELECT * FROM nv")
def never_crawled(spark, sf):
    return G.never_crawled(A.hits(spark, sf), A.log_pages(spark, sf), by=["site"])


@query("unknown_urls", f"WITH {HITS}, {_NEVER} SELECT * FROM uk")
def unknown_urls(spark, sf):
    return G.unknown_urls(A.hits(spark, sf), A.log_pages(spark, sf), by=["site"])


@query("log_findings", f"""WITH {HITS}, {_NEVER}, w AS (SELECT site, {_WASTE} FROM hits WHERE {_GB} GROUP BY site)
  SELECT site, 'log-spoofed-bot' AS rule, 'High' AS severity, spoofed AS n FROM w WHERE spoofed > 0 AND verified > 0
  UNION ALL SELECT site, 'log-error-waste', 'High', errors FROM w WHERE errors > hits * 0.05
  UNION ALL SELECT site, 'log-redirect-waste', 'Medium', redirects FROM w WHERE redirects > hits * 0.15
  UNION ALL SELECT site, 'log-param-waste', 'High', params FROM w WHERE params > hits * 0.2
  UNION ALL SELECT site, 'log-never-crawled', 'High', count(*) FROM nv GROUP BY site
  UNION ALL SELECT site, 'log-unknown-urls', 'Medium', count(*) FROM uk GROUP BY site""")
def log_findings(spark, sf):
    return G.log_findings(A.hits(spark, sf), A.log_pages(spark, sf), by=["site"]).select("site", "rule", "severity", "n")


@query("identify_bots", f"WITH {HITS} SELECT ip, coalesce(bot, '') AS bot, coalesce(CAST(verified AS VARCHAR), '') AS verified, count(*) AS n FROM hits GROUP BY ALL")
def identify_bots(spark, sf):
    return G.with_bot(A.hits(spark, sf)).groupBy(
        "ip", F.coalesce("bot", F.lit("")).alias("bot"),
        F.coalesce(F.col("verified").cast("string"), F.lit("")).alias("verified")).agg(F.count("*").alias("n"))


_FILES = "(['combined', 'combined-vhost', 'json', 'iis'])[event_id % 4 + 1]"


@query("detect_log_format", f"SELECT DISTINCT {_FILES} AS file, {_FILES} AS format FROM events")
def detect_log_format(spark, sf):
    return SL.detect_log_format(A.log_lines(spark, sf))


@query("parse_access_log", f"""SELECT {_FILES} AS file, '10.0.0.' || user_id AS ip, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "at", 'GET' AS method,
  '/a/' || json_extract_string(props, '$.k') AS url, 200 AS status, CAST(floor(value) AS BIGINT) AS bytes, 'Googlebot/2.1' AS ua FROM events WHERE event_id % 50 <> 0""")
def parse_access_log(spark, sf):
    lines = A.log_lines(spark, sf)
    h = SL.hits_of(SL.parse_log_lines(lines, SL.detect_log_format(lines)))
    return h.select("file", "ip", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "method", "url", "status",
                    "bytes", "ua")


@query("parse_totals", f"""SELECT {_FILES} AS file, count(*) AS total, count(*) FILTER (WHERE event_id % 50 <> 0) AS parsed,
  count(*) FILTER (WHERE event_id % 50 = 0) AS skipped FROM events GROUP BY ALL""")
def parse_totals(spark, sf):
    lines = A.log_lines(spark, sf)
    return SL.parse_totals(SL.parse_log_lines(lines, SL.detect_log_format(lines))).drop("format")
