"""The adapters of ``adapters.py`` as SQL, for the oracle side of each query."""

from .. import fixed_values as V

SITE = r"regexp_replace(regexp_extract(lower(url), '^https?://([^/?#]+)', 1), '^www\.', '')"
HOST = r"regexp_extract(lower(url), '^https?://([^/?#]+)', 1)"
PATH = r"(CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END)"
QS = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"


def rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def decode(x: str) -> str:
    return (f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), "
            f"'&amp;', '&')")


def squash(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{00a0}}]+', ' ', 'g'))"


def text_of(x: str) -> str:
    return squash(decode(rf"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"))


def words_of(x: str) -> str:
    return f"(CASE WHEN {x} = '' OR {x} IS NULL THEN 0 ELSE len(string_split({x}, ' ')) END)"


def px(x: str) -> str:
    def n(chars: str) -> str:
        return f"(length({x}) - length(translate({x}, {rx(chars)}, '')))"
    return (f"CAST(floor(({n(V.NARROW_CHARS)} * 28 + {n(V.WIDE_CHARS)} * 85 + {n(V.UPPER_CHARS)} * 62 + "
            f"{n(V.DIGIT_CHARS)} * 55 + (length({x}) - {n(V.NARROW_CHARS)} - {n(V.WIDE_CHARS)} - "
            f"{n(V.UPPER_CHARS)} - {n(V.DIGIT_CHARS)}) * 50) * 20 / 100.0 + 0.5) AS INTEGER)")


def long_words(x: str) -> str:
    return (f"list_distinct(list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), "
            f"lambda w: length(w) > 2))")


def pct(a: str, b: str) -> str:
    return f"CAST(CASE WHEN {b} > 0 THEN floor({a} * 100.0::DOUBLE / {b} + 0.5::DOUBLE) ELSE 0 END AS BIGINT)"


def upper_median(x: str, q: float = 0.5) -> str:
    return f"percentile_disc({round(1 - q, 6)}) WITHIN GROUP (ORDER BY {x} DESC)"


PAGES = rf"""
p0 AS (SELECT page_id AS i, url, html, {SITE} AS site, {HOST} AS host, {PATH} AS path, {QS} AS qs,
  CASE WHEN page_id % 23 = 0 THEN 404 WHEN page_id % 29 = 0 THEN 503 ELSE 200 END AS status,
  CASE WHEN page_id % 17 = 0 THEN 2 WHEN page_id % 13 = 0 THEN 1 ELSE 0 END AS hops,
  CAST((page_id * 37) % 2400 + 40 AS INTEGER) AS response_ms, CAST(page_id % 6 AS INTEGER) AS depth,
  page_id % 41 <> 0 AS html_type, page_id % 11 <> 0 AS robots_allowed, page_id % 19 = 0 AS noindex,
  CASE WHEN page_id % 19 = 0 THEN 'noindex' WHEN page_id % 43 = 0 THEN 'nofollow' END AS x_robots,
  CASE WHEN page_id % 37 = 0 THEN 'https://main.example.com/' END AS canonical,
  CASE WHEN page_id % 41 <> 0 THEN trim({decode("regexp_extract(html, '<title>(.*?)</title>', 1)")}) END AS title,
  CASE WHEN page_id % 41 <> 0 THEN {text_of("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} END AS h1,
  CASE WHEN page_id % 41 <> 0 THEN {text_of("regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")} END AS body
  FROM pages),
pg AS (SELECT *, {words_of('body')} AS words, sha1(regexp_replace(lower(body), '[^a-z0-9 ]+', '', 'g')) AS chash,
  {px('title')} AS px, status = 200 AND html_type AS is_html,
  status = 200 AND html_type AND NOT noindex AND robots_allowed AS idx,
  {long_words("regexp_extract(title, '^([^|–—-]*)', 1)")} AS tw, {long_words('h1')} AS hw,
  regexp_matches(url, {rx(V.BLOAT_URL)}) AS bloat FROM p0)"""

LINKS = r"""
pl AS (SELECT site, url AS from_url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
  regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin FROM pg WHERE html_type),
pagelinks AS (SELECT site, from_url, origin || '/' || replace(replace(url_encode(substr(href, 2)), '%2C', ','), '%21', '!') AS resolved,
  substr(href, 2) AS anchor FROM pl)"""

CRAWLS = rf"""
cr AS (SELECT site, min(page_id) AS i, min(regexp_extract(lower(url), '^(https?://[^/?#]+)', 1)) AS origin
  FROM (SELECT page_id, url, {SITE} AS site FROM pages) GROUP BY site),
crawls AS (SELECT site, origin, origin || '/' AS start_url,
  CASE WHEN i % 5 = 0 THEN 404 WHEN i % 5 = 1 THEN 500 ELSE 200 END AS robots_status,
  i % 4 = 0 AS truncated, CAST(i % 4 AS BIGINT) AS queue_left FROM cr)"""

SITEMAP = rf"""
sm AS (SELECT {SITE} AS site, unnest([url, regexp_extract(lower(url), '^(https?://[^/?#]+)', 1) || '/gone/' || page_id]) AS loc,
  '2026-01-0' || (page_id % 2 + 1) AS lastmod FROM pages WHERE page_id % 3 = 0)"""

GRAPH = """
gl AS (SELECT 's' || (l_linenumber % 3) || '.example.com' AS site,
  'https://s' || (l_linenumber % 3) || '.example.com/p/' || l_partkey AS from_url,
  l_orderkey * 10 + l_linenumber AS pos,
  'https://s' || (l_linenumber % 3) || '.example.com/p/' || (l_partkey * 3 + l_suppkey % 3 + 1) AS resolved,
  CASE WHEN l_linenumber = 3 THEN 'read more' ELSE 'item ' || l_suppkey END AS anchor,
  l_returnflag = 'R' AS nofollow, l_linenumber = 1 AS in_nav, l_linenumber = 2 AS in_footer FROM lineitem),
gp AS (SELECT 's' || n || '.example.com' AS site, 'https://s' || n || '.example.com/p/' || p_partkey AS url,
  CASE WHEN p_partkey % 31 = 0 THEN 404 WHEN p_partkey % 37 = 0 THEN 301 ELSE 200 END AS status,
  CAST(p_partkey % 5 AS INTEGER) AS depth, p_partkey % 29 = 0 AS noindex, p_name AS title,
  CAST(p_size * 10 AS INTEGER) AS word_count FROM part, (SELECT unnest([0, 1, 2]) AS n))"""

HITS = """
hits AS (SELECT *, CASE WHEN contains(url, '?') THEN TRUE ELSE FALSE END AS has_q,
  CASE WHEN bot IN ('googlebot', 'googlebotImage') THEN starts_with(ip, '66.249.') OR starts_with(ip, '34.')
       WHEN bot = 'bingbot' THEN starts_with(ip, '157.55.') END AS verified FROM (
  SELECT 'site' || (user_id % 3) AS site, ts AS seen,
  (CASE user_id % 4 WHEN 0 THEN '66.249.64.' WHEN 1 THEN '157.55.39.' WHEN 2 THEN '203.0.113.' ELSE '34.1.2.' END) || (user_id % 250) AS ip,
  CASE user_id % 7 WHEN 0 THEN 'googlebot' WHEN 1 THEN 'googlebotImage' WHEN 2 THEN 'bingbot' WHEN 3 THEN 'gptbot'
    WHEN 4 THEN NULL WHEN 5 THEN 'ahrefs' ELSE 'other' END AS bot,
  CASE event_type WHEN 'purchase' THEN 301 WHEN 'error' THEN 404 ELSE 200 END AS status,
  '/sec' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 5) || '/page-' || json_extract_string(props, '$.k') ||
    (CASE WHEN event_id % 3 = 0 THEN '?p=' || json_extract_string(props, '$.k') ELSE '' END) AS url,
  CAST(floor(value) * 100 AS BIGINT) AS bytes, (event_id * 7) % 1500 AS ms FROM events)),
lp AS (SELECT 'site' || (p_partkey % 3) AS site, '/sec' || (p_partkey % 5) || '/page-' || p_partkey AS path,
  CASE WHEN p_partkey % 13 = 0 THEN 404 ELSE 200 END AS status, p_partkey % 17 = 0 AS noindex,
  CAST(p_size AS BIGINT) AS inbound, CAST(p_partkey % 4 AS INTEGER) AS depth FROM part)"""

PERF = """
perf AS (SELECT 'q' || CAST(floor(l_partkey / 5.0) AS BIGINT) AS query, '/p/' || CAST(floor(l_suppkey / 4.0) AS BIGINT) AS page,
  CAST(sum(l_linenumber) AS BIGINT) AS clicks, CAST(sum(CAST(l_quantity AS BIGINT)) * 4 AS BIGINT) AS impressions,
  CAST(sum(l_linenumber) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) * 4 AS DOUBLE) AS ctr,
  floor(CAST(sum(l_linenumber + CAST(l_quantity AS BIGINT) % 15) AS DOUBLE) * 10 / count(*)) / 10 AS position
  FROM lineitem GROUP BY ALL)"""

DAILY = """
daily AS (SELECT 'site' || (user_id % 3) AS site, CAST(ts AS DATE) AS date,
  CAST(sum(CASE WHEN event_type = 'click' THEN user_id % 5 + 1 ELSE 0 END) AS BIGINT) AS clicks,
  count(*) AS impressions, floor(CAST(sum(event_id % 20) AS DOUBLE) * 10 / count(*)) / 10 AS position
  FROM events GROUP BY ALL)"""

ANSWERS = """
ans AS (SELECT 'run' || (conv_id % 4) AS run_id, 'prompt ' || CAST(floor(conv_id / 8.0) AS BIGINT) AS prompt,
  'm' || (conv_id % 3) AS provider, conv_id, turn, conv_id % 17 <> 0 AS ok,
  CASE WHEN conv_id % 17 <> 0 THEN text || (CASE conv_id % 5
    WHEN 0 THEN ' Acme is the best and most reliable choice. See acme.com for more.'
    WHEN 1 THEN ' Some prefer Beta Works. Acme is expensive but popular.'
    WHEN 2 THEN ' Beta Works leads here.' ELSE '' END) END AS answer
  FROM conversations WHERE role = 'assistant')"""

RUNS = """
rf AS (SELECT site, run_id, rule, n_urls, (['Critical', 'High', 'Medium', 'Low'])[r] AS severity, r,
  (['eligibility', 'indexation', 'onpage', 'schema', 'performance'])[CAST(substr(rule, 1, 1) AS INTEGER)] AS stage,
  CASE n_urls % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'M' ELSE 'L' END AS effort,
  CASE WHEN n_urls % 2 = 0 THEN 'dev' ELSE 'content' END AS owner FROM (
  SELECT 's' || CAST(floor(o_custkey / 50.0) AS BIGINT) AS site, CAST(year(o_orderdate) AS VARCHAR) AS run_id,
  o_orderpriority AS rule, CAST(min(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 1 ELSE 2 END) + max(o_custkey % 2) AS INTEGER) AS r,
  count(*) AS n_urls FROM orders GROUP BY ALL)),
rl AS (SELECT site, run_id, lag(run_id) OVER (PARTITION BY site ORDER BY run_id) AS prev_id FROM (SELECT DISTINCT site, run_id FROM rf))"""

SUGGEST = """
sg AS (SELECT lower(p_brand) AS seed, (CASE p_partkey % 9 WHEN 0 THEN 'best ' WHEN 1 THEN 'how to choose a ' WHEN 2 THEN 'buy ' ELSE '' END)
  || p_name || ' ' || lower(p_type) AS suggestion, p_size AS rank FROM part)"""

CLUSTERS = """
dc AS (SELECT lower(p_brand) AS site, (CASE p_partkey % 9 WHEN 0 THEN 'best ' WHEN 1 THEN 'how to choose a ' WHEN 2 THEN 'buy '
  WHEN 3 THEN 'near me ' ELSE '' END) || p_name || ' ' || p_partkey AS label,
  CASE p_partkey % 4 WHEN 0 THEN 'transactional' WHEN 1 THEN 'informational' ELSE 'unclear' END AS intent,
  CAST(p_size % 7 AS BIGINT) AS pages, p_partkey % 5 + 1 AS winnability,
  CAST(floor(p_partkey / 5.0) AS BIGINT) % 5 + 1 AS value, CAST(floor(p_partkey / 25.0) AS BIGINT) % 5 + 1 AS difficulty FROM part)"""


def intent_case(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(' ' || lower({x}) || ' ', {rx(p)}) THEN '{i}'" for i, p in V.KEYWORD_INTENTS)
    return f"CASE {whens} ELSE 'unclear' END"


def families(rows: str, least: float = 0.85) -> str:
    """CTEs over ``rows`` (site, url, chash, w: words): ``ndf`` with one row per content
    that has a near copy. Needs WITH RECURSIVE."""
    return f"""nr AS ({rows}),
nw AS (SELECT site, chash, min(url) AS url, count(*) AS copies, min_by(w, url) AS w FROM nr WHERE len(w) >= 5 AND site IS NOT NULL GROUP BY site, chash),
ns AS (SELECT site, chash, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) AS x FROM nw),
nz AS (SELECT site, chash, count(*) AS n FROM ns GROUP BY site, chash),
nv AS (SELECT a.site, a.chash AS a, b.chash AS b, count(*) AS i FROM ns a JOIN ns b ON a.site = b.site AND a.x = b.x AND a.chash <> b.chash GROUP BY ALL),
nj AS (SELECT nv.site, a, b, i::DOUBLE / (p.n + q.n - i) AS score FROM nv JOIN nz p ON p.site = nv.site AND p.chash = a JOIN nz q ON q.site = nv.site AND q.chash = b),
nc AS (SELECT site, a AS chash, a AS seen FROM nj WHERE score >= {least}::DOUBLE UNION SELECT nc.site, nc.chash, nj.b FROM nc JOIN nj ON nj.site = nc.site AND nj.a = nc.seen AND score >= {least}::DOUBLE),
nf AS (SELECT nc.site, nc.chash, min(nw.url) AS representative, count(*) AS family_size FROM nc JOIN nw ON nw.site = nc.site AND nw.chash = nc.seen GROUP BY nc.site, nc.chash),
ndf AS (SELECT nf.site, nw.url, nw.chash, nw.copies, representative, family_size, CASE WHEN nw.url = representative THEN 1.0::DOUBLE ELSE coalesce(nj.score, 0) END AS score
  FROM nf JOIN nw ON nw.site = nf.site AND nw.chash = nf.chash JOIN nw AS h ON h.site = nf.site AND h.url = representative
  LEFT JOIN nj ON nj.site = nf.site AND nj.a = nf.chash AND nj.b = h.chash)"""
