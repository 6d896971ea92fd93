"""Supplied tables as inputs of the operators: plain deterministic projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import spread, stage_table, tune
from ..sources.pages import extract_pages, with_page_defaults

# tables whose rows are costly to process: text, markup, JSON
_HEAVY_ROWS = {"documents", "conversations", "events", "lineitem"}
# rows a task gets of tables that lie in few splits: pages for the time that each takes,
# parts for the rows that become of each
_ROWS_A_TASK = {"pages": 2048, "part": 65_536}
_EXTRACTED: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = tune(spark).read.parquet(f"{sf}/{name}.parquet")
    return spread(df, _ROWS_A_TASK.get(name)) if name in _HEAVY_ROWS or name in _ROWS_A_TASK else df


def _when(*pairs: tuple[Column, object], otherwise: object = None) -> Column:
    out = F.when(pairs[0][0], pairs[0][1])
    for cond, value in pairs[1:]:
        out = out.when(cond, value)
    return out.otherwise(otherwise)


def pages_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Fetched pages; fetch facts derive from page_id."""
    i = F.col("page_id")
    headers = F.map_from_entries(F.array_compact(F.array(
        F.struct(F.lit("Content-Type"), F.lit("text/html")),
        F.when(i % 19 == 0, F.struct(F.lit("X-Robots-Tag"), F.lit("noindex"))),
        F.when((i % 43 == 0) & (i % 19 != 0), F.struct(F.lit("X-Robots-Tag"), F.lit("nofollow"))),
        F.when(i % 37 == 0, F.struct(F.lit("Link"), F.lit('<https://main.example.com/>; rel="canonical"'))),
        F.when(i % 3 == 0, F.struct(F.lit("Server"), F.lit("nginx/1.18.0"))),
        F.when(i % 3 == 1, F.struct(F.lit("Server"), F.lit("edge"))),
        F.when(i % 2 == 0, F.struct(F.lit("Strict-Transport-Security"), F.lit("max-age=31536000; includeSubDomains"))),
        F.when(i % 4 == 1, F.struct(F.lit("Strict-Transport-Security"), F.lit("max-age=300"))),
        F.when(i % 5 == 0, F.struct(F.lit("Content-Security-Policy"), F.lit("default-src 'self'"))),
        F.when(i % 5 == 1, F.struct(F.lit("Content-Security-Policy"), F.lit("script-src 'self' 'unsafe-inline'"))),
        F.when(i % 3 == 0, F.struct(F.lit("X-Content-Type-Options"), F.lit("nosniff"))),
        F.when(i % 7 == 0, F.struct(F.lit("Referrer-Policy"), F.lit("unsafe-url"))),
        F.when(i % 7 == 1, F.struct(F.lit("Referrer-Policy"), F.lit("no-referrer"))),
        F.when(i % 4 == 0, F.struct(F.lit("Set-Cookie"), F.lit("sid=1; Secure; Path=/"))),
    )))
    src = table(spark, sf, "pages").select(
        "page_id", "url", "html", F.lit("r1").alias("run_id"),
        _when((i % 23 == 0, 404), (i % 29 == 0, 503), otherwise=200).alias("status"),
        _when((i % 17 == 0, 2), (i % 13 == 0, 1), otherwise=0).alias("hops"),
        ((i * 37) % 2400 + 40).alias("response_ms"), (i % 6).alias("depth"),
        _when((i % 41 == 0, "application/pdf"), otherwise="text/html; charset=utf-8").alias("content_type"),
        (i % 11 != 0).alias("robots_allowed"),
        _when((i % 7 == 0, "sitemap")).cast("string").alias("discovered_via"), headers.alias("headers"))
    return with_page_defaults(src)


def _state(spark: SparkSession, path: str) -> tuple:
    """Number of a table's files and a hash of their names, sizes and times; contents are not read."""
    files = spark.read.format("binaryFile").load(path)
    return tuple(files.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """The extracted page table, computed once per session and state of the given files and
    written to the shared folder, as a crawl job would write it for the analyses."""
    key = (spark.sparkContext.applicationId, sf, *_state(spark, f"{sf}/pages.parquet"))
    if key not in _EXTRACTED:
        _EXTRACTED[key] = stage_table(extract_pages(pages_raw(spark, sf)))
    return _EXTRACTED[key]


def crawls(spark: SparkSession, sf: str) -> DataFrame:
    """One crawl row per host of the page table."""
    p = table(spark, sf, "pages")
    return p.groupBy(U.bare_host(F.col("url")).alias("site")).agg(
        F.min("page_id").alias("i"), F.min(U.origin(F.col("url"))).alias("origin")).select(
        F.lit("r1").alias("run_id"), "site", F.concat("origin", F.lit("/")).alias("start_url"), "origin",
        _when((F.col("i") % 5 == 0, 404), (F.col("i") % 5 == 1, 500), otherwise=200).alias("robots_status"),
        (F.col("i") % 4 == 0).alias("truncated"), (F.col("i") % 4).cast("bigint").alias("queue_left"))


def page_sitemap(spark: SparkSession, sf: str) -> DataFrame:
    """Every third page is listed, with a date, plus one unknown URL per listed page."""
    p = table(spark, sf, "pages").filter(F.col("page_id") % 3 == 0)
    rows = F.array(F.col("url"), F.concat(U.origin(F.col("url")), F.lit("/gone/"), F.col("page_id")))
    return p.select(F.lit("r1").alias("run_id"), U.bare_host(F.col("url")).alias("site"), F.explode(rows).alias("loc"),
                    F.concat(F.lit("2026-01-0"), (F.col("page_id") % 2 + 1).cast("string")).alias("lastmod"))


def page_targets(spark: SparkSession, sf: str) -> DataFrame:
    """The term that every ninth page is aimed at, one per address."""
    p = table(spark, sf, "pages").filter(F.col("page_id") % 9 == 0)
    return p.groupBy("url").agg(F.min(F.concat(F.lit("Guide "), U.last_segment(F.col("url")))).alias("target"))


def graph_links(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of a wide tree from the order lines, three sites."""
    li = table(spark, sf, "lineitem")
    host = F.concat(F.lit("s"), (F.col("l_linenumber") % 3).cast("string"), F.lit(".example.com"))
    base = F.concat(F.lit("https://"), host, F.lit("/p/"))
    return li.select(
        F.lit("r1").alias("run_id"), host.alias("site"),
        F.concat(base, F.col("l_partkey").cast("string")).alias("from_url"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.concat(base, (F.col("l_partkey") * 3 + F.col("l_suppkey") % 3 + 1).cast("string")).alias("resolved"),
        F.when(F.col("l_linenumber") == 3, "read more").otherwise(
            F.concat(F.lit("item "), F.col("l_suppkey").cast("string"))).alias("anchor"),
        (F.col("l_returnflag") == "R").alias("nofollow"), (F.col("l_linenumber") == 1).alias("in_nav"),
        (F.col("l_linenumber") == 2).alias("in_footer"))


def graph_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page per part on each of the three sites."""
    hosts = F.explode(F.array(*[F.lit(f"s{n}.example.com") for n in range(3)]))
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", hosts.alias("site"))
    k = F.col("p_partkey")
    return p.select(
        F.lit("r1").alias("run_id"), "site",
        F.concat(F.lit("https://"), "site", F.lit("/p/"), k.cast("string")).alias("url"),
        _when((k % 31 == 0, 404), (k % 37 == 0, 301), otherwise=200).alias("status"), (k % 5).cast("int").alias("depth"),
        (k % 29 == 0).alias("noindex"), F.lit("text/html").alias("content_type"), F.col("p_name").alias("title"),
        (F.col("p_size") * 10).cast("int").alias("word_count"), F.lit(True).alias("robots_allowed"), F.col("p_size"))


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Access-log hits from the event stream."""
    e = table(spark, sf, "events")
    u, n = F.col("user_id"), F.col("event_id")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.concat(F.lit("site"), (u % 3).cast("string")).alias("site"), F.col("ts").alias("at"),
        F.concat(_when((u % 4 == 0, "66.249.64."), (u % 4 == 1, "157.55.39."), (u % 4 == 2, "203.0.113."),
                       otherwise="34.1.2."), (u % 250).cast("string")).alias("ip"),
        _when((u % 7 == 0, "Mozilla/5.0 (compatible; Googlebot/2.1)"), (u % 7 == 1, "Googlebot-Image/1.0"),
              (u % 7 == 2, "Mozilla/5.0 (compatible; bingbot/2.0)"), (u % 7 == 3, "GPTBot/1.0"),
              (u % 7 == 4, "Mozilla/5.0 (Windows NT 10.0)"), (u % 7 == 5, "Mozilla/5.0 (compatible; AhrefsBot/7.0)"),
              otherwise="somecrawler/0.1").alias("ua"),
        _when((F.col("event_type") == "purchase", 301), (F.col("event_type") == "error", 404), otherwise=200)
        .alias("status"),
        F.concat(F.lit("/sec"), (k.cast("int") % 5).cast("string"), F.lit("/page-"), k,
                 F.when(n % 3 == 0, F.concat(F.lit("?p="), k)).otherwise(F.lit(""))).alias("url"),
        (F.floor(F.col("value")) * 100).cast("bigint").alias("bytes"), ((n * 7) % 1500).alias("ms"),
        F.lit("GET").alias("method"))


def log_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Crawled pages to set against the hits: one per part."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(F.concat(F.lit("site"), (k % 3).cast("string")).alias("site"),
                    F.concat(F.lit("https://www.example.com/sec"), (k % 5).cast("string"), F.lit("/page-"),
                             k.cast("string")).alias("url"),
                    F.when(k % 13 == 0, 404).otherwise(200).alias("status"), (k % 17 == 0).alias("noindex"),
                    F.col("p_size").cast("bigint").alias("inbound_count"), (k % 4).cast("int").alias("depth"))


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The hits as raw log lines: one file per format in splits of a thousand events, some
    lines broken, the first one of them included."""
    e = table(spark, sf, "events")
    n = F.col("event_id")
    fmt = _when((n % 4 == 0, "combined"), (n % 4 == 1, "combined-vhost"), (n % 4 == 2, "json"), otherwise="iis")
    k = F.get_json_object("props", "$.k")
    ip = F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"))
    clf = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    size = F.floor("value").cast("string")
    combined = F.concat(ip, F.lit(" - - ["), clf, F.lit(' -0700] "GET /a/'), k, F.lit(' HTTP/1.1" 200 '), size,
                        F.lit(' "-" "Googlebot/2.1"'))
    js = F.concat(F.lit('{"ip":"'), ip, F.lit('","time":"'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                  F.lit('","method":"GET","url":"/a/'), k, F.lit('","status":200,"bytes":'), size,
                  F.lit(',"ua":"Googlebot/2.1"}'))
    iis = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), ip, F.lit(" GET /a/"), k, F.lit(" - 200 "),
                   size, F.lit(" Googlebot/2.1"))
    line = (F.when(n % 50 == 0, F.lit("broken line")).when(fmt == "combined", combined)
            .when(fmt == "combined-vhost", F.concat(F.lit("www.example.com "), combined)).when(fmt == "json", js)
            .otherwise(iis))
    rows = e.select(fmt.alias("file"), (n - n % 1000).alias("at_block"), n.alias("i"), line.alias("line"))
    head = e.filter(n % 4 == 3).groupBy(F.lit("iis").alias("file")).agg(F.lit(-1).cast("bigint").alias("i")).select(
        "file", F.col("i").alias("at_block"), "i", F.lit("#Fields: date time c-ip cs-method cs-uri-stem cs-uri-query sc-status sc-bytes "
                                  "cs(User-Agent)").alias("line"))
    return rows.unionByName(head)


def search_perf(spark: SparkSession, sf: str) -> DataFrame:
    """Query by page rows from the order lines; whole-number arithmetic."""
    li = table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("bigint")
    at = F.col("l_linenumber") + q % 15
    per = li.groupBy(F.concat(F.lit("q"), F.floor(F.col("l_partkey") / 5).cast("string")).alias("query"),
                     F.concat(F.lit("/p/"), F.floor(F.col("l_suppkey") / 4).cast("string")).alias("page")).agg(
        F.sum(F.col("l_linenumber").cast("bigint")).alias("clicks"), (F.sum(q) * 4).alias("impressions"),
        F.sum(at).alias("a"), F.count("*").alias("n"))
    return per.select("query", "page", "clicks", "impressions",
                      (F.col("clicks") / F.col("impressions")).alias("ctr"),
                      (F.floor(F.col("a") * 10 / F.col("n")) / 10).alias("position"))


def daily_perf(spark: SparkSession, sf: str) -> DataFrame:
    """Daily series per site from the event stream."""
    e = table(spark, sf, "events")
    return e.groupBy(F.concat(F.lit("site"), (F.col("user_id") % 3).cast("string")).alias("site"),
                     F.to_date("ts").alias("date")).agg(
        F.sum(F.when(F.col("event_type") == "click", F.col("user_id") % 5 + 1).otherwise(0)).alias("clicks"),
        F.count("*").alias("impressions"),
        (F.floor(F.sum(F.col("event_id") % 20) * 10 / F.count("*")) / 10).alias("position"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    i = F.col("conv_id")
    tail = _when((i % 5 == 0, " Acme is the best and most reliable choice. See acme.com for more."),
                 (i % 5 == 1, " Some prefer Beta Works. Acme is expensive but popular."),
                 (i % 5 == 2, " Beta Works leads here."), otherwise="")
    return c.select(F.concat(F.lit("run"), (i % 4).cast("string")).alias("run_id"),
                    F.concat(F.lit("prompt "), F.floor(i / 8).cast("string")).alias("prompt"),
                    F.concat(F.lit("m"), (i % 3).cast("string")).alias("provider"), i, F.col("turn"),
                    F.when(i % 17 != 0, F.concat("text", tail)).alias("answer"),
                    F.when(i % 17 == 0, F.lit("timeout")).alias("error"))


def run_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings per site and yearly run from the orders."""
    o = table(spark, sf, "orders")
    rank = F.min(_when((F.col("o_orderstatus") == "F", 3), (F.col("o_orderstatus") == "P", 1), otherwise=2))
    per = o.groupBy(F.concat(F.lit("s"), F.floor(F.col("o_custkey") / 50).cast("string")).alias("site"),
                    F.year("o_orderdate").cast("string").alias("run_id"), F.col("o_orderpriority").alias("rule")).agg(
        (rank + F.max(F.col("o_custkey") % 2)).alias("r"), F.count("*").alias("n_urls"))
    sev = F.element_at(F.array(F.lit("Critical"), F.lit("High"), F.lit("Medium"), F.lit("Low")), F.col("r").cast("int"))
    stage = _when((F.substring("rule", 1, 1) == "1", "eligibility"), (F.substring("rule", 1, 1) == "2", "indexation"),
                  (F.substring("rule", 1, 1) == "3", "onpage"), (F.substring("rule", 1, 1) == "4", "schema"),
                  otherwise="performance")
    effort = _when((F.col("n_urls") % 3 == 0, "S"), (F.col("n_urls") % 3 == 1, "M"), otherwise="L")
    owner = _when((F.col("n_urls") % 2 == 0, "dev"), otherwise="content")
    return per.select("site", "run_id", "rule", sev.alias("severity"), "n_urls", stage.alias("stage"),
                      effort.alias("effort"), owner.alias("owner"))


def run_list(spark: SparkSession, sf: str) -> DataFrame:
    return run_findings(spark, sf).select("site", "run_id").distinct().withColumn(
        "run_at", F.concat("run_id", F.lit("-12-31")).cast("timestamp"))


def run_stats(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy(F.concat(F.lit("s"), F.floor(F.col("o_custkey") / 50).cast("string")).alias("site"),
                     F.year("o_orderdate").cast("string").alias("run_id")).agg(
        F.count("*").alias("crawled"), F.count_if(F.col("o_orderstatus") == "P").alias("noindex"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("errors"),
        F.count_if(F.col("o_orderstatus") == "O").alias("indexable"))


def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    word = _when((k % 9 == 0, "best "), (k % 9 == 1, "how to choose a "), (k % 9 == 2, "buy "), otherwise="")
    return p.select(F.lower("p_brand").alias("seed"),
                    F.concat(word, "p_name", F.lit(" "), F.lower("p_type")).alias("suggestion"),
                    F.col("p_size").alias("rank"))


def demand_clusters(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    word = _when((k % 9 == 0, "best "), (k % 9 == 1, "how to choose a "), (k % 9 == 2, "buy "),
                 (k % 9 == 3, "near me "), otherwise="")
    return p.select(F.lower("p_brand").alias("site"), F.concat(word, "p_name", F.lit(" "), k.cast("string")).alias("label"),
                    _when((k % 4 == 0, "transactional"), (k % 4 == 1, "informational"), otherwise="unclear")
                    .alias("intent"), (F.col("p_size") % 7).alias("pages"), (k % 5 + 1).alias("winnability"),
                    (F.floor(k / 5) % 5 + 1).alias("value"), (F.floor(k / 25) % 5 + 1).alias("difficulty"))
