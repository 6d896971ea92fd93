import pytest
from pyspark.sql import functions as F

from sitegrid.operators import logs as G
from sitegrid.operators import search as H
from sitegrid.sources import logs as SL
from sitegrid.sources import search_exports as SE

GB = "Mozilla/5.0 (compatible; Googlebot/2.1)"


def line(ip="66.249.1.1", url="/a", status=200, ua=GB, when="10/Oct/2026:13:55:36 -0700"):
    return f'{ip} - - [{when}] "GET {url} HTTP/1.1" {status} - "-" "{ua}"'


def test_four_formats(spark, tmp_path):
    (tmp_path / "a.log").write_text(line() + "\nrubbish\n\n" + line(url="/b?x=1", status=404))
    (tmp_path / "b.log").write_text("www.e.com " + line())
    (tmp_path / "c.log").write_text('{"ClientRequestURI":"/c","clientIp":"1.2.3.4","EdgeResponseStatus":301,"EdgeStartTimestamp":"2026-10-10T13:55:36Z",'
                                    '"ClientRequestUserAgent":"bingbot","duration":1500}\n{"no":"url"}\nnot json')
    (tmp_path / "d.log").write_text("#Software: Microsoft IIS\n#Fields: date time cs-uri-stem cs-uri-query sc-status c-ip cs(User-Agent) time-taken\n"
                                    "2026-10-10 13:55:36 /d q=1 200 9.9.9.9 Mozilla/5.0+(compatible;+Googlebot/2.1) 12\n2026-10-10 13:55:37 /e - 200 9.9.9.9 x 5")
    hits, totals = SL.read_access_logs(spark, str(tmp_path))
    t = {r.file[-5:]: (r.format, r.total, r.skipped) for r in totals.collect()}
    assert t == {"a.log": ("combined", 3, 1), "b.log": ("combined-vhost", 1, 0), "c.log": ("json", 3, 2), "d.log": ("iis", 2, 0)}
    by = {r.url: r for r in hits.collect()}
    assert set(by) == {"/a", "/b?x=1", "/c", "/d?q=1", "/e"} and by["/b?x=1"].status == 404 and by["/a"].bytes == 0
    assert by["/c"].ip == "1.2.3.4" and by["/c"].status == 301 and by["/c"].ms == 1500
    assert by["/d?q=1"].ua == "Mozilla/5.0 (compatible; Googlebot/2.1)" and by["/d?q=1"].ms == 12
    at = hits.filter("url in ('/a', '/c', '/e')").select(F.date_format("at", "yyyy-MM-dd HH:mm:ss")).distinct().collect()
    assert {r[0] for r in at} == {"2026-10-10 13:55:36", "2026-10-10 13:55:37"}
    one = spark.createDataFrame([("f", 0, line())], "file string, at_block int, line string")
    applied = SL.hits_of(SL.parse_log_lines(one, "combined", tz="apply")).select(F.date_format("at", "HH:mm")).first()[0]
    assert applied == "20:55"


def hits_of(spark, *groups):
    rows = [r for n, *rest in groups for r in [tuple(rest)] * n]
    return spark.createDataFrame(rows, "ip string, url string, status int, ua string").select(
        "*", F.current_timestamp().alias("at"), F.lit(10).cast("bigint").alias("bytes"), F.lit(5).cast("bigint").alias("ms"))


def test_bots_and_waste(spark):
    h = hits_of(spark, (50, "66.249.1.1", "/a", 200, GB), (30, "203.0.113.9", "/b?p=1", 404, GB), (20, "9.9.9.9", "/a", 200, "Mozilla"),
                (5, "157.55.1.1", "/a", 301, "bingbot/2.0"), (3, "1.1.1.1", "/i", 200, "Googlebot-Image/1.0"))
    t = {r.bot: r for r in G.bot_traffic(h).collect()}
    assert t["googlebot"].hits == 80 and (t["googlebot"].verified, t["googlebot"].spoofed) == (50, 30)
    assert t["human"].hits == 20 and t["bingbot"].hits == 5 and t["googlebotImage"].hits == 3 and t["human"].bytes == 200
    w = G.crawl_waste(h).first()
    assert (w.errors, w.error_share, w.params, w.param_share, w.redirects) == (30, 38, 30, 38, 0)
    rules = {r.rule: r for r in G.log_findings(h).collect()}
    assert set(rules) == {"log-spoofed-bot", "log-error-waste", "log-param-waste"} and rules["log-error-waste"].urls == ["/b?p=1"]
    pages = spark.createDataFrame([("https://e.com/a", 200, False, 3, 1), ("https://e.com/lonely", 200, False, 0, 2),
                                   ("https://e.com/no", 200, True, 0, 2)], "url string, status int, noindex boolean, inbound_count bigint, depth int")
    assert [r.path for r in G.never_crawled(h, pages).collect()] == ["/lonely"]
    assert G.unknown_urls(h, pages).count() == 0
    assert {r.url: r.hits for r in G.crawl_by_url(h).collect()} == {"/a": 50, "/b?p=1": 30}


def test_search_export_numbers(spark, tmp_path):
    (tmp_path / "Queries.csv").write_text('Top queries,Clicks,Impressions,CTR,Position\n"running, shoes",120,4300,2.79%,8.4\nb,"1,234",10000,"1,50%",3\n,1,1,1%,1\n')
    (tmp_path / "Pages.csv").write_text("Pages les plus populaires,Clics,Impressions\nhttps://e.com/,25,100\n")
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    tables, errors = SE.read_search_exports(spark, [str(tmp_path / n) for n in ("Queries.csv", "Pages.csv", "bad.csv")])
    q = {r.key: r for r in tables["query"].collect()}
    assert set(q) == {"running, shoes", "b"} and abs(q["running, shoes"].ctr - 0.0279) < 1e-9
    assert q["b"].clicks == 1234 and abs(q["b"].ctr - 0.015) < 1e-9
    assert tables["page"].first().ctr == 0.25 and len(errors) == 1
    with pytest.raises(ValueError):
        SE.read_search_export(spark, str(tmp_path / "bad.csv"))


PERF = "query string, page string, clicks bigint, impressions bigint, ctr double, position double"


def test_search_analyses(spark):
    q = spark.createDataFrame([("a", "/a", 5, 500, 0.01, 6.0), ("b", "/b", 1, 200, 0.005, 14.0), ("c", "/c", 0, 5, 0.0, 7.0),
                               ("d", "/d", 60, 300, 0.2, 2.0)], PERF)
    assert {r["query"] for r in H.striking_distance(q).collect()} == {"a", "b"}
    assert [r["query"] for r in H.ctr_gaps(q).collect()] == ["a"]
    assert H.striking_distance(q, "api").filter("query = 'a'").first().opportunity == 45
    x = spark.createDataFrame([("x", "/a", 1, 100, 0.01, 3.0), ("x", "/b", 1, 80, 0.01, 5.0), ("y", "/c", 1, 10, 0.1, 1.0)], PERF)
    rows = H.cannibalisation(x).collect()
    assert {r.page for r in rows} == {"/a", "/b"} and {r["query"] for r in rows} == {"x"}
    assert {r.severity for r in H.cannibalisation(x, "api").collect()} == {"High"}


def test_trend_and_triage(spark):
    rows = [(f"2026-01-{d:02}", 100 if d <= 15 else 60, 1000, 0.1, 4.0) for d in range(1, 31)]
    daily = spark.createDataFrame(rows, "date string, clicks bigint, impressions bigint, ctr double, position double").withColumn(
        "date", F.to_date("date"))
    r = H.trend_read(daily).first()
    assert (r.reading, r.clicks_change, r.impr_change) == ("ctr", -40, 0)
    assert H.trend_read(daily.limit(10)).first().reading is None
    t = H.traffic_triage(daily, ("2026-01-16", "2026-01-30"), ("2026-01-01", "2026-01-15")).first()
    assert (t.click_change, t.layout_change, t.seasonality) == (-40.0, "likely", "unlikely")


def test_headers_are_carried_over_splits(spark, tmp_path):
    """A large file with a new header every few lines, read in many small splits, equals
    the plain loop; so does a table of lines in any order."""
    import random
    rnd = random.Random(3)
    names = ["date", "time", "cs-uri-stem", "sc-status", "c-ip"]
    lines, want, cols = ["#Software: Microsoft IIS"], [], None
    for n in range(3000):
        if n == 5 or rnd.random() < (0.05 if n < 1500 else 0.0005):
            cols = rnd.sample(names, 5)
            lines.append("#Fields: " + " ".join(cols))
        values = {"date": "2026-01-01", "time": "10:00:00", "cs-uri-stem": f"/p{n}", "sc-status": str(200 + n % 5), "c-ip": "9.9.9.9"}
        lines.append(" ".join(values[c] for c in (cols or names)))
        want.append((f"/p{n}", 200 + n % 5) if cols else None)
    (tmp_path / "w3c.log").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        hits, totals = SL.read_access_logs(spark, str(tmp_path))
        got = {(r.url, r.status) for r in hits.collect()}
        assert SL.read_log_lines(spark, str(tmp_path)).select("at_block").distinct().count() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {w for w in want if w}
    assert [(t.format, t.total, t.skipped) for t in totals.collect()] == [("iis", 3000, want.count(None))]
    rows = [("f", i // 100, i, x) for i, x in enumerate(lines)]
    rnd.shuffle(rows)
    table = spark.createDataFrame(rows, "file string, at_block int, i long, line string")
    again = SL.hits_of(SL.parse_log_lines(table, SL.detect_log_format(table)))
    assert {(r.url, r.status) for r in again.collect()} == got


def test_format_where_the_first_line_is_broken(spark):
    rows = [("a", 0, "rubbish"), ("a", 0, line()), ("a", 0, line(url="/b")), ("b", 0, "# note"), ("c", 0, "what"), ("c", 0, "is this"),
            ("d", 0, "torn {"), ("d", 64, '{"url":"/x"}'), ("e", 0, line()), ("e", 0, '{"url":"/x"}'), ("e", 0, '{"url":"/y"}')]
    got = SL.detect_log_format(spark.createDataFrame(rows, "file string, at_block int, line string"))
    assert {r.file: r.format for r in got.collect()} == {"a": "combined", "b": "empty", "c": "unknown", "d": "json", "e": "combined"}
