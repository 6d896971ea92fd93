"""Answers that a cut, a prefix or a first header would change."""

from pyspark.sql import functions as F

from sitegrid.functions import text as X
from sitegrid.operators import compare, headers, plan
from sitegrid.sources import logs


def test_a_thirteenth_section_is_not_missing(spark):
    own = [("r", "a", f"https://a/s{i}/p{k}", 200, "text/html") for i in range(13) for k in range(20 - (i == 12) * 2)]
    pages = spark.createDataFrame(own, "run_id string, site string, url string, status int, content_type string")
    assert compare.site_sections(pages).count() == 13
    assert compare.site_sections(pages, 12).count() == 12


def test_hash_reads_whole_texts(spark):
    a, b = "word " * 6000, "word " * 5999 + "other"
    rows = spark.createDataFrame([(a,), (b,), (a,)], "t string").select(X.content_hash(F.col("t")).alias("h")).collect()
    assert rows[0].h == rows[2].h != rows[1].h


def test_all_planned_pages_have_their_own_address(spark):
    long = "x" * 70
    c = spark.createDataFrame([("guide", "info", 100), (long + " one", "info", 2), (long + " two", "info", 2)], "label string, intent string, pages int")
    rows = [r.url for r in plan.cluster_url_plan(c).filter("role <> 'section'").collect()]
    assert len(rows) == 104 == len(set(rows))


def test_each_iis_line_is_read_under_the_header_above_it(spark, tmp_path):
    (tmp_path / "x.log").write_text("#Software: Microsoft IIS\n#Fields: date time cs-uri-stem c-ip sc-status\n2026-01-01 00:00:01 /a 1.1.1.1 200\n"
                                    "#Fields: date time c-ip cs-uri-stem sc-status\n2026-01-01 00:00:02 2.2.2.2 /b 404\n2026-01-01 00:00:03 3.3.3.3 /c 200\n")
    hits, totals = logs.read_access_logs(spark, str(tmp_path))
    assert sorted((r.url, r.ip, r.status) for r in hits.collect()) == [("/a", "1.1.1.1", 200), ("/b", "2.2.2.2", 404), ("/c", "3.3.3.3", 200)]
    assert totals.first().skipped == 0


def test_header_views_judge_html_pages(spark):
    rows = [("r", "a", "https://a/x", 200, "text/html", {"set-cookie": "sid=1; Secure"}), ("r", "a", "https://a/y", 200, "text/html", {"set-cookie": "sid=1; HttpOnly"}),
            ("r", "a", "https://a/z", 404, "text/html", {"set-cookie": "bad=1"}), ("r", "a", "https://a/p", 200, "application/pdf", {})]
    pages = spark.createDataFrame(rows, "run_id string, site string, url string, status int, content_type string, headers map<string,string>")
    assert [(r.name, r.missing) for r in headers.cookie_issues(pages).collect()] == [("sid", ["Secure", "HttpOnly", "SameSite"])]
    assert headers.security_rollup(headers.grade_headers(pages)).first().pages == 2
