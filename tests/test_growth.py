"""What must not grow with the input: tasks of tables in few splits, broadcasts, walks made twice."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from sitegrid.functions import html as H
from sitegrid.functions import text as X
from sitegrid.functions import urls as U
from sitegrid.operators import audit as D
from sitegrid.operators import links as L
from sitegrid.operators import summarise as N
from sitegrid.plans import adapters as A
from sitegrid.plans import page_queries as P
from sitegrid.session import spread
from sitegrid.sources import robots as SR

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_tables_of_few_splits_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    for name in ("part", "pages"):
        assert A.table(spark, SF, name).rdd.getNumPartitions() >= cores, name
    assert spread(spark.range(0, 1000, 1, 1), 20).rdd.getNumPartitions() == 50


def test_sitemap_entries_of_all_forms(spark):
    rows = [("r", "s", "u1", "<?xml?><urlset><url><loc><![CDATA[https://S.com/a?utm_source=x]]></loc><priority>0.5</priority></url><url><loc>/rel</loc></url></urlset>"),
            ("r", "s", "u2", "https://s.com/b\r\nnot one\nhttps://s.com/a"), ("r", "s", "u3", "<?xml?>\nhttps://s.com/c"),
            ("r", "s", "u4", "<sitemapindex><sitemap><loc>https://s.com/d</loc></sitemap></sitemapindex>"), ("r", "s", "u5", ""), ("r", "s", "u6", None)]
    found = SR.read_sitemaps(spark.createDataFrame(rows, "run_id string, site string, url string, body string"))
    assert sorted((r["loc"], r["priority"], r["source"]) for r in found.collect()) == [
        ("https://s.com/a", "0.5", "u1"), ("https://s.com/b", None, "u2")]
    assert "Union" not in plan(found)       # one pass over the documents


def test_same_site_reads_each_address_once(spark):
    us = ["https://a.com/x", "https://www.a.com/y?q", "https://A.com/z", "https://a.com:8080", "https://u@a.com/x", "https://www./",
          "https://www.www./", "https://b.a.com/x", "//a.com/x", "", "mailto:a@a.com", "https://a.com\0https://a.com", "https://a.co/m", "https://a.com#f"]
    df = spark.createDataFrame([(a, b) for a in us for b in us], "a string, b string")
    ha, hb = U.hostname(F.col("a")), U.hostname(F.col("b"))
    start = F.contains("a", F.lit("://")) & (F.substring_index("a", "/", 3) == F.substring_index("b", "/", 3))
    want = start | ((ha != "") & (hb != "") & ((ha == hb) | (U.bare_host(F.col("a")) == U.bare_host(F.col("b")))))
    assert df.filter(~U.same_site(F.col("a"), F.col("b")).eqNullSafe(want)).count() == 0


def test_external_links_are_sorted_once(spark):
    rows = [("r", "s", f"https://s.com/{p}", i, "https://o.com/", "" if (p, i) == (0, 0) else f"t{p}{i}", (p, i) == (0, 0)) for p in range(3) for i in range(3)]
    found = L.external_links(spark.createDataFrame(rows, "run_id string, site string, from_url string, pos int, resolved string, anchor string, nofollow boolean"))
    (r,) = found.collect()
    assert (r.n, r.nofollow, r.anchors, r.host) == (9, True, ["t01", "t02", "t10"], "o.com")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") and "SortAggregate(key=[run_id" not in text.split("WindowGroupLimit")[-1]


def test_redirects_and_canonicals_are_not_broadcast(spark):
    hops = spark.createDataFrame([("r", "s", str(i), str(i + 1), 301) for i in range(4)], "run_id string, site string, from string, to string, status int")
    chains = L.redirect_chains(hops)
    assert "Broadcast" not in chains._jdf.queryExecution().executedPlan().toString()
    pages = spark.createDataFrame([("r", "s", "https://s.com/a", 200, False, "https://s.com/b", "text/html", True)],
                                  "run_id string, site string, url string, status int, noindex boolean, canonical string, content_type string, robots_allowed boolean")
    assert "Broadcast" not in D.canonical_hits(pages)._jdf.queryExecution().executedPlan().toString()


def test_sentences_are_split_once(spark):
    docs = spark.createDataFrame([(1, "Mr. Smith met  Dr. Jones at the  station today. They went on to  the sea by e.g. boat!\n\nThen all was quiet for some time."), (2, ""), (3, None)],
                                 "doc_id long, text string")
    found = N.sentences(docs)
    assert [r.sentence for r in found.orderBy("i").collect()] == [
        "Mr. Smith met Dr. Jones at the station today.", "They went on to the sea by e.g. boat!", "Then all was quiet for some time."]
    for df in (found, N.excerpt(docs)):
        assert "size(filter" not in df._jdf.queryExecution().optimizedPlan().toString().split("Filter", 1)[-1].split("\n")[0]
    assert [r.doc_id for r in N.excerpt(docs).collect()] == [1]


def test_header_queries_do_not_walk_pages(spark, monkeypatch):
    def walked(*_):
        raise AssertionError("extracts pages")

    monkeypatch.setattr(A, "pages", walked)
    for q in (P.failing_checks, P.header_grades, P.security_rollup, P.header_disclosure, P.cookie_issues):
        assert q(spark, SF).count() > 0


def test_walk_holds_a_few_pages_of_a_batch():
    page = "<html><head><title>T</title></head><body>" + "<p><a href='/x'>word</a> and more</p>" * 40 + "</body></html>"

    def peak(n):
        html, base = pa.array([page] * n), pa.array(["https://a.com/"] * n)
        tracemalloc.start()
        assert len(H._markup.func(html, base)) == n
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top

    assert peak(1024) < 2 * peak(128)


def test_squash_of_odd_spaces():
    assert H._squash(" a  b﻿ c\x85\n") == H._WS.sub(" ", " a  b﻿ c\x85\n").strip() == "a b c"
    assert H._squash("　a \t b\x1c") == "a b"
