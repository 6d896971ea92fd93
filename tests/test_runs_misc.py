import datetime as dt

from pyspark.sql import functions as F

from sitegrid.operators import artefacts as O
from sitegrid.operators import behaviour as B
from sitegrid.operators import compare as K
from sitegrid.operators import headers as M
from sitegrid.operators import insights as E
from sitegrid.operators import links as L
from sitegrid.operators import plan as P
from sitegrid.operators import runs as R
from sitegrid.operators import serp as Q
from sitegrid.sources import documents as SD
from sitegrid.sources.pages import links_of

from . import sites

DAY = dt.datetime(2026, 1, 1)


def test_run_diffs(spark):
    f = spark.createDataFrame(
        [("s", "1", "a", "High", 4), ("s", "1", "b", "Low", 1), ("s", "1", "gone", "Low", 1),
         ("s", "2", "a", "Critical", 8), ("s", "2", "b", "Low", 1), ("s", "2", "new", "Critical", 1), ("s", "2", "quiet", "Low", 1),
         ("t", "1", "a", "High", 1), ("t", "2", "a", "High", 1)], "site string, run_id string, rule string, severity string, n_urls bigint")
    runs = spark.createDataFrame([(s, r, DAY + dt.timedelta(int(r))) for s in "st" for r in "12"], "site string, run_id string, run_at timestamp")
    d = R.diff_findings(f, runs)
    assert {(r.site, r.rule, r.change) for r in d.collect()} == {
        ("s", "a", "worsened"), ("s", "a", "grew"), ("s", "gone", "resolved"), ("s", "new", "appeared"), ("s", "quiet", "appeared")}
    assert {r.rule for r in R.alertable(d).collect()} == {"a", "new"}
    stats = spark.createDataFrame([("s", "1", 100, 0, 1, 50), ("s", "2", 60, 3, 1, 44), ("t", "1", 9, 0, 0, 5), ("t", "2", 1, 0, 0, 1)],
                                  "site string, run_id string, crawled bigint, noindex bigint, errors bigint, indexable bigint")
    st = R.structural_changes(stats, runs)
    assert {(r.site, r.change) for r in st.collect()} == {("s", "pages fell"), ("s", "noindex rose"), ("s", "indexable fell")}
    status = {(r.site, r.run_id): r.status for r in R.run_status(runs, d, st).collect()}
    assert status == {("s", "1"): "baseline", ("s", "2"): "changed", ("t", "1"): "baseline", ("t", "2"): "quiet"}


def test_diff_pages(spark):
    schema = "site string, url string, status int, title string, noindex boolean, canonical string, word_count int, inbound_count int"
    before = spark.createDataFrame([("s", "same", 200, "t", False, None, 10, 1), ("s", "moved", 200, "t", False, None, 10, 1), ("s", "old", 200, "t", False, None, 1, 1)], schema)
    after = spark.createDataFrame([("s", "same", 200, "t", False, None, 90, 1), ("s", "moved", 404, "u", True, "c", 200, 2), ("s", "new", 200, "t", False, None, 1, 1)], schema)
    got = {r.url: r for r in R.diff_pages(before, after).collect()}
    assert set(got) == {"moved", "old", "new"} and got["moved"].severe and not got["new"].severe
    assert got["moved"].detail == "status 200 to 404; title changed; noindex added; canonical none to c; words 10 to 200; inbound 1 to 2"


def headed(spark, url, headers):
    return spark.createDataFrame([("r", "s", url, headers)], "run_id string, site string, url string, headers map<string,string>")


def test_header_grades(spark):
    full = {"strict-transport-security": "max-age=31536000; includeSubDomains", "content-security-policy": "default-src 'self'; frame-ancestors 'self'",
            "x-content-type-options": "nosniff", "referrer-policy": "no-referrer", "permissions-policy": "camera=()", "cross-origin-opener-policy": "same-origin"}
    assert M.grade_headers(headed(spark, "https://e.com/", full)).first().grade == "A"
    bare = M.grade_headers(headed(spark, "https://e.com/", {"server": "nginx/1.2.3"})).first()
    assert bare.grade == "F" and bare.score == 12
    http = M.grade_headers(headed(spark, "http://e.com/", full)).first()
    assert http.checks[0].level == "skip" and http.score == 100
    weak = {r.id: r.level for r in M.grade_headers(headed(spark, "https://e.com/", {
        "content-security-policy": "script-src * 'unsafe-inline'", "strict-transport-security": "max-age=300",
        "x-frame-options": "ALLOW-FROM x"})).first().checks}
    assert (weak["csp"], weak["hsts"], weak["xfo"], weak["xcto"]) == ("warn", "warn", "warn", "fail")
    two = headed(spark, "https://e.com/a", {"set-cookie": "sid=1"}).unionByName(headed(spark, "https://e.com/b", {"set-cookie": "sid=2"}))
    assert [(r.name, r.missing) for r in M.cookie_issues(two).collect()] == [("sid", ["Secure", "HttpOnly", "SameSite"])]
    assert M.header_disclosure(headed(spark, "https://e.com/", {"server": "nginx/1.2.3"})).first().versioned
    roll = M.security_rollup(M.grade_headers(two)).first()
    assert roll.consistent and roll.pages == 2 and roll.grade == "F"


def profile(spark, rows):
    return spark.createDataFrame(rows, "run_id string, site string, pages bigint, schema_pages bigint, authors bigint, breadcrumbs bigint, "
                                       "depth_median bigint, words_median bigint, inbound_median bigint, response_ms bigint, truncated boolean")


def test_compare_sites(spark):
    p = profile(spark, [("r", "us", 20, 1, 0, 0, 4, 200, 1, 1200, False), ("r", "them", 20, 20, 10, 20, 2, 900, 6, 200, True)])
    pairs = spark.createDataFrame([("us", "them"), ("them", "us")], "site string, rival string")
    types = spark.createDataFrame([("them", "FAQPage", 4), ("them", "Rare", 1), ("us", "Article", 1)], "site string, name string, n bigint")
    sections = spark.createDataFrame([("them", "locations", 8), ("them", "case-studies", 4), ("us", "blog", 9)], "site string, name string, n bigint")
    gaps = {(r.site, r.area): r.severity for r in K.compare_sites(p, pairs, types, sections).collect()}
    assert gaps[("us", "structured data")] == "High" and gaps[("us", "missing sections")] == "High" and gaps[("us", "breadcrumbs")] == "Low"
    assert {a for s, a in gaps if s == "us"} == {"structured data", "click depth", "content depth", "authorship", "breadcrumbs",
                                                 "internal linking", "server response", "schema types", "missing sections"}
    assert {r.name for r in K.missing_names(types, pairs, 2).collect()} == {"FAQPage"}
    assert {r.area for r in K.ahead_of(p, pairs).filter("site = 'them'").collect()} == {"structured data", "click depth", "internal linking",
                                                                                      "server response", "content depth"}
    assert all(r.warn for r in K.truncation_warning(p, pairs).collect())


def test_plan(spark):
    f = spark.createDataFrame([("r", "s", "a", "onpage", "High", "M", "dev"), ("r", "s", "b", "eligibility", "Low", "L", "dev"),
                               ("r", "s", "c", "eligibility", "Critical", "S", "content")],
                              "run_id string, site string, rule string, stage string, severity string, effort string, owner string")
    plan = P.build_plan(f, 3, "2026-01-05")
    assert [(r.rule, r.week, r.week_start) for r in plan.orderBy("position").collect()] == [
        ("c", 1, "2026-01-05"), ("b", 2, "2026-01-12"), ("a", 3, "2026-01-19")]
    assert {r.stage: (r.points, r.blocking) for r in P.plan_stages(plan).collect()} == {"eligibility": (9, True), "onpage": (3, True)}
    people = spark.createDataFrame([("ann", 2.0, "dev"), ("bo", None, "content")], "person string, capacity double, role string")
    load = {r.person: (r.points, r.weeks, r.note) for r in P.workload(
        f, spark.createDataFrame([("b", "ann"), ("a", "bo")], "rule string, person string"), people).collect()}
    assert load == {"ann": (8, 4.0, "queue"), "bo": (3, None, "no capacity"), None: (1, None, "unassigned")}
    assert {r.rule: r.person for r in P.suggest_assignee(f, people).collect()} == {"a": "ann", "b": "ann", "c": "bo"}


def test_cluster_plan(spark):
    c = spark.createDataFrame([("how to fix a tap", "informational", 6, 3, 3), ("tap guide", "informational", 1, 5, 1), ("buy taps", "transactional", 3, 4, 4),
                               ("best taps", "commercial", 1, 1, 1)], "label string, intent string, pages int, winnability int, value int")
    rows = P.cluster_url_plan(c).collect()
    fix = [r for r in rows if r.label == "how to fix a tap"]
    assert sorted(r.role for r in fix) == ["pillar"] + ["spoke"] * 5 and not any(r.too_deep for r in rows)
    assert [r.url for r in rows if r.role == "section"] == ["https://example.com/guides/"]
    assert {r.url for r in rows if r.label == "buy taps"} >= {"https://example.com/buy-taps/", "https://example.com/buy-taps/subtopic-1/"}
    order = P.production_order(c).orderBy("start_week").collect()
    assert [(r.label, r.start_week, r.end_week) for r in order] == [("buy taps", 1, 2), ("tap guide", 3, 3), ("how to fix a tap", 4, 6), ("best taps", 7, 7)]


def test_intent(spark):
    res = [("q", i + 1, f"https://r{i}.com/guide/x", "How to do it") for i in range(10)]
    mix = [("m", i + 1, f"https://r{i}.com/{'shop' if i % 3 == 0 else 'guides' if i % 3 == 1 else 'services'}/x", "t") for i in range(9)]
    results = spark.createDataFrame(res + mix, "query string, position int, url string, title string")
    t = spark.createDataFrame([("q", "https://www.r3.com/product/y", "Buy"), ("m", "https://me.com/shop/y", "Buy")], "query string, url string, title string")
    got = {r["query"]: r for r in Q.judge_intent(results, t).collect()}
    assert (got["q"].severity, got["q"].dominant, got["q"].share, got["q"].own_position) == ("High", "guide", 100, 4)
    assert got["m"].mixed and got["m"].severity is None and got["m"].own_position is None
    feats = spark.createDataFrame([("q", "local"), ("q", "paa")], "query string, feature string")
    assert Q.serp_feature_notes(feats).first().features == "local, paa"
    assert Q.rank_position(results, "r3.com").filter("query = 'q'").first().position == 4
    plain = spark.createDataFrame([("q", '<a href="/url?q=https%3A%2F%2Fa.com%2F%23x&sa=1"><a href="https://www.google.com/x"><h3><a href="https://b.com/"><h3>')],
                                  "query string, html string")
    assert [(r.position, r.url) for r in SD.read_serp_pages(plain, "plain").orderBy("position").collect()] == [(1, "https://a.com/"), (2, "https://b.com/")]


def test_friction_and_speed(spark):
    doc = ('[{"metricName":"Traffic","information":[{"totalSessionCount":"2,000","totalBotSessionCount":"500"}]},'
           '{"metricName":"Dead Click Count","information":[{"Device":"Mobile","Dead Click Count":"100"},{"Dead Click Count":"20"}]},'
           '{"metricName":"Rage Click Count","information":[{"count":"7"}]},{"metricName":"Excessive Scroll","information":[{"x":"0"}]}]')
    rows = SD.behaviour_rows(spark.createDataFrame([(doc,)], "json string"))
    f = {r.metric: (r.total, r.per_1000) for r in B.friction_signals(rows).collect()}
    assert f == {"Dead Click Count": (120.0, 60.0), "Rage Click Count": (7.0, 3.5)}
    assert B.traffic_summary(rows).first().bot_share == 20
    field = spark.createDataFrame([("s", "cumulative_layout_shift", DAY + dt.timedelta(i), v) for i, v in enumerate((None, 0.1, 0.3, None))],
                                  "site string, metric string, period_end timestamp, p75 double")
    r = B.field_trend(field).first()
    assert (r.first, r.latest, r.change, r.rating) == (0.1, 0.3, 200, "POOR") or (r["first"], r.latest, r.rating) == (0.1, 0.3, "POOR")


def test_distributions_and_artefacts(spark):
    p = L.with_inbound(sites.broken(spark), links_of(sites.broken(spark)))
    words = {r.bucket: r.n for r in E.word_distribution(p).collect()}
    assert sum(words.values()) == 7 and len(words) == 6
    assert {r["class"]: r.n for r in E.status_classes(p).collect()} == {"2xx": 7, "4xx": 1}
    assert E.depth_distribution(p).count() == 2 and E.response_percentiles(p).first().p50 == 100
    assert E.schema_coverage(sites.good(spark)).filter("type = 'Organization'").first().coverage == 100
    titles = {r.url: r for r in O.draft_titles(p, brand="Firm").collect()}
    assert titles["https://broken.example.com/b/"].suggested == "One | Firm"
    long = sites.table(spark, "e.com", {"/": dict(html=sites.page("t", "<h1>" + "Wide Words " * 20 + "</h1>"))})
    d = O.draft_titles(long, brand="Firm").first()
    assert d.suggested_px <= 581 and d.suggested.endswith(" | Firm")
    assert O.draft_metas(long, cta="Call.").first().suggested_px <= 920
    crumbs = spark.createDataFrame([("https://e.com/big-shop/red_shoes/",)], "u string").select(O.breadcrumb_markup(F.col("u"))).first()[0]
    assert '"name":"Big Shop","item":"https://e.com/big-shop/"' in crumbs and '"position":3' in crumbs
