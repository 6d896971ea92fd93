from pyspark.sql import functions as F

from sitegrid.operators import audit as D
from sitegrid.operators import artefacts as O
from sitegrid.operators import links as L
from sitegrid.sources import robots as SR
from sitegrid.sources.pages import links_of

from . import sites


def fired(findings):
    return {r.rule: r for r in findings.collect()}


def test_broken_site(spark):
    p = sites.broken(spark).cache()
    sm = sites.sitemap(spark, "broken.example.com", ["/a/", "/c/", "/orphan-only/", "/gone/"])
    t = D.AuditInput(p, crawls=sites.crawls(spark, "broken.example.com", status=503), sitemap=sm)
    findings, urls = D.run_audit(t)
    found = fired(findings)
    assert {"noindex-present", "canonical-cross", "h1-missing", "h1-multiple", "title-duplicate", "meta-duplicate", "thin-content",
            "jsonld-invalid", "img-alt", "soft-404", "broken-links", "redirect-chains", "sitemap-dirty", "robots-missing",
            "viewport-missing"} <= set(found)
    assert found["robots-missing"].severity == "High" and found["broken-links"].severity == "High"
    assert found["title-duplicate"].n_urls == 1 and found["title-duplicate"].title.startswith("1 title(s)")
    assert urls.filter("rule = 'title-duplicate'").count() == 3
    ordered = [(r.severity, r.stage) for r in D.order_findings(findings).collect()]
    ranks = [(["Critical", "High", "Medium", "Low"].index(s), ["eligibility", "indexation", "intent", "onpage", "linking", "schema",
                                                              "performance", "offpage"].index(g)) for s, g in ordered]
    assert ranks == sorted(ranks)
    fixes = O.fix_findings(findings, urls, p, links_of(p)).collect()
    by_rule = {r.rule for r in fixes}
    assert {"title-duplicate", "h1-missing", "canonical-cross", "broken-links", "noindex-present"} <= by_rule
    proposed = [r.proposed for r in fixes if r.field in ("title", "h1s") and r.rule != "h1-multiple"]
    assert proposed and not any("broken.example.com" in t or t == "<h1>Firm</h1>" for t in proposed)


def test_good_site_is_nearly_silent(spark):
    p = sites.good(spark)
    t = D.AuditInput(p, crawls=sites.crawls(spark, "good.example.com"), sitemap=sites.sitemap(spark, "good.example.com", ["/", "/one/", "/two/"]))
    loud = [r for r in D.run_audit(t)[0].collect() if r.severity != "Low" and r.rule != "near-duplicate"]
    assert len(loud) <= 2, loud


def test_truncated_crawl_makes_no_orphan_claim(spark):
    p = sites.broken(spark)
    cr = sites.crawls(spark, "broken.example.com", truncated=True)
    found = fired(D.run_audit(D.AuditInput(p, crawls=cr), near_duplicates=False)[0])
    assert "orphans-unknown" in found and "orphans" not in found
    stats = D.site_stats(p, links_of(p), cr, orphan_urls=sites.sitemap(spark, "broken.example.com", ["/z/"])).first()
    assert stats.orphans is None and stats.truncated and stats.errors == 1
    full = sites.crawls(spark, "broken.example.com")
    assert "orphans" in fired(D.run_audit(D.AuditInput(p, crawls=full), near_duplicates=False)[0])


def test_extra_rules(spark):
    css = "".join(f'<link rel="stylesheet" href="/s{i}.css">' for i in range(7)) + '<link rel=stylesheet media="print" href=p.css>'

    def alt(*pairs):
        return "".join(f'<link rel="alternate" hreflang="{lang}" href="{href}">' for lang, href in pairs)

    def canon(u):
        return f'<link rel="canonical" href="{u}">'

    p = sites.table(spark, "x.com", {
        "/": dict(html=sites.page("Home", '<a href="/hidden/">click here</a>' * 6)),
        "/hidden/": dict(html=sites.page("H", "x"), headers={"X-Robots-Tag": "noindex"}),
        "/nf/": dict(html=sites.page("N", "x"), headers={"X-Robots-Tag": "nofollow"}),
        "/cc/": dict(html=sites.page("C", "x", canon("/cc/")), headers={"Link": '<https://x.com/zz/>; rel=canonical'}),
        "/1/": dict(html=sites.page("1", "x", canon("/2/"))), "/2/": dict(html=sites.page("2", "x", canon("/3/"))),
        "/3/": dict(html=sites.page("3", "x", canon("/3/"))),
        "/blog/page/2/": dict(html=sites.page("P", "x", canon("/blog/"))),
        "/en/": dict(html=sites.page("E", "x", alt(("en-UK", "/en/"), ("fr", "/fr/")))),
        "/fr/": dict(html=sites.page("F", "x", alt(("en", "/de/")))),
        "/m/": dict(html=sites.page("M", "x", '<meta http-equiv="refresh" content="0;url=/t/">')),
        "/css/": dict(html=sites.page("S", "x", css + "<style>@font-face{src:x}</style>")),
        **{f"/list/?colour={i}&size=1": dict(html=sites.page("L", "x")) for i in range(3)},
    })
    found = fired(D.run_audit(D.AuditInput(p, sitemap=sites.sitemap(spark, "x.com", ["/hidden/", "/1/"])), near_duplicates=False)[0])
    assert {"xrobots-noindex", "xrobots-nofollow", "canonical-header-conflict", "canonical-chain", "pagination-canonical",
            "hreflang-no-self", "hreflang-no-return", "hreflang-bad-code", "hreflang-no-xdefault", "meta-refresh", "links-to-noindex",
            "sitemap-nonindexable", "param-crawl-trap", "render-blocking", "font-display", "generic-anchors"} <= set(found)
    assert found["generic-anchors"].n_urls == 6 and found["links-to-noindex"].total == 6
    assert found["render-blocking"].most == 7


def test_registered_rule_joins_the_scan(spark):
    p = sites.good(spark)
    rule, row = D.register_rule("short-title", "onpage", "Low", F.length("title") < 13, what="short title(s)")
    found = fired(D.run_audit(D.AuditInput(p), [rule], [row], near_duplicates=False)[0])
    assert found["short-title"].n_urls == 2


def test_money_pages(spark):
    p = sites.broken(spark)
    money = spark.createDataFrame([("https://broken.example.com/b/?utm_source=x",)], "url string")
    urls = D.run_audit(D.AuditInput(p, money_urls=money), near_duplicates=False)[1]
    assert [r.url for r in urls.filter("rule = 'thin-content'").collect()] == ["https://broken.example.com/b/"]


def test_robots_rules(spark):
    txt = spark.createDataFrame([("r1", "x.com", 200, "User-agent: *\nDisallow: /\nUser-agent: bot\nDisallow: /wp-includes/\nsitemap: https://x.com/s.xml")],
                                "run_id string, site string, status int, body string")
    rules, maps = SR.read_robots(txt)
    assert maps.first().sitemap == "https://x.com/s.xml"
    found = {r.rule for r in D.crawl_hits(sites.crawls(spark, "x.com", scheme="http"), None, rules).collect()}
    assert found == {"robots-disallow-all", "robots-blocked-assets", "no-https"}


def test_reviews_and_views(spark):
    p = L.with_inbound(sites.good(spark), links_of(sites.good(spark)))
    assert {r.lead for r in D.review_pages(p).collect()} == {"none"}
    b = L.with_inbound(sites.broken(spark), links_of(sites.broken(spark)))
    assert D.page_view(b, "errors").count() == 1 and D.page_view(b, "redirects").count() == 1


def test_robots_rules_decide_what_is_indexable(spark):
    p = sites.broken(spark).cache()
    site = p.select("run_id", "site").first()
    noindex = {r.url for r in D.run_audit(D.AuditInput(p), near_duplicates=False)[1].filter("rule = 'noindex-present'").collect()}
    assert noindex
    rules, _ = SR.read_robots(spark.createDataFrame([(site.run_id, site.site, 200, "User-agent: *\nDisallow: /\n")],
                                                    "run_id string, site string, status int, body string"))
    findings, urls = D.run_audit(D.AuditInput(p, crawls=sites.crawls(spark, site.site), robots_rules=rules), near_duplicates=False)
    found = fired(findings)
    assert "robots-disallow-all" in found and "noindex-present" not in found and "thin-content" not in found
    assert {r.url for r in urls.filter("rule = 'noindex-disallow-trap'").collect()} == noindex
