from pyspark.sql import functions as F

from sitegrid.functions.html import walk
from sitegrid.sources.pages import hreflang_of, images_of, links_of, structured_data

from . import sites

URL = "https://e.com/dir/"
HTML = """<html lang=en><head><title> A &amp; B </title><title>second</title>
<meta name="description" content=" Hello "><meta name="ROBOTS" content="NoIndex"><meta charset="utf-8">
<meta property="og:title" content="OG"><link rel="CANONICAL" href="/dir/?utm_source=x"><link rel="alternate" hreflang="en" href="/en/">
<link rel="next" href="/p/2"><style>@font-face{}</style></head><body class="x">
<header><a href="/h">Head</a></header><nav aria-label="Breadcrumb"><ul><li><a href="one">One<li><a href="#top">Top</a></ul></nav>
<div role="navigation"><a href="/r">Role</a></div>
<article><h1>Main <b>title</h1><h3>Skip</h3><p>First <a href="/img"><img src="/i.png" alt="Pic"></a> text.<p>Second para
<a>none</a><a href="mailto:a@e.com">mail</a><a href="https://other.com/" rel="nofollow ugc" aria-label="lbl"></a>
<img data-src="/lazy.png" loading="LAZY" role="presentation"><script>var x = "<a href='/no'>";</script></article>
<noscript>js off</noscript><footer><a href="/f">Foot</a></footer>
<script type="application/ld+json">[{"@type":"Person","name":"x"},{"@graph":[{"@type":["A","B"]}]}]</script>
<script type="application/ld+json">{oops}</script><div itemtype="https://schema.org/Product" class="post-Author"></div></body></html>"""


def test_walk():
    w = walk(HTML, URL)
    assert (w["title"], w["title_count"], w["meta_description"]) == ("A & B", 2, "Hello")
    assert (w["lang"], w["charset"], w["viewport"], w["next"]) == ("en", "utf-8", None, "/p/2")
    assert w["meta_robots"] == [{"name": "robots", "content": "noindex"}]
    assert w["tag_canonicals"] == ["https://e.com/dir/"]
    assert w["hreflang"] == [{"lang": "en", "href": "https://e.com/en/"}]
    assert w["headings"] == [{"level": 1, "text": "Main title"}, {"level": 3, "text": "Skip"}]
    links = {l["href"]: l for l in w["links"]}
    assert links["/h"]["in_nav"] and links["one"]["in_nav"] and links["/r"]["in_nav"] and not links["/img"]["in_nav"]
    assert links["one"]["resolved"] == "https://e.com/dir/one" and links["one"]["anchor"] == "One"
    assert links["/f"]["in_footer"] and not links["/f"]["in_nav"]
    assert links["/img"]["anchor"] == "Pic" and links["https://other.com/"]["anchor"] == "lbl"
    assert links["https://other.com/"]["nofollow"] and links["#top"]["special"] and links["mailto:a@e.com"]["special"]
    assert links[None]["no_href"] and "/no" not in links
    assert [i["src"] for i in w["images"]] == ["https://e.com/i.png", "https://e.com/lazy.png"]
    assert w["images"][1]["decorative"] and w["images"][1]["loading"] == "lazy" and not w["images"][1]["has_alt"]
    assert w["body_text"].startswith("Main titleSkip") and "Head" not in w["body_text"] and "var x" not in w["body_text"]
    assert len(w["jsonld"]) == 2 and len(w["jsonld_errors"]) == 1 and w["microdata_types"] == ["Product"]
    assert w["script_count"] == 3 and w["has_breadcrumb_el"] and w["has_author_el"] and w["og"]["title"] == "OG"
    assert walk(None, URL) is None and walk("", URL)["title"] == ""


def test_extract_pages(spark):
    p = sites.table(spark, "e.com", {"/dir/": dict(html=HTML, headers={
        "Link": '<https://e.com/other/>; rel="canonical"', "X-Robots-Tag": "nofollow", "X-Junk": "1"})})
    r = p.first()
    assert r.noindex and r.nofollow_page and not r.noarchive and r.self_canonical
    assert r.canonicals == ["https://e.com/dir/", "https://e.com/other/"] and r.header_canonical == "https://e.com/other/"
    assert sorted(r.schema_types) == ["A", "B", "Person"] and r.has_author_markup
    assert [tuple(s) for s in r.heading_skips] == [(1, 3, "Skip")] and r.h1s == ["Main title"]
    assert r.font_faces == 1 and r.font_display == 0 and "x-junk" not in r.headers
    assert links_of(p).count() == 9 and images_of(p).count() == 2 and hreflang_of(p).count() == 1
    assert structured_data(p).filter(F.col("body").isNotNull()).count() == 2


def test_empty_app_root(spark):
    shell = ('<html><body><div id="root"> </div><script>document.write("<a href=\'/x\'>x</a>")</script></body></html>')
    refresh = '<html><head><meta http-equiv=refresh content="5; url=/next"></head></html>'
    p = sites.table(spark, "app.com", {"/": dict(html=shell), "/r": dict(html=refresh), "/f": dict(html="x", status=500)})
    rows = {r.url: r for r in p.collect()}
    assert rows["https://app.com/"].root_div_empty and rows["https://app.com/"].links == []
    assert (rows["https://app.com/r"].meta_refresh.delay, rows["https://app.com/r"].meta_refresh.target) == (5, "/next")
