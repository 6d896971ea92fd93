"""Small sites with planted faults."""

from sitegrid.sources.pages import extract_pages, with_page_defaults

WORDS = " ".join(f"word{i} about widgets and their many careful uses." for i in range(60))


def page(title="", body="", head="", lang=' lang="en"'):
    t = f"<title>{title}</title>" if title is not None else ""
    return f"<!doctype html><html{lang}><head>{t}{head}</head><body>{body}</body></html>"


GOOD_HEAD = ('<meta name="viewport" content="width=device-width"><meta name="description" content="{d}">'
             '<link rel="canonical" href="{u}"><link rel="preconnect" href="https://cdn.example.com">'
             '<script type="application/ld+json">{{"@context":"https://schema.org","@graph":[{{"@type":["Organization","Thing"]}},'
             '{{"@type":"BreadcrumbList"}}]}}</script>')


def table(spark, site, pages, run_id="r1", scheme="https"):
    """pages: path -> dict(html=..., other fetch columns)."""
    rows = []
    for path, p in pages.items():
        url = f"{scheme}://{site}{path}"
        rows.append((run_id, site, url, p.get("final_url", url), p.get("depth", 1), p.get("status", 200), p.get("hops", 0),
                     p.get("ms", 100), p.get("allowed", True), p.get("via"), p.get("headers", {}), p.get("html", "")))
    df = spark.createDataFrame(
        rows, "run_id string, site string, url string, final_url string, depth int, status int, hops int, response_ms int, "
              "robots_allowed boolean, discovered_via string, headers map<string,string>, html string")
    return extract_pages(with_page_defaults(df))


def broken(spark):
    nav = '<nav><a href="/">Home</a> <a href="/a/">A</a> <a href="/b/">B</a></nav>'
    same = '<meta name="description" content="One description for all.">'
    return table(spark, "broken.example.com", {
        "/": dict(html=page("Firm", nav + "<h1>Welcome</h1><h3>Jump</h3><p>" + WORDS + "</p><img src='/x.png'>", same), depth=0),
        "/a/": dict(html=page("Firm", nav + "<p>No heading here.</p>", same)),
        "/b/": dict(html=page("Firm B", nav + "<h1>One</h1><h1>Two</h1>", '<link rel="canonical" href="https://other.example.com/">')),
        "/c/": dict(html=page("Firm C", nav + "<h1>C</h1>", '<meta name="robots" content="NOINDEX, follow">')),
        "/d/": dict(html=page("Firm D", "<h1>D</h1>", '<script type="application/ld+json">{"@type": broken}</script>')),
        "/soft/": dict(html=page("Page not found", nav + "<h1>Sorry</h1>")),
        "/gone/": dict(status=404, html=page("Gone", "")),
        "/old/": dict(hops=2, final_url="https://broken.example.com/a/", html=page("Firm", nav)),
    })


def good(spark):
    def one(path, title):
        url = f"https://good.example.com{path}"
        head = GOOD_HEAD.format(u=url, d=f"What {title} offers and why.")
        links = ' '.join(f'<p>See <a href="{q}">{n}</a></p>' for q, n in
                         (("/", "the home page"), ("/one/", "page one"), ("/two/", "page two")))
        return dict(html=page(title, f"<main><h1>{title}</h1><h2>More</h2><p>{title} {WORDS} {title}</p>{links}</main>", head))
    pages = {"/": one("/", "Home of widgets"), "/one/": one("/one/", "Blue widgets"), "/two/": one("/two/", "Red widgets")}
    pages["/"]["depth"] = 0
    return table(spark, "good.example.com", pages)


def crawls(spark, site, truncated=False, status=200, scheme="https"):
    origin = f"{scheme}://{site}"
    return spark.createDataFrame(
        [("r1", site, origin + "/", origin, status, truncated, 7 if truncated else 0)],
        "run_id string, site string, start_url string, origin string, robots_status int, truncated boolean, queue_left bigint")


def sitemap(spark, site, paths, scheme="https", lastmod="2026-01-01"):
    return spark.createDataFrame([("r1", site, f"{scheme}://{site}{p}", lastmod) for p in paths],
                                 "run_id string, site string, loc string, lastmod string")
