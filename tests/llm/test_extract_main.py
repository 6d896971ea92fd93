import html
import random
import re

from sitegrid.llm import extract
from sitegrid.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><p>Site</p></header>
<div id="cookieNotice">We use cookies</div><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- ad > --><script>var x="</p>";</script>
<main><header><h1>Head &amp; line</h1></header><p>One  <b>bold</b>&nbsp;text<br>more</p><p class="ad">Buy<p>Two &lt;tag&gt; <a href="x>y">link</a>.
<form><p>Your mail</p><input></form><aside>Side</aside><ul><li>item 1<li>item 2</ul><section id="comments"><article><p>Reader says</p></article></section>
<table><tr><td>cell</td></tr></table></main><div class="sidebar"><p>Links</p></div><footer>End</footer></body></html>"""


def lcs(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            n[i + 1][j + 1] = n[i][j] + 1 if a[i] == b[j] else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def test_structure():
    kept = [t for t, k in extract.lines_of(PAGE) if k]
    assert kept == ["Head & line", "One bold text more", "Two <tag> link.", "item 1", "item 2", "cell"]
    for odd in ("", "<", "<p", "a < b", "<!-- open", "<script>x", "<p class='x>y", "&#x41;&bogus;", "</p></div>x", "<" * 5000, "<p \"" * 3000):
        extract.lines_of(odd)
    assert extract.lines_of("a < b &#x41;") == [("a < b A", 1)]


def test_longest_common_lines(monkeypatch):
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 14))] for _ in range(2))
        got = extract.common_lines(a, b)
        it = iter(b)
        assert got == sorted(set(got)) and all(a[i] in it for i in got) and len(got) == lcs(a, b)


def test_table(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = QUERIES["op5_page_differences"](spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " " if "br" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n".join(x for x in blocks if x), (r.text[:200], body[:200])
        assert r.n_chars == len(r.text)


def test_template_lines_go_and_mirrors_stay(spark):
    def page(own, host="h.example", path="/a/1", shared=("Top words here", "Bottom words here")):
        return f"http://{host}{path}", "<body><div><p>" + "<p>".join([shared[0], *own, shared[1]]) + "</div></body>"

    rows = [(i, *page([f"text {i} {k}" for k in range(4)], path=f"/news/{i}")) for i in range(5)]
    rows += [(10, *page(["same text", "again"], "m.example", "/x")), (11, *page(["same text", "again"], "m.example", "/y")),
             (20, None, "<p>only text"), (21, "::", None), (None, "http://h.example/other", ""), (0, rows[0][1], rows[0][2]), (30, "http://alone.example/", "<p>x</p>")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, lines string")
    got = {}
    for r in extract.extract(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[2] == ["\n".join(f"text 2 {k}" for k in range(4))]
    assert got[10] == ["Top words here\nsame text\nagain\nBottom words here"] == got[11]
    assert got[20] == ["only text"] and got[21] == [""] and got[None] == [""] and len(got[0]) == 2 and got[30] == ["x"]
    assert extract.extract(df.limit(0)).collect() == []


def test_template_goes_past_mirrors_and_at_any_share(spark):
    menu, foot = [f"Menu {k}" for k in range(10)], [f"Foot {k}" for k in range(10)]

    def text(i, n=3):
        return [f"Paragraph {k} of article {i}, " + "with words that fill its line up to some length, " * 3 + "end." for k in range(n)]

    def page(own):
        return "<body>" + "".join(f"<div>{x}</div>" for x in [*menu, *own, *foot]) + "</body>"

    own = {f"http://s.example/a/{i}": text(i) for i in range(4)}  # 20 of 23 lines are shared
    own |= {f"http://c.example/a/{k}": text("copied") for k in range(5)}  # copies, then near copies, then another page
    own |= {f"http://c.example/b/{k}": [*text("near", 8), f"Printed on day {k}"] for k in range(4)}
    own |= {"http://e.example/1": text("part"), "http://e.example/2": text("part", 4), "http://e.example/3": text("more")}
    own |= {"http://c.example/c": text("other"), "http://e.example/4": [], "http://t.example/1": text(1), "http://t.example/2": [text(2)[0][:40]]}
    own |= {f"http://d.example/{k}": text("drift", 12)[k:k + 8] for k in range(5)}  # neighbours are mirrors, the ends are not
    df = spark.createDataFrame([(i, u, page(x)) for i, (u, x) in enumerate(own.items())] + [(90, "http://s.example/a/1/0", "")], "page_id long, url string, html string")
    got = {r.url: r.text for r in extract.extract(df).collect()}
    for u, x in own.items():
        if "d.example" not in u and u != "http://e.example/2":
            assert got[u] == "\n".join(x), u
    for k in range(5):
        lines = got[f"http://d.example/{k}"].split("\n")
        assert lines == [*menu, *own[f"http://d.example/{k}"], *foot]  # a host of mirrors only
    a = extract.compare([1, 2, 3], [41, 401, 41], [1, 2, 4], [41, 401, 41])
    assert a == ([0, 1], [0, 1], True, True) and extract.compare([1, 2, 3], [41, 41, 401], [1, 2, 4], [41, 41, 401])[2:] == (False, False)


def test_layout_names_keep_the_article():
    prose = "This sentence stands for a paragraph of an article and is long enough to be one, word by word. "
    for a, b in [("<div class='layout has-sidebar'><article>", "</article></div>"), ("<div class='no-comments'>", "</div>"), ("<div id=page class=ad-free><div>", "</div></div>"),
                 ("<article class='post comments-open'>", "</article>"), ("<div class='sidebar-right widget'><main>", "</main></div>"),
                 ("<form method=post><div>", "</div></form>"), ("<div class=sidebar><article>", "</article></div>"), ("<div class=comments><p>", "</p></div>"),
                 ("<article class=card>Teaser</article><div>", "</div>")]:
        page = f"<body><nav>Menu</nav><div class=sidebar>Links</div>{a}<p>{prose}1<p>{prose}2<aside>Side</aside>{b}<div class='ad'>Buy</div><footer>End</footer>"
        kept = [t for t, k in extract.lines_of(page) if k]
        assert kept == ["Teaser"] * ("Teaser" in page) + [f"{prose}1", f"{prose}2"], a
    page = f"<body><article><p>{prose}1</article><div id=comments>" + f"<article><p>{prose}2</article>" * 5 + f"</div><div class=sidebar><article>{prose}3</article></div>"
    assert [t for t, k in extract.lines_of(page) if k] == [f"{prose}1"]
    extract.lines_of("<div class=ad>" * 20000 + "x")


def test_topics_inside_an_article_are_no_chrome():
    long = "This paragraph is long enough to count as running text of the article it stands in, without doubt."
    for part in ['<h2 id="related-work">{}</h2>', '<h2 id="social-impact">{}</h2>', '<section id="consent-and-ethics">{}</section>',
                 '<section class="menu-design">{}</section>', '<div class="ad-hoc-tests">{}</div>', '<p class="notice-period">{}</p>', '<h3 id="comments">{}</h3>']:
        page = f"<body><article><p>{long}</p>{part.format('The topic')}<p>{long}</p></article></body>"
        assert [t for t, k in extract.lines_of(page) if k] == [long, "The topic", long], part
    for part in ['<div class="ad">{}</div>', '<div class="share-buttons">{}</div>', '<div class="related-posts">{}</div>', '<ul class="social_links">{}</ul>']:
        page = f"<body><article><p>{long}</p>{part.format('Gone')}<p>{long}</p></article></body>"
        assert [t for t, k in extract.lines_of(page) if k] == [long, long], part
