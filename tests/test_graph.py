import random

from pyspark.sql import functions as F

from sitegrid.operators import artefacts as O
from sitegrid.operators import audit as D
from sitegrid.operators import dedupe
from sitegrid.operators import links as L
from sitegrid.operators.ranking import numbered, running, top_per_key
from sitegrid.sources import robots as SR
from sitegrid.sources.pages import with_shingles

from .graphs import roots

LINK = "run_id string, site string, from_url string, pos int, resolved string, anchor string, nofollow boolean, in_nav boolean, in_footer boolean"


def link_table(spark, edges, site="e.com"):
    rows = [("r", site, f"https://{site}/{a}", i, f"https://{site}/{b}", "x", False, False, False) for i, (a, b) in enumerate(edges)]
    return spark.createDataFrame(rows, LINK)


def test_reach_equals_breadth_first_search(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(90)]
    seeds = [50, 55]
    want, level, depth = {0: 0}, [0], 0
    while level or depth == 0:
        depth += 1
        nxt = {b for a, b in edges if a in level} | (set(seeds) if depth == 1 else set())
        level = [b for b in nxt if b not in want]
        want.update({b: depth for b in level})
        if not level:
            break
    starts = spark.createDataFrame([("r", "e.com", "https://e.com/0")], "run_id string, site string, url string")
    sm = spark.createDataFrame([("r", "e.com", f"https://e.com/{s}") for s in seeds], "run_id string, site string, loc string")
    reach = L.crawl_reach(link_table(spark, edges), starts, sm)
    got = {int(r.url.rsplit("/", 1)[1]): r for r in reach.collect()}
    assert {k: r.depth for k, r in got.items()} == want
    assert all(got[s].via == "sitemap" and got[s].referrer is None for s in seeds if s != 0)
    assert got[0].via == "start"


def test_reach_of_chain_loops_and_limits(spark):
    edges = [(i, i + 1) for i in range(9)] + [(9, 3), (5, 5)]
    starts = spark.createDataFrame([("r", "e.com", "https://e.com/0")] * 2 + [("r", "e.com", None), (None, "e.com", "https://e.com/0")],
                                   "run_id string, site string, url string")
    links = link_table(spark, edges)
    got = L.crawl_reach(links, starts).filter("run_id is not null").collect()
    assert sorted((r.depth, r.url, r.referrer) for r in got) == [
        (i, f"https://e.com/{i}", f"https://e.com/{i - 1}" if i else None) for i in range(10)]
    assert {r.depth for r in L.crawl_reach(links, starts, max_depth=3).collect()} == {0, 1, 2, 3}
    assert L.crawl_reach(links, starts, max_depth=0).count() == 2
    assert L.crawl_reach(links, starts.limit(0)).collect() == [] and L.crawl_reach(links.limit(0), starts).count() == 2


def test_robots_groups_and_longest_match(spark):
    txt = ("Disallow: /early\nUser-agent: *\nDisallow: /\nUser-agent: google\nUser-agent: Googlebot # ours\nDisallow: /a\nAllow: /a/b\n"
           "Disallow: /a/b/c$\nUser-agent: later\nDisallow: /z")
    rules, _ = SR.read_robots(spark.createDataFrame([("r", "e.com", 200, txt)], "run_id string, site string, status int, body string"))
    assert rules.filter("agent = '*' and grp = 0").count() == 1
    pages = spark.createDataFrame([("r", "e.com", f"https://e.com{p}", True, "") for p in ("/", "/a", "/a/b", "/a/b/c", "/a/b/cd", "/z")]
                                  + [("r", "free.com", "https://free.com/a", True, "")],
                                  "run_id string, site string, url string, robots_allowed boolean, robots_rule string")
    got = {r.url: (r.robots_allowed, r.robots_rule) for r in L.robots_allowed(pages, rules).collect()}
    assert got["https://e.com/"] == (True, None) and got["https://e.com/a"] == (False, "/a")
    assert got["https://e.com/a/b"] == (True, "/a/b") and got["https://e.com/a/b/c"] == (False, "/a/b/c$")
    assert got["https://e.com/a/b/cd"] == (True, "/a/b") and got["https://free.com/a"] == (True, None)
    other = {r.url: r.robots_allowed for r in L.robots_allowed(pages, rules, "somebot").collect()}
    assert all(other.values())          # the first wildcard group holds, and it blocks /early only


def test_redirect_chains(spark):
    hops = [(i, i + 1) for i in range(12)] + [(20, 21), (21, 20), (30, 30), (40, 41)]
    df = spark.createDataFrame([("r", "s", str(a), str(b), 301) for a, b in hops], "run_id string, site string, from string, to string, status int")
    got = {r.url: (r.final_url, r.hops, r.error) for r in L.redirect_chains(df).collect()}
    assert got["40"] == ("41", 1, None) and got["10"] == ("12", 2, None)
    assert got["0"] == ("8", 8, "too_many_redirects") and got["4"] == ("12", 8, None)
    assert got["20"] == ("20", 2, "redirect_loop") and got["30"][2] == "redirect_loop"


def test_near_duplicates_equal_all_pairs_even_when_split(spark):
    rnd = random.Random(3)
    base = [f"s{i}" for i in range(40)]
    rows = []
    for d in range(60):
        s = list(base) if d % 2 else [f"t{d}_{i}" for i in range(30)] + base[:10]
        for _ in range(rnd.randrange(4)):
            s[rnd.randrange(len(s))] = f"x{rnd.randrange(1000)}"
        rows.append(("r", "s", f"u{d:03}", f"h{d if d % 7 else 0}", sorted(set(s))))
    df = spark.createDataFrame(rows, "run_id string, site string, url string, content_hash string, shingles array<string>")
    groups = {}
    for _, _, u, h, s in rows:
        groups.setdefault(h, (u, set(s)))
    names = sorted(groups.values())
    want = {(a, b) for i, (a, sa) in enumerate(names) for b, sb in names[i + 1:] if len(sa & sb) / len(sa | sb) >= 0.85}
    assert len(want) > 20
    for block in (4, 512):
        got = dedupe.near_duplicates(df, 0.85, block).select("url_a", "url_b").collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_near_duplicate_rule_reads_whole_texts(spark):
    rnd = random.Random(8)
    long = [f"w{rnd.randrange(10**6)}" for _ in range(6000)]
    texts = {"a": long, "shifted": ["first", *long], "tail": [*long[:3600], *(f"t{i}" for i in range(2400))],
             "longer": [*long, *(f"v{i}" for i in range(700))]}
    rows = [("r", "s", u, f"h{u}", " ".join(w), len(w), 200, False, True, "text/html") for u, w in texts.items()]
    df = spark.createDataFrame(rows, "run_id string, site string, url string, content_hash string, body_text string, word_count int, status int, "
                                     "noindex boolean, robots_allowed boolean, content_type string")
    sets = {u: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} for u, w in texts.items()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.85}
    assert want == {("a", "longer"), ("a", "shifted"), ("longer", "shifted")}
    assert {(r.url, r.detail.split(" ")[1]) for r in D.near_duplicate_hits(df).collect()} == want
    got = dedupe.near_duplicates(with_shingles(df)).select("url_a", "url_b").collect()
    assert {tuple(r) for r in got} == want


def test_near_duplicate_families_are_linear(spark):
    rnd = random.Random(5)
    base = [f"s{i}" for i in range(60)]
    rows, sets = [], {}
    for d in range(400):  # one family around a base, a chain, copies, strays
        s = list(base)
        if d >= 300:
            s = [f"c{(d - 300) * 4 + i}" for i in range(60)] if d < 360 else [f"z{d}_{i}" for i in range(20)] + base[:20]
        elif d:
            s[rnd.randrange(60)] = f"x{d}"
        rows.append(("r", "s" if d % 50 else "other", f"u{d:03}", f"h{d if d % 9 else 0}", s))
    rows += [("r", "s", "v1", "e1", []), ("r", None, "v2", "e2", base), (None, "s", "v3", "e3", base)]
    df = spark.createDataFrame(rows, "run_id string, site string, url string, content_hash string, shingles array<string>")
    for r, site, u, h, s in rows:
        if s and site and r:
            sets.setdefault((site, h), (u, set(s), []))[2].append(u)
    keys = sorted(sets)

    def score(a, b):
        return len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1])

    links = [(a, b) for a in keys for b in keys if a < b and a[0] == b[0] and score(a, b) >= 0.85]
    root = roots({n for e in links for n in e}, links)
    families = {}
    for n, k in root.items():
        families.setdefault(k, []).append(n)
    want = {}
    for members in families.values():
        head = min(members, key=lambda n: sets[n][0])
        for n in members:
            want[n[0], sets[n][0]] = (len(sets[n][2]), sets[head][0], round(score(n, head), 9), len(members))
    assert len(links) > 5000 and max(len(m) for m in families.values()) > 200
    for large in (4, 1000):
        got = dedupe.near_duplicate_families(df, 0.85, large).collect()
        assert {(r.site, r.url): (r.copies, r.representative, round(r.score, 9), r.family_size) for r in got} == want and len(got) == len(want)
    assert dedupe.near_duplicate_families(df.limit(0)).count() == 0


def test_redirect_map_equals_all_pairs_for_any_split(spark):
    rnd = random.Random(11)
    words = ["red", "blue", "shoes", "boots", "sale", "kids", "men", "guide"]
    new = [(f"https://n.com/{'-'.join(rnd.sample(words, rnd.randint(1, 3)))}/{i:03}x", " ".join(rnd.sample(words, 2))) for i in range(40)]
    old = sorted({f"https://o.com/{'/'.join(rnd.sample(words, rnd.randint(1, 4)))}.html" for _ in range(25)} | {"https://o.com/nothing-like"})
    import re

    def tokens(u):
        path = re.sub("^https://[^/]+", "", u).lower()
        return [t for t in re.split("[^a-z0-9]+", path) if len(t) > 2 and t not in ("www", "com", "html", "php", "index", "page")]

    want = {}
    for o in old:
        t = tokens(o)
        scored = []
        for u, title in new:
            a, b = set(t), set(tokens(u))
            s = len(a & b) / len(a | b) * 0.7 + sum(x in title.split() for x in t) / len(t) * 0.3
            scored.append((-s, u))
        s, u = min(scored)
        want[o] = ("" if -s < 0.25 else u, int(-s * 100 + 0.5))
    pages = spark.createDataFrame([("r", "s", u, t, [], 200, False) for u, t in new],
                                  "run_id string, site string, url string, title string, h1s array<string>, status int, noindex boolean")
    olds = spark.createDataFrame([("r", "s", o) for o in old], "run_id string, site string, url string")
    for hot in (0, 5, 1000):
        got = {r.from_url: (r.to_url, r.score) for r in O.redirect_map(olds, pages, hot).collect()}
        assert got == want, hot


def test_sitemap_indexes_of_any_depth(spark):
    def index(*names):
        return "<sitemapindex>" + "".join(f"<sitemap><loc>https://x.com/{n}</loc></sitemap>" for n in names) + "</sitemapindex>"

    docs = [("r", "s", f"https://x.com/i{k}", index(f"i{k + 1}", "i0")) for k in range(7)]
    docs += [("r", "s", "https://x.com/i7", "<urlset><url><loc>https://x.com/page</loc></url></urlset>")]
    df = spark.createDataFrame(docs, "run_id string, site string, url string, body string")
    roots = spark.createDataFrame([("r", "s", "https://x.com/i0")], "run_id string, site string, sitemap string")
    assert [r["loc"] for r in SR.read_sitemaps(df, roots).collect()] == ["https://x.com/page"]
    assert SR.read_sitemaps(df, roots, 4).count() == 0


def test_ranking_helpers(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i, i % 4) for i in range(200)], "k string, i int, v int")
    for name, out in (("rn", numbered(df, ["k"], ["i"])), ("total", running(df, ["k"], ["i"], F.col("v"), "total"))):
        seen = {}
        for r in sorted(out.collect(), key=lambda r: r.i):
            seen[r.k] = seen.get(r.k, 0) + (1 if name == "rn" else r.v)
            assert r[name] == seen[r.k]
    assert top_per_key(df, ["k"], [F.desc("i")], 2).count() == 4


def test_opportunities(spark):
    pages = spark.createDataFrame(
        [("r", "e.com", f"https://e.com/{u}", t, [], b, 200, False) for u, t, b in (
            ("target", "Widget repair guide", "x"), ("mentions", "Other", "We love widget repair here. Call us."),
            ("linked", "Else", "Our widget repair page."), ("silent", "None", "Nothing at all."))],
        "run_id string, site string, url string, title string, h1s array<string>, body_text string, status int, noindex boolean")
    links = link_table(spark, [("linked", "target")])
    targets = pages.filter("title like 'Widget%'").select("run_id", "site", "url")
    got = L.link_opportunities(pages, links, targets).collect()
    assert [(r.from_url, r.suggested_anchor, r.context) for r in got] == [
        ("https://e.com/mentions", "widget repair", "We love widget repair here.")]
    asked = targets.withColumn("subject", F.lit("Widget repair"))
    assert [r.from_url for r in L.mention_candidates(pages, links, asked).collect()] == ["https://e.com/mentions"]
    more = pages.unionByName(pages.filter("title = 'Other'").withColumn("url", F.lit("https://e.com/again")))
    for find in (lambda k: L.link_opportunities(more, links, targets, k), lambda k: L.mention_candidates(more, links, asked, k)):
        for k in (1, None):
            got = sorted((r.rank, r.from_url, r.total) for r in find(k).collect())
            assert got == [(1, "https://e.com/again", 2), (2, "https://e.com/mentions", 2)][:k]


def test_page_text_is_never_broadcast(spark, monkeypatch):
    pages = L.stage_table(spark.createDataFrame(
        [("r", "e.com", f"https://e.com/{i}", "Widget repair", ["Widget repair"], "We love widget repair here.", 200, False) for i in range(4)],
        "run_id string, site string, url string, title string, h1s array<string>, body_text string, status int, noindex boolean"))
    links = L.stage_table(spark.createDataFrame([("r", "e.com", "https://e.com/0", "https://e.com/1", False, False)],
                                  "run_id string, site string, from_url string, resolved string, in_nav boolean, in_footer boolean"))
    targets = pages.filter("url = 'https://e.com/0'").select("run_id", "site", "url", F.col("title").alias("subject"))
    staged, stage = [], L.stage_table
    monkeypatch.setattr(L, "stage_table", lambda df: staged.append(df) or stage(df))
    assert L.link_opportunities(pages, links, targets.drop("subject")).count() == 3
    assert L.mention_candidates(pages, links, targets).count() == 3
    for df in staged:
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan
        for line in plan.splitlines():
            assert "BroadcastHashJoin" not in line or "term" not in line and "from_url" not in line, line
