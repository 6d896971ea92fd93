import random

from pyspark.sql import functions as F

from sitegrid import fixed_values as V
from .graphs import roots
from sitegrid.operators import answers as J
from sitegrid.operators import demand as I
from sitegrid.operators import summarise as N


def tokens(k):
    return [w for w in k.split() if len(w) > 2 and w not in V.KEYWORD_STOP]


def test_greedy_clusters_follow_the_definition(spark):
    rnd = random.Random(2)
    words = ["red", "blue", "shoe", "boot", "sale", "kids", "price", "best", "near"]
    rows = [(f"s{i % 2}", " ".join(rnd.sample(words, rnd.randint(1, 4))), rnd.randrange(5)) for i in range(80)]
    rows = sorted({(s, k): b for s, k, b in rows}.items())
    df = spark.createDataFrame([(s, k, b, "unclear") for (s, k), b in rows], "seed string, keyword string, breadth bigint, intent string")
    want = {}
    for seed in ("s0", "s1"):
        clusters = []
        for (_, k), _b in sorted((r for r in rows if r[0][0] == seed), key=lambda r: (-r[1], r[0][1])):
            t = tokens(k)
            scores = [sum(x in c[0] for x in t) / len(t) if t else 0 for c in clusters]
            if scores and max(scores) >= 0.5:
                c = clusters[scores.index(max(scores))]
                c[0].update(t)
                c[1].append(k)
            else:
                clusters.append((set(t), [k]))
        want[seed] = sorted(sorted(c[1]) for c in clusters)
    m = I.cluster_members(df).cache()
    got = {s: sorted(sorted(r.keyword for r in m.filter(F.col("seed") == s).collect() if r.cluster == c)
                     for c in {r.cluster for r in m.filter(F.col("seed") == s).collect()}) for s in want}
    assert got == want
    assert m.count() == df.count() and m.columns == ["seed", "keyword", "breadth", "intent", "cluster"]


def test_greedy_clusters_in_blocks(spark):
    """Any block size gives the plain loop's clusters, on a chain that takes one keyword at a time too."""
    rnd = random.Random(9)
    vocab = [f"word{i:02}" for i in range(14)]
    rows = {("s", " ".join(rnd.sample(vocab, rnd.randint(1, 5)))) for _ in range(60)} | {
        ("t", f"link{i:02} link{i + 1:02}") for i in range(30)} | {("s", "a"), ("u", "b")}
    df = spark.createDataFrame([(s, k, 1, "x") for s, k in sorted(rows)], "seed string, keyword string, breadth bigint, intent string")
    want = {}
    for seed in ("s", "t", "u"):
        clusters = []
        for k in sorted(k for s, k in rows if s == seed):
            t = tokens(k)
            scores = [sum(x in c for x in t) / len(t) if t else 0 for c in clusters]
            best = scores.index(max(scores)) if scores and max(scores) >= 0.5 else len(clusters)
            clusters[best:] = clusters[best:] or [set()]
            clusters[best] |= set(t)
            want[seed, k] = str(best)
    rounds = []
    cut = I.Rounds.cut
    for block in (7, 2048):
        try:
            I.Rounds.cut = lambda self, df: rounds.append(block) or cut(self, df)
            got = {(r.seed, r.keyword): r.cluster for r in I.cluster_members(df, block).collect()}
        finally:
            I.Rounds.cut = cut
        assert got == want
    assert rounds.count(2048) == 1


def test_keyword_url_map(spark):
    terms = spark.createDataFrame([("s", "c1", t) for t in ("running", "shoes", "cheap")] + [("s", "c2", "umbrella")],
                                  "seed string, cluster string, term string")
    pages = spark.createDataFrame(
        [(f"u{i}", t, [], [], "", 200, False) for i, t in enumerate(("Running shoes", "Cheap shoes running", "Shoes", "Nothing"))],
        "url string, title string, h1s array<string>, headings array<struct<level:int,text:string>>, body_text string, status int, noindex boolean")
    rows = I.keyword_url_map(terms, pages).collect()
    assert [(r.url, r.score) for r in rows if r.cluster == "c1"] == [("u1", 100), ("u0", 67)]
    assert {r.status for r in rows if r.cluster == "c1"} == {"mapped"}
    assert [(r.status, r.url) for r in rows if r.cluster == "c2"] == [("gap", None)]


def test_pages_with_equal_tokens_are_compared_once(spark, monkeypatch):
    terms = spark.createDataFrame([("s", "c", t) for t in ("running", "shoes", "cheap")], "seed string, cluster string, term string")
    pages = spark.createDataFrame(
        [(f"u{i:02}", ("Cheap running", "Running cheap", "Shoes running cheap")[i % 3], [], [], "", 200, False) for i in range(30)],
        "url string, title string, h1s array<string>, headings array<struct<level:int,text:string>>, body_text string, status int, noindex boolean")
    staged, stage = [], I.stage_table
    monkeypatch.setattr(I, "stage_table", lambda df: staged.append(stage(df)) or staged[-1])
    rows = I.keyword_url_map(terms, pages).collect()
    assert [(r.rank, r.url, r.score, r.status) for r in sorted(rows)] == [
        (i + 1, f"u{2 + 3 * i:02}", 100, "contested") for i in range(4)]
    assert staged and staged[0].count() == 8 and staged[0].filter("nth = 1").count() == 2


def test_long_keywords_meet_in_the_graph(spark):
    rnd = random.Random(6)
    base = [f"tok{i:02}" for i in range(11)]
    words = [("a", " ".join([*base, f"own{i}"])) for i in range(4)] + [("a", "tok01 other"), ("a", "none here")]
    vocab = [f"word{i:02}" for i in range(60)]
    words += [("b", " ".join(rnd.sample(vocab, rnd.choice((1, 2, 3, 9, 10, 11, 12, 15))))) for _ in range(60)]
    words += [("b", "a")]
    df = spark.createDataFrame([(s, k, 1, "x") for s, k in sorted(set(words))], "seed string, keyword string, breadth bigint, intent string")
    for longest in (10, 3):
        got = {}
        for r in I.cluster_keywords_graph(df, longest).collect():
            got.setdefault((r.seed, r.cluster), set()).add(r.keyword)
        rows = sorted(set(words))
        links = [((s, x), (s2, y)) for s, x in rows for s2, y in rows if s == s2 and len(x) > 1 and len(y) > 1
                 and 2 * len(set(x.split()) & set(y.split())) >= min(len(x.split()), len(y.split()))]
        want = {}
        for k, root in roots(rows, links).items():
            want.setdefault(root, set()).add(k[1])
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
        assert set(got[next(k for k in got if k[0] == "a" and len(got[k]) > 2)]) == {k for s, k in words if s == "a" and "tok" in k}


def leaders(rows):
    """Greedy clusters by the plain loop: seed, keyword to cluster number."""
    out = {}
    for seed in {r[0] for r in rows}:
        by, n = {}, 0
        for _, keyword, _, _ in sorted((r for r in rows if r[0] == seed), key=lambda r: (-r[2], r[1])):
            tokens, hits = [t for t in keyword.split() if len(t) > 2], {}
            for t in tokens:
                for c in by.get(t, ()):
                    hits[c] = hits.get(c, 0) + 1
            best = max(hits, key=lambda c: (hits[c], -c)) if hits else None
            if best is None or hits[best] / len(tokens) < 0.5:
                best, n = n, n + 1
            for t in tokens:
                by.setdefault(t, set()).add(best)
            out[seed, keyword] = str(best)
    return out


def test_leader_clusters_equal_the_plain_loop(spark):
    rnd = random.Random(5)
    rows = []
    for seed, size, hot, n in [("a", 200, "", 120), ("b", 60, "", 120), ("hot", 120, "hot pair ", 300), ("dense", 15, "hot ", 60)]:
        keys = {hot + " ".join(f"tok{rnd.randrange(size):03}" for _ in range(rnd.randint(1, 5))) + rnd.choice(["", "", " x"]) for _ in range(n)}
        rows += [(seed, k, rnd.randint(1, 4), "x") for k in sorted(keys)]
    rows += [("none", "a b", 1, "x"), ("none", "c", 1, "x"), ("none", "tok001 tok001", 1, "x")]
    df = spark.createDataFrame(rows, "seed string, keyword string, breadth bigint, intent string")
    got = {(r.seed, r.keyword): r.cluster for r in I.cluster_members(df).collect()}
    assert got == leaders(rows)


def test_cluster_queries_equal_the_plain_loop(spark):
    from sitegrid.plans import adapters, load_queries
    from sitegrid.plans.registry import QUERIES
    load_queries()
    folder = "/root/testdata/sf0.001"
    kw = I.keyword_breadth(adapters.suggestions(spark, folder)).collect()
    want = {}
    stop = set(V.KEYWORD_STOP)
    for seed, keyword, breadth, intent in [(r.seed, r.keyword, r.breadth, r.intent) for r in kw]:
        want.setdefault(seed, []).append((seed, keyword, breadth, intent))
    import re
    groups = {}
    for seed, rows in want.items():
        by, n = {}, 0
        for r in sorted(rows, key=lambda r: (-r[2], r[1])):
            tokens = [t for t in (re.sub("[^a-z0-9]", "", w) for w in r[1].split()) if len(t) > 2 and t not in stop]
            hits = {}
            for t in tokens:
                for c in by.get(t, ()):
                    hits[c] = hits.get(c, 0) + 1
            best = max(hits, key=lambda c: (hits[c], -c)) if hits else None
            if best is None or hits[best] / len(tokens) < 0.5:
                best, n = n, n + 1
            for t in tokens:
                by.setdefault(t, set()).add(best)
            groups.setdefault((seed, str(best)), []).append(r)
    rows = {(s, c): (min((-b, len(k), k) for _, k, b, _ in m)[2], len(m)) for (s, c), m in groups.items()}
    got = {(r.seed, r.cluster): (r.label, r["size"]) for r in QUERIES["cluster_keywords"](spark, folder).collect()}
    assert got == rows


def test_keyword_map_reads_whole_pages_and_clusters(spark):
    members = spark.createDataFrame([("s", "c", f"term{i:02} word", 20 - i) for i in range(12)], "seed string, cluster string, keyword string, breadth int")
    label = spark.createDataFrame([("s", "c", "term00 word")], "seed string, cluster string, label string")
    terms = I.cluster_terms(members, label)
    assert {r.term for r in terms.collect()} == {f"term{i:02}" for i in range(12)} | {"word"}
    body = "filler " * 1000 + " ".join(f"term{i:02}" for i in range(12))
    pages = spark.createDataFrame([("u", "Title", [], [], body, 200, False)], "url string, title string, h1s array<string>, "
                                  "headings array<struct<level:int,text:string>>, body_text string, status int, noindex boolean")
    assert [(r.status, r.url, r.score) for r in I.keyword_url_map(terms, pages).collect()] == [("mapped", "u", 92)]


def test_topic_gap(spark):
    ours = spark.createDataFrame([("Blue Widgets Repair",)], "text string")
    theirs = spark.createDataFrame([("Garden Sheds guide",), ("Best garden sheds",), ("Blue widgets",), ("Blue widgets",)], "text string")
    assert [(r.topic, r.their_pages) for r in I.topic_gap(ours, theirs).collect()] == [("garden sheds", 2)]


def test_breadth_and_questions(spark):
    s = spark.createDataFrame([("shoes", "Shoes ", 0), ("shoes", "buy shoes", 3), ("shoes", "Buy Shoes", 1), ("shoes", "how to lace", 2)],
                              "seed string, suggestion string, rank int")
    k = {r.keyword: r for r in I.keyword_breadth(s).collect()}
    assert set(k) == {"buy shoes", "how to lace"} and (k["buy shoes"].breadth, k["buy shoes"].best_rank) == (2, 1)
    assert k["buy shoes"].intent == "transactional" and k["how to lace"].is_question
    assert I.question_set(s).count() == 1 and I.keyword_probes(s.select("seed").distinct()).count() == 52


def brands(spark, text, known=()):
    return spark.createDataFrame([(text,)], "t string").select(J.detect_brands(F.col("t"), list(known))).first()[0]


def test_brand_detection(spark):
    assert brands(spark, "Try Cedar & Cup or Stride today. The Bean Co is fine.", ["Stride"]) == ["Stride", "Try Cedar", "Cup"]
    got = brands(spark, "visit Northern Roast, also Cup Works and again Northern Roast.")
    assert got == ["Northern Roast", "Cup Works"]
    df = spark.createDataFrame([("A strident tone",), ("Use Stride!",), ("see stride.co.uk",), ("see stride.com/x",)], "t string")
    assert [r[0] for r in df.select(J.brand_named(F.col("t"), "Stride")).collect()] == [False, True, True, True]
    assert [r[0] for r in df.select(J.domain_cited(F.col("t"), "https://www.stride.com/")).collect()] == [False, False, False, True]


def test_sentiment_only_near_the_brand(spark):
    df = spark.createDataFrame([("Acme is the best and reliable. Others are poor.",), ("Acme exists. It is great.",), ("No one.",),
                                ("Acme is expensive.",)], "t string")
    assert [r[0] for r in df.select(J.brand_sentiment(F.col("t"), "Acme")).collect()] == [10.0, 5.0, None, 0.0]


def test_visibility(spark):
    a = spark.createDataFrame([("r1", "p", "x", "Acme rules, see acme.com.", None), ("r1", "p", "y", "nothing here", None),
                               ("r1", "p", "z", None, "timeout"), ("r2", "p", "x", None, "timeout"), ("r3", "p", "x", "Acme and Acme", None)],
                              "run_id string, prompt string, provider string, answer string, error string")
    s = J.score_answers(a, "Acme", "acme.com")
    v = {r.run_id: r for r in J.visibility_score(s).collect()}
    assert (v["r1"].score, v["r1"].named_rate, v["r1"].answered, v["r1"].attempted) == (50, 50, 2, 3)
    assert v["r2"].score is None and v["r2"].answered == 0 and v["r3"].score == 60
    p = J.visibility_by_prompt(s).first()
    assert (p.visibility, p.trend, p.samples) == (67, 0, 3)
    assert J.visibility_by_prompt(s.filter("run_id = 'r1'")).first().trend is None
    sov = J.share_of_voice(s, "Acme").filter("run_id = 'r3'").first()
    assert sov.brand == "Acme" and sov.own and sov.share == 100


def reference_summary(text, k=3):
    import re
    stop = set(V.SUMMARY_STOP.split())
    sents = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if len(s.strip()) > 30]
    if len(sents) <= k:
        return sents

    def words(s):
        return [w for w in re.findall(r"[a-z][a-z'-]+", s.lower()) if w not in stop]
    freq = {}
    for s in sents:
        for w in words(s):
            if len(w) > 2:
                freq[w] = freq.get(w, 0) + 1
    peak = max(freq.values())
    scored = []
    for i, s in enumerate(sents):
        ws = [w for w in words(s) if len(w) > 2]
        tf = sum(freq[w] / peak for w in ws) / len(ws) if ws else 0
        pos = 1.35 if i == 0 else 1.15 if i == 1 else 1.05 if i < len(sents) * 0.3 else 1
        scored.append((-round(tf * pos * (0.8 if len(s) > 260 else 0.85 if len(s) < 60 else 1), 9), i))
    chosen = []
    for _, i in sorted(scored):
        a = set(words(sents[i]))
        if len(chosen) < k and not any(len(a & set(words(sents[c]))) / min(len(a), len(set(words(sents[c])))) > 0.7 for c in chosen):
            chosen.append(i)
    return [sents[i] for i in sorted(chosen)]


def test_summaries(spark):
    rnd = random.Random(4)
    vocab = [f"term{c}{d}" for c in "abcdef" for d in "xyz"]
    texts = [" ".join("The " + " ".join(rnd.choice(vocab) for _ in range(rnd.randint(6, 14))) + "." for _ in range(n)) for n in (2, 6, 12, 20)]
    texts.append(texts[1] + " " + texts[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.sentences for r in N.summarize(df).collect()}
    assert got == {i: reference_summary(t) for i, t in enumerate(texts)}
    for r in N.excerpt(df).collect():
        assert len(r.summary) <= 156 or r.doc_id == 0
