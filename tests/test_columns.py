from pyspark.sql import functions as F

from sitegrid.functions import robots as R
from sitegrid.functions import text as X
from sitegrid.functions import urls as U


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "t string").select(*cols).first()


def test_normalise_urls(spark):
    cases = [("HTTP://Www.Example.com:80/a/index.html?utm_source=x&b=1#f", "http://www.example.com/a/?b=1"),
             ("https://e.com", "https://e.com/"), ("https://e.com/?q", "https://e.com/?q="), ("mailto:x@e.com", None)]
    for raw, want in cases:
        assert one(spark, raw, U.normalise_absolute(F.col("t")))[0] == want
        if want:
            assert U.resolve_url(raw, None) == want
    base = "https://e.com/a/"
    assert U.resolve_url("/b/#frag", base) == "https://e.com/b/"
    assert U.resolve_url("../c?x=1&gclid=2", base) == "https://e.com/c?x=1"
    assert U.resolve_url("ä b", base) == "https://e.com/a/%C3%A4%20b"
    assert U.resolve_url("http://[bad", base) is None
    df = spark.createDataFrame([("/b/#f", base), (None, base)], "r string, b string")
    assert [r[0] for r in df.select(U.normalise_url("r", "b")).collect()] == ["https://e.com/b/", None]


def test_same_site(spark):
    def same(a, b, sub=False):
        return spark.createDataFrame([(a, b)], "a string, b string").select(
            U.same_site(F.col("a"), F.col("b"), sub)).first()[0]
    assert same("https://www.e.com/", "http://e.com/x")
    assert not same("https://blog.e.com/", "https://e.com/")
    assert same("https://blog.e.com/", "https://e.com/", True)
    assert not same("nonsense", "https://e.com/")


def test_text(spark):
    assert one(spark, "wwww", X.pixel_width(F.col("t")))[0] > one(spark, "iiii", X.pixel_width(F.col("t")))[0]
    assert one(spark, "Aa1 m", X.pixel_width(F.col("t")))[0] == round(12.4 + 10 + 11 + 5.6 + 17)
    assert one(spark, "  a   b\n", X.word_count(F.col("t")))[0] == 2
    assert one(spark, "", X.word_count(F.col("t")))[0] == 0
    assert one(spark, "Call (212) 555-0100 or +1 212.555.0100 or 555-0100", X.phones(F.col("t")))[0] == ["2125550100"]
    got = one(spark, "Dr. Smith wrote a long enough first sentence. Short one. And a second sentence that counts too.",
              X.split_sentences(F.col("t")))[0]
    assert got == ["Dr. Smith wrote a long enough first sentence.", "And a second sentence that counts too."]
    empty = F.create_map().cast("map<string,string>")
    assert one(spark, "individual division", X.detect_platform(F.col("t"), empty))[0] == []
    assert one(spark, "et_pb_row", X.detect_platform(F.col("t"), empty))[0] == ["Divi"]
    hdr = F.create_map(F.lit("cf-ray"), F.lit("1"))
    assert one(spark, "", X.detect_platform(F.col("t"), hdr))[0] == ["Cloudflare"]


def shingle_list(text, n=5, cap=400):
    import re
    words = [w for w in re.sub(r"[^a-z0-9 ]", " ", text.lower()).split() if w]
    seen = []
    for i in range(0, len(words) - n + 1, 2):
        if len(seen) >= cap * 4:
            break
        s = " ".join(words[i:i + n])
        if s not in seen:
            seen.append(s)
    every = max(1, -(-len(seen) // cap))
    return [s for i, s in enumerate(seen) if i % every == 0]


def test_shingles(spark):
    for text in ("one two three four", "a b c d e f g h", " ".join(f"w{i % 37}x{i % 11}" for i in range(5000)),
                 " ".join(f"w{i}" for i in range(3000))):
        assert one(spark, text, X.shingles(F.col("t")))[0] == shingle_list(text)


def test_quantiles(spark):
    for n in (1, 2, 5, 8, 20):
        values = list(range(n))
        df = spark.createDataFrame([(v,) for v in values], "v int")
        for q in (0.5, 0.75, 0.95):
            assert df.agg(X.upper_quantile("v", q)).first()[0] == values[int(n * q)]


def test_robots_patterns(spark):
    def match(pattern, path):
        df = spark.createDataFrame([(pattern, path)], "p string, u string")
        rule = F.struct(F.col("p").alias("path"), R.pattern_regex(F.col("p")).alias("rx"), R.is_plain(F.col("p")).alias("plain"))
        return df.select(R.rule_matches(F.col("u"), rule)).first()[0]
    assert match("/a", "/abc") and not match("/a", "/b") and not match("", "/a")
    assert match("/*.php$", "/x.php") and not match("/*.php$", "/x.php5")
    assert not match("/*.php$", "/a.php/b.php")          # the first match is kept
    assert match("/a*b", "/aXXbYY") and match("/*", "/") and match("*q", "/aq") and match("/x*$", "/xyz")
    assert match("/a.b", "/a.bc") and not match("/a.b", "/aXbc")


def test_robots_pieces_equal_the_regex(spark):
    import random
    import re
    from sitegrid.functions import robots as R
    rnd = random.Random(7)
    rows = []
    for _ in range(3000):
        pattern = "".join(rnd.choice(["/", "a", "b", "*", "a.", "$", "(", "?", "ab"]) for _ in range(rnd.randint(0, 6))) + rnd.choice(["", "", "$", "*", "*$"])
        path = "/" + "".join(rnd.choice(["/", "a", "b", ".", "(", "?", "$"]) for _ in range(rnd.randint(0, 8)))
        if rnd.random() < 0.6:
            pattern = "/" + pattern
        rows.append((pattern, path))

    def plain(pattern, path):
        if not pattern:
            return False
        body = pattern[:-1] if pattern.endswith("$") else pattern
        first, *rest = body.split("*")
        at = len(first) if path.startswith(first) else -1
        for piece in rest:
            if at >= 0 and piece:
                found = path.find(piece, at)
                at = found + len(piece) if found >= 0 else -1
        return at == len(path) if pattern.endswith("$") and not body.endswith("*") else at >= 0

    df = spark.createDataFrame(rows, "p string, u string")
    rule = F.struct(F.col("p").alias("path"), R.pattern_pieces(F.col("p")).alias("pieces"), R.is_anchored(F.col("p")).alias("anchored"),
                    R.is_plain(F.col("p")).alias("plain"), R.pattern_regex(F.col("p")).alias("rx"))
    got = df.select("p", "u", R.path_matches(F.col("u"), rule).alias("m"), R.rule_matches(F.col("u"), rule).alias("by_regex")).collect()
    assert sum(r.m for r in got) > 300
    for r in got:
        assert r.m == plain(r.p, r.u) == r.by_regex, r
