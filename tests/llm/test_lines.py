import random
import re

from sitegrid.llm import lines
from sitegrid.llm.queries import QUERIES

from .cases import frame, roots


def brute(texts, most=10**9):
    """Kept lines by all pairs of distinct lines that share a shingle."""
    at, sets, holders = {}, {}, {}
    for d, t in sorted(texts.items()):
        for i, s in enumerate((t or "").lower().split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", s):
                at.setdefault(s, []).append((d, i))
    for s in at:
        sets[s] = {s[i:i + 8] for i in range(max(1, len(s) - 7))}
        for x in sets[s]:
            holders.setdefault(x, []).append(s)
    pairs = {(a, b) for h in holders.values() if len(h) < most for a in h for b in h if a < b}
    links = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = roots(sorted(at), links)
    first = {}
    for s, places in at.items():
        first[root[s]] = min([first.get(root[s], (10**18, 0)), *places])
    return {(d, i): (d, i) == first[root[s]] for s, places in at.items() for d, i in places}, len(links)


def test_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want, links = brute(texts, 40)  # a near copy shares a rare shingle
    got = {(r.doc_id, r.line): r.kept for r in QUERIES["op2_fuzzy_lines"](spark, folder).collect()}
    assert got.keys() == want.keys() and links > 0
    wrong = [k for k in want if want[k] != got[k]]
    assert len(wrong) <= 0.002 * len(want), (len(wrong), len(want))


def test_families_and_awkward_rows(spark):
    r = random.Random(6)
    base = " ".join(f"word{r.randint(0, 999)}" for _ in range(40))
    family = []
    for i in range(150):
        w = base.split()
        for _ in range(r.randint(0, 2)):
            w[r.randrange(40)] = f"other{r.randint(0, 9999)}"
        family.append((500 + i, " ".join(w) + "\nshared line\n" + f"own line number {i * 7919}", "en", "s", 1, "x", "y"))
    docs = frame(spark).union(frame(spark, family))
    got = lines.dedupe_lines(docs).collect()
    texts = {(r.doc_id if r.doc_id is not None else -2**63): r.text for r in docs.collect()}
    want, _ = brute(texts)
    keep = {(r.k1, r.line): r.kept for r in got}
    assert keep.keys() == want.keys()
    assert sum(keep[k] != want[k] for k in want) <= 2
    out = {r.doc_id: r for r in lines.without_repeats(docs).collect()}
    assert lines.without_repeats(docs).count() == docs.count() and lines.without_repeats(docs).columns == docs.columns
    for d, t in texts.items():
        if t is not None:
            left = [s for i, s in enumerate(t.split("\n")) if keep.get((d, i), True)]
            assert out[None if d == -2**63 else d].text == "\n".join(left)
    assert out[202].text is None
    assert lines.dedupe_lines(docs.limit(0)).collect() == []


def test_chunks_give_the_same_signature(monkeypatch):
    r = random.Random(2)
    text = "\n".join("".join(r.choice("abcdeé\U0001f600 ") for _ in range(r.choice([0, 3, 8, 9, 200]))) for _ in range(300))
    whole, some = lines.signatures(text)
    for size in (16, 64, 1000):
        monkeypatch.setattr(lines, "_CHUNK", size)
        got, has = lines.signatures(text)
        assert (got == whole).all() and (has == some).all()
    assert lines.signatures("")[1].tolist() == [False]


def test_pairs_grow_with_the_lines_not_their_square(spark, monkeypatch):
    """A family of near equal lines and a few strangers that share its passage."""
    r = random.Random(11)
    base = [f"word{r.randint(0, 999)}" for _ in range(60)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(2 if i % 20 else 18):
            w[r.randrange(60)] = f"other{r.randint(0, 9999)}"
        rows.append((500 + i, " ".join(w), "en", "s", 1, "x", "y"))
    seen = []

    def spy(members, verify, refine, **how):
        def counted(pairs):
            seen.append(pairs.count())
            return verify(pairs)
        return link(members, counted, refine, **how)
    link = lines.link_families
    monkeypatch.setattr(lines, "link_families", spy)
    got = {(x.doc_id, x.line): x.kept for x in lines.dedupe_lines(frame(spark, rows)).collect()}
    want, links = brute({x[0]: x[1] for x in rows})
    assert got == want and links > 5 * sum(seen), (links, seen)


def test_rarest_shingles(spark):
    """The packed passes against their definition: by holders, then by hash; own ones first."""
    r = random.Random(4)
    parts = ["".join(r.choice("abcdef gé") for _ in range(30)) for _ in range(12)]
    texts = {i: "".join(r.choice(parts) for _ in range(r.randint(1, 5))) + "x" * r.randint(0, 3) for i in range(80)}
    sets = {i: lines._shingles(s).astype("int64").tolist() for i, s in texts.items()}
    df = {}
    for h in sets.values():
        for x in h:
            df[x] = df.get(x, 0) + 1
    want = set()
    for i, h in sets.items():
        order = sorted(h, key=lambda x: (df[x], x))
        keep = len(h) - -(-len(h) * 8 // 10) + 1
        own = sum(df[x] == 1 for x in h)
        want |= {(order[p], i, len(h), p, tuple(order[own:p])) for p in range(own, keep)}
    got = lines._rarest_first(spark.createDataFrame(list(texts.items()), "node long, s string"), 0.8).collect()
    assert {(x.bucket, x.node, x.n, x.p, tuple(x.before)) for x in got} == want and len(got) == len(want) > 0
