"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from sitegrid.llm import phrases

from .cases import awkward, frame


def pieces(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", lowered)]


def counted(rows):
    f = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        for p in pieces(text):
            for k in (1, 2, 3):
                for i in range(len(p) - k + 1):
                    f["und" if lang is None else lang][tuple(p[i:i + k])] += 1
    return f


def expected(rows, least, top):
    out = []
    for lang, f in counted(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        some = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in some.items():
            if any(100 * b >= 50 * a for q, b in some.items() if len(q) > len(p) and p in (q[:2], q[1:])):
                continue
            score, _, left, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, r))
        for rank, (s, a, p, left, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, r, n, -s))
    return sorted(out)


def test_quicksort_counts_groups():
    r = np.random.default_rng(1)
    for depth, m, v in [(1, 0, 1), (1, 1, 1), (3, 500, 3), (2, 3000, 40), (3, 5000, 2), (3, 400, 400)]:
        keys, weights = r.integers(0, v, (m, depth)).astype(np.int32), r.integers(1, 4, m)
        want = Counter()
        for k, x in zip(map(tuple, keys.tolist()), weights.tolist(), strict=True):
            want[k] += x
        for least in (1, 10):
            at, f = phrases.equal_partitions(keys, weights, least)
            assert dict(zip(map(tuple, keys[at].tolist()), f.tolist(), strict=True)) == {k: c for k, c in want.items() if c >= least}


def test_awkward_rows(spark, monkeypatch):
    rows = awkward()
    r = random.Random(4)
    words = ["Of", "the", "ab", "cd", "É", "x\x1cy", "İ", "zz"]
    for i in range(300):
        rows.append((400 + i, "".join(r.choice(words) + r.choice([" ", " ", "\t", ". ", "\r\n", " , "]) for _ in range(30)), r.choice(["en", None, "und", ""]), "s", 1, "k", "n"))
    rows.append((900, "hot pair " * 3000, "en", "s", 1, "k", "n"))
    for segment in (phrases.SEGMENT, 700):
        monkeypatch.setattr(phrases, "SEGMENT", segment)
        for top in (2000, 5):
            got = phrases.collocations(frame(spark, rows).repartition(3), top=top)
            assert sorted(map(tuple, got.collect())) == expected(rows, 10, top)
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(frame(spark, rows), least=40, top=None).count() == len(expected(rows, 40, 10**9))


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(9_000_000_000, 9_000_000_001, 9_000_000_002)], "a long, l long, r long")
    got = row.select(phrases._score(row["a"], row["l"], row["r"])).first()[0]
    assert got == 10**6 * 9_000_000_000**2 // (9_000_000_001 * 9_000_000_002)
