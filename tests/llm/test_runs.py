"""Periodic runs against a plain search at every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from sitegrid.llm import runs
from sitegrid.llm.queries import QUERIES

from .cases import awkward, frame


def plain(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in found.items())


def expected(doc_id, text):
    words = [x.decode() for x in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted((a, q, b - a) for a, b, q in plain(words))
    best = min(found, key=lambda r: (-r[2], r[0], r[1]), default=None)
    kept = [x for k, x in enumerate(words) if not any(a + q <= k < a + size for a, q, size in found)]
    said = "".join(f"{a},{size},{q}\n" for a, q, size in found)
    return (doc_id, len(found), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4),
            hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_runs_of_small_alphabets():
    r = random.Random(1)
    for _ in range(1500):
        docs = []
        for _ in range(r.randint(1, 4)):
            n = r.randint(0, 60)
            w = [r.randrange(r.randint(1, 3)) for _ in range(n)]
            if n > 3 and r.random() < 0.5:
                a, p = r.randrange(n), r.randint(1, 12)
                w = [w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)]
                if r.random() < 0.3:
                    w[r.randrange(n)] = 5
            docs.append(w)
        at = np.cumsum([0] + [len(w) for w in docs])
        want = sorted((a + at[d], b + at[d], q) for d, w in enumerate(docs) for a, b, q in plain(w))
        got = runs.periodic_runs(np.array(sum(docs, []), np.int64), np.repeat(np.arange(len(docs)), [len(w) for w in docs]))
        assert got == want, docs


def test_long_and_uniform_texts():
    assert runs.periodic_runs(np.zeros(30_000, np.int64), np.zeros(30_000, np.int64)) == [(0, 30_000, 1)]
    w = np.tile(np.arange(1000), 30)
    assert runs.periodic_runs(w, np.zeros(len(w), np.int64)) == [(0, 30_000, 1000)]
    with pytest.raises(ValueError):
        runs.periodic_runs(w, w, 3, 2)


def test_awkward_rows(spark, monkeypatch):
    rows = awkward() + [(300 + i, "a b c d " * (3 + i % 7) + "tail", None, None, None, None, None) for i in range(60)]
    for size in (runs.CHUNK_WORDS, 500):
        monkeypatch.setattr(runs, "CHUNK_WORDS", size)
        found = runs.find_runs(frame(spark, rows).repartition(2), rewrite=True).collect()
        got = sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli,
                       hashlib.sha256("".join(f"{x.start},{x.length},{x.period}\n" for x in r.runs).encode()).hexdigest(),
                       hashlib.sha256(r.collapsed).hexdigest()) for r in found), key=repr)
        assert got == sorted((expected(r[0], r[1]) for r in rows), key=repr)
    plain_text = runs.find_runs(frame(spark, [(1, "x y " * 9, "en", "s", 1, "k", "n")])).first()
    assert (plain_text.n_runs, plain_text.length, plain_text.collapsed) == (1, 18, b"x y")
    assert runs.find_runs(frame(spark, [])).count() == 0


def test_query_on_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = QUERIES["op11_maximal_pairs"](spark, folder)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(expected(d.doc_id, d.text) for d in docs)
