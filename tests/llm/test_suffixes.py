import hashlib
import random
from collections import Counter

import numpy as np

from sitegrid.llm import suffixes
from sitegrid.llm.queries import QUERIES

from .cases import frame


def brute(texts, length=400):
    """Per document (bytes, removed, spans, digest of the rest) by counting all strings."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[i:i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if count[x[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()))
    return out


def test_suffix_order():
    r = np.random.default_rng(3)
    for n, k in ((0, 2), (1, 2), (50, 2), (300, 3), (300, 1), (400, 200)):
        t = r.integers(1, k + 1, n).astype(np.uint8)
        raw = t.tobytes()
        assert suffixes.suffix_array(t).tolist() == sorted(range(n), key=lambda p: raw[p:])
        due = r.random(n) < 0.2
        assert [p for p in suffixes.suffix_array(t, due=due).tolist() if due[p]] == sorted(np.nonzero(due)[0].tolist(), key=lambda p: raw[p:])


def test_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = dict(zip([d.doc_id for d in docs], brute([d.text for d in docs])))
    rows = QUERIES["op6_two_stage_suffixes"](spark, folder).collect()
    assert all(r.has_repeats == (r.n_removed > 0) for r in rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == want and sum(w[1] for w in want.values()) > 0


def test_planted_repeats(spark, monkeypatch):
    r = random.Random(8)

    def text(n):
        return "".join(r.choice("abcdefghij é ") for _ in range(n))

    shared, long = [text(k) for k in (398, 399, 400, 401, 700)], text(3000)
    texts = [text(r.randint(0, 900)) + s + text(r.randint(0, 900)) for s in shared for _ in range(3)]
    texts += [long, long, long[:1500] + "#" + long[1500:], "x" * 9000, "x" * 399, "x" * 10, None, "", "ab" * 700, text(300) + shared[4] + shared[4][:450], text(8000)]
    rows = [(i, t, "en", "s", 1, "x", "y") for i, t in enumerate(texts)]
    rows += [rows[0], (None, long[10:900], None, None, None, None, None)]
    docs = frame(spark, rows)
    want = sorted((r[0] if r[0] is not None else -1, *w) for r, w in zip(rows, brute([r[1] for r in rows])))
    for together, share in ((2048, 1024), (1, 4)):  # the second compares hashes and splits few names
        monkeypatch.setattr(suffixes, "TOGETHER", together)
        monkeypatch.setattr(suffixes, "SHARE", share)
        got = sorted((x.doc_id if x.doc_id is not None else -1, x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest())
                     for x in suffixes.remove_repeats(docs).collect())
        assert got == want
    assert suffixes.remove_repeats(docs.limit(0)).collect() == []
