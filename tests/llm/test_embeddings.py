import random

import numpy as np

from sitegrid.llm import embeddings
from sitegrid.llm.queries import QUERIES

from .cases import roots


def brute(rows):
    """Links by definition; vectors without direction or label have none."""
    good = [(k, l, np.array(v, float)) for k, (_, v, l) in enumerate(rows)
            if l is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    links = set()
    for key in {(l, len(v)) for _, l, v in good}:
        own = [(k, v / np.linalg.norm(v)) for k, l, v in good if (l, len(v)) == key]
        x = np.stack([v for _, v in own])
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1))):
            links.add((own[i][0], own[j][0]))
    return links


def test_table(spark):
    for sf in ("0.01", "0.1"):
        folder = f"/root/testdata/sf{sf}"
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
        got = {r.vec_id: r for r in QUERIES["op10_e8_lattice"](spark, folder).collect()}
        links = brute(rows)
        want, n = roots(range(len(rows)), links), [0] * len(rows)
        for a, b in links:
            n[a] += 1
            n[b] += 1
        assert len(got) == len(rows)
        assert all(got[r[0]].n_links <= n[k] for k, r in enumerate(rows))
        assert sum(g.n_links for g in got.values()) >= 0.97 * sum(n)
        same = {}
        for k, r in enumerate(rows):
            same.setdefault(want[k], []).append(r[0])
        assert sum(got[v].component_id == min(s) for s in same.values() for v in s) >= 0.97 * len(rows)


def test_awkward_rows(spark, monkeypatch):
    r = random.Random(4)
    base = [[r.gauss(0, 1) for _ in range(24)] for _ in range(30)]
    rows = []
    for i, v in enumerate(base):
        for _ in range(6):
            rows.append((len(rows), [x + r.gauss(0, 0.08) for x in v], i % 3))
    rows += [(1000 + i, list(rows[0][1]), rows[0][2]) for i in range(40)]
    rows += [(1000, list(rows[0][1]), rows[0][2]), (2000, None, 1), (2001, [0.0] * 24, 1), (2002, [None] + [1.0] * 23, 1), (2003, [float("nan")] * 24, 1),
             (2004, [float("inf")] * 24, 1), (2005, rows[0][1], None), (2006, [1e300] * 24, 0), (2007, [1e300] * 24, 0), (2008, [1.0] * 23, 0), (2009, [], 0),
             (None, [3.0] * 24, 2), (None, [3.0] * 24, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumnRenamed("label", "label")
    links = brute(rows)
    want = roots(range(len(rows)), links)
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    for block in (1024, 8):  # the second splits cells
        monkeypatch.setattr(embeddings, "BLOCK", block)
        got = embeddings.group(df).collect()
        assert len(got) == len(rows)
        ids = [x[0] for x in rows]
        least = {}
        for k, root in want.items():
            if ids[k] is not None:
                least[root] = min(least.get(root, 10**9), ids[k])
        a = sorted(((x.vec_id or -1), x.n_links, -1 if x.component_id is None else x.component_id, x.kept) for x in got)
        b = sorted(((ids[k] or -1) if ids[k] != 0 else -1, n[k], least.get(want[k], -1), ids[k] == least.get(want[k])) for k in range(len(rows)))
        same = sum(x == y for x, y in zip(a, b, strict=True))
        assert same >= len(rows) - 4, [(x, y) for x, y in zip(a, b) if x != y][:5]
    assert embeddings.group(df.limit(0)).collect() == []


def test_nearest_lattice_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    p = embeddings.lattice_points(x)
    half = p[:, :, 0] % 2
    assert (p % 2 == half[:, :, None]).all()  # all whole or all halves
    assert (p.sum(axis=2) % 4 == 0).all()  # even sum
    d = ((p / 2 - x[:, None]) ** 2).sum(axis=2)
    assert (d[:, 0] <= 1 + 1e-9).all()  # covering radius one
    assert (d[:, 0] <= d[:, 1] + 1e-9).all() and (d[:, 0] <= d[:, 2] + 1e-9).all() and (d[:, 1:] > 1e-9).all()
