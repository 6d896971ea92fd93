import random
import re

import xxhash

from sitegrid.llm import common, simhash
from sitegrid.llm.queries import QUERIES

from .cases import frame, roots


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [words[i:i + 4] for i in range(len(words) - 3)] or [words]
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def expected(rows):
    fps = {i: plain(t) for i, t in rows}
    distinct = sorted(set(fps.values()))
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 4]
    root = roots(distinct, links)
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(least.get(root[f], i), i)
    return {(i, f, least[root[f]]) for i, f in fps.items()}


def test_table_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in QUERIES["op7_simhash_anchors"](spark, folder).collect()}
    assert got == expected(docs)


def test_awkward_rows(spark):
    docs = frame(spark)
    got = simhash.group(docs).collect()
    assert len(got) == docs.count()
    rows = [(r.doc_id if r.doc_id is not None else 10**9, r.text) for r in docs.collect()]
    assert {(r.doc_id if r.doc_id is not None else 10**9, r.fp % 2**64, 10**9 if r.component_id is None else r.component_id)
            for r in got} == expected(dict(rows).items())
    assert simhash.group(docs.limit(0)).collect() == []


def test_links_at_every_distance(spark):
    """Chains, hubs and strays around a centre: all pairs within four bits are linked."""
    r = random.Random(5)
    centre = r.getrandbits(64)
    values = {centre}
    for d in range(1, 7):
        for _ in range(30):
            values.add(centre ^ sum(1 << b for b in r.sample(range(64), d)))
    values |= {r.getrandbits(64) for _ in range(50)}
    signed = {v: v - 2**64 if v >= 2**63 else v for v in values}
    fps = spark.createDataFrame([(s,) for s in signed.values()], "node long")
    from pyspark.sql import functions as F
    close = F.bit_count(F.col("x.node").bitwiseXOR(F.col("y.node"))) <= 4
    want = roots(sorted(signed.values()), [(signed[a], signed[b]) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4])
    for layout in simhash.LAYOUTS:
        for large in (3, 1000):
            got = {x.node: x.root for x in common.link_buckets(simhash.covered(fps, layout), close, rounds=1, large=large).collect()}
            assert {n: got.get(n, n) for n in want} == want
