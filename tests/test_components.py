"""Star contraction and bucket linking against plain search."""

import random

from pyspark.sql import functions as F

from sitegrid.operators.components import add_links, link_buckets, star_components
from sitegrid.session import Rounds, stage_table

from .graphs import roots


def result(df):
    return {r.node: r.root for r in df.collect()}


def test_star_components(spark):
    r = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 400)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    loose = [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(180)]
    links = [*chain, *hub, *loose, (7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    want = roots({n for e in links if e[0] != e[1] for n in e}, links)
    assert result(star_components(df)) == want
    named = df.select(*[F.format_string("n%05d", c).alias(c) for c in "ab"])
    assert result(star_components(named)) == {f"n{k:05}": f"n{v:05}" for k, v in want.items()}
    assert star_components(df.limit(0)).count() == 0
    stars = star_components(df)
    more = [(150, 1005), (5, 6), (2001, 100)]
    want = roots({*want, *(n for e in more for n in e)}, links + more)
    assert result(add_links(stars, spark.createDataFrame(more, "a long, b long"))) == want


def test_buckets_link_alike_whatever_their_size(spark):
    r = random.Random(4)
    values = [r.randrange(3000) for _ in range(400)]
    rows = sorted({(b, v, True) for v in values for b in (v // 40, (v + 20) // 40 + 1000, 5000)})
    df = stage_table(spark.createDataFrame(rows, "bucket int, node long, home boolean"))
    near = F.abs(F.col("x.node") - F.col("y.node")) <= 6
    want = roots(set(values), [(a, b) for a in values for b in values if 0 < b - a <= 6])

    def refine(nodes):
        cells = nodes.select("node", F.explode(F.array((F.col("node") / 14).cast("int"), ((F.col("node") + 7) / 14).cast("int") + 1000)).alias("bucket"))
        return cells.select("bucket", "node", F.lit(True).alias("home")), near

    for large, how in [(3, None), (10_000, None), (3, refine)]:
        got = result(link_buckets(df, near, rounds=1, large=large, refine=how))
        assert {n: got.get(n, n) for n in want} == want


def test_rounds_overwrite_only_the_round_before_last(spark):
    rounds = Rounds(spark)
    a = rounds.cut(spark.range(3))
    b = rounds.cut(a.withColumn("id", F.col("id") + 1))
    assert [x.id for x in a.orderBy("id").collect()] == [0, 1, 2]
    assert [x.id for x in rounds.cut(b.withColumn("id", F.col("id") + 1)).orderBy("id").collect()] == [2, 3, 4]
