"""Connected components and linking of rows that share buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Rounds, stage_table


def _between(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of an edge (columns a, b of one type): root is the
    least node of its component.

    Star contraction: every node joins the neighbour of least hash, or stays if its own is
    less; edges then run between the nodes that were joined, and the next round has only
    these. Nodes shrink by a constant share a round (a star takes two), so all rounds
    together cost little more than the first. The least neighbour of a hub is a partial
    aggregate, and its edges are joined with one row per node, which the adaptive planner
    splits. Each round is written to the shared folder.
    """
    def order(c: str) -> Column:
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))

    maps, rounds = [], Rounds(edges.sparkSession)
    live = rounds.cut(_between(edges))
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select("b", "a"))
        nearest = both.groupBy("a").agg(F.min(order("b")).alias("near"))
        to = stage_table(nearest.select(F.col("a").alias("node"), F.least(F.col("near"), order("a"))["node"].alias("to")))
        maps.append(to)
        live = rounds.cut(_between(live.join(to.toDF("a", "ta"), "a").join(to.toDF("b", "tb"), "b").select(
            F.col("ta").alias("a"), F.col("tb").alias("b"))))
    if not maps:
        return live.toDF("node", "root")
    end = maps.pop()
    while maps:
        here = maps.pop()
        end = here.join(end.toDF("to", "further"), "to", "left").select("node", F.coalesce("further", "to").alias("to"))
    end = stage_table(end)
    least = end.groupBy("to").agg(F.min("node").alias("root"))
    return end.join(least, "to").select("node", "root")


def add_links(stars: DataFrame, links: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """``stars`` (node, root) with the components that ``links`` (a, b) join; only the
    roots that they touch are looked at again. In a loop, ``rounds`` holds the stars."""
    at = links.join(stars.toDF("a", "ra"), "a", "left").join(stars.toDF("b", "rb"), "b", "left")
    joined = star_components(at.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    moved = stars.join(joined.toDF("root", "further"), "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    all_ = moved.union(joined.join(stars, "node", "left_anti").select("node", "root"))
    return stage_table(all_) if rounds is None else rounds.cut(all_)


def link_buckets(members: DataFrame, linked: Column | None = None, rounds: int = 3, large: int = 1000,
                 verify: Callable[[DataFrame], DataFrame] | None = None,
                 refine: Callable[[DataFrame], tuple[DataFrame, Column]] | None = None, stars: DataFrame | None = None) -> DataFrame:
    """Components of nodes that share a bucket and satisfy ``linked``.

    ``members``: bucket, node, home (boolean) and what ``linked`` compares, as
    columns of aliases ``x`` (a home member) and ``y``; a written table. ``verify``
    keeps the pairs (a, b) that link where that takes more than the columns. Only pairs
    with a home member are due. Buckets of up to ``large`` members are compared pair
    by pair. In larger ones the pairs of a large family are not all visited: in each
    round, each bucket tries one member as a centre against the rest, what links is
    contracted to stars, and buckets that lie in one component are done. What is left
    after the rounds goes through ``refine``, which brings the remaining nodes into
    narrower buckets that lose no link, with their own ``linked``; without it, or after it, it is compared pair by
    pair across components. Either way every due pair that links ends in one component.
    Returns ``node, root`` for linked nodes only, the least node being the root;
    ``stars`` are components that are known already.
    """
    same = F.col("x.bucket") == F.col("y.bucket")
    if linked is not None:
        same = same & linked
    # both ends may be home: then once
    once = (F.col("x.node") < F.col("y.node")) | (~F.col("y.home") & (F.col("x.node") != F.col("y.node")))

    edges, known, left = (Rounds(members.sparkSession) for _ in range(3))

    def ends(pairs: DataFrame) -> DataFrame:
        a, b = F.col("x.node"), F.col("y.node")
        found = pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
        return edges.cut(found if verify is None else verify(found))

    def rooted(rows: DataFrame, stars: DataFrame) -> DataFrame:
        return rows.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))

    hot = stage_table(members.groupBy("bucket").agg(F.count("*").alias("_n")).filter(F.col("_n") > large).select("bucket"))
    some = not hot.isEmpty()
    few = members.join(hot, "bucket", "left_anti") if some else members
    if stars is None:
        stars = star_components(ends(few.filter("home").alias("x").join(few.alias("y"), same & once)))
    else:
        few = rooted(few, stars)
        stars = add_links(stars, ends(few.filter("home").alias("x").join(few.alias("y"), same & once & (F.col("x.root") != F.col("y.root")))), known)
    if not some:
        return stars
    at = left.cut(members.join(hot, "bucket", "left_semi"))
    for r in range(rounds + 1):
        at = rooted(at.drop("root"), stars)
        live = at.groupBy("bucket").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"),
                                        F.max("home").alias("_home")).filter("_lo <> _hi and _home").select("bucket")
        at = left.cut(at.join(live, "bucket", "left_semi"))
        if at.isEmpty():
            return stars
        if r == rounds and refine is not None:
            narrower, alike = refine(at.select("node").distinct())
            return link_buckets(narrower, alike, rounds, large, verify, None, stars)
        x, pair = at.filter("home"), once
        if r < rounds:
            # components are drawn alike, so that a large one does not supply every centre
            centre = x.groupBy("bucket").agg(F.min_by("node", F.struct(F.xxhash64("root", F.lit(r)), "node")).alias("node"))
            x, pair = x.join(centre, ["bucket", "node"], "left_semi").distinct(), F.col("x.node") != F.col("y.node")
        stars = add_links(stars, ends(x.alias("x").join(at.alias("y"), same & pair & (F.col("x.root") != F.col("y.root")))), known)
    return stars


def _apart(rows: DataFrame, stars: DataFrame) -> DataFrame:
    """``rows`` (bucket, node) of the buckets in more than one component, with their root,
    the root of most members of the bucket (head) and the number of members (size)."""
    at = rows.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = at.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    live = parts.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("head"), F.sum("n").alias("size"), F.count("*").alias("parts"))
    return at.join(live.filter("parts > 1").drop("parts"), "bucket")


def _across(at: DataFrame, alike: Column | None = None) -> DataFrame:
    """Pairs a, b of different components in a bucket of ``_apart``. Members of the head
    meet only the others, so a large family and a few strangers make few pairs."""
    due = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") != F.col("y.root"))
    due = due & ((F.col("y.root") == F.col("y.head")) | (F.col("x.node") < F.col("y.node")))
    pairs = at.filter("root <> head").alias("x").join(at.alias("y"), due if alike is None else due & alike)
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def link_families(members: DataFrame, verify: Callable[[DataFrame], DataFrame],
                  refine: Callable[[DataFrame], tuple[DataFrame, Column]], rounds: int = 3, large: int = 64) -> DataFrame:
    """Components, as ``link_buckets`` gives them, where most members of a bucket are alike.

    ``members``: bucket, node and centre (a member of the bucket), a written table.
    Every member is compared with the centre first. Buckets in which more than one
    component is left go on: up to ``large`` members, the members outside of the
    bucket's largest component meet all others at once; larger ones try ``rounds`` more
    centres. Nodes of buckets that are apart even then go through ``refine``, which
    brings them into narrower buckets that lose no link, with a condition on aliases
    x and y. Every pair of a bucket that links ends in one component.
    """
    edges, known, left = (Rounds(members.sparkSession) for _ in range(3))

    def ends(pairs: DataFrame) -> DataFrame:
        return edges.cut(verify(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))

    stars = star_components(ends(members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))))
    at = members.select("bucket", "node")
    for r in range(rounds + 1):
        at = left.cut(_apart(at.select("bucket", "node"), stars))
        if at.isEmpty():
            return stars
        if r == rounds:
            break
        # components are drawn alike, so that a large one does not supply every centre
        hot = at.filter(F.col("size") > large)
        centre = hot.groupBy("bucket").agg(F.min_by(F.struct("node", "root"), F.struct(F.xxhash64("root", F.lit(r)), "node")).alias("c"))
        pairs = hot.join(centre, "bucket").filter("root <> c.root").select(F.col("c.node").alias("a"), F.col("node").alias("b"))
        if r == 0:
            pairs = pairs.union(_across(at.filter(F.col("size") <= large)))
        stars = add_links(stars, ends(pairs), known)
        at = hot
    narrower, alike = refine(at.select("node").distinct())
    return add_links(stars, ends(_across(_apart(narrower, stars), alike)), known)
