"""Exact and near duplicates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..session import stage_table
from .components import link_buckets

KEY = ["run_id", "site"]
BLOCK = 512


def duplicate_sets(rows: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Groups sharing a key value: size and first URL. Members come from
    ``duplicate_members``; no group is gathered."""
    return rows.groupBy(*KEY, F.col(key).alias("value")).agg(
        F.count("*").alias("n"), F.min("url").alias("first_url")).filter(F.col("n") >= least)


def duplicate_members(rows: DataFrame, key: str, least: int = 2) -> DataFrame:
    # written once: counting and listing would otherwise both compute the key from the text
    keyed = stage_table(rows.select(*KEY, "url", F.col(key).alias("value")))
    sets = duplicate_sets(keyed, "value", least)
    return keyed.join(sets.select(*KEY, "value", "n", "first_url"), [*KEY, "value"])


def variant_key(url: Column) -> Column:
    """Host, lower-case path without trailing slashes, query: equal for forms of
    one address."""
    q = U.query_string(url)
    return F.concat(U.hostname(url), F.lower(F.regexp_replace(U.path(url), "/+$", "")),
                    F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))


def url_variants(pages: DataFrame, least: int = 2) -> DataFrame:
    ok = pages.filter(F.col("status") == 200).select(*KEY, "url", variant_key(F.col("url")).alias("variant"))
    return duplicate_sets(ok, "variant", least)


def content_groups(rows: DataFrame) -> DataFrame:
    """One row per distinct content of a site: hashed shingles (the same shingle of another
    site has another hash), their number, copies, first URL. Written, each row with a number
    ``node`` that stands for site and hash in all that follows."""
    site = F.xxhash64(*KEY)
    hashed = F.array_distinct(F.transform("shingles", lambda s: F.xxhash64(site, s)))
    known = rows.filter(F.col("run_id").isNotNull() & F.col("site").isNotNull()).select(*KEY, "url", "content_hash", hashed.alias("sh"))
    # texts without shingles are left out here: a filter before would compute all shingles twice
    some = F.size("sh") > 0
    groups = known.groupBy(*KEY, "content_hash").agg(
        F.min_by("sh", F.when(some, F.col("url"))).alias("sh"), F.count_if(some).alias("copies"),
        F.min(F.when(some, F.col("url"))).alias("url")).filter("copies > 0")
    return stage_table(groups.withColumns({"n": F.size("sh"), "node": F.monotonically_increasing_id()}))


def _prefixes(groups: DataFrame, threshold: float) -> DataFrame:
    """node, n, p, q, t (df, tok): the shingles of each content at its first places ``p`` in
    order of rarity, of which two sets that reach the threshold share one; ``q`` counts the
    places before it that other contents hold too."""
    tokens = groups.select("node", "n", F.explode("sh").alias("tok"))
    # a shingle held once ranks before all others and matches nothing, so it only
    # counts towards the prefix; shared shingles alone are joined and ordered
    shared = tokens.groupBy("tok").agg(F.count("*").alias("df")).filter("df > 1")
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)) + 1
    own = F.col("n") - F.size("o")
    return (tokens.join(shared, "tok")
            .groupBy("node").agg(
                F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("o"), F.max("n").alias("n"))
            .select("node", "n", own.alias("own"), F.posexplode(F.slice(
                F.col("o"), F.lit(1), F.greatest(keep - own, F.lit(0)).cast("int"))).alias("q", "t"))
            .withColumn("p", F.col("own") + F.col("q")))


def _can_reach(threshold: float, a: str, b: str) -> Column:
    """Whether sets ``a`` and ``b`` that share a shingle can still reach the threshold: their
    sizes are near enough, and what both hold before it and from it on suffices."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    before = F.least(f"{a}.q", f"{b}.q")
    left = F.least(n - F.col(f"{a}.p"), m - F.col(f"{b}.p"))
    near = F.least(n, m) >= F.greatest(n, m) * F.lit(threshold) - F.lit(1e-9)
    return near & (before + left >= F.ceil(F.lit(threshold / (1 + threshold)) * (n + m) - F.lit(1e-9)))


def near_duplicate_families(rows: DataFrame, threshold: float = 0.85, large: int = 64) -> DataFrame:
    """run_id, site, url, content_hash, copies, representative, score, family_size: every
    content that reaches the threshold with another, in families joined by such pairs.

    One row per content, however large the family: the representative is the content
    with the least address, ``score`` the Jaccard similarity with it (below the
    threshold where a chain of pairs leads to it), ``family_size`` the number of
    contents. The same exact prefix filter as for pairs brings contents together; a
    shingle held by more than ``large`` contents compares them with a few centres first,
    and what those centres join is not compared again. ``rows`` as for
    ``near_duplicates``, which lists the pairs themselves.
    """
    groups = content_groups(rows)
    members = stage_table(_prefixes(groups, threshold).select(
        F.col("t.tok").alias("bucket"), "node", F.lit(True).alias("home"), "n", "p", "q"))
    sets = groups.select("node", "sh")

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        return both.filter(X.jaccard(F.col("sa"), F.col("sb")) >= threshold).select("a", "b")

    roots = link_buckets(members, _can_reach(threshold, "x", "y"), large=large, verify=verify)
    named = stage_table(groups.select("node", *KEY, "url", "content_hash", "copies").join(roots, "node"))
    heads = named.groupBy("root").agg(F.min(F.struct("url", "node")).alias("head"), F.count("*").alias("family_size"))
    placed = (named.join(heads, "root").join(sets, "node")
              .join(sets.select(F.col("node").alias("_head"), F.col("sh").alias("_sh")), F.col("head.node") == F.col("_head")))
    return placed.select(*KEY, "url", "content_hash", "copies", F.col("head.url").alias("representative"),
                         X.jaccard(F.col("sh"), F.col("_sh")).alias("score"), "family_size")


def near_duplicates(rows: DataFrame, threshold: float = 0.85, block: int = BLOCK) -> DataFrame:
    """Pairs of distinct contents whose shingle sets reach the Jaccard threshold.

    ``rows``: run_id, site, url, content_hash, shingles. Copies are folded first,
    so a pair stands for ``copies_a * copies_b`` page pairs. Exact prefix
    filtering: shingles ordered rarest first, two sets that reach the threshold
    share one of their first ``n - ceil(t*n) + 1``. The ordered list of a document
    is as long as its own text. A shingle held by many sets
    is split into blocks that meet pairwise in separate cells, so no task holds
    it whole and no pair is lost.
    """
    groups = content_groups(rows.filter(F.col("content_hash").isNotNull()))
    ordered = _prefixes(groups, threshold)
    blocks = F.ceil(F.col("t.df") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    cells = F.when(F.col("b") == 1, F.array(F.lit(0))).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("b") - 1),
        lambda x: F.least(x, F.col("me")) * F.col("b") + F.greatest(x, F.col("me"))))
    spread = (ordered.select("node", "n", "p", "q", F.col("t.tok").alias("tok"), blocks.alias("b"), mine.alias("me"))
              .withColumn("cell", F.explode(cells)))
    a, b = spread.alias("a"), spread.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ["tok", "cell"]]
    home = (F.col("a.me") != F.col("b.me")) | (F.col("a.cell") == F.col("a.me") * F.col("a.b") + F.col("a.me"))
    pairs = (a.join(b, same).filter((F.col("a.node") < F.col("b.node")) & _can_reach(threshold, "a", "b") & home)
             .select(F.col("a.node").alias("na"), F.col("b.node").alias("nb")).distinct())

    def side(tag: str, *keys: str) -> DataFrame:
        return groups.select(*keys, F.col("node").alias(f"n{tag}"), F.col("sh").alias(f"s{tag}"),
                             F.col("url").alias(f"url_{tag}"), F.col("copies").alias(f"copies_{tag}"))

    scored = (pairs.join(side("a", *KEY), "na").join(side("b"), "nb")
              .withColumn("score", X.jaccard(F.col("sa"), F.col("sb")))
              .filter(F.col("score") >= threshold))
    first, second = F.col("url_a") < F.col("url_b"), F.col("url_a") >= F.col("url_b")
    return scored.select(
        *KEY, F.least("url_a", "url_b").alias("url_a"), F.greatest("url_a", "url_b").alias("url_b"), "score",
        F.when(first, F.col("copies_a")).otherwise(F.col("copies_b")).alias("copies_a"),
        F.when(second, F.col("copies_a")).otherwise(F.col("copies_b")).alias("copies_b"))
