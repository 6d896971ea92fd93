"""Demand research: probes, keyword breadth, clusters, keyword-to-page map."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..session import Rounds, cut_lineage, stage_path, stage_table
from .ranking import numbered, top_per_key


def keyword_probes(seeds: DataFrame) -> DataFrame:
    """Every probe of a seed: itself, question prefixes, suffixes, letters."""
    seed = F.col("seed")
    probes = F.concat(
        F.array(seed), F.array(*[F.concat(F.lit(f"{q} "), seed) for q in V.QUESTION_WORDS]),
        F.array(*[F.concat(seed, F.lit(f" {s}")) for s in V.COMMERCIAL_SUFFIXES]),
        F.array(*[F.concat(seed, F.lit(f" {chr(c)}")) for c in range(ord("a"), ord("z") + 1)]))
    return seeds.select("seed", F.posexplode(probes).alias("n", "probe"))


def classify_intent(keyword: Column) -> Column:
    k = F.concat(F.lit(" "), F.lower(keyword), F.lit(" "))
    return reduce(lambda c, p: c.when(k.rlike(p[1]), p[0]), V.KEYWORD_INTENTS, F.when(F.lit(False), "")).otherwise(
        "unclear")


def classify_topic(topic: Column) -> Column:
    """The brief-writing preset; informational when nothing matches."""
    t = F.lower(topic)
    return reduce(lambda c, p: c.when(t.rlike(p[1]), p[0]), V.TOPIC_INTENTS, F.when(F.lit(False), "")).otherwise(
        "informational")


def is_question(keyword: Column) -> Column:
    return keyword.rlike("^(" + "|".join(V.QUESTION_WORDS) + ") ")


def keyword_breadth(suggestions: DataFrame) -> DataFrame:
    """Observations (seed, suggestion, rank) to keywords: how many probes showed
    it, best rank, intent, question flag, words. The seed itself is left out."""
    kw = F.trim(F.lower("suggestion"))
    per = suggestions.groupBy("seed", kw.alias("keyword")).agg(
        F.count("*").alias("breadth"), F.least(F.min("rank"), F.lit(99)).alias("best_rank"))
    return per.filter(F.col("keyword") != F.lower("seed")).select(
        "seed", "keyword", "breadth", "best_rank", classify_intent(F.col("keyword")).alias("intent"),
        is_question(F.col("keyword")).alias("is_question"),
        F.size(F.split("keyword", r"\s+")).alias("words"))


def question_set(suggestions: DataFrame) -> DataFrame:
    kw = F.lower("suggestion")
    return suggestions.filter(is_question(kw)).select("seed", kw.alias("question")).distinct()


def keyword_tokens(keyword: Column) -> Column:
    parts = F.transform(F.split(keyword, r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return F.filter(parts, lambda w: (F.length(w) > 2) & ~w.isin(V.KEYWORD_STOP))


# --- clusters ------------------------------------------------------------------------------

def _greedy(words: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """The decisions of one block of a seed, in order, given the tokens of the clusters it may join."""
    holders: dict[str, set] = {}
    for t, c in zip(held["t"], held["c"]):
        holders.setdefault(t, set()).add(c)
    words = words.sort_values("k")
    joined = []
    for k, n, tokens in zip(words["k"], words["n"], words["o"]):
        hits: dict[int, int] = {}
        for x in tokens:
            for c in holders.get(x["t"], ()):
                hits[c] = hits.get(c, 0) + x["m"]
        best = min(hits, key=lambda c: (-hits[c], c), default=k)
        joined.append(best if 2 * hits.get(best, 0) >= n else k)
        for x in tokens:
            holders.setdefault(x["t"], set()).add(joined[-1])
    return pd.DataFrame({"seed": words["seed"], "k": words["k"], "c": joined})


def cluster_members(keywords: DataFrame, block: int = 2048) -> DataFrame:
    """Cluster number per keyword within each seed: leaders in order of breadth
    (descending) and keyword. A keyword joins the cluster that holds most of its tokens
    (ties: the first), if that is half of them or more; the cluster then holds all of
    them. Otherwise it leads a cluster of its own; so do keywords without tokens.

    Decisions depend on all earlier ones, so a seed is decided in blocks of ``block``
    keywords, the same block of all seeds at a time, and no task holds more than a block
    and its clusters. Joins first find for each keyword of the block the best cluster of
    the blocks before: the keyword meets clusters at its rarest tokens only, as many as
    half of its tokens cannot do without, and counts the others by lookup. A cluster that
    is nobody's best gains no token within the block, and stays behind that best one
    (which only gains) or under one half. So the block is decided in order against the
    clusters that are somebody's best, one per keyword at most, and those it founds.
    """
    order = keywords.withColumn("_order", -F.col("breadth"))
    toks = keyword_tokens(F.col("keyword"))
    rows = stage_table(numbered(order, ["seed"], ["_order", "keyword"], "k").select(
        "seed", "k", "keyword", "breadth", "intent", toks.alias("tokens"), F.size(toks).alias("n")))
    tok = stage_table(rows.select("seed", "k", "n", F.explode("tokens").alias("t")).groupBy("seed", "k", "n", "t").agg(F.count("*").alias("m")))
    spark = keywords.sparkSession
    shape = "seed string, k bigint, c bigint"
    holders = spark.createDataFrame([], "seed string, t string, c bigint")
    kept, bests, path = Rounds(spark), Rounds(spark), stage_path(spark)
    last = rows.agg(F.max("k")).first()[0] or 0
    for at in range(0, last, block):
        due = tok.filter((F.col("k") > at) & (F.col("k") <= at + block))
        words = due.groupBy("seed", "k", "n").agg(F.collect_list(F.struct("t", "m")).alias("o"))
        held = holders.limit(0)
        if at:
            spread = holders.groupBy("seed", "t").agg(F.count("*").alias("df"))
            by_use = due.join(spread, ["seed", "t"], "left").fillna(0, ["df"]).groupBy("seed", "k", "n").agg(
                F.reverse(F.array_sort(F.collect_list(F.struct("df", "t", "m")))).alias("o"))
            # the most common tokens that do not make half of the keyword need no probe
            weight = F.transform("o", lambda _, i: F.aggregate(F.slice("o", F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, x: s + x["m"]))
            probes = by_use.withColumn("w", weight).select("seed", "k", F.explode(F.filter(
                "o", lambda p, i: (p["df"] > 0) & (2 * F.get("w", i) >= F.col("n")))["t"]).alias("t"))
            hits = probes.join(holders, ["seed", "t"]).select("seed", "k", "c").distinct().join(due, ["seed", "k"]).join(
                holders, ["seed", "t", "c"]).groupBy("seed", "k", "n", "c").agg(F.sum("m").alias("hits"))
            best = bests.cut(hits.filter(2 * F.col("hits") >= F.col("n")).groupBy("seed", "k").agg(
                F.min(F.struct((-F.col("hits")).alias("h"), "c")).alias("b")).select("seed", F.col("b.c").alias("c")).distinct())
            held = holders.join(best, ["seed", "c"], "left_semi").join(due.select("seed", "t"), ["seed", "t"], "left_semi")
        words.groupBy("seed").cogroup(held.groupBy("seed")).applyInPandas(_greedy, shape).write.parquet(f"{path}/at={at}")
        joined = spark.read.schema(shape).parquet(f"{path}/at={at}")
        holders = kept.cut(holders.union(due.join(joined, ["seed", "k"]).select("seed", "t", "c")).distinct())
    # one reader for all blocks, however many
    decided = spark.read.schema(shape).parquet(*[f"{path}/at={at}" for at in range(0, last, block)]) if last else rows.select("seed", "k", F.col("k").alias("c"))
    now = rows.select("seed", "k").join(decided, ["seed", "k"], "left").select("seed", "k", F.coalesce("c", "k").alias("c"))
    leaders = numbered(now.filter(F.col("k") == F.col("c")).select("seed", "c"), ["seed"], ["c"], "number")
    return rows.join(now, ["seed", "k"]).join(leaders, ["seed", "c"]).select(
        "seed", "keyword", "breadth", "intent", (F.col("number") - 1).cast("string").alias("cluster"))


def summarise_clusters(members: DataFrame) -> DataFrame:
    """Label, size, dominant intent and mixed flag per cluster."""
    keys = ["seed", "cluster"]
    head = members.groupBy(*keys).agg(
        F.min_by("keyword", F.struct((-F.col("breadth")).alias("b"), F.length("keyword").alias("l"), "keyword"))
        .alias("label"), F.count("*").alias("size"))
    intents = members.groupBy(*keys, "intent").agg(F.count("*").alias("n"), F.min("keyword").alias("k"))
    top = intents.groupBy(*keys).agg(
        F.min_by("intent", F.struct((-F.col("n")).alias("n"), "intent")).alias("dominant_intent"),
        (F.count("*") > 2).alias("intent_mixed"))
    return head.join(top, keys)


def cluster_keywords(keywords: DataFrame) -> DataFrame:
    return summarise_clusters(cluster_members(keywords))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node name reachable over undirected edges (columns a, b).
    Label propagation with pointer jumping, checkpointed every round, until no label
    moves."""
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    label = cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(label.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(
            F.min("label").alias("seen"))
        step = label.join(near, "a").select("a", "label", F.least("label", "seen").alias("new"))
        jump = label.select(F.col("a").alias("new"), F.col("label").alias("further"))
        nxt = cut_lineage(step.join(jump, "new", "left").select(
            "a", "label", F.least("new", F.coalesce("further", "new")).alias("new")))
        moved = not nxt.filter(F.col("new") < F.col("label")).isEmpty()
        label = nxt.select("a", F.col("new").alias("label"))
        if not moved:
            return label


def cluster_keywords_graph(keywords: DataFrame, longest: int = 10) -> DataFrame:
    """Order-free variant for large seeds: keywords are linked when one holds at
    least half of the other's tokens, clusters are connected components.

    A keyword meets others at nodes for each half of its token set instead of in
    pairs, so a token in every keyword adds one edge per keyword. Token sets of more
    than ``longest`` tokens have too many halves: they meet all others through the
    rarest tokens of the shorter set, one of which the longer set must hold.
    """
    toks = F.array_sort(F.array_distinct(keyword_tokens(F.col("keyword"))))
    rows = cut_lineage(keywords.withColumn("t", toks).withColumn("n", F.size("t")))
    ids = F.concat_ws("\u0001", "seed", "keyword")

    def subsets(df: DataFrame, size: Column) -> DataFrame:
        masks = F.filter(F.sequence(F.lit(1), F.pow(F.lit(2), F.col("n")).cast("int") - 1),
                         lambda m: F.bit_count(m) == size)
        names = F.transform(masks, lambda m: F.array_join(F.filter(
            "t", lambda _, i: F.floor(m / F.pow(F.lit(2), i)) % 2 == 1), " "))
        return df.select("seed", ids.alias("id"), F.explode(names).alias("half"))

    short = rows.filter((F.col("n") > 0) & (F.col("n") <= longest))
    active = subsets(short, F.ceil(F.col("n") / 2)).select("seed", "half").distinct()
    sizes = active.select("seed", F.size(F.split("half", " ")).alias("k")).distinct()
    holds = subsets(short.join(sizes, "seed").filter(F.col("k") <= F.col("n")), F.col("k")).join(
        active, ["seed", "half"], "left_semi")
    long = rows.filter(F.col("n") > longest).select("seed", ids.alias("id"), F.array_join("t", " ").alias("half"))
    edges = holds.unionByName(long).select(
        F.concat(F.lit("k"), "id").alias("a"), F.concat(F.lit("t"), "seed", F.lit("\u0001"), "half").alias("b"))
    node = F.when(F.col("n") <= longest, F.concat(F.lit("k"), ids)).otherwise(
        F.concat(F.lit("t"), "seed", F.lit("\u0001"), F.array_join("t", " ")))
    sets = rows.filter("n > 0").select("seed", node.alias("a"), "t", "n").distinct()
    wide = sets.filter(F.col("n") > longest)
    held = wide.select("seed", F.explode("t").alias("tok"), F.col("a").alias("b"), F.col("t").alias("u"), F.col("n").alias("m"))
    probes = (sets.join(wide.select("seed").distinct(), "seed", "left_semi").select("*", F.explode("t").alias("tok"))
              .join(held.groupBy("seed", "tok").agg(F.count("*").alias("df")), ["seed", "tok"], "left").fillna(0, ["df"])
              .groupBy("seed", "a", "t", "n").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("o"))
              .select("seed", "a", "t", "n", F.explode(F.slice(
                  "o", F.lit(1), (F.col("n") - F.ceil(F.col("n") / 2) + 1).cast("int"))["tok"]).alias("tok")))
    met = probes.join(held, ["seed", "tok"]).filter(
        ((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b"))))
        & (F.size(F.array_intersect("t", "u")) * 2 >= F.col("n")))
    edges = edges.unionByName(met.select("a", "b").distinct())
    comp = connected_components(edges).filter(F.col("a").startswith("k"))
    out = rows.withColumn("a", F.concat(F.lit("k"), ids)).join(comp, "a", "left")
    return out.select("seed", "keyword", "breadth", "intent",
                      F.sha1(F.coalesce("label", "a")).alias("cluster"))


# --- keyword to page ---------------------------------------------------------------------------

def cluster_terms(members: DataFrame, label_of: DataFrame, first: int | None = None) -> DataFrame:
    """Terms over three letters from a cluster's label and its members, or its first ones."""
    keys = ["seed", "cluster"]
    some = top_per_key(members, keys, [F.desc("breadth"), F.col("keyword")], first).select(*keys, "keyword")
    names = some.unionByName(label_of.select(*keys, F.col("label").alias("keyword")))
    return names.select(*keys, F.explode(F.split("keyword", r"\s+")).alias("term")).filter(
        F.length("term") > 3).distinct()


def page_text(pages: DataFrame) -> Column:
    return F.lower(F.concat_ws(" ", "title", F.array_join("h1s", " "),
                               F.array_join(F.transform("headings", lambda h: h["text"]), " "),
                               "body_text"))


def keyword_url_map(terms: DataFrame, pages: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Pages covering more than ``threshold`` of a cluster's terms, best four,
    with the status gap, contested or mapped.

    Token join with prefix filtering: a page above the threshold holds one of
    the cluster's rarest ``n - need + 1`` terms, so common terms never generate
    candidates on their own, and it has ``need`` tokens or more. Pages with the same
    tokens score alike, so a token set is compared once and stands for its first four pages.
    """
    keys = ["seed", "cluster"]
    tokens_of = F.array_sort(F.array_distinct(X.alnum_tokens(page_text(pages))))
    live = pages.filter((F.col("status") == 200) & ~F.col("noindex")).select("url", tokens_of.alias("tokens"))
    first = stage_table(top_per_key(live.withColumn("set", F.sha2(F.array_join("tokens", " "), 256)), ["set"], [F.col("url")], 4, "nth"))
    same = first.select("set", "url")
    sets_of = first.filter("nth = 1").select("set", "tokens", F.size("tokens").alias("size"))
    tokens = sets_of.select("set", "size", F.explode("tokens").alias("term"))
    df = tokens.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(
        F.count("*").alias("df"))
    sets = stage_table(terms.join(df, "term", "left").fillna(0, ["df"]).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("df", "term"))).alias("o")))
    n = F.size("o")
    need = F.floor(n * F.lit(threshold)) + 1
    probes = sets.select(*keys, need.alias("need"), F.explode(F.slice("o", F.lit(1), (n - need + 1).cast("int"))).alias("p"))
    cand = probes.select(*keys, "need", F.col("p.term").alias("term")).join(tokens, "term").filter(
        F.col("size") >= F.col("need")).select(*keys, "set").distinct()
    scored = cand.join(sets_of, "set").join(sets.select(*keys, F.transform("o", lambda s: s["term"]).alias("all")), keys).withColumn(
        "score", F.size(F.array_intersect("all", "tokens")) / F.size("all")).filter(F.col("score") > threshold)
    best = top_per_key(scored.select(*keys, "set", "score").join(same, "set").drop("set"), keys, [F.desc("score"), F.col("url")], 4)
    head = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "url", "score"))).alias("best"))
    s1, s2 = F.get("best", F.lit(0))["score"], F.get("best", F.lit(1))["score"]
    status = (F.when(s1.isNull(), "gap")
              .when(F.coalesce(s2 > s1 * 0.85, F.lit(False)), "contested").otherwise("mapped"))
    return (sets.select(*keys).join(head, keys, "left").select(*keys, status.alias("status"), F.explode_outer("best").alias("b"))
            .select(*keys, "status", "b.rank", "b.url", X.half_up(F.col("b.score") * 100).alias("score")))


def heading_bigrams(pages: DataFrame) -> DataFrame:
    """Adjacent word pairs, both of four letters or more, per occurrence."""
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " ")

    def pairs(w: Column) -> Column:
        two = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))),
                         F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))),
                         lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.transform(F.filter(two, lambda p: (F.length(p["a"]) >= 4) & (F.length(p["b"]) >= 4)),
                           lambda p: F.concat_ws(" ", p["a"], p["b"]))

    return pages.select(F.explode(X.bind(words, pairs)).alias("topic"))


def topic_gap(ours: DataFrame, theirs: DataFrame, least: int = 2, k: int | None = None) -> DataFrame:
    """Topics they use at least twice and we never do. Both sides need a column
    ``text`` with title and headings."""
    per = heading_bigrams(theirs).groupBy("topic").agg(F.count("*").alias("their_pages")).filter(
        F.col("their_pages") >= least)
    gap = per.join(heading_bigrams(ours).distinct(), "topic", "left_anti")
    return gap if k is None else gap.orderBy(F.desc("their_pages"), "topic").limit(k)
