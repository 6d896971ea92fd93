"""What result pages reward, and whether a page matches it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..functions import urls as U

FEATURE_NOTES = {
    "local": "proximity and business listing matter more than page content",
    "featured": "answer the question in the first two sentences",
    "paa": "the questions shown are the subtopics to cover",
}


def classify_result(title: Column, url: Column) -> Column:
    """Kind of a result: a path hint wins, then the first title or URL pattern."""
    p = F.lower(U.path(url))
    said = F.concat_ws(" ", title, url)
    c = F.when(F.lit(False), "")
    for kind, rx in V.PATH_KINDS:
        c = c.when((U.hostname(url) != "") & p.rlike(rx), kind)
    for kind, rx in V.RESULT_KINDS:
        c = c.when(said.rlike(rx), kind)
    return c.otherwise("other")


def kind_distribution(results: DataFrame) -> DataFrame:
    """Kinds among the first ten results of each query. ``results``: query,
    position, url, title."""
    return results.filter(F.col("position") <= 10).groupBy(
        "query", classify_result(F.col("title"), F.col("url")).alias("kind")).agg(
        F.count("*").alias("n"), F.min("position").alias("first_at"))


def judge_intent(results: DataFrame, targets: DataFrame) -> DataFrame:
    """Does the page we aim at a query have the format its results have?
    ``targets``: query, url, title."""
    kinds = kind_distribution(results)
    per = kinds.groupBy("query").agg(
        F.min_by("kind", F.struct((-F.col("n")).alias("n"), "first_at")).alias("dominant"),
        F.max("n").alias("top"), F.sum("n").alias("n"))
    host = targets.select("query", U.bare_host(F.col("url")).alias("host")).distinct()
    own = (results.withColumn("host", U.bare_host(F.col("url"))).join(host, ["query", "host"])
           .groupBy("query", "host").agg(F.min("position").alias("own_position")))
    j = targets.withColumns({"kind": classify_result(F.coalesce("title", F.lit("")), F.col("url")),
                             "host": U.bare_host(F.col("url"))}).join(per, "query").join(
        own, ["query", "host"], "left")
    share = X.percent(F.col("top"), F.col("n"))
    mixed, match = share < 50, F.col("kind") == F.col("dominant")
    return j.select("query", "url", "kind", "dominant", share.alias("share"), mixed.alias("mixed"),
                    match.alias("match"), F.when(~mixed & ~match, "High").alias("severity"), "own_position")


def serp_feature_notes(features: DataFrame) -> DataFrame:
    """Advice per query from the features it shows. ``features``: query, feature."""
    note = reduce(lambda c, kv: c.when(F.col("feature") == kv[0], kv[1]), FEATURE_NOTES.items(),
                  F.when(F.lit(False), ""))
    per = features.select("query", "feature", note.alias("note")).distinct()
    return per.groupBy("query").agg(
        F.array_join(F.array_sort(F.collect_set("feature")), ", ").alias("features"),
        F.array_join(F.array_sort(F.collect_set("note")), "; ").alias("notes"))


def rank_position(results: DataFrame, domain: str) -> DataFrame:
    """First result on the domain per query; NULL when absent."""
    bare = domain.removeprefix("https://").removeprefix("http://").removeprefix("www.").rstrip("/")
    at = F.regexp_replace("url", r"^https?://(www\.)?", "")
    hit = F.when(F.startswith(at, F.lit(bare)), F.struct("position", "url"))
    return results.groupBy("query").agg(F.min(hit).alias("h")).select(
        "query", F.col("h").isNotNull().alias("found"), F.col("h.position").alias("position"),
        F.col("h.url").alias("url"))
