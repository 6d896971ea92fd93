"""Comparing runs of an audit: regressions, structure, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .audit import severity_rank
from .ranking import top_per_key


def consecutive_runs(runs: DataFrame) -> DataFrame:
    """Each run of a site with the one before it. ``runs``: site, run_id, run_at;
    one short row per run."""
    w = W.partitionBy("site").orderBy("run_at", "run_id")
    return runs.select("site", "run_id", "run_at", F.lag("run_id").over(w).alias("prev_id"))


def diff_findings(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """What changed between consecutive runs: appeared, resolved, worsened, grew.

    ``findings``: site, run_id, rule, severity, n_urls. A finding can both worsen
    and grow. First runs have nothing to compare with and yield no rows.
    """
    pairs = consecutive_runs(runs).filter(F.col("prev_id").isNotNull()).select("site", "run_id", "prev_id")
    cols = [F.col("rule"), F.col("severity"), F.col("n_urls")]
    after = findings.select("site", "run_id", *cols).join(pairs.select("site", "run_id"), ["site", "run_id"])
    before = findings.select("site", F.col("run_id").alias("prev_id"), *cols).join(
        pairs, ["site", "prev_id"]).drop("prev_id")
    a = after.select("site", "run_id", "rule", F.struct("severity", "n_urls").alias("a"))
    b = before.select("site", "run_id", "rule", F.struct("severity", "n_urls").alias("b"))
    both = a.join(b, ["site", "run_id", "rule"], "full_outer").select(
        "site", "run_id", "rule", F.col("a.severity").alias("severity"), F.col("b.severity").alias("from_severity"),
        F.col("a.n_urls").alias("n_urls"), F.col("b.n_urls").alias("from_urls"))
    kinds = F.array_compact(F.array(
        F.when(F.col("from_severity").isNull(), "appeared"), F.when(F.col("severity").isNull(), "resolved"),
        F.when(severity_rank("severity") < severity_rank("from_severity"), "worsened"),
        F.when((F.col("from_urls") > 0) & (F.col("n_urls") >= F.col("from_urls") * 2), "grew")))
    return both.withColumn("change", F.explode(kinds))


def structural_changes(stats: DataFrame, runs: DataFrame) -> DataFrame:
    """Site-level drops the finding list would miss. ``stats``: site, run_id,
    crawled, noindex, errors, indexable."""
    w = W.partitionBy("site").orderBy("run_at", "run_id")
    fields = ["crawled", "noindex", "errors", "indexable"]
    j = stats.join(runs.select("site", "run_id", "run_at"), ["site", "run_id"])
    j = j.withColumns({f"p_{c}": F.lag(c).over(w) for c in fields})

    def change(cond: Column, name: str, col: str) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("change"), F.col(f"p_{col}").cast("bigint").alias("before"),
                                     F.col(col).cast("bigint").alias("after")))

    rows = F.array_compact(F.array(
        change((F.col("p_crawled") > 10) & (F.col("crawled") < F.col("p_crawled") * 0.8), "pages fell", "crawled"),
        change(F.col("noindex") > F.col("p_noindex"), "noindex rose", "noindex"),
        change(F.col("errors") > F.col("p_errors"), "errors rose", "errors"),
        change((F.col("p_indexable") > 5) & (F.col("indexable") < F.col("p_indexable") * 0.9), "indexable fell",
               "indexable")))
    return j.select("site", "run_id", F.explode(rows).alias("c")).select("site", "run_id", "c.*")


def alertable(diff: DataFrame, alert_on: list[str] = ("Critical", "High")) -> DataFrame:
    return diff.filter(F.col("change").isin("appeared", "worsened") & F.col("severity").isin(list(alert_on)))


def run_status(runs: DataFrame, diff: DataFrame, structural: DataFrame,
               alert_on: list[str] = ("Critical", "High")) -> DataFrame:
    """baseline, quiet or changed per run, with alert and structural counts."""
    n_alert = alertable(diff, alert_on).groupBy("site", "run_id").agg(F.count("*").alias("alerts"))
    n_struct = structural.groupBy("site", "run_id").agg(F.count("*").alias("structural"))
    keys = ["site", "run_id"]
    out = consecutive_runs(runs).join(n_alert, keys, "left").join(n_struct, keys, "left").fillna(
        0, ["alerts", "structural"])
    return out.withColumn("status", F.when(F.col("prev_id").isNull(), "baseline").when(
        (F.col("alerts") == 0) & (F.col("structural") == 0), "quiet").otherwise("changed"))


def diff_pages(before: DataFrame, after: DataFrame, by: list[str] = ("site",)) -> DataFrame:
    """Pages added, removed or changed between two snapshots, severe ones flagged.
    Both: by..., url, status, title, noindex, canonical, word_count, inbound_count."""
    cols = ["status", "title", "noindex", "canonical", "word_count", "inbound_count"]
    keys = [*by, "url"]
    b = before.select(*keys, F.struct(*cols).alias("b"))
    a = after.select(*keys, F.struct(*cols).alias("a"))
    j = a.join(b, keys, "full_outer")

    def new(c: str) -> Column:
        return F.col(f"a.{c}")

    def old(c: str) -> Column:
        return F.col(f"b.{c}")

    def moved(c: str, label: str) -> Column:
        return F.when(~new(c).eqNullSafe(old(c)), F.concat(
            F.lit(label + " "), F.coalesce(old(c).cast("string"), F.lit("none")), F.lit(" to "),
            F.coalesce(new(c).cast("string"), F.lit("none"))))

    now_no, was_no = F.coalesce(new("noindex"), F.lit(False)), F.coalesce(old("noindex"), F.lit(False))
    words = F.abs(F.coalesce(new("word_count"), F.lit(0)) - F.coalesce(old("word_count"), F.lit(0)))
    status_moved = moved("status", "status")
    notes = F.array_compact(F.array(
        status_moved, F.when(~new("title").eqNullSafe(old("title")), F.lit("title changed")),
        F.when(now_no != was_no, F.when(was_no, "noindex removed").otherwise("noindex added")),
        moved("canonical", "canonical"),
        F.when(words > 100, F.concat(F.lit("words "), old("word_count").cast("string"), F.lit(" to "),
                                     new("word_count").cast("string"))),
        moved("inbound_count", "inbound")))
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed")
    out = j.select(*keys, kind.alias("kind"),
                   F.when(kind == "changed", F.concat_ws("; ", notes))
                   .when(kind == "added", F.concat(F.lit("status "), new("status").cast("string")))
                   .otherwise(F.concat(F.lit("was status "), old("status").cast("string"))).alias("detail"),
                   ((kind == "changed") & (status_moved.isNotNull() | (now_no & ~was_no))).alias("severe"))
    return out.filter(F.col("detail") != "")


def run_log(runs: DataFrame, keep: int = 60) -> DataFrame:
    return top_per_key(runs, ["site"], [F.desc("run_at"), F.desc("run_id")], keep)
