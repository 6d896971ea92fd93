"""Behaviour exports and field speed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X


def friction_signals(behaviour: DataFrame, by: list[str] = ()) -> DataFrame:
    """Six signals: total and rate per 1000 sessions. ``behaviour``: by...,
    metric, value; sessions and bot sessions come as metrics ``sessions`` and
    ``bot_sessions``."""
    by = list(by)
    if not by:
        return friction_signals(behaviour.withColumn("_all", F.lit(1)), ["_all"]).drop("_all")
    per = behaviour.groupBy(*by, "metric").agg(F.sum("value").alias("total"))
    names = [m for m, _, _ in V.FRICTION_METRICS]
    sessions = traffic_summary(behaviour, by)

    def look(i: int) -> Column:
        return reduce(lambda c, m: c.when(F.col("metric") == m[0], m[i]), V.FRICTION_METRICS, F.when(F.lit(False), ""))

    rows = per.filter(F.col("metric").isin(names) & (F.col("total") > 0))
    return rows.join(sessions, by, "left").select(*by, "metric", look(1).alias("label"), look(2).alias("severity"), "total",
                       F.when(F.col("sessions") > 0, F.round(F.col("total") / F.col("sessions") * 1000, 1))
                       .alias("per_1000"))


def traffic_summary(behaviour: DataFrame, by: list[str] = ()) -> DataFrame:
    def total(metric: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("metric") == metric, F.col("value"))), F.lit(0.0))

    s, b = total("sessions"), total("bot_sessions")
    return behaviour.groupBy(*by).agg(s.alias("sessions"), b.alias("bot_sessions"), F.when(
        s + b > 0, X.half_up(b / (s + b) * 100)).alias("bot_share"))


def _rating(value: Column, good: Column, fair: Column) -> Column:
    return F.when(value <= good, "GOOD").when(value <= fair, "NEEDS_IMPROVEMENT").when(value.isNotNull(), "POOR")


def _limits(spark, table) -> DataFrame:
    return F.broadcast(spark.createDataFrame(table, "metric string, label string, good double, fair double"))


def field_trend(field_metrics: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """First and latest reading per site and metric, change and rating.
    ``field_metrics``: site, metric, period_end, p75."""
    limits = _limits(field_metrics.sparkSession, V.FIELD_THRESHOLDS) if thresholds is None else thresholds
    seen = field_metrics.filter(F.col("p75").isNotNull())
    per = seen.groupBy("site", "metric").agg(
        F.min_by("p75", "period_end").alias("first"), F.max_by("p75", "period_end").alias("latest"),
        F.count("*").alias("points"))
    change = F.when(F.col("first") != 0, X.half_up((F.col("latest") - F.col("first")) / F.col("first") * 100))
    return per.join(limits, "metric").select(
        "site", "metric", "label", "first", "latest", change.alias("change"),
        _rating(F.col("latest"), F.col("good"), F.col("fair")).alias("rating"), "points")


def field_rating(readings: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """p75 per metric against its limits; metrics without limits keep NULL."""
    limits = _limits(readings.sparkSession, V.LAB_THRESHOLDS) if thresholds is None else thresholds
    return readings.join(limits, "metric", "left").select(
        *[c for c in readings.columns], F.coalesce("label", "metric").alias("label"),
        (F.col("p75") <= F.col("good")).alias("good"), _rating(F.col("p75"), F.col("good"), F.col("fair")).alias("rating"))


def lab_series(lab_runs: DataFrame, keep: int | None = None) -> DataFrame:
    """Runs per URL with their points in time order; the latest ``keep`` if given."""
    from .ranking import top_per_key
    counts = lab_runs.groupBy("url").agg(F.count("*").alias("runs"))
    latest = lab_runs if keep is None else top_per_key(lab_runs, ["url"], [F.desc("at")], keep)
    last = latest.groupBy("url").agg(F.array_sort(F.collect_list(
        F.struct("at", "performance", "lcp", "cls", "tbt"))).alias("points"))
    return counts.join(last, "url")
