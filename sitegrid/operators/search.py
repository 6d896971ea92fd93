"""Search-performance analysis over query, page and date rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from .ranking import top_per_key


def search_totals(perf: DataFrame, by: list[str] = ()) -> DataFrame:
    return perf.groupBy(*by).agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
        F.round(F.avg("position"), 1).alias("position"), F.count("*").alias("rows"))


def _capped(df: DataFrame, by: list[str], order: list[Column], k: int | None) -> DataFrame:
    return df if k is None else top_per_key(df, by, order, k)


def striking_distance(perf: DataFrame, preset: str = "export", by: list[str] = (), k: int | None = None) -> DataFrame:
    """Rankings within reach. ``export``: positions 4-20 by impressions, report
    size 40. ``api``: positions 5-20 with the clicks position three would add,
    report size 200. ``k`` cuts to a report; by default all rows stay."""
    pos, impr = F.col("position"), F.col("impressions")
    if preset == "export":
        rows = perf.filter(pos.between(4, 20) & (impr >= 30)).withColumn(
            "page_one", F.col("position") <= 10)
        return _capped(rows, list(by), [F.desc("impressions"), *map(F.col, _ident(perf))], k)
    gain = X.half_up(impr * (F.lit(0.10) - F.col("ctr")))
    rows = perf.filter(pos.between(5, 20) & (impr >= 30)).withColumn("opportunity", gain).filter("opportunity > 0")
    return _capped(rows, list(by), [F.desc("opportunity"), *map(F.col, _ident(perf))], k)


def _ident(perf: DataFrame) -> list[str]:
    return [c for c in ("query", "page") if c in perf.columns]


def expected_ctr(position: Column, curve: dict[int, float]) -> Column:
    at = X.half_up(position)
    return reduce(lambda c, kv: c.when(at == kv[0], kv[1]), curve.items(), F.when(F.lit(False), 0.0)).otherwise(
        V.CTR_FLOOR)


def ctr_gaps(perf: DataFrame, preset: str = "export", by: list[str] = (), k: int | None = None) -> DataFrame:
    """Rows clicked far less than their position earns. ``export``: relative gap
    of -35 percent or worse. ``api``: more than 1.5 points, with missed clicks."""
    pos, impr, ctr = F.col("position"), F.col("impressions"), F.col("ctr")
    order = [*map(F.col, _ident(perf))]
    if preset == "export":
        rows = perf.filter((impr >= 100) & pos.between(1, 10)).withColumn(
            "expected", expected_ctr(pos, V.CTR_CURVE_EXPORT))
        rows = rows.withColumn("gap", F.round((ctr - F.col("expected")) / F.col("expected") * 100).cast("int"))
        return _capped(rows.filter("gap <= -35"), list(by), [F.desc("impressions"), *order], k)
    rows = perf.filter((impr >= 100) & (pos <= 10.5)).withColumn("expected", expected_ctr(pos, V.CTR_CURVE_API))
    rows = rows.withColumn("gap", X.half_up_to((F.col("expected") - ctr) * 100, 1)).withColumn(
        "missed_clicks", X.half_up(impr * (F.col("expected") - ctr)))
    return _capped(rows.filter("gap > 1.5"), list(by), [F.desc("missed_clicks"), *order], k)


def cannibalisation(perf: DataFrame, preset: str = "export", by: list[str] = ()) -> DataFrame:
    """Queries on which several pages compete, one row per competing page.

    Query totals are partially aggregated and joined back, so a query with very
    many rows is split by the skew join instead of being windowed in one task.
    """
    keys = [*by, "query"]
    totals = perf.groupBy(*keys).agg(
        F.sum("impressions").alias("total_impressions"), F.sum("clicks").alias("total_clicks"),
        F.count("*").alias("n_pages"), F.min("position").alias("best_position"))
    share = F.col("impressions") / F.col("total_impressions")
    if preset == "export":
        big = totals.filter((F.col("total_impressions") >= 60) & (F.col("n_pages") >= 2))
        sharing = perf.join(big, keys).filter(share > 0.15).withColumn("share", X.half_up(share * 100)).drop("n_pages")
        rest = [c for c in sharing.columns if c not in keys]
        # shares above 0.15 add up to at most one, so a query has at most six such rows
        packed = sharing.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("rows")).filter(F.size("rows") >= 2)
        return packed.select(*keys, F.size("rows").cast("bigint").alias("competing"), F.explode("rows").alias("r")).select(
            *keys, "competing", "r.*")
    big = totals.filter((F.col("total_impressions") >= 50) & (F.col("n_pages") >= 2))
    top = top_per_key(perf.join(big, keys, "left_semi"), keys, [F.desc("impressions"), F.col("page")], 5)
    lead = top.groupBy(*keys).agg(F.max(F.when(F.col("rank") == 1, F.col("impressions"))).alias("first"),
                                  F.max(F.when(F.col("rank") == 2, F.col("impressions"))).alias("second"))
    ratio = F.col("second") / F.col("first")
    return (top.join(big, keys).join(lead.filter(ratio > 0.2), keys)
            .withColumn("severity", F.when((F.col("n_pages") > 2) | (ratio > 0.6), "High").otherwise("Medium"))
            .withColumn("share", X.half_up(share * 100)).drop("first", "second"))


def _change(now: Column, before: Column) -> Column:
    return F.when(before != 0, X.half_up_to((now - before) / before * 100, 1)).otherwise(0.0)


def traffic_triage(daily: DataFrame, drop: tuple[str, str], base: tuple[str, str], by: list[str] = ()) -> DataFrame:
    """Four windows in one pass - now, base, and both a year earlier - with the
    verdicts for seasonality and result-layout change. ``daily``: date, clicks,
    impressions, position."""
    def window(span: tuple[str, str], back: bool) -> Column:
        a, b = (F.add_months(F.lit(d).cast("date"), -12 if back else 0) for d in span)
        return F.col("date").between(a, b)

    def total(col: str, cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0))

    now, before = window(drop, False), window(base, False)
    t = daily.groupBy(*by).agg(
        total("clicks", now).alias("clicks_now"), total("clicks", before).alias("clicks_before"),
        total("impressions", now).alias("impr_now"), total("impressions", before).alias("impr_before"),
        F.round(F.avg(F.when(now, F.col("position"))), 1).alias("pos_now"),
        F.round(F.avg(F.when(before, F.col("position"))), 1).alias("pos_before"),
        total("clicks", window(drop, True)).alias("_yn"), total("clicks", window(base, True)).alias("_yb"))
    t = t.withColumns({
        "click_change": _change(F.col("clicks_now"), F.col("clicks_before")),
        "impr_change": _change(F.col("impr_now"), F.col("impr_before")),
        "yoy_change": _change(F.col("_yn"), F.col("_yb"))}).drop("_yn", "_yb")
    return t.withColumns({
        "seasonality": F.when(F.abs(F.col("yoy_change") - F.col("click_change")) < 10, "likely").otherwise("unlikely"),
        "layout_change": F.when((F.col("impr_change") > -8) & (F.col("click_change") < -15), "likely")
        .otherwise("unlikely")})


TRIAGE_STEPS = ["tracking", "seasonality", "layout_change", "core_update", "manual_action", "regression", "competitors"]


def triage_steps(triage: DataFrame, by: list[str] = ()) -> DataFrame:
    """The seven checks in order; two are decided by the data, the rest are for people."""
    verdict = {"seasonality": F.col("seasonality"), "layout_change": F.col("layout_change"),
               "tracking": F.lit("manual"), "manual_action": F.lit("manual")}
    rows = F.array(*[F.struct(F.lit(i + 1).alias("n"), F.lit(s).alias("step"),
                              verdict.get(s, F.lit("check")).alias("verdict")) for i, s in enumerate(TRIAGE_STEPS)])
    return triage.select(*by, F.explode(rows).alias("s")).select(*by, "s.*")


def period_deltas(before: DataFrame, after: DataFrame, dim: str, by: list[str] = ()) -> DataFrame:
    """Per page or query: before against after, a missing side counts as zero.
    One tagged aggregation instead of an outer join."""
    cols = [*by, dim, "clicks", "impressions", "position"]
    both = before.select(*cols, F.lit(True).alias("_b")).unionByName(after.select(*cols, F.lit(False).alias("_b")))

    def total(col: str, b: bool) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_b") == b, F.col(col))), F.lit(0)).cast("bigint")

    out = both.groupBy(*by, F.col(dim).alias("key")).agg(
        total("clicks", True).alias("clicks_before"), total("clicks", False).alias("clicks_after"),
        total("impressions", True).alias("impr_before"), total("impressions", False).alias("impr_after"),
        F.round(F.avg(F.when(F.col("_b"), F.col("position"))), 1).alias("pos_before"),
        F.round(F.avg(F.when(~F.col("_b"), F.col("position"))), 1).alias("pos_after"))
    return out.withColumn("delta", F.col("clicks_after") - F.col("clicks_before"))


def cluster_by_landing_page(perf: DataFrame, by: list[str] = (), least: int = 10, k: int | None = None) -> DataFrame:
    """Queries grouped by the page they land on: totals, primary query and its
    queries in order; the top ``k`` if given. A page has no more queries than people ask."""
    rows = perf.filter(F.col("impressions") >= least)
    keys = [*by, "page"]
    totals = rows.groupBy(*keys).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
                                     F.count("*").alias("query_count"))
    listed = rows if k is None else top_per_key(rows, keys, [F.desc("impressions"), F.col("query")], k).drop("rank")
    top = listed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("impressions")).alias("order"), "query", "clicks", "impressions", "position"))).alias("q")).select(
        *keys, F.transform("q", lambda x, i: F.struct(
            (i + 1).alias("rank"), *[x[c].alias(c) for c in ("query", "clicks", "impressions", "position")])).alias("queries"))
    return totals.join(top, keys).withColumn("primary_query", F.col("queries")[0]["query"])


def trend_read(daily: DataFrame, by: list[str] = ()) -> DataFrame:
    """Halves of a daily series compared; NULL reading under 14 points.
    ``daily`` holds one row per day, so a series is short."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    pts = daily.filter(F.col("date").isNotNull()).withColumns({
        "_rn": F.row_number().over(w.orderBy("date")), "_n": F.count("*").over(w)})
    late = F.col("_rn") > F.floor(F.col("_n") / 2)

    def half(col: str, second: bool, agg=F.sum) -> Column:
        return agg(F.when(late if second else ~late, F.col(col)))

    def pct(col: str) -> Column:
        a, b = half(col, False), half(col, True)
        return F.when(a != 0, X.half_up((b - a) / a * 100)).otherwise(0)

    t = pts.groupBy(*by).agg(
        F.count("*").alias("points"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
        F.round(F.avg("position"), 1).alias("position"), pct("clicks").alias("clicks_change"),
        pct("impressions").alias("impr_change"),
        F.round(half("position", True, F.avg) - half("position", False, F.avg), 1).alias("position_change"))
    c, i, p = F.col("clicks_change"), F.col("impr_change"), F.col("position_change")
    read = (F.when(F.col("points") < 14, None).when((c <= -15) & (F.abs(i) < 10), "ctr")
            .when((c <= -15) & (i <= -15) & (p > 1), "ranking")
            .when((c <= -15) & (i <= -15) & (F.abs(p) <= 1), "demand").when(c >= 15, "up").otherwise("flat"))
    return t.withColumn("reading", read)


def index_status(inspections: DataFrame) -> DataFrame:
    """Stored inspection results with the canonical agreement, NULL when either is missing."""
    fields = ["verdict", "coverage_state", "robots_state", "indexing_state", "fetch_state", "google_canonical",
              "user_canonical", "last_crawl_time"]
    return inspections.select("run_id", "site", "url", *fields, F.when(
        F.col("google_canonical").isNotNull() & F.col("user_canonical").isNotNull(),
        F.col("google_canonical") == F.col("user_canonical")).alias("canonical_match"))


def sitemap_coverage(status: DataFrame) -> DataFrame:
    return status.select("run_id", "site", "path", "errors", "warnings", "submitted", "indexed",
                         X.percent(F.col("indexed"), F.col("submitted")).alias("coverage"))
