"""Dashboard distributions over the page table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from .audit import severity_rank, stage_rank
from .ranking import top_per_key

KEY = ["run_id", "site"]


def bucket_index(value: Column, edges: list[int]) -> Column:
    """Index of the first edge at or above the value, ``len(edges)`` beyond all."""
    out = F.when(value <= edges[0], 0)
    for i, e in enumerate(edges[1:], start=1):
        out = out.when(value <= e, i)
    return out.otherwise(len(edges))


def histogram(df: DataFrame, value: Column, edges: list, by: list[str] = KEY) -> DataFrame:
    """Counts per right-closed bucket, empty buckets kept. One aggregation gives
    all buckets as columns, unpivoted afterwards."""
    b = df.select(*by, bucket_index(value, edges).alias("b"))
    n = len(edges) + 1
    wide = b.groupBy(*by).agg(*[F.count_if(F.col("b") == i).alias(f"b{i}") for i in range(n)])
    rows = F.array(*[F.struct(
        F.lit(i).alias("bucket"), F.lit(None if i == n - 1 else edges[i]).cast("double").alias("upto"),
        F.col(f"b{i}").alias("n")) for i in range(n)])
    return wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def ok_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("content_type").rlike("(?i)html") & (F.col("status") == 200))


def depth_distribution(pages: DataFrame) -> DataFrame:
    """Dense counts from 0 to the deepest page, with the share deeper than three."""
    per = ok_pages(pages).groupBy(*KEY, F.coalesce("depth", F.lit(0)).alias("depth")).agg(F.count("*").alias("n"))
    span = per.groupBy(*KEY).agg(F.max("depth").alias("deepest"), F.sum("n").alias("total"),
                                 F.sum(F.when(F.col("depth") > 3, F.col("n")).otherwise(0)).alias("deep"))
    grid = span.select(*KEY, F.explode(F.sequence(F.lit(0), "deepest")).alias("depth"),
                       X.percent(F.col("deep"), F.col("total")).alias("deep_share"))
    return grid.join(per, [*KEY, "depth"], "left").fillna(0, ["n"]).select(*KEY, "depth", "n", "deep_share")


def status_classes(pages: DataFrame) -> DataFrame:
    cls = F.when(F.coalesce("status", F.lit(0)) == 0, "failed").otherwise(
        F.concat(F.substring(F.col("status").cast("string"), 1, 1), F.lit("xx")))
    return pages.groupBy(*KEY, cls.alias("class")).agg(F.count("*").alias("n"))


def title_widths(pages: DataFrame) -> DataFrame:
    px = ok_pages(pages).filter(F.col("title") != "").withColumn("px", X.pixel_width(F.col("title")))
    return histogram(px, F.col("px"), V.TITLE_PX_EDGES)


def title_width_limits(pages: DataFrame) -> DataFrame:
    px = ok_pages(pages).filter(F.col("title") != "").withColumn("px", X.pixel_width(F.col("title")))
    return px.groupBy(*KEY).agg(F.count_if(F.col("px") > V.TITLE_MAX_PX).alias("over"),
                                F.count_if(F.col("px") < V.TITLE_MIN_PX).alias("under"), F.count("*").alias("titled"))


def word_distribution(pages: DataFrame) -> DataFrame:
    return histogram(ok_pages(pages), F.coalesce("word_count", F.lit(0)), V.WORD_EDGES)


def inbound_distribution(pages_with_inbound: DataFrame) -> DataFrame:
    return histogram(ok_pages(pages_with_inbound), F.coalesce("inbound_count", F.lit(0)), V.INBOUND_EDGES)


def response_percentiles(pages: DataFrame) -> DataFrame:
    """p50, p75, p95 of response times, only from more than four samples."""
    timed = pages.filter(F.col("response_ms") > 0)
    return timed.groupBy(*KEY).agg(
        F.count("*").alias("samples"), *[X.upper_quantile("response_ms", q / 100).cast("bigint").alias(f"p{q}")
                                         for q in (50, 75, 95)]).filter(F.col("samples") > 4)


def response_distribution(pages: DataFrame) -> DataFrame:
    return histogram(pages.filter(F.col("response_ms") > 0), F.col("response_ms"), V.RESPONSE_EDGES)


def indexability_split(pages: DataFrame) -> DataFrame:
    html = pages.filter(F.col("content_type").rlike("(?i)html"))
    noindex, blocked = F.count_if(F.coalesce("noindex", F.lit(False))), F.count_if(
        ~F.coalesce("robots_allowed", F.lit(True)))
    return html.groupBy(*KEY).agg((F.count("*") - noindex - blocked).alias("indexable"),
                                  noindex.alias("noindex"), blocked.alias("blocked"))


def findings_by_stage(findings: DataFrame) -> DataFrame:
    """Stage by severity, and the earliest stage with a serious finding."""
    per = findings.groupBy(*KEY, "stage").pivot("severity", V.SEVERITIES).agg(F.count(F.lit(1))).fillna(0)
    first = findings.filter(severity_rank() <= 2).groupBy(*KEY).agg(F.min(stage_rank()).alias("first_serious_stage"))
    return per.join(first, KEY, "left")


def schema_coverage(pages: DataFrame, k: int | None = None) -> DataFrame:
    """Structured-data types by use, the ``k`` most used if given, with the share of
    pages carrying any."""
    ok = ok_pages(pages)
    cover = ok.groupBy(*KEY).agg(X.percent(F.count_if(F.size("schema_types") > 0), F.count("*")).alias("coverage"))
    types = ok.select(*KEY, F.explode("schema_types").alias("type")).groupBy(*KEY, "type").agg(
        F.count("*").alias("pages"))
    return top_per_key(types, KEY, [F.desc("pages"), F.col("type")], k).join(cover, KEY)

