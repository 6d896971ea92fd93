"""Saved result pages, answers, behaviour exports, field and lab measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V

_LISTED = r'(?is)<a[^>]+class="result__a"[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
_PLAIN = r'(?i)<a[^>]+href="/url\?q=([^&"]+)[^"]*"[^>]*>|<a[^>]+href="(https?://[^"]+)"[^>]*><(?:h3|br)'
_OWN = r"google\.|gstatic|googleusercontent|/search\?"


def read_serp_pages(pages: DataFrame, layout: str = "listed", keep: int = 30) -> DataFrame:
    """Saved result-page markup to ranked rows. ``pages``: query, html. Two
    layouts: ``listed`` (class-marked links with titles) and ``plain``."""
    if layout == "listed":
        hits = F.arrays_zip(F.regexp_extract_all("html", F.lit(_LISTED), F.lit(1)).alias("href"),
                            F.regexp_extract_all("html", F.lit(_LISTED), F.lit(2)).alias("text"))
        rows = pages.select("query", F.posexplode(hits).alias("pos", "h")).select(
            "query", "pos", F.col("h.href").alias("href"), F.col("h.text").alias("text"))
        wrapped = F.try_url_decode(F.regexp_extract("href", r"uddg=([^&]+)", 1))
        rows = rows.select("query", "pos", F.when(F.contains("href", F.lit("uddg=")), wrapped).otherwise(
            F.col("href")).alias("url"), F.trim(F.replace(F.regexp_replace("text", "<[^>]+>", ""), F.lit("&amp;"),
                                                          F.lit("&"))).alias("title"))
    else:
        tags = F.regexp_extract_all("html", F.lit(_PLAIN), F.lit(0))
        rows = pages.select("query", F.posexplode(tags).alias("pos", "tag"))
        wrapped = F.try_url_decode(F.regexp_extract("tag", r'(?i)href="/url\?q=([^&"]+)', 1))
        direct = F.regexp_extract("tag", r'(?i)href="(https?://[^"]+)"', 1)
        rows = rows.select("query", "pos", F.substring_index(F.when(direct != "", direct).otherwise(wrapped), "#", 1)
                           .alias("url"), F.lit("").alias("title"))
        rows = rows.filter(~F.col("url").rlike(_OWN)).groupBy("query", "url", "title").agg(F.min("pos").alias("pos"))
    kept = rows.filter(F.col("url").rlike("^https?:"))
    # one page lists a few dozen links, which bounds the list per query
    ranked = kept.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("pos", "url", "title"))).alias("r"))
    return ranked.select("query", F.posexplode(F.slice("r", 1, keep)).alias("i", "x")).select(
        "query", (F.col("i") + 1).alias("position"), "x.url", "x.title")


def read_ai_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answers as stored, error rows kept."""
    return spark.read.parquet(path).select("run_id", "prompt", "provider", "model", "answer", "error")


def string_number(v: Column) -> Column:
    return F.replace(v, F.lit(","), F.lit("")).try_cast("double")


_METRICS = "array<struct<metricName:string,information:array<map<string,string>>>>"


def behaviour_rows(docs: DataFrame, column: str = "json") -> DataFrame:
    """Metric-array JSON to long rows: metric, dims, value. Numbers arrive as
    strings. Traffic rows become the metrics sessions and bot_sessions."""
    m = docs.select(*[c for c in docs.columns if c != column],
                    F.explode(F.from_json(column, _METRICS)).alias("m"))
    rest = [c for c in m.columns if c != "m"]
    info = m.select(*rest, F.col("m.metricName").alias("metric"), F.explode("m.information").alias("i"))
    numbers = F.filter(F.transform(F.map_values("i"), string_number), lambda n: n.isNotNull())
    value = F.coalesce(string_number(F.try_element_at("i", F.col("metric"))),
                       string_number(F.try_element_at("i", F.lit("count"))), F.get(numbers, F.lit(0)), F.lit(0.0))
    dims = F.map_filter("i", lambda k, v: string_number(v).isNull())
    plain = info.filter(F.col("metric") != "Traffic").select(*rest, "metric", dims.alias("dims"), value.alias("value"))
    traffic = info.filter(F.col("metric") == "Traffic").select(*rest, dims.alias("dims"), F.explode(F.array(
        F.struct(F.lit("sessions").alias("metric"),
                 string_number(F.try_element_at("i", F.lit("totalSessionCount"))).alias("value")),
        F.struct(F.lit("bot_sessions").alias("metric"),
                 string_number(F.try_element_at("i", F.lit("totalBotSessionCount"))).alias("value")))).alias("t"))
    return plain.unionByName(traffic.select(*rest, "t.metric", "dims", F.coalesce("t.value", F.lit(0.0)).alias("value")))


def read_behaviour(spark: SparkSession, path: str) -> DataFrame:
    return behaviour_rows(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


_FIELD = ("record struct<key:struct<origin:string,url:string,formFactor:string>,"
          "collectionPeriods:array<struct<lastDate:struct<year:int,month:int,day:int>>>,"
          "metrics:map<string,struct<percentilesTimeseries:struct<p75s:array<string>>,"
          "histogramTimeseries:array<struct<densities:array<double>>>>>>")


def field_rows(docs: DataFrame, column: str = "json") -> DataFrame:
    """p75 time series JSON to long rows, one per metric and period."""
    r = docs.select(F.from_json(column, _FIELD)["record"].alias("r"))
    m = r.select(F.coalesce("r.key.origin", "r.key.url").alias("site"), F.col("r.key.formFactor").alias("form_factor"),
                 F.col("r.collectionPeriods").alias("periods"), F.explode("r.metrics").alias("metric", "node"))
    zipped = F.arrays_zip(F.col("periods").alias("d"), F.col("node.percentilesTimeseries.p75s").alias("p"),
                          F.coalesce(F.get("node.histogramTimeseries", F.lit(0))["densities"],
                                     F.array().cast("array<double>")).alias("g"))
    return m.select("site", "metric", "form_factor", F.explode(zipped).alias("z")).select(
        "site", "metric", "form_factor",
        F.make_date("z.d.lastDate.year", "z.d.lastDate.month", "z.d.lastDate.day").alias("period_end"),
        F.col("z.p").try_cast("double").alias("p75"), F.col("z.g").alias("good_share"))


def read_field_metrics(spark: SparkSession, path: str) -> DataFrame:
    return field_rows(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


_AUDIT = "map<string,struct<id:string,title:string,score:double,displayValue:string,details:struct<type:string,overallSavingsMs:double>>>"


def lab_rows(docs: DataFrame, column: str = "json") -> dict[str, DataFrame]:
    """Lab result JSON to four tables: scores (with the main metrics),
    opportunities over 100 ms, failed diagnostics, failed search checks."""
    v = docs.select(F.try_parse_json(column).alias("v")).filter(F.col("v").isNotNull())

    def get(path: str, t: str = "string") -> Column:
        return F.try_variant_get("v", path, t)

    def score(name: str) -> Column:
        return F.floor(F.coalesce(get(f"$.lighthouseResult.categories['{name}'].score", "double"), F.lit(0.0)) * 100
                       + 0.5).cast("int")

    def shown(name: str) -> Column:
        return get(f"$.lighthouseResult.audits['{name}'].displayValue")

    url, at = get("$.id").alias("url"), get("$.analysisUTCTimestamp").alias("at")
    scores = v.select(url, at, score("performance").alias("performance"), score("seo").alias("seo"),
                      score("accessibility").alias("accessibility"), score("best-practices").alias("best_practices"),
                      shown("largest-contentful-paint").alias("lcp"), shown("cumulative-layout-shift").alias("cls"),
                      shown("total-blocking-time").alias("tbt"), shown("first-contentful-paint").alias("fcp"),
                      shown("speed-index").alias("si"))
    audits = v.select(url, F.explode(F.from_json(F.to_json(F.try_variant_get(
        "v", "$.lighthouseResult.audits", "variant")), _AUDIT)).alias("id", "a"), F.from_json(F.to_json(
            F.try_variant_get("v", "$.lighthouseResult.categories.seo.auditRefs", "variant")),
            "array<struct<id:string>>").alias("refs"))
    saving = F.col("a.details.overallSavingsMs")
    opportunities = audits.filter((F.col("a.details.type") == "opportunity") & (saving > 100)).select(
        "url", "id", F.col("a.title").alias("title"), F.floor(saving + 0.5).cast("int").alias("savings_ms"))
    diagnostics = audits.filter(F.col("id").isin(V.LAB_DIAGNOSTICS) & (F.col("a.score") < 0.9)).select(
        "url", "id", F.col("a.title").alias("title"), F.col("a.displayValue").alias("display"))
    failed = audits.filter((F.col("a.score") < 1) & F.coalesce(
        F.exists("refs", lambda r: r["id"] == F.col("id")), F.lit(False))).select(
        "url", "id", F.col("a.title").alias("title"))
    return {"scores": scores, "opportunities": opportunities, "diagnostics": diagnostics, "failed_seo": failed}


def read_lab_results(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return lab_rows(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))
