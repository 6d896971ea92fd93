"""Fetched responses and the page table extracted from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..functions import urls as U
from ..functions.html import markup
from ..schemas import PAGES_RAW


def keep_headers(headers: Column) -> Column:
    """Lower-case names, allow-listed and non-empty."""
    named = F.transform_keys(headers, lambda k, _: F.lower(k))
    return F.map_filter(named, lambda k, v: k.isin(V.KEPT_HEADERS) & v.isNotNull() & (v != ""))


def with_page_defaults(df: DataFrame, run_id: str = "run") -> DataFrame:
    """Fill every fetch column a source may lack, so any table with ``url`` and
    ``html`` is a valid input."""
    have = set(df.columns)

    def col(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    null = F.lit(None)
    values = {
        "run_id": col("run_id", F.lit(run_id)),
        "site": col("site", U.bare_host(F.col("url"))),
        "final_url": col("final_url", F.col("url")),
        "depth": col("depth", null), "linked_from": col("linked_from", F.array()),
        "status": col("status", F.lit(200)), "hops": col("hops", F.lit(0)),
        "content_type": col("content_type", F.lit("text/html")),
        "bytes": col("bytes", F.octet_length("html")), "response_ms": col("response_ms", null),
        "error": col("error", null), "discovered_via": col("discovered_via", null),
        "robots_allowed": col("robots_allowed", F.lit(True)), "robots_rule": col("robots_rule", null),
        "headers": keep_headers(F.col("headers")) if "headers" in have else F.create_map(),
        "url": F.col("url"), "html": F.col("html"),
    }
    return df.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in PAGES_RAW.fields])


def read_pages(spark: SparkSession, path: str, run_id: str = "run") -> DataFrame:
    """Parquet table of fetched pages, completed to the raw page schema."""
    return with_page_defaults(spark.read.parquet(path), run_id)


def schema_types(jsonld: Column) -> Column:
    """Distinct ``@type`` names in any depth of the structured-data blocks."""
    raw = F.flatten(F.transform(jsonld, lambda j: F.regexp_extract_all(
        j, F.lit(r'"@type"\s*:\s*("(?:[^"\\]|\\.)*"|\[[^\]]*\])'), F.lit(1))))
    names = F.flatten(F.transform(raw, lambda t: F.regexp_extract_all(t, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))))
    return F.array_distinct(names)


def heading_skips(headings: Column) -> Column:
    """Every downward jump of more than one level."""
    pairs = F.zip_with(
        F.slice(headings, F.lit(1), F.greatest(F.size(headings) - 1, F.lit(0))),
        F.slice(headings, F.lit(2), F.greatest(F.size(headings) - 1, F.lit(0))),
        lambda a, b: F.struct(a["level"].alias("from"), b["level"].alias("to"),
                              F.substring(b["text"], 1, 80).alias("text")))
    return F.filter(pairs, lambda s: s["to"] > s["from"] + 1)


def extract_pages(raw: DataFrame) -> DataFrame:
    """The extraction job: raw pages in, typed page table out. Costly and a
    codegen barrier, so run it once per crawl and persist the result."""
    is_html = F.col("content_type").rlike("(?i)text/html")
    html, low = F.col("html"), F.col("low")
    link_header = F.element_at("headers", "link")
    marked = raw.withColumn("html", F.when(is_html, html)).withColumn("low", F.lower("html")).withColumn(
        "m", markup(html, F.col("final_url")))

    def lacks(*needed: str) -> Column:
        """None of the strings, one of which stands in all that a pattern matches, in any case."""
        return reduce(lambda a, b: a & b, [~F.contains(low, F.lit(x)) for x in needed])

    none = F.array().cast("array<string>")
    head = marked.select(
        *[c for c in PAGES_RAW.names if c != "html"], "m.*",
        F.element_at("headers", "x-robots-tag").alias("x_robots_tag"),
        F.nullif(F.trim(F.regexp_extract(link_header, V.HEADER_CANONICAL, 1)), F.lit("")).alias("header_canonical"),
        F.when(lacks(*[f"id={q}{i}" for q in "\"'" for i in ("root", "app", "__next")]), F.lit(False))
        .otherwise(html.rlike(V.EMPTY_APP_ROOT)).alias("root_div_empty"),
        F.when(F.col("final_url").startswith("https://") & lacks("\"http://", "'http://"), none)
        .when(F.col("final_url").startswith("https://"),
              F.slice(F.regexp_extract_all(html, F.lit(V.INSECURE_REF), F.lit(1)), 1, V.MAX_INSECURE_REFS))
        .otherwise(none).alias("insecure_refs"),
        F.when(lacks("http-equiv"), F.lit("")).otherwise(F.regexp_extract(html, V.META_REFRESH_TAG, 0)).alias("refresh_tag"),
        F.when(lacks("@font-face"), F.lit(0)).otherwise(F.regexp_count(html, F.lit("(?i)@font-face"))).alias("font_faces"),
        F.when(lacks("font-display"), F.lit(0)).otherwise(F.regexp_count(html, F.lit(r"(?i)font-display\s*:"))).alias("font_display"),
        F.when(lacks("preconnect", "dns-prefetch"), none)
        .otherwise(F.regexp_extract_all(html, F.lit(V.PRECONNECT), F.lit(1))).alias("preconnects"),
        (F.when(lacks("stylesheet"), F.lit(0)).otherwise(F.regexp_count(html, F.lit(V.BLOCKING_STYLE)))
         + F.when(lacks("src="), F.lit(0)).otherwise(F.regexp_count(html, F.lit(V.BLOCKING_SCRIPT)))).alias("render_blocking"),
        X.detect_platform(html, F.col("headers"), low).alias("platform"),
    )
    directives = F.lower(F.concat_ws(
        ",", F.array_join(F.transform("meta_robots", lambda d: d["content"]), ","), F.col("x_robots_tag")))
    canonicals = F.array_compact(F.concat(
        F.coalesce(F.col("tag_canonicals"), F.array()),
        F.array(F.coalesce(U.normalise_absolute(F.col("header_canonical")), F.col("header_canonical")))))
    refresh = F.when(F.col("refresh_tag") != "", F.struct(
        F.expr(r"try_cast(regexp_extract(refresh_tag, '(?i)content\\s*=\\s*[\"\']?\\s*(\\d+)\\s*;\\s*url', 1) AS INT)")
        .alias("delay"),
        F.nullif(F.trim(F.regexp_extract("refresh_tag", V.META_REFRESH_TARGET, 2)), F.lit("")).alias("target")))
    typed = head.withColumns({
        "noindex": F.coalesce(directives.rlike(r"\bnoindex\b"), F.lit(False)),
        "nofollow_page": F.coalesce(directives.rlike(r"\bnofollow\b"), F.lit(False)),
        "noarchive": F.coalesce(directives.rlike(r"\bnoarchive\b"), F.lit(False)),
        "canonicals": canonicals,
        "canonical": F.get(canonicals, F.lit(0)),
        "h1s": F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["text"]),
        "heading_skips": heading_skips(F.col("headings")),
        "schema_types": schema_types(F.col("jsonld")),
        "word_count": X.squashed_word_count(F.col("body_text")),
        "content_hash": X.content_hash(F.col("body_text")),
        "phones": X.phones(F.col("body_text")),
        "meta_refresh": refresh,
    })
    return typed.withColumns({
        "self_canonical": F.coalesce(F.col("canonical") == F.coalesce(
            U.normalise_absolute(F.col("final_url")), F.col("final_url")), F.lit(False)),
        "has_breadcrumb_markup": F.coalesce(F.array_contains("schema_types", "BreadcrumbList"), F.lit(False)),
        "has_author_markup": F.coalesce(F.array_contains("schema_types", "Person") | F.col("has_author_el"),
                                        F.lit(False)),
    }).drop("refresh_tag", "tag_canonicals", "has_author_el")


def with_shingles(pages: DataFrame) -> DataFrame:
    return pages.withColumn("shingles", X.whole_shingles(F.col("body_text")))


def structured_data(pages: DataFrame) -> DataFrame:
    """One row per structured-data object, body as VARIANT."""
    return (pages.select("run_id", "site", "url", F.posexplode("jsonld").alias("block", "json"))
            .withColumn("body", F.try_parse_json("json")))


def links_of(pages: DataFrame) -> DataFrame:
    """Edge table: one row per anchor."""
    return pages.select("run_id", "site", F.col("url").alias("from_url"),
                        F.posexplode("links").alias("pos", "l")).select(
        "run_id", "site", "from_url", "pos", "l.*")


def images_of(pages: DataFrame) -> DataFrame:
    return pages.select("run_id", "site", "url", F.posexplode("images").alias("pos", "i")).select(
        "run_id", "site", "url", "pos", "i.*")


def hreflang_of(pages: DataFrame) -> DataFrame:
    return pages.select("run_id", "site", "url", F.posexplode("hreflang").alias("pos", "h")).select(
        "run_id", "site", "url", "pos", "h.lang", "h.href")
