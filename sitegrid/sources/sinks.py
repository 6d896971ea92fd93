"""Exports: CSV, JSON, sitemaps, redirect rules, snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..functions import urls as U
from ..operators.audit import images_without_alt
from ..operators.ranking import numbered

KEY = ["run_id", "site"]


def _line(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "\r?\n", " ")


def _csv(df: DataFrame, path: str) -> None:
    df.select(*[_line(F.col(f"`{c}`")).alias(c) for c in df.columns]).write.mode("overwrite").csv(
        path, header=True, quoteAll=True, escape='"', emptyValue="")


def joined_urls(finding_urls: DataFrame, most: int = 60) -> DataFrame:
    """Up to ``most`` affected URLs of a finding in one cell; the long table
    keeps all."""
    from ..operators.ranking import top_per_key
    top = top_per_key(finding_urls, [*KEY, "rule"], [F.col("url"), F.col("detail")], most)
    return top.groupBy(*KEY, "rule").agg(F.array_sort(F.collect_list(F.struct("rank", "url"))).alias("u")).select(
        *KEY, "rule", F.transform("u", lambda s: s["url"]).alias("urls"))


def findings_table(findings: DataFrame, finding_urls: DataFrame, most: int = 60) -> DataFrame:
    j = findings.join(joined_urls(finding_urls, most), [*KEY, "rule"], "left")
    return j.select(
        F.col("severity").alias("Severity"), F.col("stage").alias("Phase"), F.col("owner").alias("Owner"),
        F.col("effort").alias("Effort"), F.col("title").alias("Title"), F.col("example_url").alias("Where"),
        F.col("what").alias("What"), F.col("why").alias("Why"), F.col("fix").alias("Fix"),
        F.array_join(F.coalesce("urls", F.array().cast("array<string>")), " | ").alias("Affected URLs"))


def write_findings_csv(findings: DataFrame, finding_urls: DataFrame, path: str) -> None:
    _csv(findings_table(findings, finding_urls), path)


def crawl_table(pages: DataFrame) -> DataFrame:
    """The 18 columns of a crawl export; needs inbound columns."""
    open_page = (F.col("status") == 200) & ~F.coalesce("noindex", F.lit(False)) & F.coalesce(
        "robots_allowed", F.lit(True))
    bare = F.filter("images", lambda i: ~i["has_alt"] | (F.trim(F.coalesce(i["alt"], F.lit(""))) == ""))
    return pages.select(
        F.col("url").alias("URL"), F.col("status").alias("Status"), F.col("hops").alias("Hops"),
        F.col("depth").alias("Depth"), F.when(open_page, "yes").otherwise("no").alias("Indexable"),
        F.col("title").alias("Title"), F.when(F.col("title") != "", X.pixel_width(F.col("title"))).alias("Title px"),
        F.col("meta_description").alias("Meta description"), F.get("h1s", F.lit(0)).alias("H1"),
        F.size("h1s").alias("H1 count"), F.col("word_count").alias("Words"), F.col("canonical").alias("Canonical"),
        F.when(F.col("self_canonical"), "yes").otherwise("no").alias("Self-canonical"),
        F.col("inbound_count").alias("Inbound links"), F.col("inbound_body_count").alias("Inbound body links"),
        F.array_join("schema_types", " ").alias("Schema types"), F.size(bare).alias("Images missing alt"),
        F.col("response_ms").alias("Response ms"))


def write_crawl_csv(pages: DataFrame, path: str) -> None:
    _csv(crawl_table(pages), path)


def _html(c: Column) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br/>")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def workitem_table(findings: DataFrame, finding_urls: DataFrame, area: str = "", iteration: str = "",
                   tag: str = "SEO") -> DataFrame:
    """Ticket import rows: escaped body, priority by severity, acceptance per rule."""
    j = findings.join(joined_urls(finding_urls, 25), [*KEY, "rule"], "left")
    parts = [F.concat(F.lit(f"<b>{name}:</b><br/>"), _html(F.col(col))) for name, col in (
        ("Where", "example_url"), ("What", "what"), ("Why it matters", "why"), ("Fix", "fix"),
        ("Acceptance criteria", "acceptance"))]
    parts.append(F.when(F.size("urls") > 0, F.concat(
        F.lit("<b>Affected URLs ("), F.col("n_urls").cast("string"), F.lit("):</b><br/>"),
        F.array_join(F.transform("urls", _html), "<br/>"))))
    priority = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in V.SEVERITIES]), F.col("severity")), F.lit(3))
    return j.select(
        F.lit("Task").alias("Work Item Type"),
        F.concat(F.lit(f"[{tag}/"), "severity", F.lit("] "), "title").alias("Title"),
        F.concat_ws("<br/><br/>", *parts).alias("Description"),
        F.when(priority > 0, priority).otherwise(3).cast("int").alias("Priority"),
        F.concat_ws(";", F.lit(tag), "owner", "stage").alias("Tags"), F.lit(area).alias("Area Path"),
        F.lit(iteration).alias("Iteration Path"), F.lit("").alias("Assigned To"))


def write_workitem_csv(findings: DataFrame, finding_urls: DataFrame, path: str, area: str = "",
                       iteration: str = "") -> None:
    _csv(workitem_table(findings, finding_urls, area, iteration), path)


def write_link_graph_csv(report: DataFrame, path: str) -> None:
    _csv(report.select(F.col("url").alias("URL"), F.col("title").alias("Title"), F.col("depth").alias("Depth"),
                       F.col("inbound").alias("Inbound"), F.col("inbound_body").alias("Inbound body"),
                       F.col("outbound").alias("Outbound"), F.col("words").alias("Words")), path)


def slim_pages(pages: DataFrame) -> DataFrame:
    """The page fields worth keeping in an export; no text, links or markup."""
    return pages.select(
        *KEY, "url", "final_url", "status", "hops", "depth", "content_type", "response_ms", "error", "title",
        "meta_description", "h1s", "heading_skips", "canonical", "self_canonical", "noindex", "robots_allowed",
        "word_count", "schema_types", "jsonld_errors", "inbound_count", "inbound_body_count",
        F.size("images").alias("image_count"), F.size(images_without_alt()).alias("images_missing_alt"), "platform",
        "discovered_via", "viewport", "lang",
        F.size(F.filter("links", lambda k: k["resolved"].isNotNull())).alias("outbound_count"), "headers")


def write_audit_json(stats: DataFrame, findings: DataFrame, pages: DataFrame, path: str) -> None:
    """One JSON-lines folder per kind, partitioned by site, so no site is gathered
    into one document."""
    for kind, df in (("stats", stats), ("findings", findings), ("pages", slim_pages(pages))):
        df.write.mode("overwrite").partitionBy("site").json(f"{path}/{kind}")


def sitemap_entries(pages: DataFrame, per_file: int = V.SITEMAP_LIMIT) -> DataFrame:
    """Canonical, indexable, live HTML pages with file number and XML element."""
    ok = pages.filter((F.col("status") == 200) & ~F.coalesce("noindex", F.lit(False))
                      & F.coalesce("robots_allowed", F.lit(True))
                      & (F.col("canonical").isNull() | (F.col("canonical") == F.col("url")))
                      & F.col("content_type").rlike("(?i)text/html"))
    stamp = F.try_to_timestamp(F.regexp_extract(
        F.element_at("headers", "last-modified"), r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1),
        F.lit("d MMM yyyy HH:mm:ss"))
    esc = F.col("url")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    xml = F.concat(F.lit("<url><loc>"), esc, F.lit("</loc>"), F.coalesce(
        F.concat(F.lit("<lastmod>"), F.date_format(stamp, "yyyy-MM-dd"), F.lit("</lastmod>")), F.lit("")),
        F.lit("</url>"))
    return numbered(ok.select(*KEY, "url", xml.alias("xml")), KEY, ["url"]).select(
        *KEY, (F.floor((F.col("rn") - 1) / per_file) + 1).cast("int").alias("part"), "url", "xml")


def write_sitemaps(pages: DataFrame, path: str, per_file: int = V.SITEMAP_LIMIT) -> None:
    """One XML document per site and part of at most 50,000 URLs; a document is
    bounded by that limit, so it may be assembled in one row."""
    doc = sitemap_entries(pages, per_file).groupBy(*KEY, "part").agg(F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'
              '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'),
        F.array_join(F.array_sort(F.collect_list("xml")), "\n"), F.lit("\n</urlset>")).alias("value"))
    doc.write.mode("overwrite").partitionBy(*KEY, "part").text(path)


def redirect_rules(mapped: DataFrame, format: str = "csv") -> DataFrame:
    """Redirect map as server rules, one line per row. Formats: htaccess, nginx,
    plugin, json, csv (for review, unmapped rows included)."""
    src, to = U.path(F.col("from_url")), F.col("to_url")
    if format == "csv":
        return mapped.select(F.format_string('"%s","%s",%s,%d,"%s"', "from_url", "to_url", "confidence", "score",
                                             "action").alias("value"))
    rows = mapped.filter(F.col("to_url") != "")
    bare = F.regexp_replace(F.regexp_replace(src, "^/", ""), "/$", "")
    line = {
        "htaccess": F.concat(F.lit("RewriteRule ^"), bare, F.lit("/?$ "), to, F.lit(" [R=301,L]")),
        "nginx": F.concat(F.lit("rewrite ^"), src, F.lit("/?$ "), to, F.lit(" permanent;")),
        "plugin": F.concat(F.lit('"'), src, F.lit('","'), to, F.lit('",url,301')),
        "json": F.to_json(F.struct(src.alias("source"), to.alias("target"), F.lit(301).alias("code"))),
    }[format]
    return rows.select(line.alias("value"))


def write_redirect_rules(mapped: DataFrame, path: str, format: str = "csv") -> None:
    redirect_rules(mapped, format).write.mode("overwrite").text(path)


# --- snapshots -----------------------------------------------------------------------------

_MANIFEST = "snapshot string, write int, saved_at timestamp, rows map<string,bigint>"


def _clean(name: str) -> str:
    return "".join(c if c.isalnum() or c in "-_" else "-" for c in name)


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(_MANIFEST).json(f"{root}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)  # nothing published yet


def _published(spark: SparkSession, root: str) -> DataFrame:
    """The last published write of each snapshot."""
    latest = F.max_by(F.struct("write", "saved_at", "rows"), "write").alias("m")
    return _manifest(spark, root).groupBy("snapshot").agg(latest).select("snapshot", "m.*")


def save_snapshot(tables: dict[str, DataFrame], root: str, name: str) -> None:
    """Each table in a folder of its own; then one line of the manifest, a single file
    that its commit renames into place, publishes all of them at once. A write that ends
    before that stays invisible, and the next one under the name overwrites what it left.
    A name saved again shows its last write. One writer a name at a time."""
    if "manifest" in tables:
        raise ValueError("no table may be called manifest")
    spark = next(iter(tables.values())).sparkSession
    snapshot = _clean(name)
    write = _manifest(spark, root).filter(F.col("snapshot") == snapshot).count()
    rows = {}
    for table, df in tables.items():
        path = f"{root}/{table}/snapshot={snapshot}/write={write}"
        df.write.mode("overwrite").parquet(path)
        rows[table] = spark.read.schema(df.schema).parquet(path).count()
    line = spark.createDataFrame([(snapshot, write, None, rows)], _MANIFEST).withColumn("saved_at", F.current_timestamp())
    line.coalesce(1).write.mode("append").json(f"{root}/manifest")


def load_snapshot(spark: SparkSession, root: str, table: str, name: str) -> DataFrame:
    """A table of the last published write of a snapshot."""
    snapshot = _clean(name)
    found = _published(spark, root).filter((F.col("snapshot") == snapshot) & F.map_contains_key("rows", table)).select("write").head()
    if found is None:
        raise LookupError(f"no snapshot {name!r} of {table!r} in {root}")
    return spark.read.parquet(f"{root}/{table}/snapshot={snapshot}/write={found[0]}")


def list_snapshots(spark: SparkSession, root: str, table: str = "pages") -> DataFrame:
    """Published snapshots of a table with their rows, newest first."""
    return _published(spark, root).filter(F.map_contains_key("rows", table)).select(
        "snapshot", "saved_at", F.col("rows")[table].alias("rows")).orderBy(F.desc("saved_at"), "snapshot")
