"""robots.txt and sitemap documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..session import cut_lineage

KEY = ["run_id", "site"]


def read_robots(robots_txt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, sitemaps) of a table run_id, site, status, body.

    Lines are numbered and grouped per document; a new group opens at the first
    agent line after a rule line. One robots file bounds each window.
    """
    lines = robots_txt.select(*KEY, F.posexplode(F.split("body", "\r?\n")).alias("pos", "raw")).withColumn(
        "line", F.trim(F.regexp_replace("raw", "#.*$", ""))).filter(F.instr("line", ":") > 0)
    parsed = lines.select(
        *KEY, "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"),
        F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    sitemaps = parsed.filter(F.col("field") == "sitemap").select(*KEY, F.col("value").alias("sitemap"))
    known = parsed.filter(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    w = W.partitionBy(*KEY).orderBy("pos")
    is_rule = F.col("field").isin("allow", "disallow")
    rules_before = F.coalesce(F.sum(is_rule.cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    agent_line = F.col("field") == "user-agent"
    # the last agent line's rule count tells whether rules came in between
    marked = known.withColumn("seen", rules_before).withColumn(
        "prev_seen", F.last(F.when(agent_line, F.col("seen")), True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    opens = agent_line & (F.col("prev_seen").isNull() | (F.col("seen") > F.col("prev_seen")))
    grouped = marked.withColumn("grp", F.sum(opens.cast("int")).over(w))
    agents = grouped.filter(agent_line).select(*KEY, "grp", F.lower("value").alias("agent"))
    # rules before any agent line belong to everyone
    implied = grouped.filter(is_rule & (F.col("grp") == 0)).select(*KEY, "grp", F.lit("*").alias("agent")).distinct()
    rules = grouped.filter(is_rule).select(*KEY, "grp", "pos", F.col("field").alias("type"),
                                           F.col("value").alias("path"))
    delays = grouped.filter(F.col("field") == "crawl-delay").groupBy(*KEY, "grp").agg(
        F.max_by(F.expr("try_cast(value AS DOUBLE)"), "pos").alias("crawl_delay"))
    out = (agents.unionByName(implied).join(rules, [*KEY, "grp"], "left").join(delays, [*KEY, "grp"], "left")
           .select(*KEY, "grp", "agent", "pos", "type", "path", "crawl_delay"))
    return out, sitemaps


_BLOCK = r"(?is)<(?:url|sitemap)\b.*?</(?:url|sitemap)>"


def _tag(block: Column, name: str) -> Column:
    inner = F.regexp_extract(block, rf"(?is)<{name}>\s*(.*?)\s*</{name}>", 1)
    return F.nullif(F.trim(F.regexp_replace(inner, r"<!\[CDATA\[|\]\]>", "")), F.lit(""))


def _entries(body: Column) -> Column:
    """Entries of one document: its blocks or, in a document without any that is not XML,
    the lines that are addresses."""
    none = F.lit(None).cast("string")

    def lines() -> Column:
        return F.filter(F.transform(F.split(body, "\r?\n"), lambda line, i: F.struct(
            i.alias("pos"), F.trim(line).alias("loc"), none.alias("lastmod"), none.alias("priority"))),
            lambda e: e["loc"].rlike("^https?://"))

    def of(blocks: Column) -> Column:
        tagged = F.transform(blocks, lambda b, i: F.struct(
            i.alias("pos"), _tag(b, "loc").alias("loc"), _tag(b, "lastmod").alias("lastmod"),
            _tag(b, "priority").alias("priority")))
        return F.when((F.size(blocks) > 0) | F.contains(body, F.lit("<?xml")), tagged).otherwise(lines())

    return X.bind(F.regexp_extract_all(body, F.lit(_BLOCK), F.lit(0)), of)


def read_sitemaps(docs: DataFrame, roots: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """Entries of url sets, reached from the root documents through index files of any
    depth (or ``max_depth`` levels), plus plain-text lists. One row per normalised URL."""
    typed = docs.select(*KEY, "url", "body", F.regexp_like("body", F.lit("(?i)<sitemapindex")).alias("is_index"))
    reached = typed
    if roots is not None:
        blocks = F.regexp_extract_all("body", F.lit(_BLOCK), F.lit(0))
        children = typed.filter("is_index").select(*KEY, "url", F.explode(blocks).alias("block")).select(
            *KEY, "url", _tag(F.col("block"), "loc").alias("child"))
        level = roots.select(*KEY, F.col("sitemap").alias("url")).distinct()
        names = level
        while max_depth is None or max_depth > 0:      # names only; the documents are joined once
            level = cut_lineage(level.join(children, [*KEY, "url"]).select(*KEY, F.col("child").alias("url")).distinct()
                                .join(names, [*KEY, "url"], "left_anti"))
            if level.isEmpty():
                break
            names = cut_lineage(names.unionByName(level))
            max_depth = None if max_depth is None else max_depth - 1
        reached = typed.join(names.distinct(), [*KEY, "url"], "left_semi")
    # outer: else a filter on the array's size is inferred and the array computed twice; an
    # address is absolute where its normal form is not null
    rows = reached.filter(~F.col("is_index")).select(*KEY, F.col("url").alias("source"), F.explode_outer(_entries(F.col("body"))).alias("e"))
    clean = rows.filter(U.is_absolute(F.col("e.loc"))).select(
        *KEY, U.normalise_absolute(F.col("e.loc")).alias("loc"), F.struct("source", "e.pos", "e.lastmod", "e.priority").alias("e"))
    first = clean.groupBy(*KEY, "loc").agg(F.min("e").alias("e"))
    return first.select(*KEY, "loc", "e.lastmod", "e.priority", "e.source")


def render_text(html):
    """Text of markup by stripping scripts, styles and tags."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
    return X.squash(F.regexp_replace(bare, r"<[^>]+>", " "))


def render_gap(raw: DataFrame, rendered: DataFrame, key: str | None = None) -> DataFrame:
    """Source against rendered markup per URL: words, links, ratios, and whether
    the page depends on scripts. Both tables: run_id, site, url, html; where a URL was
    fetched more than once, ``key`` names a column that tells its copies apart."""
    keys = [*KEY, "url", *([key] if key else [])]

    def measured(df: DataFrame, tag: str) -> DataFrame:
        no_script = F.regexp_replace("html", r"(?is)<script.*?</script>", " ")
        found = F.regexp_extract_all(no_script, F.lit(r"""(?i)<a\b[^>]*href\s*=\s*["']([^"'#]+)"""), F.lit(0))
        return df.select(*keys, X.squashed_word_count(render_text(F.col("html"))).alias(f"{tag}_words"),
                         F.size(F.array_distinct(found)).alias(f"{tag}_links"))

    j = measured(raw, "raw").join(measured(rendered, "rendered"), keys)

    def ratio(what: str):
        return F.when(F.col(f"rendered_{what}") > 0,
                      F.col(f"raw_{what}") / F.col(f"rendered_{what}")).otherwise(F.lit(1.0))

    return j.select("*", X.half_up_to(ratio("words"), 2).alias("word_ratio"),
                    X.half_up_to(ratio("links"), 2).alias("link_ratio"),
                    ((ratio("words") < 0.5) | (ratio("links") < 0.5)).alias("dependent"))
