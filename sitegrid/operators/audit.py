"""The audit: rules over pages, links, robots and sitemap, and what follows from
the findings.

Page predicates run in one scan: every page row yields an array of hits, which
is exploded. Group and join rules each add one aggregate or one equi-join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..functions import urls as U
from ..plans.rule_catalog import rule_catalog
from ..session import stage_table
from . import dedupe, links as L
from .ranking import top_per_key

KEY = ["run_id", "site"]
HIT = [*KEY, "rule", "url", "detail", "weight", "escalate"]


@dataclass
class AuditInput:
    """Tables of one audit. ``links`` defaults to the edges inside ``pages``."""

    pages: DataFrame
    crawls: DataFrame | None = None
    links: DataFrame | None = None
    sitemap: DataFrame | None = None
    robots_rules: DataFrame | None = None
    money_urls: DataFrame | None = None
    orphan_mode: str = "unlinked"


@dataclass
class PageRule:
    """A boolean column over the page table, reported per page."""

    rule: str
    when: Column
    detail: Column | None = None
    weight: Column | None = None
    escalate: Column | None = None


# --- column predicates ------------------------------------------------------------------

def is_html() -> Column:
    return F.coalesce(F.col("content_type").rlike("(?i)text/html") & (F.col("status") == 200), F.lit(False))


def is_indexable() -> Column:
    return is_html() & ~F.coalesce(F.col("noindex"), F.lit(False)) & F.coalesce("robots_allowed", F.lit(True))


def is_bloat() -> Column:
    return F.col("url").rlike(V.BLOAT_URL)


def header_has(word: str) -> Column:
    return F.coalesce(F.col("x_robots_tag").rlike(f"(?i){word}"), F.lit(False))


def title_disagrees() -> Column:
    head = X.long_words(X.title_head(F.col("title")))
    h1 = X.long_words(F.get("h1s", F.lit(0)))
    return F.coalesce((F.size("h1s") > 0) & (F.col("title") != "") & (F.size(head) > 0) & (F.size(h1) > 0)
                      & (X.jaccard(head, h1) < 0.25), F.lit(False))


def depends_on_scripts() -> Column:
    return F.col("root_div_empty") | ((F.col("raw_body_text_length") < 400) & (F.col("script_count") > 5))


def images_without_alt() -> Column:
    return F.filter("images", lambda i: ~i["decorative"] & (~i["has_alt"] | (F.trim(F.coalesce(i["alt"], F.lit(""))) == "")))


def with_flags(pages: DataFrame) -> DataFrame:
    """The three tests most rules start from, evaluated once per row."""
    return pages.withColumns({"_html": is_html(), "_idx": is_indexable(), "_bloat": is_bloat()})


def page_rules() -> list[PageRule]:
    """Every rule that one page row decides, over a table ``with_flags``."""
    html, idx, bloat, money = F.col("_html"), F.col("_idx"), F.col("_bloat"), F.col("is_money")
    ident = F.concat_ws(" ", "title", F.array_join("h1s", " "), F.col("url"))
    said = F.concat_ws(" ", "title", F.array_join("h1s", " "), F.substring("body_text", 1, 500))
    other = F.col("canonical").isNotNull() & (F.col("canonical") != F.col("url"))
    status = F.col("status")
    return [
        PageRule("noindex-disallow-trap", html & F.col("noindex") & ~F.col("robots_allowed")),
        PageRule("noindex-present", html & F.col("noindex") & F.col("robots_allowed") & ~bloat,
                 F.coalesce("x_robots_tag", F.array_join(F.transform("meta_robots", lambda d: d["content"]), "; "))),
        PageRule("broken-links", (status >= 400) | (status == 0),
                 F.concat_ws(" ", status.cast("string"), "error"), escalate=(status >= 500) | (status == 0)),
        PageRule("redirect-chains", F.col("hops") > 1, F.col("final_url"), F.col("hops")),
        PageRule("mixed-content", html & (F.size("insecure_refs") > 0), F.get("insecure_refs", F.lit(0))),
        PageRule("soft-404", html & (F.col("word_count") < 60) & said.rlike(V.SOFT_404)),
        PageRule("canonical-missing", idx & F.col("canonical").isNull()),
        PageRule("canonical-conflict", html & (F.size(F.array_distinct("canonicals")) > 1),
                 F.array_join("canonicals", " | ")),
        PageRule("index-bloat", idx & bloat),
        PageRule("click-depth", idx & (F.col("depth") > 3), weight=F.col("depth")),
        PageRule("breadcrumbs-missing", idx & (F.col("depth") > 1) & ~F.col("has_breadcrumb_markup")),
        PageRule("title-missing", idx & (F.col("title") == "")),
        PageRule("title-length", idx & (X.pixel_width(F.col("title")) > V.TITLE_MAX_PX), F.col("title")),
        PageRule("title-h1-mismatch", idx & title_disagrees(), F.col("title")),
        PageRule("h1-missing", idx & (F.size("h1s") == 0)),
        PageRule("h1-multiple", idx & (F.size("h1s") > 1), weight=F.size("h1s")),
        PageRule("heading-skips", idx & (F.size("heading_skips") > 0)),
        PageRule("meta-missing", idx & (F.col("meta_description") == "")),
        PageRule("thin-content", idx & (F.col("word_count") > 0) & (F.col("word_count") < 250) & ~bloat & money,
                 weight=F.col("word_count")),
        PageRule("img-alt", idx & (F.size(images_without_alt()) > 0), weight=F.size(images_without_alt())),
        PageRule("img-dimensions", idx & F.exists("images", lambda i: i["width"].isNull() | i["height"].isNull())),
        PageRule("lazy-above-fold", idx & F.exists(
            "images", lambda i: i["above_fold"] & F.coalesce(i["loading"] == "lazy", F.lit(False)))),
        PageRule("jsonld-invalid", idx & (F.size("jsonld_errors") > 0), F.get("jsonld_errors", F.lit(0))),
        PageRule("schema-absent", idx & (F.size("schema_types") == 0) & (F.size("microdata_types") == 0) & money
                 & (F.col("word_count") > 200)),
        PageRule("eeat-author", idx & ident.rlike(V.YMYL) & ~F.col("has_author_markup")
                 & (F.col("word_count") > 400)),
        PageRule("js-dependency", idx & depends_on_scripts(), weight=F.col("raw_body_text_length")),
        PageRule("viewport-missing", idx & F.col("viewport").isNull()),
        PageRule("lang-missing", idx & F.col("lang").isNull()),
        PageRule("slow-ttfb", (status == 200) & (F.col("response_ms") > 1500), weight=F.col("response_ms")),
        PageRule("xrobots-noindex", html & header_has("noindex"), F.col("x_robots_tag")),
        PageRule("xrobots-nofollow", html & header_has("nofollow") & ~header_has("noindex"), F.col("x_robots_tag")),
        PageRule("canonical-header-conflict", html & F.col("header_canonical").isNotNull()
                 & F.col("canonical").isNotNull() & (F.col("header_canonical") != F.col("canonical")),
                 F.concat_ws(" ", "header_canonical", "canonical")),
        PageRule("pagination-canonical", html & other & F.col("url").rlike(V.PAGED_URL)
                 & ~F.col("canonical").rlike(V.PAGED_URL), F.col("canonical")),
        PageRule("hreflang-no-self", html & (F.size("hreflang") > 0)
                 & ~F.exists("hreflang", lambda h: F.coalesce(h["href"] == F.col("url"), F.lit(False)))),
        PageRule("meta-refresh", html & F.col("meta_refresh").isNotNull(), F.col("meta_refresh.target")),
        PageRule("link-heavy", html & (F.size("links") > 200), weight=F.size("links")),
        PageRule("render-blocking", html & (F.col("render_blocking") > 6), weight=F.col("render_blocking")),
        PageRule("font-display", html & (F.col("font_faces") > 0) & (F.col("font_display") == 0)),
    ]


def page_hits(pages: DataFrame, rules: list[PageRule]) -> DataFrame:
    """One scan: all predicates as one array, exploded where they hold."""
    none = F.lit(None)

    def struct(r: PageRule) -> Column:
        return F.when(F.coalesce(r.when, F.lit(False)), F.struct(
            F.lit(r.rule).alias("rule"),
            (r.detail if r.detail is not None else none).cast("string").alias("detail"),
            (r.weight if r.weight is not None else F.lit(1)).cast("bigint").alias("weight"),
            F.coalesce(r.escalate if r.escalate is not None else F.lit(False), F.lit(False)).alias("escalate")))

    return with_flags(pages).select(
        *KEY, "url", F.explode(F.array_compact(F.array(*[struct(r) for r in rules]))).alias("h")) \
        .select(*KEY, "h.rule", "url", "h.detail", "h.weight", "h.escalate")


def _hits(df: DataFrame, rule: str, url: str | Column = "url", detail: Column | None = None,
          weight: Column | None = None, escalate: Column | None = None) -> DataFrame:
    return df.select(*KEY, F.lit(rule).alias("rule"),
                     (F.col(url) if isinstance(url, str) else url).alias("url"),
                     (detail if detail is not None else F.lit(None)).cast("string").alias("detail"),
                     (weight if weight is not None else F.lit(1)).cast("bigint").alias("weight"),
                     F.coalesce(escalate if escalate is not None else F.lit(False), F.lit(False)).alias("escalate"))


# --- group rules: hits are groups, members are listed separately ------------------------------

def group_keys() -> list[tuple[str, Column, Column, int]]:
    """(rule, rows it looks at, value that must not repeat, repeats to report)."""
    idx = is_indexable()
    params = U.param_keys(F.col("url"))
    return [
        ("duplicate-content", idx & (F.col("word_count") > 80), F.col("content_hash"), 2),
        ("url-variants", F.col("status") == 200, dedupe.variant_key(F.col("url")), 2),
        ("title-duplicate", idx & (F.col("title") != ""), F.lower("title"), 2),
        ("meta-duplicate", idx & (F.col("meta_description") != ""), F.lower("meta_description"), 2),
        ("param-crawl-trap", is_html() & (params != ""), params, 3),
    ]


def group_hits(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one hit per repeated value, every member URL). The groupings share one
    scan and one partially aggregated shuffle; members are found by a semi join,
    no group is gathered."""
    keys = group_keys()
    tagged = pages.select(*KEY, "url", F.explode(F.array_compact(F.array(*[
        F.when(F.coalesce(cond, F.lit(False)), F.struct(
            F.lit(rule).alias("rule"), value.alias("value"), F.lit(least).alias("least")))
        for rule, cond, value, least in keys]))).alias("g")).select(*KEY, "url", "g.*")
    sets = tagged.groupBy(*KEY, "rule", "value").agg(
        F.count("*").alias("n"), F.min("url").alias("url"), F.max("least").alias("least")).filter("n >= least")
    hits = sets.select(*KEY, "rule", "url", F.col("value").alias("detail"), F.col("n").alias("weight"),
                       F.lit(False).alias("escalate"))
    members = tagged.join(sets.select(*KEY, "rule", "value"), [*KEY, "rule", "value"], "left_semi").select(
        *KEY, "rule", "url", F.col("value").alias("detail"))
    return hits, members


def phone_hits(pages: DataFrame) -> DataFrame:
    per = pages.filter(is_indexable()).select(*KEY, "url", F.explode("phones").alias("phone")).groupBy(
        *KEY, "phone").agg(F.count("*").alias("n"), F.min("url").alias("url"))
    return _hits(per, "nap-inconsistent", detail=F.col("phone"), weight=F.col("n"))


def site_flag_hits(pages: DataFrame) -> DataFrame:
    """Rules that hold for a whole site or not at all."""
    html = pages.filter(is_html())
    per = html.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.min("url").alias("url"),
        F.bool_and((F.col("font_faces") == 0) & (F.size("preconnects") == 0)
                   & ~F.coalesce(F.col("body_text").rlike(r"fonts\.googleapis\.com|fonts\.gstatic\.com"), F.lit(False)))
        .alias("bare"),
        F.count_if(F.size("hreflang") > 0).alias("n_lang"),
        F.count_if(F.exists("hreflang", lambda h: h["lang"] == "x-default")).alias("n_default"))
    return _hits(per.filter(F.col("bare") & (F.col("n") > 2)), "no-preconnect", weight=F.col("n")).unionByName(
        _hits(per.filter((F.col("n_lang") > 1) & (F.col("n_default") == 0)), "hreflang-no-xdefault",
              weight=F.col("n_lang")))


# --- join rules -----------------------------------------------------------------------------------

def link_hits(pages: DataFrame, links: DataFrame) -> DataFrame:
    html = pages.filter(is_html()).select(*KEY, F.col("url").alias("from_url"))
    from_html = links.filter(F.col("resolved").isNotNull()).join(html, [*KEY, "from_url"], "left_semi")
    redirecting = pages.filter(F.col("hops") > 0).select(*KEY, F.col("url").alias("resolved"))
    closed = pages.filter(is_html() & (F.col("noindex") | header_has("noindex"))).select(
        *KEY, F.col("url").alias("resolved"))
    to_redirect = _hits(from_html.join(redirecting, [*KEY, "resolved"], "left_semi"),
                        "internal-links-to-redirects", "from_url", F.col("resolved"))
    to_closed = from_html.filter(~F.col("nofollow")).join(closed, [*KEY, "resolved"], "left_semi").groupBy(
        *KEY, "from_url").agg(F.count("*").alias("n"))
    generic = from_html.filter((F.col("anchor") != "") & F.col("anchor").rlike(V.GENERIC_ANCHOR)
                               & ~F.col("in_nav") & ~F.col("in_footer"))
    return reduce(DataFrame.unionByName, [
        to_redirect,
        _hits(to_closed, "links-to-noindex", "from_url", weight=F.col("n")),
        _hits(generic, "generic-anchors", "from_url",
              F.concat(F.lit('"'), F.col("anchor"), F.lit('" to '), F.col("resolved"))),
    ])


def broken_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Every URL that answers with an error: its status, how many HTML pages link to it
    and the first of them, NULL where none does."""
    broken = pages.filter((F.col("status") >= 400) | (F.col("status") == 0)).select(*KEY, "url", "status")
    html = pages.filter(is_html()).select(*KEY, F.col("url").alias("from_url"))
    held = (links.filter(F.col("resolved").isNotNull()).select(*KEY, "from_url", F.col("resolved").alias("url"))
            .join(broken.select(*KEY, "url").distinct(), [*KEY, "url"], "left_semi").join(html, [*KEY, "from_url"], "left_semi")
            .distinct().groupBy(*KEY, "url").agg(F.count("*").alias("referrers"), F.min("from_url").alias("first_referrer")))
    return broken.join(held, [*KEY, "url"], "left").fillna(0, ["referrers"])


def canonical_hits(pages: DataFrame) -> DataFrame:
    """Pages whose canonical names another URL, joined once with the page it names."""
    cross = pages.filter(F.col("canonical").isNotNull() & (F.col("canonical") != F.col("url"))).select(
        *KEY, "url", F.col("canonical").alias("target"), is_html().alias("html"),
        (is_indexable() & ~is_bloat()).alias("keep"))
    named = pages.select(*KEY, F.col("url").alias("target"), F.lit(True).alias("known"),
                         ((F.col("status") >= 300) | F.coalesce("noindex", F.lit(False))).alias("bad"),
                         is_html().alias("t_html"), F.col("canonical").alias("t_canonical"))
    j = cross.join(named.hint("merge"), [*KEY, "target"], "left")  # see redirect_chains
    chain = F.col("html") & F.col("t_html") & F.col("t_canonical").isNotNull() \
        & (F.col("t_canonical") != F.col("target"))
    return _hits(j.filter("keep"), "canonical-cross", detail=F.col("target"), escalate=F.col("bad")).unionByName(
        _hits(j.filter(chain), "canonical-chain", detail=F.concat_ws(" -> ", "url", "target", "t_canonical")))


def hreflang_hits(pages: DataFrame) -> DataFrame:
    html = pages.filter(is_html() & (F.size("hreflang") > 0))
    edges = html.select(*KEY, "url", F.explode("hreflang").alias("h")).select(*KEY, "url", "h.lang", "h.href")
    bad = edges.filter(~F.col("lang").rlike(V.LANG_CODE) | F.col("lang").isin(V.DISPUTED_LANG_CODES))
    pairs = edges.filter(F.col("href").isNotNull()).select(*KEY, "url", "href")
    in_set = html.select(*KEY, F.col("url").alias("href"))
    back = pairs.select(*KEY, F.col("url").alias("href"), F.col("href").alias("url")).distinct()
    missing = pairs.join(in_set, [*KEY, "href"], "left_semi").join(back, [*KEY, "url", "href"], "left_anti")
    return _hits(bad, "hreflang-bad-code", detail=F.col("lang")).unionByName(
        _hits(missing, "hreflang-no-return", detail=F.col("href")))


def sitemap_hits(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    listed = sitemap.select(*KEY, F.col("loc").alias("url"), "lastmod")
    other = F.col("canonical").isNotNull() & (F.col("canonical") != F.col("url"))
    seen = pages.select(*KEY, "url", "status", F.coalesce("noindex", F.lit(False)).alias("noindex"),
                        other.alias("other"), is_html().alias("html"), header_has("noindex").alias("closed"),
                        "canonical")
    j = listed.join(seen, [*KEY, "url"])
    dirty = j.filter((F.col("status") != 200) | F.col("noindex") | F.col("other"))
    closed = j.filter(F.col("html") & (F.col("noindex") | F.col("closed") | F.col("other")))
    per = sitemap.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.count("lastmod").alias("dated"),
        F.count_distinct(F.substring("lastmod", 1, 10)).alias("days"), F.min("loc").alias("url"))
    idx = pages.filter(is_indexable() & ~is_bloat()).select(*KEY, "url")
    absent = idx.join(per.select(*KEY), KEY, "left_semi").join(listed, [*KEY, "url"], "left_anti")
    return reduce(DataFrame.unionByName, [
        _hits(dirty, "sitemap-dirty", detail=F.concat_ws(
            ", ", F.col("status").cast("string"), F.when(F.col("noindex"), "noindex"),
            F.when(F.col("other"), "canonicalised away"))),
        _hits(closed, "sitemap-nonindexable", detail=F.when(
            F.col("noindex") | F.col("closed"), F.lit("noindex")).otherwise(F.col("canonical"))),
        _hits(per.filter((F.col("dated") > 15) & (F.col("days") <= 2)), "sitemap-lastmod", weight=F.col("dated")),
        _hits(per.filter(F.col("n") > V.SITEMAP_LIMIT), "sitemap-too-large", weight=F.col("n")),
        _hits(absent, "sitemap-incomplete"),
    ])


def graph_hits(pages: DataFrame, links: DataFrame, crawls: DataFrame | None, mode: str) -> DataFrame:
    full = L.with_inbound(pages.filter(is_indexable()), links)
    if crawls is not None:
        info = crawls.select(*KEY, "start_url", "truncated")
        full = full.join(info, KEY, "left")
    else:
        full = full.withColumns({"start_url": F.lit(None).cast("string"), "truncated": F.lit(False)})
    start = F.coalesce(F.col("url") == F.col("start_url"), F.lit(False))
    if mode == "reference":
        lonely = F.coalesce(F.col("discovered_via") == "sitemap", F.lit(False)) | (
            (F.col("inbound_count") == 0) & ~start)
    else:
        lonely = (F.col("inbound_others") == 0) & ~start
    open_crawl = ~F.coalesce("truncated", F.lit(False))
    nav_only = (F.col("inbound_count") > 0) & (F.col("inbound_body_count") == 0) & (F.col("depth") > 0) \
        & F.col("is_money")
    return _hits(full.filter(lonely & open_crawl), "orphans").unionByName(
        _hits(full.filter(nav_only), "nav-only-links", weight=F.col("inbound_count")))


def near_duplicate_rows(pages: DataFrame) -> DataFrame:
    return pages.filter(is_indexable() & (F.col("word_count") > 120)).select(
        *KEY, "url", "content_hash", X.whole_shingle_hashes(F.col("body_text")).alias("shingles"))


def near_duplicate_families(pages: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Hits of the rule: one per content but the representative of its family."""
    found = dedupe.near_duplicate_families(near_duplicate_rows(pages), threshold).filter(F.col("url") != F.col("representative"))
    return _hits(found, "near-duplicate", "url", F.concat_ws(" ", X.half_up(F.col("score") * 100).cast("string"),
                                                             F.col("representative")), F.col("copies"))


def near_duplicate_hits(pages: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Hits by pair, for sites whose families are small."""
    pairs = dedupe.near_duplicates(near_duplicate_rows(pages), threshold)
    return _hits(pairs, "near-duplicate", "url_a", F.concat_ws(" ", X.half_up(F.col("score") * 100).cast("string"),
                                                               F.col("url_b")),
                 F.col("copies_a") * F.col("copies_b"))


# --- site rules --------------------------------------------------------------------------------------

def crawl_hits(crawls: DataFrame, sitemap: DataFrame | None, rules: DataFrame | None) -> DataFrame:
    status = F.coalesce("robots_status", F.lit(0))
    out = [
        _hits(crawls.filter(status != 200), "robots-missing", F.concat("origin", F.lit("/robots.txt")),
              status, escalate=status >= 500),
        _hits(crawls.filter(F.col("origin").startswith("http://")), "no-https", "origin"),
        _hits(crawls.filter("truncated"), "orphans-unknown", "start_url", weight=F.col("queue_left")),
    ]
    if sitemap is not None:
        bare = crawls.join(sitemap.select(*KEY).distinct(), KEY, "left_anti")
        out.append(_hits(bare, "sitemap-absent", F.concat("origin", F.lit("/sitemap.xml"))))
    if rules is not None:
        deny = rules.filter(F.col("type") == "disallow").dropDuplicates([*KEY, "pos"])
        out.append(_hits(deny.filter(F.col("path").isin("/", "/*")), "robots-disallow-all", "path", F.col("agent")))
        out.append(_hits(deny.filter(F.col("path").rlike(V.BLOCKED_ASSET_RULE)), "robots-blocked-assets", "path"))
    return reduce(DataFrame.unionByName, out)


# --- the audit ----------------------------------------------------------------------------------------

def with_money(pages: DataFrame, money_urls: DataFrame | None) -> DataFrame:
    """Marks pages on the optional list of important URLs; without one, all."""
    if money_urls is None:
        return pages.withColumn("is_money", F.lit(True))
    listed = money_urls.select(U.normalise_absolute(F.col("url")).alias("url")).distinct().withColumn(
        "is_money", F.lit(True))
    return pages.join(listed, "url", "left").fillna(False, ["is_money"])


def rule_hits(t: AuditInput, extra: list[PageRule] = (), near_duplicates: bool = True) -> tuple[DataFrame, DataFrame]:
    """(hits counted by the rules, members of the grouping rules' sets)."""
    pages = with_money(t.pages, t.money_urls)
    if t.robots_rules is not None:  # the verdict of the site's own rules replaces the crawl's
        pages = L.robots_allowed(pages, t.robots_rules)
    links = t.links
    if links is None:
        from ..sources.pages import links_of
        links = links_of(pages)
    grouped, members = group_hits(pages)
    single = [page_hits(pages, page_rules() + list(extra)), phone_hits(pages), site_flag_hits(pages),
              link_hits(pages, links), canonical_hits(pages), hreflang_hits(pages),
              graph_hits(pages, links, t.crawls, t.orphan_mode)]
    if near_duplicates:
        single.append(near_duplicate_families(pages))
    if t.sitemap is not None:
        single.append(sitemap_hits(pages, t.sitemap))
    if t.crawls is not None:
        single.append(crawl_hits(t.crawls, t.sitemap, t.robots_rules))
    return reduce(DataFrame.unionByName, [*single, grouped]), members


def run_audit(t: AuditInput, extra: list[PageRule] = (), extra_catalog: list[tuple] = (),
              near_duplicates: bool = True) -> tuple[DataFrame, DataFrame]:
    """All rules: (findings, finding_urls). The hits are written once; findings
    count them per rule with partial aggregation and keep the rules that reach
    their minimum, finding_urls lists every affected URL of those."""
    hits, members = rule_hits(t, extra, near_duplicates)
    hits = stage_table(hits.hint("rebalance"))      # few well-sized files from many small inputs
    catalog = rule_catalog(t.pages.sparkSession, list(extra_catalog))
    totals = t.pages.groupBy(*KEY).agg(F.count_if(is_html()).alias("n_html"))
    counted = hits.groupBy(*KEY, "rule").agg(
        F.count("*").alias("n_urls"), F.sum("weight").alias("total"), F.max("weight").alias("most"),
        F.min("url").alias("example_url"), F.bool_or("escalate").alias("escalate"))
    fired = (counted.join(F.broadcast(catalog), "rule").filter(F.col("n_urls") >= F.col("least"))
             .join(totals, KEY, "left"))
    share = F.col("n_urls") / F.greatest(F.lit(1), F.coalesce("n_html", F.lit(0)))
    severity = (F.when((F.col("rule") == "noindex-present") & (share > 0.5), "Critical")
                .when((F.col("rule") == "broken-links") & F.col("escalate"), "Critical")
                .when(F.col("rule").isin("robots-missing", "canonical-cross") & F.col("escalate"), "High")
                .otherwise(F.col("severity")))
    findings = fired.select(
        *KEY, "rule", severity.alias("severity"), "stage", "owner", "effort", "evidence", "n_urls", "total", "most",
        F.concat_ws(" ", F.col("n_urls").cast("string"), "what").alias("title"),
        "example_url", "what", "why", "fix", "acceptance")
    grouped = [rule for rule, *_ in group_keys()]
    urls = hits.filter(~F.col("rule").isin(grouped)).select(*KEY, "rule", "url", "detail").unionByName(members)
    finding_urls = urls.join(findings.select(*KEY, "rule"), [*KEY, "rule"], "left_semi")
    return findings, finding_urls


def register_rule(rule: str, stage: str, severity: str, when: Column, least: int = 1, what: str = "page(s)",
                  why: str = "", fix: str = "", owner: str = "dev", effort: str = "S") -> tuple[PageRule, tuple]:
    """A caller's own page rule: pass the pair on as ``extra`` and ``extra_catalog``."""
    return (PageRule(rule, when),
            (rule, stage, severity, least, owner, effort, "observed", what, why, fix, ""))


def severity_rank(col: str = "severity") -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in V.SEVERITIES]), F.col(col)).cast("int")


def stage_rank(col: str = "stage") -> Column:
    pos = F.array_position(F.array(*[F.lit(s) for s in V.STAGES]), F.col(col)).cast("int")
    return F.when(pos > 0, pos).otherwise(99)


def order_findings(findings: DataFrame) -> DataFrame:
    """Severity first, then stage, then rule id."""
    return findings.orderBy(*KEY, severity_rank(), stage_rank(), "rule")


def top_findings(findings: DataFrame, n: int = 3) -> DataFrame:
    return top_per_key(findings, KEY, [severity_rank(), stage_rank(), F.col("rule")], n)


def finding_counts(findings: DataFrame, by: list[str] = ()) -> DataFrame:
    """Findings per severity, optionally per stage or other columns."""
    return findings.groupBy(*KEY, *by).agg(*[
        F.count_if(F.col("severity") == s).alias(s.lower()) for s in V.SEVERITIES], F.count("*").alias("n"))


def site_stats(pages: DataFrame, links: DataFrame | None = None, crawls: DataFrame | None = None,
               sitemap: DataFrame | None = None, orphan_urls: DataFrame | None = None,
               blocked: DataFrame | None = None) -> DataFrame:
    """Site-level measures in one aggregation; orphan count NULL on a truncated crawl."""
    status, hops = F.col("status"), F.col("hops")
    base = pages.withColumns({
        "_html": is_html(), "_idx": is_indexable(),
        "_ms": F.when(status == 200, F.col("response_ms")),
        "_w": F.when(is_html(), F.coalesce("word_count", F.lit(0))),
    })
    stats = base.groupBy(*KEY).agg(
        F.count("*").alias("crawled"), F.count_if("_html").alias("html"), F.count_if("_idx").alias("indexable"),
        F.count_if(F.col("_html") & F.col("noindex")).alias("noindex"),
        F.count_if((status >= 400) | (status == 0)).alias("errors"), F.count_if(hops > 0).alias("redirects"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
        F.coalesce(X.upper_quantile("_ms", 0.5), F.lit(0)).cast("bigint").alias("median_response_ms"),
        F.coalesce(X.upper_quantile("_w", 0.5), F.lit(0)).cast("bigint").alias("median_words"))
    if "platform" in pages.columns:
        marks = base.filter("_html").select(*KEY, F.explode("platform").alias("p")).groupBy(*KEY).agg(
            F.array_sort(F.collect_set("p")).alias("platform"))
        stats = stats.join(marks, KEY, "left")
    if links is not None:
        domains = L.external_links(links).groupBy(*KEY).agg(F.count_distinct("host").alias("external_domains"))
        stats = stats.join(domains, KEY, "left").fillna(0, ["external_domains"])
    for extra, name in ((sitemap, "sitemap_urls"), (blocked, "blocked_by_robots"), (orphan_urls, "orphans")):
        if extra is not None:
            stats = stats.join(extra.groupBy(*KEY).agg(F.count("*").alias(name)), KEY, "left").fillna(0, [name])
    if crawls is not None:
        stats = stats.join(crawls.select(*KEY, "truncated"), KEY, "left")
        if orphan_urls is not None:
            stats = stats.withColumn("orphans", F.when(~F.col("truncated"), F.col("orphans")))
    return stats


# --- reviews ---------------------------------------------------------------------------------------------

REVIEW = ["eligible", "canonical", "intent", "content", "links_in", "structured_data", "in_source"]


def review_pages(pages: DataFrame) -> DataFrame:
    """Seven verdicts per page and the lead issue: first fail, else first warn.
    Needs the inbound columns of ``with_inbound``."""
    ok = (F.col("status") == 200) & ~F.col("noindex") & F.col("robots_allowed")
    tidy = (F.col("title") != "") & (F.size("h1s") == 1) & (F.size("heading_skips") == 0)
    verdicts = [
        F.when(ok, "pass").otherwise("fail"),
        F.when(F.col("self_canonical"), "pass").otherwise("warn"),
        F.lit("manual"),
        F.when(F.coalesce(tidy, F.lit(False)), "pass").otherwise("warn"),
        F.when(F.col("inbound_body_count") > 0, "pass").otherwise("fail"),
        F.when(F.size("jsonld_errors") > 0, "fail").when(F.size("schema_types") > 0, "pass").otherwise("warn"),
        F.when(depends_on_scripts(), "fail").otherwise("pass"),
    ]
    steps = F.array(*[F.struct(F.lit(i + 1).alias("n"), F.lit(q).alias("question"), v.alias("verdict"))
                      for i, (q, v) in enumerate(zip(REVIEW, verdicts))])
    out = pages.select(*KEY, "url", steps.alias("steps"))
    fail = F.get(F.filter("steps", lambda s: s["verdict"] == "fail"), F.lit(0))
    warn = F.get(F.filter("steps", lambda s: s["verdict"] == "warn"), F.lit(0))
    lead = F.coalesce(fail, warn)
    return out.select(*KEY, "url", "steps", F.coalesce(lead["question"], F.lit("none")).alias("lead"),
                      F.coalesce(lead["verdict"], F.lit("pass")).alias("lead_verdict"))


def prelaunch_checks(t: AuditInput, staging: DataFrame | None = None,
                     redirects: DataFrame | None = None) -> DataFrame:
    """Eight launch checks per site, each pass, fail or manual.

    ``staging``: run_id, site, blocked. ``redirects``: output of ``redirect_test``.
    """
    per = t.pages.groupBy(*KEY).agg(F.count_if(F.coalesce("noindex", F.lit(False))).alias("noindexed"),
                                    F.count_if(F.size("insecure_refs") > 0).alias("mixed"))
    base = t.crawls.join(per, KEY, "left").fillna(0, ["noindexed", "mixed"])
    no = F.lit(0).cast("bigint")
    if t.robots_rules is not None:
        walls = t.robots_rules.filter((F.col("type") == "disallow") & (F.col("path") == "/")).groupBy(*KEY).agg(
            F.count("*").alias("walls"))
        base = base.join(walls, KEY, "left").fillna(0, ["walls"])
    else:
        base = base.withColumn("walls", no)
    if t.sitemap is not None:
        base = base.join(t.sitemap.groupBy(*KEY).agg(F.count("*").alias("listed")), KEY, "left").fillna(0, ["listed"])
    else:
        base = base.withColumn("listed", no)
    if staging is not None:
        base = base.join(staging.select(*KEY, F.col("blocked").alias("_st")), KEY, "left")
    else:
        base = base.withColumn("_st", F.lit(None).cast("boolean"))
    if redirects is not None:
        bad = redirects.groupBy(*KEY).agg(F.count_if((F.col("status") != 200) | (F.col("hops") != 1)).alias("_bad"))
        base = base.join(bad, KEY, "left")
    else:
        base = base.withColumn("_bad", F.lit(None).cast("bigint"))

    def state(ok: Column) -> Column:
        return F.when(ok, "pass").otherwise("fail")

    checks = [
        ("noindex-removed", state(F.col("noindexed") == 0)),
        ("robots-correct", state((F.col("robots_status") == 200) & (F.col("walls") == 0))),
        ("staging-blocked", F.when(F.col("_st").isNull(), "manual").otherwise(state(F.col("_st")))),
        ("redirects-tested", F.when(F.col("_bad").isNull(), "manual").otherwise(state(F.col("_bad") == 0))),
        ("sitemap-present", state(F.col("listed") > 0)),
        ("https-clean", state(F.col("origin").startswith("https://") & (F.col("mixed") == 0))),
        ("measurement-verified", F.lit("manual")),
        ("day-one-crawl", F.lit("manual")),
    ]
    rows = F.array(*[F.struct(F.lit(i + 1).alias("n"), F.lit(name).alias("check"), s.alias("state"))
                     for i, (name, s) in enumerate(checks)])
    return base.select(*KEY, F.explode(rows).alias("c")).select(*KEY, "c.*")


def redirect_test(pairs: DataFrame, chains: DataFrame, pages: DataFrame) -> DataFrame:
    """Expected against observed redirects: one hop, status 200, right target.
    ``pairs``: run_id, site, from_url, to_url."""
    landing = pages.select(*KEY, F.col("url").alias("landed"), F.col("status").alias("landed_status"))
    j = (pairs.withColumn("url", F.col("from_url"))
         .join(chains.select(*KEY, "url", "final_url", "hops").hint("merge"), [*KEY, "url"], "left")
         .withColumn("landed", F.coalesce("final_url", "from_url")).fillna(0, ["hops"])
         .join(landing.hint("merge"), [*KEY, "landed"], "left"))
    status = F.coalesce("landed_status", F.lit(0))
    expected = U.normalise_absolute(F.col("to_url"))
    wrong = expected.isNotNull() & (F.col("landed") != expected)
    return j.select(
        *KEY, "from_url", F.col("to_url").alias("expected"), "landed", status.alias("status"), "hops",
        ((status == 200) & (F.col("hops") == 1) & ~wrong).alias("ok"),
        F.when(status != 200, F.concat(F.lit("status "), status.cast("string")))
        .when(F.col("hops") == 0, "no redirect")
        .when(F.col("hops") > 1, F.concat(F.col("hops").cast("string"), F.lit(" hops")))
        .when(wrong, "wrong target").alias("issue"))


# --- views ------------------------------------------------------------------------------------------------------

def filter_findings(findings: DataFrame, severity: list[str] | None = None, owner: str | None = None,
                    stage: str | None = None) -> DataFrame:
    if severity:
        findings = findings.filter(F.col("severity").isin(severity))
    if owner:
        findings = findings.filter(F.col("owner") == owner)
    if stage:
        findings = findings.filter(F.col("stage") == stage)
    return findings


def page_view_filters() -> dict[str, Column]:
    return {
        "all": F.lit(True),
        "errors": (F.col("status") >= 400) | (F.col("status") == 0),
        "redirects": F.col("hops") > 0,
        "noindex": F.coalesce("noindex", F.lit(False)),
        "orphans": F.col("inbound_count") == 0,
        "no_h1": F.size("h1s") == 0,
        "thin": F.col("word_count") < 250,
        "no_schema": F.size("schema_types") == 0,
    }


def page_view(pages: DataFrame, name: str) -> DataFrame:
    return pages.filter(page_view_filters()[name])


def page_view_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy(*KEY).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n)
                                     for n, c in page_view_filters().items()])


def unchecked_stages(findings: DataFrame, sites: DataFrame, checked: list[str]) -> DataFrame:
    """Stage table per site: a stage without evidence is unchecked, never clear."""
    stages = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("n"), F.lit(s).alias("stage"),
                                          F.lit(s in checked).alias("checked")) for i, s in enumerate(V.STAGES)]))
    grid = sites.select(*KEY).distinct().select(*KEY, stages.alias("s")).select(*KEY, "s.*")
    counts = findings.groupBy(*KEY, "stage").agg(
        F.count("*").alias("findings"),
        F.count_if(F.col("severity").isin("Critical", "High")).alias("serious"))
    return grid.join(counts, [*KEY, "stage"], "left").fillna(0, ["findings", "serious"]).withColumn(
        "state", F.when(F.col("findings") > 0, F.when(F.col("serious") > 0, "failing").otherwise("open"))
        .when(F.col("checked"), "clear").otherwise("unchecked"))
