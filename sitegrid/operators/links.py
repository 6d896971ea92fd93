"""Link graph: edges, inbound counts, reach, orphans, redirect chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import fixed_values as V
from ..functions import robots as R
from ..functions import text as X
from ..functions import urls as U
from ..session import cut_lineage, stage_path, stage_table
from .ranking import numbered, top_per_key

KEY = ["run_id", "site"]


def internal_links(links: DataFrame, subdomains: bool = False) -> DataFrame:
    return links.filter(F.col("resolved").isNotNull()
                        & U.same_site(F.col("resolved"), F.col("from_url"), subdomains))


def crawlable_links(links: DataFrame, subdomains: bool = False, ignore_query: bool = False) -> DataFrame:
    """Internal links a crawl would follow: no assets, feeds or trackbacks."""
    url = F.col("resolved")
    # both patterns need a piece that most page URLs lack; look for it first
    dotted = F.contains(F.substring_index(url, "/", -1), F.lit(".")) | F.contains(url, F.lit("?"))
    feedish = url.rlike("(?i)feed|trackback|wp-json")
    kept = internal_links(links, subdomains).filter(
        ~(dotted & url.rlike(V.ASSET_URL)) & ~(feedish & url.rlike(V.FEED_URL)))
    if ignore_query:
        kept = kept.withColumn("resolved", F.substring_index("resolved", "?", 1))
    return kept


def external_links(links: DataFrame, subdomains: bool = False) -> DataFrame:
    """Off-site targets: host, instance count, first three anchors, nofollow of
    the first instance. Most used first when ordered by ``n``."""
    off = links.filter(F.col("resolved").isNotNull()
                       & ~U.same_site(F.col("resolved"), F.col("from_url"), subdomains))
    totals = off.groupBy(*KEY, "resolved").agg(F.count("*").alias("n"))
    # the first three with and without a text are sorted out once, counts need no order
    named = F.coalesce(F.col("anchor") != "", F.lit(False))
    few = top_per_key(off.select(*KEY, "resolved", named.alias("named"), "from_url", "pos", "anchor", "nofollow"),
                      [*KEY, "resolved", "named"], [F.col("from_url"), F.col("pos")], 3)
    first = few.groupBy(*KEY, "resolved").agg(
        F.min_by("nofollow", F.struct("from_url", "pos")).alias("nofollow"),
        F.array_sort(F.collect_list(F.when(F.col("named"), F.struct("rank", "anchor")))).alias("a"))
    return (totals.join(first, [*KEY, "resolved"], "left")
            .select(*KEY, F.col("resolved").alias("url"), U.hostname(F.col("resolved")).alias("host"), "n",
                    F.coalesce(F.transform("a", lambda s: s["anchor"]), F.array().cast("array<string>"))
                    .alias("anchors"), "nofollow"))


def inbound_counts(links: DataFrame, subdomains: bool = False) -> DataFrame:
    """Anchor instances per target, those outside navigation and footer, and
    distinct linking pages. Pre-aggregated per edge, so a target linked from
    every page costs one partial row per task."""
    body = ~F.col("in_nav") & ~F.col("in_footer")
    edges = internal_links(links, subdomains).groupBy(*KEY, "resolved", "from_url").agg(
        F.count("*").alias("n"), F.count_if(body).alias("n_body"))
    return edges.groupBy(*KEY, F.col("resolved").alias("url")).agg(
        F.sum("n").alias("inbound_count"), F.sum("n_body").alias("inbound_body_count"),
        F.count("*").alias("inbound_distinct"),
        F.count_if(F.col("from_url") != F.col("resolved")).alias("inbound_others"))


def with_inbound(pages: DataFrame, links: DataFrame, subdomains: bool = False) -> DataFrame:
    counts = inbound_counts(links, subdomains)
    zero = ["inbound_count", "inbound_body_count", "inbound_distinct", "inbound_others"]
    joined = pages.drop(*zero).join(counts, [*KEY, "url"], "left")
    return joined.fillna(0, zero)


def link_graph_report(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Indexable HTML pages with their place in the graph; order by
    ``inbound_body`` then depth descending for the thinnest first."""
    kept = pages.filter((F.col("status") == 200) & ~F.col("noindex")
                        & F.col("content_type").rlike("(?i)text/html"))
    out = links.filter(F.col("resolved").isNotNull()).groupBy(*KEY, F.col("from_url").alias("url")).agg(
        F.count("*").alias("outbound"))
    seen = internal_links(links).filter(F.col("anchor") != "").groupBy(
        *KEY, F.col("resolved").alias("url"), "anchor").agg(F.min(F.struct("from_url", "pos")).alias("at"))
    top = top_per_key(seen, [*KEY, "url"], [F.col("at"), F.col("anchor")], 6).groupBy(*KEY, "url").agg(
        F.array_sort(F.collect_list(F.struct("rank", "anchor"))).alias("a"))
    return (with_inbound(kept, links).join(out, [*KEY, "url"], "left").join(top, [*KEY, "url"], "left")
            .select(*KEY, "url", "title", "depth", F.col("inbound_count").alias("inbound"),
                    F.col("inbound_body_count").alias("inbound_body"),
                    F.coalesce("outbound", F.lit(0)).alias("outbound"),
                    F.coalesce(F.transform("a", lambda s: s["anchor"]), F.array().cast("array<string>"))
                    .alias("anchors"),
                    F.col("word_count").alias("words")))


# --- reach ------------------------------------------------------------------------------

def crawl_reach(links: DataFrame, starts: DataFrame, sitemap: DataFrame | None = None,
                max_depth: int | None = None) -> DataFrame:
    """Breadth-first reach over the stored edges.

    ``starts`` has run_id, site, url; sitemap rows are seeds at depth 1. Returns
    run_id, site, url, depth, referrer, via. Edges and visited pages are written in
    folders by the hash of the page, the same for both. A level reads only the folders
    its pages lie in and is appended to the visited ones; nothing is united or read
    again, so a long chain costs a folder per step, not the graph. The loop ends on an
    empty level. Null sites and URLs are never reached.
    """
    spark = links.sparkSession
    folders = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def placed(df: DataFrame, url: str) -> DataFrame:
        return df.withColumn("b", F.pmod(F.xxhash64(*KEY, url), F.lit(folders)).cast("int"))

    def write(df: DataFrame, url: str, path: str) -> tuple[DataFrame, list[int]]:
        """The table as read back and the folders it has rows in, ``folders`` at most."""
        laid = placed(df, url)
        laid.repartition("b").write.partitionBy("b").parquet(path)
        back = spark.read.schema(laid.schema).parquet(path)
        return back, sorted({int(f.rsplit("/b=", 1)[1].split("/", 1)[0]) for f in back.inputFiles()})

    root = stage_path(spark)
    seen_at = f"{root}/visited"
    edges, _ = write(crawlable_links(links).select(*KEY, "from_url", F.col("resolved").alias("url")).distinct(), "from_url", f"{root}/edges")
    level = starts.filter(F.col("url").isNotNull()).select(
        *KEY, "url", F.lit(None).cast("string").alias("referrer"), F.lit("start").alias("via")).dropDuplicates([*KEY, "url"])
    shape = placed(level, "url").schema
    depth = 0
    while True:
        fresh, touched = write(level, "url", f"{seen_at}/depth={depth}")
        if not touched or depth == max_depth:
            break
        depth += 1
        found = (fresh.select(*KEY, F.col("url").alias("from_url"), "b")
                 .join(edges.filter(F.col("b").isin(touched)), [*KEY, "from_url", "b"])
                 .groupBy(*KEY, "url").agg(F.min("from_url").alias("referrer"))
                 .select(*KEY, "url", "referrer", F.lit("link").alias("via")))
        if depth == 1 and sitemap is not None:
            seeds = sitemap.filter(F.col("loc").isNotNull()).select(*KEY, F.col("loc").alias("url")).distinct()
            found = (found.join(seeds, [*KEY, "url"], "left_anti").unionByName(seeds.select(
                *KEY, "url", F.lit(None).cast("string").alias("referrer"), F.lit("sitemap").alias("via"))))
        seen = spark.read.schema(shape).parquet(seen_at)  # the files that are there now
        if len(touched) < folders:
            found, asked = write(found, "url", f"{root}/found-{depth}")
            seen = seen.filter(F.col("b").isin(asked))
        else:  # a wide level meets nearly every folder: no use in writing it to find out
            found = placed(found, "url")
        level = found.join(seen.select(*KEY, "url", "b"), [*KEY, "url", "b"], "left_anti").drop("b")
    whole = spark.read.schema(StructType([*shape.fields, StructField("depth", IntegerType())])).parquet(seen_at)
    return whole.select(*KEY, "url", "depth", "referrer", "via")


def reach_budget(reach: DataFrame, max_pages: int = 1000) -> DataFrame:
    """Per site: pages inside the cap, truncated flag, queue left over."""
    return reach.groupBy(*KEY).agg(F.count("*").alias("reached")).select(
        *KEY, F.least("reached", F.lit(max_pages)).alias("pages"),
        (F.col("reached") >= max_pages).alias("truncated"),
        F.greatest(F.col("reached") - max_pages, F.lit(0)).alias("queue_left"))


def within_budget(reach: DataFrame, max_pages: int = 1000) -> DataFrame:
    """The rows a capped crawl would have visited, in breadth-first order."""
    return numbered(reach, KEY, ["depth", "url"]).filter(F.col("rn") <= max_pages).drop("rn")


def orphans(sitemap: DataFrame, reach: DataFrame) -> DataFrame:
    """Sitemap URLs outside the reach; pass a reach computed without sitemap
    seeds to find the pages no link leads to."""
    return sitemap.select(*KEY, "loc").distinct().join(
        reach.select(*KEY, F.col("url").alias("loc")), [*KEY, "loc"], "left_anti")


# --- robots -------------------------------------------------------------------------------

def robots_for_agent(rules: DataFrame, agent: str = "googlebot") -> DataFrame:
    """The group that applies to an agent, as one array of rules per site: the
    longest agent name contained in ours wins, ``*`` only when none is. A
    robots file is at most a few hundred kilobytes, which bounds the array."""
    named = (F.col("agent") != "*") & F.contains(F.lit(agent.lower()), F.col("agent"))
    fits = rules.filter(named | (F.col("agent") == "*")).withColumn(
        "fit", F.when(named, F.length("agent")).otherwise(0))
    best = fits.groupBy(*KEY).agg(F.max_by("grp", F.struct("fit", -F.col("grp"))).alias("grp"))
    chosen = rules.join(best, [*KEY, "grp"]).filter(F.col("type").isNotNull()).dropDuplicates(
        [*KEY, "pos"])
    return chosen.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(
        "pos", "type", "path", R.pattern_pieces(F.col("path")).alias("pieces"),
        R.is_anchored(F.col("path")).alias("anchored"), R.is_plain(F.col("path")).alias("plain")))).alias("rules"))


def robots_allowed(pages: DataFrame, rules: DataFrame, agent: str = "googlebot") -> DataFrame:
    """Verdict per page: longest matching rule wins, the earlier one on a tie.
    Replaces the columns robots_allowed and robots_rule."""
    per_site = robots_for_agent(rules, agent)
    target = U.path_and_query(F.col("url"))
    joined = pages.drop("robots_allowed", "robots_rule").join(per_site, KEY, "left")
    hits = X.bind(target, lambda p: F.filter("rules", lambda r: R.path_matches(p, r)))
    ranked = F.transform(hits, lambda r: F.struct(
        F.length(r["path"]).alias("n"), (-r["pos"]).alias("first"), r["type"].alias("type"), r["path"].alias("path")))
    return (joined.withColumn("_win", F.array_max(ranked))
            .withColumn("robots_allowed", F.coalesce(F.col("_win.type") == "allow", F.lit(True)))
            .withColumn("robots_rule", F.col("_win.path")).drop("_win", "rules"))


def blocked_urls(reach: DataFrame, rules: DataFrame, agent: str = "googlebot") -> DataFrame:
    return robots_allowed(reach, rules, agent).filter(~F.col("robots_allowed")).select(
        *KEY, "url", F.col("robots_rule").alias("rule"), "depth", "referrer")


# --- redirects -------------------------------------------------------------------------------

def redirect_chains(hops: DataFrame, max_hops: int = 8) -> DataFrame:
    """Follow the hop table from every source URL: final URL, hop count, the
    chain, and whether it loops or runs past ``max_hops``. Joined by merging: the
    planner judges a hop table by its compressed size, and eight copies of it in
    every task's memory grow with the table."""
    step = hops.select(*KEY, F.col("from").alias("_f"), F.col("to").alias("_t"),
                       F.col("status").alias("_s")).dropDuplicates([*KEY, "_f"]).hint("merge")
    state = step.select(*KEY, F.col("_f").alias("url"), F.col("_t").alias("final_url"),
                        F.array(F.struct(F.col("_f").alias("from"), F.col("_t").alias("to"),
                                         F.col("_s").alias("status"))).alias("chain"),
                        (F.col("_f") == F.col("_t")).alias("loop"), F.lit(False).alias("more"))
    for n in range(1, max_hops + 1):
        j = state.join(step.withColumnRenamed("_f", "final_url"), [*KEY, "final_url"], "left")
        go = F.col("_t").isNotNull() & ~F.col("loop")
        if n == max_hops:
            state = j.withColumn("more", go).select(*state.columns)
            break
        state = j.select(
            *KEY, "url", F.when(go, F.col("_t")).otherwise(F.col("final_url")).alias("final_url"),
            F.when(go, F.concat("chain", F.array(F.struct(
                F.col("final_url").alias("from"), F.col("_t").alias("to"), F.col("_s").alias("status")))))
            .otherwise(F.col("chain")).alias("chain"),
            (F.col("loop") | F.coalesce((F.col("_t") == F.col("final_url")) | F.array_contains(F.col("chain")["from"], F.col("_t")),
                                        F.lit(False))).alias("loop"),
            "more")
        if n % 4 == 0:
            state = cut_lineage(state)
    return state.select(
        *KEY, "url", "final_url", F.size("chain").alias("hops"), "chain",
        F.when(F.col("loop"), "redirect_loop").when(F.col("more"), "too_many_redirects").alias("error"))


# --- opportunities ------------------------------------------------------------------------------

def target_terms(pages: DataFrame) -> DataFrame:
    """Terms that name a page: bigrams of its title and H1 words over three
    letters, plus the single words over six."""
    words = F.filter(X.alnum_tokens(F.concat_ws(" ", "title", F.array_join("h1s", " "))), lambda w: F.length(w) > 3)

    def terms(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))),
                           F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))),
                           lambda a, b: F.concat_ws(" ", a, b))
        return F.array_distinct(F.concat(pairs, F.filter(w, lambda x: F.length(x) > 6)))

    return pages.select(*KEY, F.col("url").alias("to_url"), F.explode(X.bind(words, terms)).alias("term")).filter(
        F.length("term") > 4)


def text_terms(pages: DataFrame) -> DataFrame:
    """Every word and adjacent word pair of the body, once per page."""
    def terms(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))),
                           F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))),
                           lambda a, b: F.concat_ws(" ", a, b))
        return F.array_distinct(F.concat(w, pairs))

    return pages.select(*KEY, F.col("url").alias("from_url"),
                        F.explode(X.bind(X.alnum_tokens(F.col("body_text")), terms)).alias("term"))


def link_opportunities(pages: DataFrame, links: DataFrame, targets: DataFrame,
                       per_target: int | None = 15, n_terms: int | None = 4, context: int | None = 220) -> DataFrame:
    """Pages whose text mentions a chosen target's terms without linking to it.

    ``targets`` is a caller's choice of pages (run_id, site, url), optionally
    with a ``term`` column. Token equi-join instead of a substring scan. The report keeps
    ``per_target`` pages a target, ``n_terms`` terms and ``context`` characters, None
    keeps all; ``total`` and ``n_matched`` count what there was.

    Text, terms and edges of all pages are joined by merging: the planner takes an exploded
    body for a few kilobytes and would send it whole through the driver as a broadcast.
    """
    if "term" in targets.columns:
        terms = targets.select(*KEY, F.col("url").alias("to_url"), F.lower("term").alias("term")).filter(
            F.length("term") > 4).distinct()
    else:
        terms = target_terms(pages.join(targets.select(*KEY, "url").distinct(), [*KEY, "url"], "left_semi"))
    live = pages.filter((F.col("status") == 200) & ~F.col("noindex"))
    linked = internal_links(links).select(*KEY, "from_url", F.col("resolved").alias("to_url")).distinct()
    pairs = (text_terms(live).hint("merge").join(terms, [*KEY, "term"]).filter(F.col("from_url") != F.col("to_url"))
             .groupBy(*KEY, "from_url", "to_url").agg(F.collect_set("term").alias("terms"))
             .join(linked.hint("merge"), [*KEY, "from_url", "to_url"], "left_anti"))
    inbound = inbound_counts(links).select(*KEY, F.col("url").alias("from_url"), "inbound_count")
    scored = pairs.join(inbound.hint("merge"), [*KEY, "from_url"], "left").withColumn(
        "score", F.size("terms") + F.when(F.coalesce("inbound_count", F.lit(0)) > 3, 1).otherwise(0))
    best = _reported(scored, [F.desc("score"), F.col("from_url")], per_target)
    longest = F.transform(F.col("terms"), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))
    body = pages.select(*KEY, F.col("url").alias("from_url"), F.col("title").alias("from_title"), "body_text")
    sentence = F.get(F.filter(
        F.regexp_extract_all(F.col("body_text"), F.lit(r"[^.!?]+[.!?]+"), F.lit(0)),
        lambda s: F.contains(F.lower(s), F.col("anchor"))), F.lit(0))
    return (best.withColumn("anchor", F.array_min(longest)["t"]).join(body.hint("merge"), [*KEY, "from_url"])
            .select(*KEY, "from_url", "from_title", "to_url",
                    (F.array_sort("terms") if n_terms is None else F.slice(F.array_sort("terms"), 1, n_terms)).alias("matched_terms"),
                    F.col("anchor").alias("suggested_anchor"),
                    (F.trim(sentence) if context is None else F.substring(F.trim(sentence), 1, context)).alias("context"),
                    "score", "rank", F.size("terms").alias("n_matched"), "total"))


def _reported(scored: DataFrame, order: list[Column], k: int | None) -> DataFrame:
    """The first ``k`` rows of each target (None: all) with rank and the target's total."""
    scored = stage_table(scored)
    totals = scored.groupBy(*KEY, "to_url").agg(F.count("*").alias("total"))
    best = (numbered(scored, [*KEY, "to_url"], order).withColumnRenamed("rn", "rank") if k is None
            else top_per_key(scored, [*KEY, "to_url"], order, k))
    return best.join(totals, [*KEY, "to_url"])


def mention_candidates(pages: DataFrame, links: DataFrame, subjects: DataFrame, k: int | None = 8) -> DataFrame:
    """For each chosen page, the pages naming at least two of its subject words
    (one, if it has one) that do not link to it. ``subjects``: run_id, site, url,
    subject. The first ``k`` of each (None: all), with the ``total`` there was."""
    words = F.array_distinct(F.filter(F.split(F.lower("subject"), " +"), lambda w: F.length(w) > 4))
    asked = subjects.select(*KEY, F.col("url").alias("to_url"), words.alias("w")).withColumn(
        "need", F.least(F.lit(2), F.size("w")))
    terms = asked.select(*KEY, "to_url", "need", F.explode("w").alias("term"))
    tokens = pages.select(*KEY, F.col("url").alias("from_url"), F.explode(F.array_distinct(
        X.alnum_tokens(F.col("body_text")))).alias("term"))
    linked = internal_links(links).select(*KEY, "from_url", F.col("resolved").alias("to_url")).distinct()
    pairs = (tokens.hint("merge").join(terms, [*KEY, "term"]).filter(F.col("from_url") != F.col("to_url"))
             .groupBy(*KEY, "to_url", "from_url").agg(
                 F.count("*").alias("hits"), F.max("need").alias("need"),
                 F.array_sort(F.collect_set("term")).alias("matched"))
             .filter(F.col("hits") >= F.col("need"))
             .join(linked.hint("merge"), [*KEY, "from_url", "to_url"], "left_anti"))
    return _reported(pairs.drop("need"), [F.desc("hits"), F.col("from_url")], k)
