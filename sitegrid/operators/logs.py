"""Access-log analysis: bots, where the crawl budget goes, what it misses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..functions import urls as U
from .ranking import top_per_key


def identify_bot(ua: Column, patterns: list[tuple[str, str, str]] = V.BOT_PATTERNS) -> Column:
    """Id of the first pattern that matches, NULL for people."""
    return reduce(lambda c, p: c.when(ua.rlike(p[2]), p[0]), patterns, F.when(F.lit(False), F.lit(None)))


def verify_bot(bot: Column, ip: Column, prefixes: dict[str, list[str]] = V.BOT_PREFIXES) -> Column:
    """True or false where the bot publishes address ranges, NULL elsewhere."""
    out = F.when(F.lit(False), F.lit(None).cast("boolean"))
    for name, starts in prefixes.items():
        out = out.when(bot == name, F.coalesce(
            reduce(lambda a, b: a | b, [ip.startswith(p) for p in starts]), F.lit(False)))
    return out


def clean_url(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def with_bot(hits: DataFrame) -> DataFrame:
    tagged = hits.withColumn("bot", identify_bot(F.coalesce("ua", F.lit(""))))
    return tagged.withColumns({"verified": verify_bot(F.col("bot"), F.col("ip")), "clean": clean_url(F.col("url"))})


def bot_traffic(hits: DataFrame, by: list[str] = ()) -> DataFrame:
    """Hits and bytes per bot; people under ``human``."""
    return with_bot(hits).groupBy(*by, F.coalesce("bot", F.lit("human")).alias("bot")).agg(
        F.count("*").alias("hits"), F.sum("bytes").alias("bytes"),
        F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("spoofed"))


def log_span(hits: DataFrame, bot: str = "googlebot", by: list[str] = ()) -> DataFrame:
    """First and last day, whole days between (at least one), bot hits per day."""
    secs = F.unix_timestamp(F.max("at")) - F.unix_timestamp(F.min("at"))
    days = F.greatest(F.lit(1).cast("bigint"), X.half_up(F.coalesce(secs, F.lit(0)) / 86400.0))
    per = with_bot(hits).groupBy(*by).agg(
        F.min("at").alias("a"), F.max("at").alias("b"), days.alias("days"),
        F.count_if(F.col("bot") == bot).alias("bot_hits"))
    return per.select(*by, F.date_format("a", "yyyy-MM-dd").alias("first_day"),
                      F.date_format("b", "yyyy-MM-dd").alias("last_day"), "days", "bot_hits",
                      X.half_up(F.col("bot_hits") / F.col("days")).alias("per_day"))


def bot_hits(hits: DataFrame, bot: str = "googlebot") -> DataFrame:
    return with_bot(hits).filter(F.col("bot") == bot)


def crawl_by_url(hits: DataFrame, bot: str = "googlebot", by: list[str] = ()) -> DataFrame:
    """Hits per URL with a status map. Statuses are few, so the map is small."""
    per = bot_hits(hits, bot).groupBy(*by, F.col("clean").alias("url"), "status").agg(F.count("*").alias("n"))
    return per.groupBy(*by, "url").agg(
        F.sum("n").alias("hits"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))
        .alias("statuses"), F.bool_or(F.col("status").between(400, 599)).alias("has_error"))


def crawl_by_status(hits: DataFrame, bot: str = "googlebot", by: list[str] = ()) -> DataFrame:
    return bot_hits(hits, bot).groupBy(*by, "status").agg(F.count("*").alias("hits"))


def crawl_by_section(hits: DataFrame, bot: str = "googlebot", by: list[str] = (), k: int | None = None) -> DataFrame:
    per = bot_hits(hits, bot).groupBy(*by, U.section(F.col("clean")).alias("section")).agg(F.count("*").alias("hits"))
    return top_per_key(per, list(by), [F.desc("hits"), F.col("section")], k)


def crawl_budget_sets(hits: DataFrame, bot: str = "googlebot") -> DataFrame:
    """Status and section totals from one scan by grouping sets."""
    tagged = bot_hits(hits, bot).withColumn("section", U.section(F.col("clean")))
    return tagged.groupingSets([["status"], ["section"]], "status", "section").agg(F.count("*").alias("hits"))


def waste_columns() -> list[Column]:
    s, n = F.col("status"), F.count("*")
    errors, redirects = F.count_if(s.between(400, 599)), F.count_if(s.between(300, 399))
    params = F.count_if(F.contains("clean", F.lit("?")))
    return [n.alias("hits"), errors.alias("errors"), redirects.alias("redirects"), params.alias("params"),
            X.percent(errors, n).alias("error_share"), X.percent(redirects, n).alias("redirect_share"),
            X.percent(params, n).alias("param_share"), F.count_if(F.col("ms") > V.SLOW_HIT_MS).alias("slow"),
            F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("spoofed")]


def crawl_waste(hits: DataFrame, bot: str | None = "googlebot", by: list[str] = ()) -> DataFrame:
    """Shares of bot hits spent on errors, redirects and parameter URLs. With
    ``bot=None`` one row per bot."""
    tagged = with_bot(hits).filter(F.col("bot").isNotNull() if bot is None else F.col("bot") == bot)
    keys = list(by) + (["bot"] if bot is None else [])
    return tagged.groupBy(*keys).agg(*waste_columns())


def crawl_urls(pages: DataFrame) -> DataFrame:
    """Pages keyed as a log names them: path and query."""
    return pages.withColumn("target", U.path_and_query(F.col("url")))


def never_crawled(hits: DataFrame, pages: DataFrame, bot: str = "googlebot", by: list[str] = ()) -> DataFrame:
    """Indexable 200 pages the bot never asked for; order by inbound for the
    weakest first."""
    asked = bot_hits(hits, bot).select(*by, F.col("clean").alias("target")).distinct()
    return (crawl_urls(pages).filter((F.col("status") == 200) & ~F.col("noindex"))
            .join(asked, [*by, "target"], "left_anti")
            .select(*by, F.col("target").alias("path"), F.coalesce("inbound_count", F.lit(0)).alias("inbound"),
                    "depth"))


def unknown_urls(hits: DataFrame, pages: DataFrame, bot: str = "googlebot", by: list[str] = ()) -> DataFrame:
    """URLs without a query the bot asks for and the crawl never found."""
    known = crawl_urls(pages).select(*by, F.col("target").alias("clean")).distinct()
    return (bot_hits(hits, bot).filter(~F.contains("clean", F.lit("?")))
            .groupBy(*by, "clean").agg(F.count("*").alias("hits"))
            .join(known, [*by, "clean"], "left_anti").withColumnRenamed("clean", "url"))


def log_findings(hits: DataFrame, pages: DataFrame | None = None, bot: str = "googlebot",
                 by: list[str] = ()) -> DataFrame:
    """Threshold findings of a log: severity, count, share and the worst URLs."""
    waste = crawl_waste(hits, bot, by)
    share = {n: F.col(n) / F.col("hits") for n in ("errors", "redirects", "params")}
    claims = F.col("verified") + F.col("spoofed")

    def finding(rule: str, severity: str, n: str, rate: str | Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(n).alias("n"),
                        (F.col(rate) if isinstance(rate, str) else rate).alias("share"))

    rows = F.array_compact(F.array(
        F.when((F.col("spoofed") > 0) & (F.col("verified") > 0), finding(
            "log-spoofed-bot", "High", "spoofed", X.percent(F.col("spoofed"), claims))),
        F.when(share["errors"] > 0.05, finding("log-error-waste", "High", "errors", "error_share")),
        F.when(share["redirects"] > 0.15, finding("log-redirect-waste", "Medium", "redirects", "redirect_share")),
        F.when(share["params"] > 0.2, finding("log-param-waste", "High", "params", "param_share"))))
    out = waste.select(*by, F.explode(rows).alias("f")).select(*by, "f.*")
    per_url = crawl_by_url(hits, bot, by)
    order = [F.desc("hits"), F.col("url")]

    def worst(df: DataFrame, rule: str, k: int) -> DataFrame:
        top = top_per_key(df, list(by), order, k)
        return top.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "url", "hits"))).alias("w")).select(
            *by, F.lit(rule).alias("rule"), F.transform("w", lambda s: s["url"]).alias("urls"))

    lists = worst(per_url.filter("has_error"), "log-error-waste", 10).unionByName(
        worst(per_url.filter(F.contains("url", F.lit("?"))), "log-param-waste", 8))
    if pages is not None:
        for rule, df, sev in (("log-never-crawled", never_crawled(hits, pages, bot, by), "High"),
                              ("log-unknown-urls", unknown_urls(hits, pages, bot, by), "Medium")):
            out = out.unionByName(df.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 0").select(
                *by, F.lit(rule).alias("rule"), F.lit(sev).alias("severity"), "n",
                F.lit(None).cast("bigint").alias("share")))
    return out.join(lists, [*by, "rule"], "left")
