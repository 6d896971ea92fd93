"""Quality rules with host verdicts (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .common import SPACE, let, whole, words_of

#: Rules counted by host, over the columns of ``document_counts``.
HOST_RULES = {
    "base": "n_words < 50 or 100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
}
REJECT_RATE = 0.5
LEAST_SHARE = 1e-6


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""
    def marked(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = let(order, lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])))
        starts = F.sort_array(F.transform(twice, lambda x: x["p"]))
        # a start covers up to the next start, at most three words
        return let(starts, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    def counted(w: Column) -> Column:
        windows = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
                              lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(marked(h)))

    return let(words, counted)


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words.
    Null text has no words. Existing columns of these names are replaced."""
    t = whole(text)
    symbols = F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))
    chars = F.length(F.translate(t, " \t\n\x0b\x0c\r", ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = words_of(t)
    counts = F.struct(
        F.size(words).cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"), _repeat_words(words).cast("long").alias("n_repeat_words"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]
    return docs.withColumns({n: counts[n] for n in names})


def host_rates(marked: DataFrame, host: str = "host") -> DataFrame:
    """host, rule, n, failed, rate: the failure rate of each rule on each host,
    shrunk to the pooled rate by a beta prior.

    ``marked`` has the host (null is a host of its own) and one boolean column per
    rule. The prior of a rule is fitted to the hosts by moments: with pooled rate p
    and S = sum n (k/n - p)^2, the share of variance between hosts is
    (S / p(1-p) - (H-1)) / (N - sum n^2 / N - (H-1)), and the prior weighs
    1/share - 1 documents. Hosts are partial aggregates, so a hot host is one row.
    """
    flags = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"_{r}").alias("bad")) for r in HOST_RULES])
    by_host = marked.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), *[F.count_if(F.col(f"_{r}")).alias(f"_{r}") for r in HOST_RULES])
    long = by_host.select("host", "n", F.explode(flags).alias("f")).select(
        "host", "n", F.col("f.rule").alias("rule"), F.col("f.bad").alias("failed"))
    prior = long.groupBy("rule").agg(
        F.count("*").alias("hosts"), F.sum("n").alias("all"), F.sum("failed").alias("bad"),
        F.sum(F.col("n") * F.col("n") / 1.0).alias("nn"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("kk"))
    p = F.col("bad") / F.col("all")
    within = F.col("hosts") - 1
    share = F.try_divide(F.try_divide(F.col("kk") - F.col("bad") * p, p * (1 - p)) - within,
                         F.col("all") - F.col("nn") / F.col("all") - within)
    share = F.least(F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(LEAST_SHARE)), F.lit(1 - LEAST_SHARE))
    prior = prior.select("rule", p.alias("p"), (1 / share - 1).alias("weight"))
    # one row per rule: a fixed handful
    return long.join(F.broadcast(prior), "rule").select(
        "host", "rule", "n", "failed", ((F.col("failed") + F.col("p") * F.col("weight")) / (F.col("n") + F.col("weight"))).alias("rate"))


def judge(docs: DataFrame, host: str = "source", text: str = "text", keep: list[str] | None = None,
          reject_rate: float = REJECT_RATE) -> DataFrame:
    """Every document with its counts, base_failed and kept.

    A document is rejected if the base rule fails, or if it fails a rule that its
    host fails at a shrunk rate above ``reject_rate``; clean documents of a bad host
    stay, and a failure of a single rule on a good host is forgiven. ``keep`` names
    the columns of ``docs`` to return (all by default); ``row`` holds them as a
    struct, so no name can clash. Counts are written once and read by both the
    aggregate and the join. Null and empty texts have no words and fail the base rule; a
    null host is a host of its own; repeated rows count and repeat; a very long text is one
    row of array functions; an empty table gives no rows.
    """
    cols = docs.columns if keep is None else keep
    base = docs.select(F.struct(*[F.col(c) for c in cols]).alias("row"), F.col(host).alias("host"), F.col(text).alias("text"))
    counted = document_counts(base).drop("text")
    marked = stage_table(counted.withColumns({f"_{r}": F.expr(c) for r, c in HOST_RULES.items()}))
    bad = host_rates(marked).filter(F.col("rate") > reject_rate).groupBy("host").agg(F.collect_set("rule").alias("bad_rules"))
    joined = marked.alias("d").join(bad.alias("b"), F.col("d.host").eqNullSafe(F.col("b.host")), "left")
    failed = F.array_compact(F.array(*[F.when(F.col(f"_{r}"), F.lit(r)) for r in HOST_RULES if r != "base"]))
    rejected = F.col("_base") | F.coalesce(F.arrays_overlap(failed, F.col("bad_rules")), F.lit(False))
    return joined.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         F.col("_base").alias("base_failed"), (~rejected).alias("kept"))
