"""Visibility of a brand in generated answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from .ranking import top_per_key


def _literal(text: str) -> str:
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}" else c for c in text)


def brand_named(text: Column, brand: str) -> Column:
    """The brand as a whole word, any case."""
    if not brand:
        return F.lit(False)
    return text.rlike(f"(?i)(^|[^a-z0-9]){_literal(brand)}([^a-z0-9]|$)")


def domain_cited(text: Column, domain: str) -> Column:
    """The bare domain, not as part of a longer host name."""
    if not domain:
        return F.lit(False)
    bare = domain.removeprefix("https://").removeprefix("http://").removeprefix("www.").split("/")[0]
    return text.rlike(f"(?i)(^|[^a-z0-9.-]){_literal(bare)}([^a-z0-9-]|$)")


def brand_sentiment(text: Column, brand: str) -> Column:
    """0 to 10 from lexicon terms in the sentences naming the brand; NULL when
    no sentence does."""
    said = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: brand_named(s, brand))
    joined = F.array_join(said, " ")
    pos, neg = F.regexp_count(joined, F.lit(V.POSITIVE_TERMS)), F.regexp_count(joined, F.lit(V.NEGATIVE_TERMS))
    score = F.when(pos + neg > 0, (pos - neg) / (pos + neg)).otherwise(0.0)
    return F.when(F.size(said) > 0, F.round((score + 1) / 2 * 10, 1))


def sentiment_label(score: Column) -> Column:
    raw = score / 5 - 1
    return F.when(raw > 0.2, "Positive").when(raw < -0.2, "Negative").when(score.isNotNull(), "Neutral")


def _padded(name: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(name), "[^a-z0-9]", " "), F.lit(" "))


def detect_brands(text: Column, known: list[str]) -> Column:
    """Names in an answer, in order: the known brands it names, then capitalised
    runs of up to three words. A run that contains a name already found is
    skipped, a name inside a longer one is dropped. One answer bounds the fold."""
    listed = F.array_compact(F.array(*[F.when(brand_named(text, b), F.lit(b)) for b in known]))
    listed = listed.cast("array<string>")
    runs = F.regexp_extract_all(text, F.lit(V.BRAND_RUN), F.lit(1))
    runs = F.filter(runs, lambda c: (F.length(c) >= 3) & ~c.rlike(V.BRAND_STOP))
    found = F.aggregate(runs, listed, lambda acc, c: F.when(
        F.exists(acc, lambda k: F.contains(_padded(c), _padded(k))), acc).otherwise(F.concat(acc, F.array(c))))

    def whole(names: Column) -> Column:
        return F.filter(names, lambda n: ~F.exists(names, lambda o: (F.length(o) > F.length(n))
                                                   & F.contains(_padded(o), _padded(n))))

    return X.bind(found, whole)


def score_answers(answers: DataFrame, brand: str, domain: str, rivals: list[str] = ()) -> DataFrame:
    """Adds named, cited, brands, position and sentiment to answers with columns
    run_id, prompt, provider, answer, error. Error rows keep NULLs."""
    ok = F.col("error").isNull()
    text = F.coalesce("answer", F.lit(""))
    out = answers.withColumn("brands", F.when(ok, detect_brands(text, [brand, *rivals])))
    place = F.array_min(F.filter(F.transform(
        "brands", lambda b, i: F.when(brand_named(b, brand), i + 1)), lambda p: p.isNotNull()))
    return out.withColumns({
        "named": F.when(ok, brand_named(text, brand)), "cited": F.when(ok, domain_cited(text, domain)),
        "sentiment": F.when(ok, brand_sentiment(text, brand)), "position": F.when(ok, place)})


def visibility_score(scored: DataFrame, by: list[str] = ("run_id",)) -> DataFrame:
    """Out of 100 per run: 60 for being named, decaying with position to a floor,
    40 for being cited. Error rows stay out; NULL without any answer."""
    ok = F.col("error").isNull()
    n = F.count_if(ok)
    weight = F.when(ok & F.col("named"), F.greatest(
        F.lit(0.4), 1 - (F.coalesce("position", F.lit(3)) - 1) * F.lit(0.2))).otherwise(0.0)
    named, cited = F.count_if(ok & F.col("named")), F.count_if(ok & F.col("cited"))
    return scored.groupBy(*by).agg(
        F.when(n > 0, X.half_up(F.sum(weight) / n * 60 + cited / n * 40)).alias("score"),
        X.percent(named, n).alias("named_rate"), X.percent(cited, n).alias("cited_rate"),
        F.round(F.avg(F.when(ok, F.col("sentiment"))), 1).alias("sentiment"),
        n.alias("answered"), F.count("*").alias("attempted"))


def share_of_voice(scored: DataFrame, brand: str, by: list[str] = ("run_id",), k: int | None = None) -> DataFrame:
    """Mentions per name over all mentions in the same answers; the top ``k`` if given."""
    by = list(by)
    names = scored.filter(F.col("error").isNull()).select(*by, F.explode("brands").alias("brand"))
    per = names.groupBy(*by, "brand").agg(F.count("*").alias("mentions"))
    total = per.groupBy(*by).agg(F.sum("mentions").alias("all_mentions"))
    return (top_per_key(per, by, [F.desc("mentions"), F.col("brand")], k).join(total, by)
            .withColumn("share", X.percent(F.col("mentions"), F.col("all_mentions")))
            .withColumn("own", brand_named(F.col("brand"), brand)))


def visibility_by_prompt(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rates per prompt over all runs, and the change in namings from the first to
    the last run; NULL under two runs. Runs are ordered by ``run_id``."""
    ok = scored.filter(F.col("error").isNull())
    keys = [*by, "prompt"]
    per_run = ok.groupBy(*keys, "run_id").agg(
        F.count("*").alias("n"), F.count_if("named").alias("named"), F.count_if("cited").alias("cited"),
        F.sum("sentiment").alias("s"), F.count("sentiment").alias("sn"))
    n = F.sum("n")
    first, last = F.min_by("named", "run_id"), F.max_by("named", "run_id")
    return per_run.groupBy(*keys).agg(
        X.percent(F.sum("named"), n).alias("visibility"), X.percent(F.sum("cited"), n).alias("cited_rate"),
        F.round(F.sum("s") / F.nullif(F.sum("sn"), F.lit(0)), 1).alias("sentiment"),
        F.when(F.count("*") >= 2, X.half_up((last - first) / F.greatest(F.lit(1), first) * 100)).alias("trend"),
        n.alias("samples"))


def suggest_prompts(brands: DataFrame, k: int = 12) -> DataFrame:
    """Buyer questions per brand record (name, services, locations)."""
    place = F.get("locations", F.lit(0))
    at = F.coalesce(F.concat(F.lit(" in "), place), F.lit(""))
    svc = F.transform(F.slice("services", 1, 4), lambda s: F.lower(s))
    per = F.flatten(F.transform(svc, lambda s: F.array(
        F.concat(F.lit("best "), s, at),
        F.concat(F.lit("how do I choose a "), F.regexp_replace(s, "s$", "")))))
    name = F.col("name")
    tail = F.array_compact(F.array(
        F.concat(F.lit("is "), name, F.lit(" any good")), F.concat(name, F.lit(" alternatives")),
        F.when(place.isNotNull(), F.concat(F.lit("who should I use for "),
                                           F.coalesce(F.get(svc, F.lit(0)), F.lit("this")), F.lit(" in "), place))))
    return brands.select("name", F.posexplode(F.slice(F.array_distinct(F.concat(per, tail)), 1, k)).alias("n", "prompt"))

