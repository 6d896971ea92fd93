"""Extractive summaries: sentences chosen verbatim from the text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..session import spread
from .ranking import top_per_key

_WORD = r"[a-z][a-z'-]+"


def _stop() -> list[str]:
    return V.SUMMARY_STOP.split()


def _word_set(text: Column) -> Column:
    """Distinct informative words."""
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)),
                          F.array(*[F.lit(w) for w in _stop()]))


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, i, n, sentence; each row is split where it is."""
    s = spread(docs.select(key, text)).select(key, X.split_sentences(F.col(text)).alias("s"))
    # outer: else a filter on the array's size is inferred and the array computed twice
    return s.select(key, F.size("s").alias("n"), F.posexplode_outer("s").alias("i", "sentence")).filter("i is not null")


def _informative(sentence: Column) -> Column:
    words = F.regexp_extract_all(F.lower(sentence), F.lit(_WORD), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(_stop()))


def term_frequency(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int | None = None) -> DataFrame:
    """Counts of informative words per document; the top ``k`` if given. Only
    counts are shuffled."""
    words = sentences(docs, key, text).select(key, F.explode(_informative(F.col("sentence"))).alias("word"))
    tf = words.groupBy(key, "word").agg(F.count("*").alias("n"))
    return top_per_key(tf, [key], [F.desc("n"), F.col("word")], k)


def _weights(documents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Per sentence: sum of its words' counts in the document, words, largest count of any word."""
    for batch in documents:
        out = []
        for tokens in batch:
            tokens = () if tokens is None else tokens
            count = Counter(w for ws in tokens for w in ws)
            peak = max(count.values(), default=0)
            out.append([{"mass": sum(count[w] for w in ws), "words": len(ws), "peak": peak} for ws in tokens])
        yield pd.Series(out)


def _scored_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, scored: every sentence of a document with its score, in order. A
    document is a row from beginning to end, so a table with as many splits as cores is
    not shuffled."""
    weights = F.pandas_udf(_weights, "array<struct<mass:long,words:int,peak:int>>")
    split = spread(docs.select(key, text)).select(key, X.split_sentences(F.col(text)).alias("s"))
    weighed = split.withColumn("w", weights(F.transform("s", _informative)))
    n = F.size("s")

    def score(sentence: Column, i: Column) -> Column:
        w = F.get("w", i)
        place = (F.when(i == 0, 1.35).when(i == 1, 1.15).when(i < n * 0.3, 1.05).otherwise(1.0))
        size = F.when(F.length(sentence) > 260, 0.8).when(F.length(sentence) < 60, 0.85).otherwise(1.0)
        share = F.when(w["words"] > 0, w["mass"] / w["words"] / w["peak"]).otherwise(F.lit(0.0))
        return share * place * size

    return weighed.select(key, n.alias("n"), F.transform("s", lambda x, i: F.struct(
        i.alias("i"), x.alias("sentence"), score(x, i).alias("score"))).alias("scored"))


def score_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Mean relative term frequency, times position and length factors."""
    # outer: else a filter on the array's size is inferred and the array computed twice
    return _scored_rows(docs, key, text).select(key, "n", F.explode_outer("scored").alias("x")).filter("x is not null").select(
        key, "x.i", "n", "x.sentence", "x.score")


def summarize(docs: DataFrame, k: int = 3, max_chars: int = 0, key: str = "doc_id",
              text: str = "text") -> DataFrame:
    """Best ``k`` sentences in their order, skipping one that shares over 70
    percent of the smaller word set with one already chosen, within a character
    budget. Choosing is a fold over one document's scored sentences."""
    # nothing is filtered before the weights: the sentences would be split for it once more
    ranked = _scored_rows(docs, key, text).select(key, "n", F.array_sort(F.transform("scored", lambda x: F.struct(
        (-x["score"]).alias("o"), x["i"].alias("i"), x["sentence"].alias("sentence")))).alias("c"))

    def overlaps(a: Column, b: Column) -> Column:
        least = F.least(F.size(a), F.size(b))
        return (least > 0) & (F.size(F.array_intersect(a, b)) / least > 0.7)

    def take(acc: Column, s: Column) -> Column:
        # word sets are made of the sentences looked at, not of all
        bagged = F.struct(s["i"].alias("i"), s["sentence"].alias("sentence"), _word_set(s["sentence"]).alias("bag"))
        return F.when(F.size(acc) >= k, acc).otherwise(X.bind(bagged, lambda e: F.when(
            F.exists(acc, lambda x: overlaps(x["bag"], e["bag"])), acc).otherwise(F.concat(acc, F.array(e)))))

    def placed(found: Column) -> Column:
        return F.transform(found, lambda s: F.struct(s["i"].alias("i"), s["sentence"].alias("s")))

    none = F.array().cast("array<struct<i:int,sentence:string,bag:array<string>>>")
    everything = F.col("n") <= k
    in_order = F.array_sort(F.when(everything, placed(F.col("c"))).otherwise(placed(F.aggregate("c", none, take))))
    out = ranked.select(key, "n", everything.alias("_all"), F.transform(in_order, lambda s: s["s"]).alias("sentences"))
    if max_chars:
        keep = F.array_max(F.filter(F.sequence(F.lit(1), F.size("sentences")), lambda m: (m == 1) | (
            F.length(F.array_join(F.slice(F.col("sentences"), F.lit(1), m), " ")) <= max_chars)))
        out = out.withColumn("sentences", F.when(F.col("_all"), F.col("sentences")).otherwise(
            F.slice(F.col("sentences"), F.lit(1), keep)))
    summary = F.array_join("sentences", " ")
    if max_chars:
        head = F.substring(summary, 1, max_chars)
        cut = F.length(head) - F.instr(F.reverse(head), " ")
        summary = F.when(~F.col("_all") & (F.length(summary) > max_chars), F.concat(
            F.left(summary, F.when(F.instr(head, " ") > 0, cut).otherwise(F.length(summary) - 1)), F.lit("…"))).otherwise(summary)
    made = F.when(F.col("n") > 0, F.array(F.struct("sentences", summary.alias("summary"))))
    return out.select(key, F.explode_outer(made).alias("x")).filter("x is not null").select(key, "x.sentences", "x.summary")


def excerpt(docs: DataFrame, max_chars: int = 155, key: str = "doc_id", text: str = "text") -> DataFrame:
    return summarize(docs, 2, max_chars, key, text)
