"""Benchmark decontamination by a prefix-filtered set join (native)."""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .common import row_key, whole

#: Words of a window and of a shingle; shingles of the items that are joined at a time.
WINDOW, SHINGLE = 10, 5
TOGETHER = 1 << 18
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: str = "text") -> Column:
    """Words of letters, digits and all characters beyond ASCII; A-Z lowered, no others."""
    t = whole(text)
    ascii_only = F.octet_length(t) == F.char_length(t)
    lowered = F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, ascii_uppercase, ascii_lowercase))
    return F.array_remove(F.split(lowered, _NO_WORD), "")


def _shingle(words: str, at: Column, size: int) -> Column:
    """Hash of ``size`` words; equal hashes are checked by the words themselves later."""
    return F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)])


def windows_of(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Windows (wid, words, len), distinct over all items, and which items hold them
    (wid, item_id). An item shorter than the window is one window; one without words has none."""
    w = items.select(F.col(item_id).cast("string").alias("item_id"), item_words(text).alias("words")).filter("size(words) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    each = w.select("item_id", "words", F.explode(starts).alias("at")).select(
        "item_id", F.slice("words", F.col("at") + 1, F.lit(window)).alias("words"))
    held = stage_table(each.withColumn("wid", F.unhex(F.sha2(F.array_join("words", " "), 256))).distinct())
    return held.select("wid", "words", F.size("words").alias("len")).distinct(), held.filter("item_id is not null").select("wid", "item_id").distinct()


def _positions(docs: DataFrame, size: int) -> DataFrame:
    """One row per shingle start of ``docs`` (words, n_words, ...) and one at -1, without
    a shingle, per document. (The outer form: for the inner one Spark would split the
    text a second time to see that the list is not empty.)"""
    starts = F.sequence(F.lit(-1), F.greatest(F.col("n_words") - size, F.lit(-1)))
    return docs.withColumn("pos", F.explode_outer(starts)).withColumn("h", F.when(F.col("pos") >= 0, _shingle("words", F.col("pos"), size)))


def _parts(rows: DataFrame, n: int, together: int) -> list[DataFrame]:
    """``rows`` (h, ...) in parts of about ``together``, each small enough to broadcast."""
    parts = max(1, -(-n // together))
    return [rows if parts == 1 else rows.filter(F.pmod("h", F.lit(parts)) == k) for k in range(parts)]


def occurrences(docs: DataFrame, windows: DataFrame, shingle: int = SHINGLE, together: int = TOGETHER) -> DataFrame:
    """k1, k2, doc_id, n_words, pos, len, wid: every place where a window occurs in a
    document, and one row per document with a null wid.

    A window is the set of its shingles; a document window of its size contains it only
    if it holds the rarest of them. So shingles are counted over all documents, each
    window is looked up by its rarest one (ties: least hash) and only there; the place of
    the shingle in the window gives the start, which must leave room for the window on
    both sides, and then the words themselves are compared. Windows with a shingle that no
    document holds are gone after the count. The windows' side is joined in parts of at most
    ``together`` rows, which are broadcast: documents are never shuffled, however often a
    shingle occurs, and a larger benchmark means more parts and more scans.
    """
    sizes = [r["s"] for r in windows.select(F.least("len", F.lit(shingle)).alias("s")).distinct().collect()]  # at most ``shingle`` rows
    t = docs.select(*row_key(), "doc_id", item_words().alias("words")).withColumn("n_words", F.size("words"))
    ours = {"len": "int", "wid": "binary"}
    if not sizes:
        return t.select("k1", "k2", "doc_id", "n_words", F.lit(-1).alias("pos"), *[F.lit(None).cast(kind).alias(c) for c, kind in ours.items()])
    least = F.least("len", F.lit(shingle))
    own = stage_table(reduce(DataFrame.union, [
        windows.filter(least == s).select("wid", F.lit(s).alias("s"), F.explode(F.sequence(F.lit(0), F.col("len") - s)).alias("off"), "words")
        .select("wid", "s", "off", _shingle("words", F.col("off"), s).alias("h")) for s in sizes]))
    distinct = stage_table(own.select("h", "s").distinct())
    n = distinct.count()
    counts = stage_table(reduce(DataFrame.union, [
        _positions(t, s).select("h").join(F.broadcast(part), "h").groupBy("h").agg(F.count("*").alias("df"))
        for s in sizes for part in _parts(distinct.filter(F.col("s") == s).select("h"), n, together)]))
    rare = own.join(counts, "h", "left").groupBy("wid").agg(
        F.min(F.struct("df", "h", "off")).alias("p"), F.count_if(F.col("df").isNull()).alias("unseen")).filter("unseen = 0")
    prefix = stage_table(rare.select("wid", "p.h", "p.off").join(windows, "wid").select("h", "off", "len", "wid", "words", least.alias("s")))
    n = prefix.count()
    found = []
    for s in sizes:
        for part in _parts(prefix.filter(F.col("s") == s).select("h", "off", *ours, F.col("words").alias("ours")), n, together):
            x, y = _positions(t, s).alias("x"), F.broadcast(part).alias("y")
            start = F.col("pos") - F.col("off")
            fits = (F.col("x.h") == F.col("y.h")) & (start >= 0) & (start + F.col("len") <= F.col("n_words"))
            same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("ours")
            at = x.join(y, fits & same, "inner" if found else "left").filter("wid is not null" if found else "wid is not null or pos = -1")
            found.append(at.select("k1", "k2", "doc_id", "n_words", F.coalesce(start, "pos").alias("pos"), *ours))
    return reduce(DataFrame.union, found)


def _covered(spans: Column) -> Column:
    """Positions inside any of the spans (pos, len), which may overlap."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = (x["pos"] + x["len"]).cast("long")
        fresh = F.greatest(end - F.greatest(acc["end"], x["pos"].cast("long")), F.lit(0).cast("long"))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(F.sort_array(spans), zero, step)["n"]


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans, contaminated for each row of ``docs``.

    n_hit counts the words inside any occurrence of a window of ``window`` consecutive
    words of an item (fewer: the whole item); ``items`` lists the identifiers of the items
    with an occurring window, sorted as strings; ``spans`` the occurrences (pos, len).
    Null text has no words, in documents and items; an item without identifier marks words
    but is not listed, and rows that share an identifier are one item; documents that
    repeat in doc_id and text repeat with the same verdict; empty tables give zeros or no
    rows; columns other than these are not read, so their names cannot clash. Very long
    texts are one row; their windows are looked up position by position.
    """
    t = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    windows, holders = windows_of(items, item_id, item_text, window)
    found = stage_table(occurrences(t, stage_table(windows), shingle, together))
    hits = found.filter("wid is not null")
    keys = ["k1", "k2", "doc_id"]
    listed = hits.select(*keys, "wid").distinct().join(holders, "wid").select(*keys, "item_id").distinct()
    none = {"n_words": F.lit(None).cast("int"), "span": F.lit(None).cast("struct<pos: int, len: int>"), "item": F.lit(None).cast("string")}
    rows = (found.filter("wid is null").select(*keys, F.col("n_words"), none["span"].alias("span"), none["item"].alias("item"))
            .union(hits.select(*keys, none["n_words"], F.struct("pos", "len"), none["item"]).distinct())
            .union(listed.select(*keys, none["n_words"], none["span"], "item_id")))
    per = rows.groupBy(*keys).agg(
        F.max("n_words").cast("long").alias("n_words"), F.count("n_words").cast("int").alias("copies"),
        F.collect_list("span").alias("spans"), F.sort_array(F.collect_list("item")).alias("items"))
    out = per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("n_hit", _covered(F.col("spans")))
    return out.select("doc_id", "n_words", "n_hit", "items", F.sort_array("spans").alias("spans"), (F.col("n_hit") > 0).alias("contaminated"))
