"""Secret scans over an incremental blob ledger (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .common import let, row_key, whole

#: kind: version, pattern, group that is measured, its least length. Order is that of spans at one start.
RULES = {
    "assign": (1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (1, r"[0-9a-f]{24,}", 0, 24),
    "pem": (1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "jwt": (1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
}
BASE = ["assign", "access", "hex"]
LEDGER = "blob binary, rule string, version int, spans array<struct<start:long,end:long>>"


def _matches(text: Column, rule: str) -> Column:
    """Array of (gap before the match, its length, whether it holds) and one last gap."""
    _, pattern, group, least = RULES[rule]
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    if group:
        good = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x) >= least)
    else:
        good = F.transform(found, lambda n: n >= least)
    return F.arrays_zip(gaps.alias("gap"), found.alias("len"), good.alias("ok"))


def scan(blobs: DataFrame) -> DataFrame:
    """Ledger rows of ``blobs`` (blob, text, due: rules to run): one row per blob and
    rule, without findings too.

    A match's place is the running sum of the lengths between and of the matches
    before it, so positions come from built-in expressions alone. The patterns
    find maximal leftmost runs; failing matches are dropped, not retried.
    """
    runs = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("version"), F.when(
        F.array_contains("due", r) & F.col("text").rlike(p), _matches(F.col("text"), r)).alias("m"))
        for r, (v, p, _, _) in RULES.items()])
    one = blobs.select("blob", F.explode(F.filter(runs, lambda r: F.array_contains(F.col("due"), r["rule"]))).alias("r"))
    parts = one.select("blob", "r.rule", "r.version", F.posexplode_outer("r.m").alias("i", "m"))
    # places inside one blob: the window holds one document's matches of one rule
    from pyspark.sql import Window as W
    before = W.partitionBy("blob", "rule", "version").orderBy("i")
    at = F.sum(F.col("m.gap") + F.coalesce(F.col("m.len"), F.lit(0))).over(before) - F.col("m.len")
    quiet = parts.filter("m is null").select("blob", "rule", "version", F.lit(None).cast("struct<start:long,end:long>").alias("span"))
    loud = (parts.filter("m is not null").dropDuplicates(["blob", "rule", "version", "i"]).withColumn("start", at.cast("long"))
            .select("blob", "rule", "version", F.when(F.col("m.ok"), F.struct(
                F.col("start"), (F.col("start") + F.col("m.len")).alias("end"))).alias("span")))
    return quiet.union(loud).groupBy("blob", "rule", "version").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def update(docs: DataFrame, ledger: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(paths, new)``: k1, k2, doc_id, blob of every row of ``docs``, and the ledger
    rows that were missing.

    A blob is named by the SHA-256 of its text (null counts as empty), so copies and
    re-crawled versions are scanned once. Only pairs of blob and rule version that
    the ledger lacks are scanned; the text of one row per such blob is fetched by its
    key. Append ``new`` to the ledger; an old row is never changed. Both frames come
    from tables written in the shared folder.
    """
    t = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    paths = stage_table(t.select(*row_key(), "doc_id", F.unhex(F.sha2(whole(), 256)).alias("blob")))
    wanted = paths.groupBy("blob").agg(F.min(F.struct("k1", "k2")).alias("k"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v[0]).alias("version")) for r, v in RULES.items()])
    if ledger is None:
        due = wanted.select("blob", "k.k1", "k.k2", F.array(*[F.lit(r) for r in RULES]).alias("due"))
    else:
        pairs = wanted.select("blob", "k", F.explode(rules).alias("r")).select("blob", "k", "r.rule", "r.version")
        due = (pairs.join(ledger, ["blob", "rule", "version"], "left_anti")
               .groupBy("blob", "k").agg(F.collect_set("rule").alias("due")).select("blob", "k.k1", "k.k2", "due"))
    # the keys are the small side: texts stream past a hash table of each partition
    texts = t.select(*row_key(), whole().alias("text")).join(due.hint("shuffle_hash"), ["k1", "k2"])
    return paths, stage_table(scan(texts.select("blob", "text", "due")))


def find(docs: DataFrame, ledger: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """k1, k2, doc_id, found (array of start, kind, rule, end in order) per row of
    ``docs``: ledger findings of the current rule versions joined to all paths.
    Repeated rows repeat; an empty table gives none."""
    paths, new = update(docs, ledger, doc_id, text)
    everything = new if ledger is None else new.unionByName(ledger.select(*new.columns))
    no = (F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("rule")) - 1).cast("int")
    current = F.array_contains(F.array(*[F.concat_ws(":", F.lit(r), F.lit(v[0])) for r, v in RULES.items()]), F.concat_ws(":", "rule", "version"))
    spans = (everything.filter(current & (F.size("spans") > 0)).select("blob", "rule", no.alias("kind"), F.explode("spans").alias("s"))
             .groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("s.start", "kind", "rule", "s.end"))).alias("found")))
    joined = paths.join(spans, "blob", "left")
    empty = F.array().cast("array<struct<start:long,kind:int,rule:string,end:long>>")
    return joined.select("k1", "k2", "doc_id", F.coalesce("found", empty).alias("found"))


def spelled(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")


def redact(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced; overlapping spans become one mark."""
    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(found, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step)
    return F.when(F.size(found) == 0, text).otherwise(let(done, lambda d: F.concat(
        d["out"], F.substring(text, (d["at"] + 1).cast("int"), F.length(text)))))
