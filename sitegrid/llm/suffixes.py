"""Removal of repeated strings by suffix arrays, sorted in two stages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .common import row_key, whole

#: Bytes of a repeat; bytes of the grams whose least hash names a window.
LENGTH, GRAM = 400, 16
#: Bytes of one suffix array, contexts of one name sorted together.
BUFFER, TOGETHER = 1 << 18, 2048
#: A key with over a ``SHARE``-th of all rows is dealt over ``PARTS`` tasks.
SHARE, PARTS = 1024, 64
_CHUNK = 1 << 20
_END = 255  # never a byte of UTF-8


def suffix_array(t: np.ndarray, depth: int = LENGTH, due: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of the bytes ``t`` in order of at least their first ``depth`` bytes; if
    ``due`` marks places, of these and of what inducing them takes only.

    Stage one sorts only the suffixes that are smaller than their successors. Stage
    two scans the buckets of first bytes upwards: the suffix before each placed one,
    where it is larger than its successor, goes to the end of the larger part built so
    far of its own bucket.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    step = np.sign(np.diff(t.astype(np.int16)))
    step = np.append(step, -1)  # the last suffix is larger than the empty one
    where = np.where(step != 0, np.arange(n), n)
    turn = np.minimum.accumulate(where[::-1])[::-1]  # an equal run compares as its end does
    small = step[turn] > 0
    wanted = np.ones(n, bool) if due is None else due.copy()
    while True:  # a larger suffix is induced from its successor
        more = wanted[:-1] & ~small[:-1] & ~wanted[1:]
        if not more.any():
            break
        wanted[1:] |= more
    raw = t.tobytes()
    first = sorted(np.nonzero(small & wanted)[0].tolist(), key=lambda p: raw[p:p + depth])
    first = np.array(first, np.int64)
    heads = t[first]
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced = wanted & ~small
    if induced[-1]:
        waiting[t[-1]].append(np.array([n - 1]))
    out = []
    for c in np.unique(t):
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = []
        while len(level):
            bucket.append(level)
            before = level[level > 0] - 1
            level = before[(t[before] == c) & induced[before]]
        bucket.append(first[np.searchsorted(heads, c, "left"):np.searchsorted(heads, c, "right")])
        done = np.concatenate(bucket)
        out.append(done)
        before = done[done > 0] - 1
        before = before[(t[before] > c) & induced[before]]
        order = np.argsort(t[before], kind="stable")
        before = before[order]
        keys = t[before]
        for d in np.unique(keys):
            waiting[d].append(before[np.searchsorted(keys, d, "left"):np.searchsorted(keys, d, "right")])
    return np.concatenate(out)


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its starts begin ``length`` bytes that start elsewhere
    in ``contexts`` too: neighbours in the suffix array with a common prefix as long."""
    raw = b"\xff".join(contexts) + b"\xff"
    t = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    valid = np.zeros(len(t) + 1, np.int64)
    fits = sizes >= length
    np.add.at(valid, begin[fits], 1)
    np.add.at(valid, (begin + sizes - length + 1)[fits], -1)
    valid = np.cumsum(valid)[:-1] > 0
    order = suffix_array(t, length, valid)
    order = order[valid[order]].tolist()
    hit = np.zeros(len(t), bool)
    for a, b in zip(order, order[1:], strict=False):
        if raw[a:a + length] == raw[b:b + length]:
            hit[a] = hit[b] = True
    return [hit[s:s + max(0, k - length + 1)] for s, k in zip(begin, sizes, strict=True)]


def window_names(t: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts in documents laid end to end: (first start, starts, name). The name
    of a start is the least hash of a gram within its ``length`` bytes, so equal strings
    have equal names; consecutive starts whose first such gram is the same one make a
    run. Two starts of a run lie differently to that gram, so no run repeats itself."""
    width = length - GRAM + 1
    begin = np.concatenate([[0], ends[:-1]])
    n = len(t) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = t.astype(np.uint64) + np.uint64(1)
    p, k = np.uint64(0x9E3779B97F4A7C15), 1
    while k < GRAM:
        h = h[:-k] * p + h[k:]
        with np.errstate(over="ignore"):
            p = p * p
        k *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    least, k = h, 1
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if k < width:
        least = np.minimum(least[:len(h) - width + 1], least[width - k:])
    ok = np.zeros(len(t) + 1, np.int64)
    fits = ends - begin >= length
    np.add.at(ok, begin[fits], 1)
    np.add.at(ok, (ends - length + 1)[fits], -1)
    ok = np.cumsum(ok)[:n] > 0
    new = np.ones(n, bool)
    # the name changes, or its first gram drops out of the window and an equal one remains
    new[1:] = (least[1:] != least[:-1]) | (h[:n - 1] == least[:-1])
    new[begin[begin < n]] = True
    new[1:] |= ok[1:] != ok[:-1]
    start = np.nonzero(new)[0]
    size = np.diff(np.append(start, n))
    keep = ok[start]
    start, size = start[keep], size[keep]
    return start, size, least[start]


def _runs(docs: DataFrame) -> DataFrame:
    """k1, k2, name, ctx, at, n: the runs of every document, with a hash of the bytes
    they cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            lo = 0
            while lo < len(texts):
                held, size, hi = [], 0, lo
                while hi < len(texts) and size < _CHUNK:
                    held.append(texts[hi].as_py())
                    size += len(held[-1])
                    hi += 1
                raw = b"".join(held)
                ends = np.cumsum([len(x) for x in held])
                start, n, name = window_names(np.frombuffer(raw, np.uint8), ends)
                ctx = [xxhash.xxh3_64_intdigest(raw[s:s + k + LENGTH - 1]) for s, k in zip(start.tolist(), n.tolist(), strict=True)]
                row = np.searchsorted(ends, start, side="right")
                at = start - np.concatenate([[0], ends[:-1]])[row] if len(held) else start
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column("k1").take(take), b.column("k2").take(take), pa.array(name.view(np.int64)), pa.array(np.array(ctx, np.uint64).view(np.int64)),
                     pa.array(at, pa.int32()), pa.array(n, pa.int32())], ["k1", "k2", "name", "ctx", "at", "n"])
                lo = hi
    return docs.mapInArrow(run, "k1 long, k2 long, name long, ctx long, at int, n int")


def _sorted_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Name, ctx, first and last + 1 repeated start of the contexts of whole names."""
    names, keys, bodies, size = [], [], [], 0

    def solve() -> pd.DataFrame:
        rows = []
        for name, key, hit in zip(names, keys, repeated_starts(bodies), strict=True):
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            rows += [(name, key, int(a), int(b)) for a, b in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0], strict=True)]
        return pd.DataFrame(rows, columns=["name", "ctx", "lo", "hi"]).astype({"name": "int64", "ctx": "int64", "lo": "int32", "hi": "int32"})

    for b in batches:
        for name, key, body in zip(b["name"].tolist(), b["ctx"].tolist(), b["body"].tolist(), strict=True):
            if size >= BUFFER and name != names[-1]:
                yield solve()
                names, keys, bodies, size = [], [], [], 0
            names.append(name)
            keys.append(key)
            bodies.append(bytes(body))
            size += len(body)
    if names:
        yield solve()


def _hashed_starts(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """bucket, body: the strings of a batch of contexts, one packed row per bucket of
        their hash: two words of hash, name, ctx and place of each."""
        for b in batches:
            if not len(b):
                continue
            digest, size = xxhash.xxh3_128_digest, []
            parts = []
            for body in b["body"]:
                body = bytes(body)
                size.append(len(body) - LENGTH + 1)
                parts += [digest(body[p:p + LENGTH]) for p in range(size[-1])]
            d = np.frombuffer(b"".join(parts), "<i8").reshape(-1, 2)
            size = np.array(size)
            lo = np.arange(len(d)) - np.repeat(np.cumsum(size) - size, size)
            rows = np.stack([d[:, 0], d[:, 1], np.repeat(b["name"].to_numpy(np.int64), size), np.repeat(b["ctx"].to_numpy(np.int64), size), lo], axis=1)
            yield _packed(rows, (np.ascontiguousarray(d[:, 0]).view(np.uint64) % np.uint64(buckets)).astype(np.int64))
    return run


def _packed(rows: np.ndarray, bucket: np.ndarray) -> pd.DataFrame:
    """Rows of numbers as one binary row per bucket."""
    order = np.argsort(bucket, kind="stable")
    full, at = np.unique(bucket[order], return_index=True)
    return pd.DataFrame({"bucket": full, "body": [x.tobytes() for x in np.split(rows[order], at[1:])] if len(full) else []})


def _by_bucket(batches: Iterator[pd.DataFrame], width: int) -> Iterator[np.ndarray]:
    """The rows of each bucket of sorted packed rows."""
    held, now = [], None
    for b in batches:
        for bucket, body in zip(b["bucket"], b["body"], strict=True):
            if bucket != now and held:
                yield np.frombuffer(b"".join(held), "<i8").reshape(-1, width)
                held = []
            now = bucket
            held.append(bytes(body))
    if held:
        yield np.frombuffer(b"".join(held), "<i8").reshape(-1, width)


def _equal_strings(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Name, ctx and place of the strings of each bucket that occur twice, packed by context."""
        for rows in _by_bucket(batches, 5):
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
            twice = rows[np.append(same, False) | np.insert(same, 0, False)][:, 2:]
            yield _packed(twice, (np.ascontiguousarray(twice[:, 1]).view(np.uint64) % np.uint64(buckets)).astype(np.int64) if len(twice) else np.zeros(0, np.int64))
    return run


def _as_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Name, ctx, lo, hi of the runs of repeated starts of each context."""
    for rows in _by_bucket(batches, 3):
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1) | (rows[1:, 2] > rows[:-1, 2] + 1))
        first = np.nonzero(new)[0]
        last = np.append(first[1:], len(rows)) - 1
        yield pd.DataFrame({"name": rows[first, 0], "ctx": rows[first, 1], "lo": rows[first, 2].astype(np.int32), "hi": rows[last, 2].astype(np.int32) + 1})


def _join_split(rows: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame, place: list[Column]) -> DataFrame:
    """Inner join in which the rows of a hot key spread over ``PARTS`` parts by their
    place and the other side's row of that key is repeated for each part. ``hot`` holds
    keys with over a ``SHARE``-th of all rows, so ``SHARE`` rows at most: it is broadcast."""
    hot = F.broadcast(hot.select(*keys, F.lit(True).alias("hot")))
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(hot, keys, "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.hash(*place), F.lit(PARTS))).otherwise(0))
    return dealt.drop("hot").join(small.join(hot, keys, "left").withColumn("part", F.explode(parts)).drop("hot"), [*keys, "part"]).drop("part")


def repeats(docs: DataFrame) -> DataFrame:
    """k1, k2, starts: sorted array of (lo, hi), the starts of repeated strings, for the
    documents that have any. ``docs``: k1, k2, text (binary)."""
    runs = stage_table(_runs(docs), compression="zstd")
    named = stage_table(runs.groupBy("name").agg(F.count("*").alias("uses"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1")).filter("uses > 1"))
    many = F.col("uses") * SHARE > runs.count()
    place = [F.col(c) for c in ("k1", "k2", "at")]
    # written once: runs whose name occurs elsewhere
    again = stage_table(_join_split(runs, named.select("name", (F.col("c0") == F.col("c1")).alias("alike")), ["name"], named.filter(many), place),
                        compression="zstd")
    # all contexts of the name are copies of one: each start has a twin
    alike = again.filter("alike").select("k1", "k2", F.col("at").alias("lo"), (F.col("at") + F.col("n")).alias("hi"))
    kinds = again.filter("not alike").groupBy("name", "ctx").agg(
        F.count("*").alias("uses"), F.min(F.struct("k1", "k2", "at", "n")).alias("first"))
    kinds = stage_table(kinds)
    crowd = kinds.groupBy("name").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > TOGETHER).select("name", F.lit(True).alias("crowded"))
    due = kinds.join(crowd, "name", "left").groupBy("first.k1", "first.k2").agg(
        F.collect_list(F.struct("name", "ctx", "first.at", "first.n", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("due"))
    bodies = stage_table(docs.join(due.hint("shuffle_hash"), ["k1", "k2"]).select("text", F.explode("due").alias("d")).select(
        "d.name", "d.ctx", "d.crowded", F.expr(f"substring(text, d.at + 1, d.n + {LENGTH - 1})").alias("body")).dropDuplicates(["name", "ctx"]))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = "name long, ctx long, lo int, hi int"
    sorted_ = (bodies.filter("not crowded").select("name", "ctx", "body").repartition(n, "name").sortWithinPartitions("name")
               .mapInPandas(_sorted_groups, ranges))
    # names with more contexts than one task should hold: their strings meet by hash, in
    # buckets that are several to a task and solved one at a time
    strings = bodies.filter("crowded").select("name", "ctx", "body").mapInPandas(_hashed_starts(16 * n), "bucket long, body binary")
    equal = strings.repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(_equal_strings(16 * n), "bucket long, body binary")
    crowded = equal.repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(_as_ranges, ranges)
    copies = kinds.filter("uses > 1").select("name", "ctx", F.lit(0).alias("lo"), F.col("first.n").alias("hi"))
    found = sorted_.union(crowded).union(copies).groupBy("name", "ctx").agg(F.collect_set(F.struct("lo", "hi")).alias("r"))
    placed = _join_split(again.filter("not alike"), found, ["name", "ctx"], kinds.filter(many), place).select("k1", "k2", "at", F.explode("r").alias("r")).select(
        "k1", "k2", (F.col("at") + F.col("r.lo")).alias("lo"), (F.col("at") + F.col("r.hi")).alias("hi"))
    return alike.union(placed).groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("starts"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """k1, k2, doc_id, n_bytes, n_removed, n_spans, kept (bytes) of each row: every byte
    covered by a string of ``LENGTH`` bytes that also starts elsewhere is gone.

    Windows of that length are named by the least hash of their grams; a string's
    occurrences share the name, so only runs of windows with a name that occurs twice
    go on. Runs with equal bytes are folded to one context (a group of copies costs one
    row per run and task merge), and the contexts of a name are put into a suffix
    array, sorted in two stages, where repeats are neighbours; names with over
    ``TOGETHER`` different contexts compare hashes of their strings instead, which
    spreads over all tasks. Judged on the input: nothing is removed in between. Null
    text counts as empty; rows equal in doc_id and text are separate documents and so
    repeats of each other. Very long texts are windowed like all others; only doc_id and
    text are read; an empty table gives no rows.
    """
    t = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).select(
        *row_key(), "doc_id", F.encode(whole(), "utf-8").alias("text"))
    found = stage_table(repeats(t.select("k1", "k2", "text")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, spans, kept = [], [], []
            starts = b.column("starts").to_pylist()
            for x, ranges in zip(b.column("text"), starts, strict=True):
                raw = x.as_py()
                if not ranges:
                    removed.append(0)
                    spans.append(0)
                    kept.append(raw)
                    continue
                pieces, at, runs, gone = [], 0, 0, 0
                lo, hi = ranges[0]["lo"], ranges[0]["hi"] + LENGTH - 1
                for r in [*ranges[1:], None]:
                    if r is not None and r["lo"] <= hi:
                        hi = max(hi, r["hi"] + LENGTH - 1)
                        continue
                    pieces.append(raw[at:lo])
                    at, runs, gone = hi, runs + 1, gone + hi - lo
                    if r is not None:
                        lo, hi = r["lo"], r["hi"] + LENGTH - 1
                pieces.append(raw[at:])
                removed.append(gone)
                spans.append(runs)
                kept.append(b"".join(pieces))
            yield pa.RecordBatch.from_arrays(
                [b.column("k1"), b.column("k2"), b.column("doc_id"), pa.array([len(k) + g for k, g in zip(kept, removed, strict=True)], pa.int64()),
                 pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                ["k1", "k2", "doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = t.join(found.hint("shuffle_hash"), ["k1", "k2"], "left").select("k1", "k2", "doc_id", "text", "starts")
    return joined.mapInArrow(cut, "k1 long, k2 long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
