"""Phrase collocations by multikey three-way quicksort of suffix pointers."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import top_per_key
from ..session import stage_table
from .common import whole

#: Words of the longest phrase, least occurrences of a candidate, and suffix pointers that
#: a task sorts at once before it sends them.
DEPTH, LEAST, TOP = 3, 10, 2000
SEGMENT = 2_000_000
_BITS = 21  # local word numbers of a segment fit: 3 of them in one long
_BREAK = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(10 if c in _BREAK else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_P = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def equal_partitions(keys: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """One pointer and the summed weight of every group of rows of ``keys`` (pointers,
    depth) that are equal in all columns and weigh ``least`` or more.

    Multikey three-way quicksort, all partitions of a round at once: each takes the word
    of its middle pointer at its own depth as pivot and falls into smaller, equal and
    larger; an equal partition moves one word deeper, at full depth its weight is the
    count. Partitions that weigh less than ``least`` are abandoned whatever their depth,
    as no group inside can weigh more.
    """
    m, full = keys.shape
    idx = np.arange(m)
    start = np.zeros(1 if m else 0, np.int64)
    depth = np.zeros(len(start), np.int64)
    found, sizes = [], []
    while len(start):
        size = np.diff(np.append(start, len(idx)))
        weight = np.add.reduceat(weights[idx], start)
        done = (depth == full) & (weight >= least)
        found.append(idx[start[done]])
        sizes.append(weight[done])
        live = (weight >= least) & (depth < full)
        if not live.all():
            idx = idx[np.repeat(live, size)]
            size, depth = size[live], depth[live]
            start = np.cumsum(size) - size
            if not len(start):
                break
        part = np.repeat(np.arange(len(start)), size)
        at = depth[part]
        word = keys[idx, at]
        pivot = word[start + size // 2][part]
        side = (word >= pivot).astype(np.int64) + (word > pivot)
        # stable three-way split of every partition: a running count per side
        place = np.empty(len(idx), np.int64)
        count = np.empty((len(start), 3), np.int64)
        before = start[part].copy()
        for s in range(3):
            mine = side == s
            run = np.cumsum(mine)
            base = run[start] - mine[start]
            count[:, s] = np.append(base[1:], run[-1]) - base
            place[mine] = (before + run - 1 - base[part])[mine]
            before += count[part, s]
        moved = np.empty_like(idx)
        moved[place] = idx
        idx = moved
        full_count = count.reshape(-1)
        deeper = np.stack([depth, depth + 1, depth], axis=1).reshape(-1)
        some = full_count > 0
        start = (np.cumsum(full_count) - full_count)[some]
        depth = deeper[some]
    return np.concatenate(found or [idx[:0]]), np.concatenate(sizes or [weights[:0]])


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Unsigned 32-bit numbers as byte planes."""
    return b"".join(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays)


def _unpack(raw: bytes, n: int, columns: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(columns, 4, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(columns, n)


def _shipped(seq: np.ndarray, own: int, words: list[bytes], buckets: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(bucket, depth, pointers, body) of a segment's pointers: positions below ``own`` in
    ``seq`` (word numbers, 0 between pieces). Pointers equal in all words of a depth are
    one row with a weight; the bucket is the hash of exactly these leading words."""
    hashes = np.fromiter((zlib.crc32(x) for x in words), np.uint64, len(words))
    packer = zstandard.ZstdCompressor(level=3)
    key, ok = np.zeros(own, np.int64), np.ones(own, bool)
    for d in range(1, DEPTH + 1):
        ahead = np.zeros(own, np.int64)
        part = seq[d - 1:d - 1 + own]
        ahead[:len(part)] = part
        ok &= ahead > 0
        key = key << _BITS | ahead
        distinct, weight = np.unique(key[ok], return_counts=True)
        columns = [distinct >> (_BITS * (d - 1 - k)) & ((1 << _BITS) - 1) for k in range(d)]
        mixed = np.zeros(len(distinct), np.uint64)
        for k, c in enumerate(columns):
            mixed = (mixed ^ (mixed >> np.uint64(31))) * _P[0] + hashes[c] * _P[1 + k % 2]
        bucket = ((mixed ^ (mixed >> np.uint64(29))) * _P[2] >> np.uint64(33)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.nonzero(np.diff(cuts))[0].tolist():
            rows = order[cuts[b]:cuts[b + 1]]
            cols = [c[rows] for c in columns]
            used, local = np.unique(np.concatenate(cols), return_inverse=True)
            names = b" ".join(words[i] for i in used.tolist())
            body = len(names).to_bytes(4, "little") + names + _pack([*local.reshape(d, -1), weight[rows]])
            yield b, d, len(rows), packer.compress(body)


def _lang(b: pa.RecordBatch) -> Iterator[tuple[str, str]]:
    yield from zip(b.column("lang").to_pylist(), (x.as_py() for x in b.column("text")), strict=True)


def _pointers(t: DataFrame, buckets: int) -> DataFrame:
    """lang, bucket, depth, n, body of all suffix pointers of ``t`` (lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, _Numbers] = {}
        held: dict[str, list[np.ndarray]] = {}
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, arrays in held.items():
                seq = np.concatenate(arrays)
                names = np.array(list(number[lang]), object)
                for at in range(0, len(seq), SEGMENT):
                    used, local = np.unique(seq[at:at + SEGMENT + DEPTH - 1], return_inverse=True)
                    if used[0] != 0:  # zero stays the mark between pieces
                        used, local = np.concatenate([[0], used]), local + 1
                    rows = list(_shipped(local, min(SEGMENT, len(seq) - at), names[used].tolist(), buckets))
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], pa.int32()) for k in range(3)),
                             pa.array([r[3] for r in rows], pa.binary())], ["lang", "bucket", "depth", "n", "body"])
            number.clear()
            held.clear()

        for b in batches:
            for lang, text in _lang(b):
                if lang not in number:
                    number[lang] = _Numbers({b"\n": 0})
                    held[lang] = []
                tokens = (text.encode("utf-8", "surrogatepass").translate(_TABLE).replace(b"\n", b" \n ") + b" \n").split(b" ")
                held[lang].append(np.fromiter(map(number[lang].__getitem__, filter(None, tokens)), np.int32))
                total += len(held[lang][-1])
                if total >= SEGMENT:
                    yield from flush()
                    total = 0
        yield from flush()

    return t.mapInArrow(run, "lang string, bucket int, depth int, n int, body binary")


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """lang, depth, w (array of words), f: every phrase of 1 to ``DEPTH`` words with
    ``least`` occurrences or more, counted within pieces; depth 0 has the number of all
    word occurrences of the language.

    A pointer goes to the bucket of its first words, for each depth by all the words of
    that depth: a leading pair that is everywhere is one row a segment at depth 2, and at
    depth 3 its continuations spread over all buckets. A task sorts one bucket at a time.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), whole(text).alias("text"))

    def close(held: dict[tuple[str, int], list[tuple[int, bytes]]]) -> Iterator[pa.RecordBatch]:
        for (lang, d), rows in held.items():
            number, parts = _Numbers(), []
            for m, body in rows:
                raw = zstandard.decompress(body)
                size = int.from_bytes(raw[:4], "little")
                own = np.fromiter(map(number.__getitem__, raw[4:4 + size].split(b" ")), np.int32)
                cols = _unpack(raw[4 + size:], m, d + 1)
                parts.append((own[cols[:d].T], cols[d].astype(np.int64)))
            keys, weight = np.concatenate([k for k, _ in parts]), np.concatenate([x for _, x in parts])
            at, f = equal_partitions(keys, weight, least)
            names = np.array(list(number), object)
            phrases = [[names[i].decode("utf-8", "surrogatepass") for i in row] for row in keys[at].tolist()]
            depths, counts = [d] * len(at), f.tolist()
            if d == 1:
                phrases, depths, counts = [*phrases, []], [*depths, 0], [*counts, int(weight.sum())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(depths), pa.string()), pa.array(depths, pa.int32()), pa.array(phrases, pa.list_(pa.string())), pa.array(counts, pa.int64())],
                ["lang", "depth", "w", "f"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for b in batches:
            for i in range(b.num_rows):
                lang, bucket, d, m, body = (b.column(j)[i].as_py() for j in range(5))
                if bucket != now:
                    yield from close(held)
                    now, held = bucket, {}
                held.setdefault((lang, d), []).append((m, body))
        yield from close(held)

    sent = _pointers(t, 2 * n).repartition(n, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(sort, "lang string, depth int, w array<string>, f long")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (l r)), exact: up to 38 digits."""
    wide = [x.cast("decimal(19,0)") for x in (a, left, right)]
    return F.call_function("div", wide[0] * wide[0] * F.lit(1_000_000).cast("decimal(7,0)"), wide[1] * wide[2])


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the strongest phrases of two and three words
    of each language, all with ``top=None`` (then without rank).

    Of the cuts of a phrase the weakest counts, ties to the first. A phrase inside a
    longer candidate that has half its occurrences or more is left out. Texts are whole;
    null text has no words, a null language is ``und``; repeated rows count again; words
    are bytes, ties in score and count go by the phrase's bytes; only text and language
    are read, so other columns cannot clash; an empty table gives an empty result.
    """
    counts = stage_table(phrase_counts(docs, text, lang, least))
    total = counts.filter("depth = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    known = counts.filter("depth > 0").select("lang", F.array_join("w", " ").alias("p"), "f")
    longer = counts.filter("depth > 1").select("lang", "depth", "w", F.col("f").alias("a"))

    def words(a: int, b: Column | int) -> Column:
        return F.array_join(F.slice("w", a, b), " ")

    cuts = longer.select("*", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k"))
    cuts = cuts.withColumns({"head": words(1, F.col("k")), "tail": F.array_join(F.slice("w", F.col("k") + 1, F.col("depth") - F.col("k")), " ")})
    cut = (cuts.join(known.select("lang", F.col("p").alias("head"), F.col("f").alias("l")), ["lang", "head"])
           .join(known.select("lang", F.col("p").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]))
    scored = cut.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r"))).groupBy("lang", "w", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inner = longer.filter("depth = 3").select("lang", "a", F.explode(F.array(words(1, 2), words(2, 2))).alias("phrase"))
    best = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.select("lang", F.array_join("w", " ").alias("phrase"), "a", "c.l", "c.r", "c.score").join(
        best, ["lang", "phrase"], "left").filter("longer is null or 2 * longer < a")
    ranked = top_per_key(kept.join(total, "lang"), ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], top)
    ranks = [] if top is None else [F.col("rank").cast("long").alias("rank")]
    return ranked.select("lang", *ranks, "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
