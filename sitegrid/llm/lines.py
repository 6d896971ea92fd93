"""Fuzzy line deduplication by MinHash."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, stage_table
from .common import link_families, row_key, whole

#: Characters of a shingle, least Jaccard similarity, bands and bins per band: a pair at
#: the threshold shares a band with probability 1 - (1 - 0.8^4)^10 = 0.995, one at 0.85 with 0.9994.
SHINGLE, LEAST, BANDS, ROWS = 8, 0.8, 10, 4
_BINS = BANDS * ROWS
_CHUNK = 1 << 19
#: Rows of numbers that a task packs together; parts of a shuffle partition that are held one at a time.
_PACK, _PARTS = 1 << 18, 16
_EMPTY = np.uint64(1 << 32)
#: Where empty bins look for a full one: random bins, so that the bins of a band borrow
#: independently (neighbours would all take one value); at last every bin in turn.
_BORROW = [*np.random.default_rng(5).integers(0, _BINS, (64, _BINS)), *((np.arange(_BINS) + d) % _BINS for d in range(1, _BINS))]
_P = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _rolled(c: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of ``SHINGLE`` code points."""
    h = c.astype(np.uint64) + np.uint64(1)
    for k in (1, 2, 4):
        h = h[:-k] * np.uint64(pow(_P, k, 1 << 64)) + h[k:]
    return h


def signatures(text: str) -> tuple[np.ndarray, np.ndarray]:
    """One-permutation MinHash of every line of ``text``: least hash of the shingles of
    each bin (lines, bins), and which lines have a shingle. Long texts are read in
    chunks; empty bins borrow from full ones."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n_lines = int((c == 10).sum()) + 1
    out = np.full(n_lines * _BINS, _EMPTY, np.uint64)
    line = 0
    for at in range(0, len(c), _CHUNK):
        seg = c[at:at + _CHUNK + SHINGLE - 1]
        lid = line + np.cumsum(seg == 10)
        h = _rolled(seg)
        m = len(h)
        ok = (lid[:m] == lid[SHINGLE - 1:]) & (seg[:m] != 10) if m > 0 else np.zeros(0, bool)
        h = _mix(h[ok])
        where = lid[:m][ok] * _BINS + ((h >> np.uint64(32)) * np.uint64(_BINS) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out, where, h & np.uint64(0xFFFFFFFF))
        line += int((seg[:_CHUNK] == 10).sum())
    out = out.reshape(n_lines, _BINS)
    full = out != _EMPTY
    some = full.any(axis=1)
    todo = np.nonzero(some & ~full.all(axis=1))[0]
    part, known = out[todo], full[todo]
    filled, done = part.copy(), known.copy()
    for d, other in enumerate(_BORROW, 1):
        if done.all():
            break
        take = known[:, other] & ~done
        filled[take] = part[:, other][take] + np.uint64(d) * np.uint64(0x1000003D)
        done |= take
    out[todo] = filled
    return out, some


def _bands(minima: np.ndarray) -> np.ndarray:
    v = minima.reshape(len(minima), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(minima), BANDS)).copy()
    for r in range(ROWS):
        h = _mix((h + v[:, :, r]) * np.uint64(_P))
    return h.view(np.int64)


def _shingles(s: str) -> np.ndarray:
    """Sorted 64-bit hashes of the shingles of ``s``, which has one at least."""
    return np.unique(_mix(_rolled(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4"))))


@lru_cache(maxsize=1024)
def _recent(s: str) -> np.ndarray:
    """Pairs arrive sorted by one side, and the others of a family come again."""
    return _shingles(s)


def jaccard(a: str, b: str) -> float:
    """Exact similarity of two lines by the hashes of their shingles, or equality for short lines."""
    if min(len(a), len(b)) < SHINGLE:
        return float(a == b)
    x, y = (_recent(s) if len(s) < 4096 else _shingles(s) for s in (a, b))
    h = np.sort(np.concatenate([x, y]))
    both = int((h[1:] == h[:-1]).sum())
    return both / (len(x) + len(y) - both)


def _packed(rows: np.ndarray, key: int, parts: int) -> pa.RecordBatch:
    """part, body: rows of numbers as one binary value for each part of the column ``key``."""
    part = (np.ascontiguousarray(rows[:, key]).view(np.uint64) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    full, at = np.unique(part[order], return_index=True)
    body = [x.tobytes() for x in np.split(rows[order], at[1:])] if len(full) else []
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(body, pa.binary())], ["part", "body"])


def _flushed(blocks: Iterator[np.ndarray], key: int, parts: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for rows in blocks:
        held.append(rows)
        size += len(rows)
        if size >= _PACK:
            yield _packed(np.concatenate(held), key, parts)
            held, size = [], 0
    if size:
        yield _packed(np.concatenate(held), key, parts)


def _by_part(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """The rows of each part of sorted packed rows."""
    held, now = [], None
    for b in batches:
        for part, body in zip(b.column("part").to_pylist(), b.column("body"), strict=True):
            if part != now and held:
                yield np.frombuffer(b"".join(held), "<i8").reshape(-1, width)
                held = []
            now = part
            held.append(body.as_py())
    if held:
        yield np.frombuffer(b"".join(held), "<i8").reshape(-1, width)


def _firsts(column: np.ndarray) -> np.ndarray:
    """Which rows of a sorted column begin a new value."""
    return np.append(True, column[1:] != column[:-1])


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * _PARTS


def _dealt(packed: DataFrame) -> DataFrame:
    return packed.repartition(_parts(packed) // _PARTS, "part").sortWithinPartitions("part")


def _banded(docs: DataFrame, parts: int) -> DataFrame:
    """bucket, node for the lines of ``docs`` (lowered), packed: each task sends a line once."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        sent: set[int] = set()
        for b in batches:
            texts, held, size = [], [], 0
            column = b.column("lowered")
            for i in range(len(column)):
                held.append(column[i].as_py())
                size += len(held[-1])
                if size >= _CHUNK or i == len(column) - 1:
                    texts.append("\n".join(held))
                    held, size = [], 0
            for t in texts:
                lines = t.split("\n")
                name = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in lines], np.uint64).view(np.int64)
                minima, some = signatures(t)
                _, first = np.unique(name, return_index=True)
                first = first[some[first]]
                first = first[[x not in sent for x in name[first].tolist()]] if len(first) else first
                if len(sent) < 1 << 20:  # beyond, lines may be sent again
                    sent.update(name[first].tolist())
                yield np.stack([_bands(minima[first]).reshape(-1), np.repeat(name[first], BANDS)], axis=1)
    return docs.mapInArrow(lambda batches: _flushed(blocks(batches), 0, parts), "part long, body binary")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, node, centre of the buckets that different lines share; the centre is the least."""
    for rows in _by_part(batches, 2):
        rows = rows[np.argsort(rows[:, 0])]
        same = rows[1:, 0] == rows[:-1, 0]
        rows = rows[np.append(same, False) | np.append(False, same)]
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        if len(rows):
            rows = rows[_firsts(rows[:, 0]) | _firsts(rows[:, 1])]  # a line that several tasks sent
            at = np.nonzero(_firsts(rows[:, 0]))[0]
            size = np.diff(np.append(at, len(rows)))
            centre, several = np.repeat(rows[at, 1], size), np.repeat(size > 1, size)
            yield pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (rows[:, 0], rows[:, 1], centre)], ["bucket", "node", "centre"])


def _rarest_first(texts: DataFrame, least: float) -> DataFrame:
    """bucket, node, n, p, before: for each line its rarest shingles that others hold too,
    as many as a line at the threshold must share one of; with the line's number of
    shingles, the place of this one in order of rarity and the ones before it. Packed
    rows are counted by shingle, then ordered by line."""
    def listed(parts: int):
        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for b in batches:
                for node, s in zip(b.column("node").to_pylist(), b.column("s").to_pylist(), strict=True):
                    h = _shingles(s).view(np.int64)
                    yield np.stack([h, np.full(len(h), node), np.full(len(h), len(h))], axis=1)
        return lambda batches: _flushed(blocks(batches), 0, parts)

    def counted(parts: int):
        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for rows in _by_part(batches, 3):
                rows = rows[np.argsort(rows[:, 0])]
                at = np.nonzero(_firsts(rows[:, 0]))[0]
                size = np.diff(np.append(at, len(rows)))
                df = np.repeat(size, size)
                yield np.column_stack([rows, df])[df > 1]
        return lambda batches: _flushed(blocks(batches), 1, parts)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(batches, 4):
            rows = rows[np.lexsort((rows[:, 0], rows[:, 3], rows[:, 1]))]
            at = np.nonzero(_firsts(rows[:, 1]))[0]
            size = np.diff(np.append(at, len(rows)))
            n = rows[at, 2]
            own = n - size  # held by no other line: first in order, met by none
            keep = n - np.ceil(n * least - 1e-9).astype(np.int64) + 1
            take = np.clip(keep - own, 0, size)
            q = np.arange(len(rows)) - np.repeat(at, size)
            pick = np.nonzero(q < np.repeat(take, size))[0]
            q, ends = q[pick], np.concatenate([[0], np.cumsum(q[pick])])
            inner = np.arange(ends[-1]) - np.repeat(ends[:-1], q) + np.repeat(pick - q, q)
            before = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(rows[inner, 0])))
            p = np.repeat(own, size)[pick] + q
            yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(x)) for x in (rows[pick, 0], rows[pick, 1], rows[pick, 2], p)], before],
                                             ["bucket", "node", "n", "p", "before"])

    parts = _parts(texts)
    packed = "part long, body binary"
    held = _dealt(texts.select("node", "s").mapInArrow(listed(parts), packed)).mapInArrow(counted(parts), packed)
    return _dealt(held).mapInArrow(ordered, "bucket long, node long, n long, p long, before array<long>")


def dedupe_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """k1, k2, doc_id, line (from 0), node, root, kept for each line with a word.

    Lines are compared in lower case, by shingles of ``SHINGLE`` characters; shorter
    lines only meet equal ones. Equal lines are folded to one node (a 64-bit hash of
    the line) before anything is compared, and a task sends a line's bands once. The
    texts of lines that share a band with another are fetched by key and verified by
    exact Jaccard similarity; a family is linked through a centre, so its pairs are
    not all visited, and lines that share a crowded band without being alike are parted
    by their rarest shingles. ``kept`` is true for the first line, by doc_id and place, of
    each component. Null text has no lines and blank lines are no members; documents
    that repeat in doc_id and text share their verdict. Long texts are hashed in chunks;
    only doc_id and text are read; an empty table gives no rows.
    """
    t = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keyed = t.select(*row_key(), "doc_id", F.lower(whole()).alias("lowered"))
    lines = stage_table(keyed.select("k1", "k2", "doc_id", F.posexplode(F.split("lowered", "\n")).alias("line", "s"))
                        .filter(F.col("s").rlike(r"[^\x20\x09-\x0D]")).select("k1", "k2", "doc_id", "line", F.xxhash64("s").alias("node")))
    sent = _banded(keyed.select("lowered"), _parts(docs))
    members = stage_table(_dealt(sent).mapInArrow(_met, "bucket long, node long, centre long"))
    suspects = members.select("node").distinct()
    firsts = lines.join(suspects, "node", "left_semi").groupBy("node").agg(F.min(F.struct("k1", "k2", "line")).alias("at"))
    wanted = firsts.groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("at.line", "node")).alias("lines"))
    # one row per document that holds a suspect; texts stream past a hash table of each partition
    texts = stage_table(keyed.select("k1", "k2", "lowered").join(wanted.hint("shuffle_hash"), ["k1", "k2"])
                        .select(F.split("lowered", "\n").alias("s"), F.explode("lines").alias("w"))
                        .select("w.node", F.get("s", F.col("w.line")).alias("s")).dropDuplicates(["node"]), compression="zstd")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [jaccard(x, y) >= least - 1e-12 for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
        return both.select("a", "b", "ta", "tb").mapInArrow(near, "a long, b long")

    def refine(nodes: DataFrame) -> tuple[DataFrame, Column]:
        """Buckets of the lines left in crowded bands, by exact prefix filtering: of two
        lines at the threshold, one of the rarest shingles of each, more than 1 - least of
        them, is common to both. A passage that many lines share is not among these."""
        narrow = stage_table(_rarest_first(texts.join(nodes, "node"), least))
        x, y = F.col("x.n"), F.col("y.n")
        # a pair meets at its first common shingle only, from which on enough can follow
        room = F.least(x - F.col("x.p"), y - F.col("y.p")) >= F.lit(least / (1 + least)) * (x + y) - F.lit(1e-9)
        alike = (F.least(x, y) >= F.greatest(x, y) * F.lit(least) - F.lit(1e-9)) & room & ~F.arrays_overlap("x.before", "y.before")
        return narrow, alike

    roots = link_families(members, verify, refine)
    first = lines.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct("k1", "line", "k2")).alias("at"))
    # a line met once and linked with none is its own class and kept
    named = first.join(roots, "node", "left").filter("root is not null or n > 1").withColumn("root", F.coalesce("root", "node"))
    keep = named.groupBy("root").agg(F.min("at").alias("keep"), F.sum("n").alias("total")).filter("total > 1")
    verdict = cut_lineage(named.join(keep, "root").select("node", "root", "keep"))
    is_first = (F.col("keep.k1") == F.col("k1")) & (F.col("keep.line") == F.col("line")) & (F.col("keep.k2") == F.col("k2"))
    return lines.join(verdict, "node", "left").select(
        "k1", "k2", "doc_id", "line", "node", F.coalesce("root", "node").alias("root"), (F.col("keep").isNull() | is_first).alias("kept"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every line but the kept one of each component taken out of its text;
    all columns stay. A document that loses all its lines keeps an empty text."""
    gone = dedupe_lines(docs, doc_id, text).filter(~F.col("kept")).groupBy("k1", "k2").agg(F.collect_set("line").alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select("row", *row_key())
    joined = rows.join(stage_table(gone).hint("shuffle_hash"), ["k1", "k2"], "left")
    whole_text = F.col("row").getField(text)
    rest = F.array_join(F.filter(F.split(whole_text, "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return joined.withColumn("row", F.col("row").withField(text, F.when(F.col("gone").isNull(), whole_text).otherwise(rest))).select("row.*")
