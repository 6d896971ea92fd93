"""Periodic runs of words by maximal-pair enumeration."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole

#: Shortest run in words, least number of periods in it, and words that a task holds at once.
SHORTEST, PERIODS = 6, 4
CHUNK_WORDS = 1 << 19
#: Any two starts of a run's pair agree on this many words: length - period >= 5, whatever the period.
GRAM = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document with the periodic stretch that its number calls for."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a:a + p]
    return words[:a] + (stretch * ((n - a) // len(stretch) + 1))[:n - a]


def _suffixes(w: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that share their first ``GRAM`` words with another of the same
    document: their positions in suffix order, and the words that each shares with
    the one before it. Suffixes without such a partner head no node of the tree below."""
    n = len(w)
    if n < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = n - GRAM + 1
    h = doc[:m].astype(np.uint64)
    for k in range(GRAM):
        h = (h ^ (h >> np.uint64(29))) * _MIX + w[k:k + m].astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * _MIX
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice &= doc[:m] == doc[GRAM - 1:]
    due = np.nonzero(twice)[0]
    if not len(due):
        return due, due
    # exact ranks by the first words, then by twice as many each round. What follows a
    # shared stretch starts GRAM words after a due suffix; it may have no partner itself.
    end = np.searchsorted(doc, doc, side="right")
    after = due + GRAM
    base = np.unique(np.concatenate([due, after[after < end[due]]]))
    columns = [np.where(base + k < end[base], w[np.minimum(base + k, n - 1)], -1) for k in range(GRAM - 1, -1, -1)] + [doc[base]]
    order = np.lexsort(columns)
    new = np.zeros(len(base), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    rank = np.empty(len(base), np.int64)
    rank[order] = np.cumsum(new)
    place = np.full(n + 1, -1, np.int64)
    place[base] = np.arange(len(base))
    levels, span = [rank], GRAM
    while rank.max() < len(rank) - 1:
        ahead = base + span
        at = np.where(ahead < end[base], place[np.minimum(ahead, n)], -1)
        second = np.where(at >= 0, rank[at], -1)  # the end comes first
        order = np.lexsort([second, rank])
        new = np.zeros(len(base), bool)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        rank = np.empty(len(base), np.int64)
        rank[order] = np.cumsum(new)
        levels.append(rank)
        span *= 2
    order = np.argsort(rank[place[due]])
    a, b = due[order][:-1].copy(), due[order][1:].copy()
    lcp = np.zeros(len(a), np.int64)
    for level, ranks in zip(range(len(levels) - 1, -1, -1), reversed(levels), strict=True):
        x, y = place[np.minimum(a, n)], place[np.minimum(b, n)]
        equal = (x >= 0) & (y >= 0) & (ranks[x] == ranks[y])
        step = np.where(equal, GRAM << level, 0)
        a, b, lcp = a + step, b + step, lcp + step
    live = lcp > 0
    for _ in range(GRAM - 1):
        live &= (a < n) & (b < n)
        live[live] = (w[a[live]] == w[b[live]]) & (doc[a[live]] == doc[b[live]])
        a, b, lcp = a + live, b + live, lcp + live
    return due[order], np.concatenate([[0], lcp])


def _stretches(lcp: np.ndarray, suffix: np.ndarray, periods: int) -> Iterator[tuple[int, int]]:
    """Ranges of the suffix order below one node of ``GRAM`` words or more, where some
    two starts are near enough for a run."""
    cut = np.nonzero(lcp < GRAM)[0]
    ends = np.append(cut[1:], len(lcp))
    inner = lcp.copy()
    inner[cut] = 0
    group = np.repeat(np.arange(len(cut)), ends - cut)
    order = np.lexsort([suffix, group])
    gap = np.diff(suffix[order], prepend=-(1 << 60))
    gap[cut] = 1 << 60  # sorted by group, so each group's first stands where it begins
    nearest = np.minimum.reduceat(gap, cut)
    deepest = np.maximum.reduceat(inner, cut)
    for i in np.nonzero(((periods - 1) * nearest <= deepest) & (ends - cut > 1))[0]:
        yield int(cut[i]), int(ends[i])


def _merged(large: list[int], small: list[int], left: dict[int, int], shared: int, shortest: int, periods: int,
            found: dict[tuple[int, int], int]) -> list[int]:
    """One node's occurrences from two children's, which are sorted. Pairs are taken
    across the children (so their common words end at ``shared``), between different
    left-word classes, at a distance that the shared words span ``periods - 1`` times."""
    if len(small) > len(large):
        large, small = small, large
    reach = shared // (periods - 1)
    for x in small:
        k = bisect_left(large, x)
        for y in large[max(0, k - 1):k + 1]:
            i, j = (x, y) if x < y else (y, x)
            q = j - i
            if q <= reach and shared + q >= shortest and left[i] != left[j]:
                end = j + shared
                if q < found.get((i, end), 1 << 60):
                    found[i, end] = q
    if 8 * len(small) > len(large):
        large += small
        large.sort()  # two sorted stretches: one merge
    else:
        for x in small:
            insort(large, x)
    return large


def periodic_runs(w: np.ndarray, doc: np.ndarray, shortest: int = SHORTEST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run in the numbered words ``w``, whose documents
    ``doc`` ascend; runs never cross documents.

    A run of period q and length L is a pair of starts q apart that share L - q words,
    differ in the word before them and in the word after: a maximal pair. They are read
    off the tree of LCP intervals from the bottom. A node holds its occurrences in text
    order, each with the word to its left as its class; pairs meet only across classes
    and children. A start between the two of a pair would share these words at a smaller
    distance, and by the periodicity lemma the pair's distance would be no smallest
    period; so neighbours in text order are enough, and merging the smaller list into
    the larger looks at O(n log n) of them. A stretch found at a multiple of its period
    is also found at the period, which wins.
    """
    if shortest - shortest // periods < GRAM:
        raise ValueError(f"pairs of a run must share at least {GRAM} words")
    suffix, lcp = _suffixes(w, doc)
    found: dict[tuple[int, int], int] = {}
    if not len(suffix):
        return []
    # the word to the left; the first of a document is a class of its own
    first = np.ones(len(w), bool)
    first[1:] = doc[1:] != doc[:-1]
    left = np.where(first, -1 - np.arange(len(w)), np.concatenate([[0], w[:-1]]))
    for lo, hi in _stretches(lcp, suffix, periods):
        starts, shares = suffix[lo:hi].tolist(), lcp[lo:hi].tolist()
        own = dict(zip(starts, left[suffix[lo:hi]].tolist(), strict=True))
        stack: list[tuple[int, list[int]]] = []
        hold = [starts[0]]
        for k in range(1, len(starts)):
            depth = shares[k]
            while stack and stack[-1][0] > depth:
                d, before = stack.pop()
                hold = _merged(before, hold, own, d, shortest, periods, found)
            if stack and stack[-1][0] == depth:
                d, before = stack.pop()
                hold = _merged(before, hold, own, d, shortest, periods, found)
            stack.append((depth, hold))
            hold = [starts[k]]
        while stack:
            d, before = stack.pop()
            hold = _merged(before, hold, own, d, shortest, periods, found)
    return sorted((i, end, q) for (i, end), q in found.items())


def _described(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """Result row of a document: ``runs`` as (start, end, period), by start then period."""
    listed = sorted((i, q, end - i) for i, end, q in runs)
    text = b" ".join(words) if not runs else None
    if runs:
        gone = np.zeros(len(words), bool)
        for i, end, q in runs:
            gone[i + q:end] = True
        text = b" ".join([words[k] for k in np.nonzero(~gone)[0].tolist()])
    best = max(listed, key=lambda r: (r[2], -r[0], -r[1]), default=None)
    start, period, length = best or (None, None, None)
    return (len(listed), start, length, period, None if best is None else 1000 * length // period,
            [{"start": i, "length": size, "period": q} for i, q, size in listed], text)


_COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>"


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rewrite: bool = False,
              shortest: int = SHORTEST, periods: int = PERIODS) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs, collapsed for each row.

    A run is a stretch of words with smallest period q, of ``shortest`` words and
    ``periods`` periods or more, that no neighbouring word extends. start to
    exponent_milli describe the longest (ties: least start, then period; null without a
    run), ``collapsed`` is the text without the words of any run after its first period.
    ``rewrite`` plants the stretches of ``planted`` first. Null, empty and blank texts
    have no words and no runs; repeated rows repeat, a null doc_id is kept and gets no
    planted stretch; other columns are not carried, so names cannot clash; an empty
    table gives an empty result. A task holds ``CHUNK_WORDS`` words, or one document if
    that is longer, and never a second pass of the table: nothing is shuffled.
    """
    t = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))

    def solve(rows: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        number = _Numbers()
        w = np.array([number[x] for _, words in rows for x in words], np.int64)
        sizes = np.array([len(words) for _, words in rows], np.int64)
        at = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(rows)), sizes)
        of: dict[int, list[tuple[int, int, int]]] = {}
        for i, end, q in periodic_runs(w, doc, shortest, periods):
            d = int(doc[i])
            of.setdefault(d, []).append((i - int(at[d]), end - int(at[d]), q))
        out = [_described(words, of.get(d, [])) for d, (_, words) in enumerate(rows)]
        longs = [pa.array([r[k] for r in out], pa.int64()) for k in range(5)]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in rows], pa.int64()), *longs, pa.array([r[5] for r in out], kind), pa.array([r[6] for r in out], pa.binary())],
            ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for k, body in zip(b.column("doc_id"), b.column("text"), strict=True):
                key = k.as_py()
                words = body.as_py().encode("utf-8", "surrogatepass").split()
                if rewrite:
                    words = planted(words, key)
                rows.append((key, words))
                held += len(words)
                if held >= CHUNK_WORDS:
                    yield solve(rows)
                    rows, held = [], 0
        if rows:
            yield solve(rows)

    return t.mapInArrow(run, f"doc_id long, {_COLUMNS}, collapsed binary")
