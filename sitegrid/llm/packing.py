"""Packing token sequences by linear grouping and best fit."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from ..session import stage_table
from .common import row_key, whole

CAPACITY = 2048
GROUPS = 64
#: Lengths above this share of the capacity are grouped; the others are fitted last.
LARGE = 1 / 8
CACHE = 600_000

# ---- tokens -----------------------------------------------------------------

#: Texts that meet this go through the tokenizer whole: its normaliser may change them,
#: its white space differs from Python's, or they may hold the name of a special token.
_RARE = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-įı-˿‐-‧€]|<\\|")


class WordTokens:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer lower-cases, drops white space and never merges across it, so ids
    are joined per chunk between white space, and each chunk's are kept: the merges
    run once per distinct word of a worker (up to ``CACHE``, then afresh). Merging is
    done by rank on bytes, with 0xFF (never in UTF-8) for the end of a word.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        import regex
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
        hidden = [c for c in range(256) if c not in set(shown)]
        byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(hidden)}

        def raw(token: str) -> bytes:
            core = token.removesuffix(end)
            return bytes(byte[c] for c in core) + (b"\xff" if core != token else b"")

        order = [(bytes([c]), vocab[u]) for u, c in byte.items()]
        order.sort()
        order += sorted((bytes([c, 255]), vocab[u + end]) for u, c in byte.items())
        merged = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])]
        order += [(raw(m), vocab[m]) for m in merged]
        ranks = {t: i for i, (t, _) in enumerate(order)}
        if len(ranks) != len(order):
            raise ValueError("two merges give one token: ranks on bytes would not be exact")
        self.ids = np.array([v for _, v in order], np.uint32)
        self.merge = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.chunks: dict[str, bytes] = {}

    def chunk(self, chunk: str) -> bytes:
        ranks = [r for w in self.words(chunk) for r in self.merge(w.encode() + b"\xff")]
        return self.ids[ranks].tobytes() if ranks else b""

    def encode(self, text: str) -> bytes:
        if _RARE.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        parts = text.lower().split()
        known = self.chunks
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for p in set(parts):
                if p not in known:
                    known[p] = self.chunk(p)
            return b"".join([known[p] for p in parts])


_LOADED: dict[str, WordTokens] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
           keep_ids: bool = False) -> DataFrame:
    """k1, k2, doc_id, piece, start, length, ids_crc32 (and ids) of every piece: each
    text's ids and id 0, cut every ``capacity`` tokens. Null text counts as empty and
    gives one piece of length 1; repeated rows give repeated pieces."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _LOADED.setdefault(tokenizer, None) or WordTokens(tokenizer)
        _LOADED[tokenizer] = enc
        step = 4 * capacity
        for b in batches:
            row, piece, length, crc, ids = [], [], [], [], []
            for i, t in enumerate(b.column("text")):
                raw = enc.encode(t.as_py()) + b"\0\0\0\0"
                for k in range(0, len(raw), step):
                    part = raw[k:k + step]
                    row.append(i)
                    piece.append(k // step)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(part)
            at = pa.array(row, pa.int32())
            p = np.array(piece, np.int32)
            out = [b.column(c).take(at) for c in ("k1", "k2", "doc_id")] + [
                pa.array(p), pa.array(p.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["k1", "k2", "doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    t = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).select(*row_key(), "doc_id", whole().alias("text"))
    schema = "k1 long, k2 long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return t.mapInArrow(cut, schema)


# ---- plan: over the histogram of lengths only, so its size is that of the capacity ----

def _configurations(sizes: np.ndarray, need: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """How many bins of which contents hold ``need`` items of each of few sizes.

    The linear relaxation by column generation (price by a knapsack),
    rounded down; the rest by repeatedly filling a bin as full as it gets.
    """
    k = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    basis = [columns[:, j].copy() for j in range(k)]
    for _ in range(400):
        mat = np.stack(basis, axis=1)
        price = np.linalg.solve(mat.T, np.ones(k))
        worth, picks = np.zeros(capacity + 1), []
        for j in range(k):
            now, pick = worth.copy(), np.zeros(capacity + 1, int)
            for t in range(1, capacity // int(sizes[j]) + 1 if price[j] > 0 else 1):
                tried, at = worth[:-t * sizes[j]] + t * price[j], slice(int(t * sizes[j]), None)
                better = tried > now[at] + 1e-12
                now[at] = np.where(better, tried, now[at])
                pick[at] = np.where(better, t, pick[at])
            worth = now
            picks.append(pick)
        best = int(np.argmax(worth))
        if worth[best] <= 1 + 1e-9:
            break
        col = np.zeros(k)
        for j in reversed(range(k)):
            col[j] = picks[j][best]
            best -= int(col[j] * sizes[j])
        x, d = np.linalg.solve(mat, need.astype(float)), np.linalg.solve(mat, col)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        basis[int(np.argmin(ratio))] = col
    left = need.copy()
    plan = []
    for col, x in zip(basis, np.linalg.solve(np.stack(basis, axis=1), need.astype(float)), strict=True):
        items = col.round().astype(int)
        n = int(min([max(0, int(x + 1e-9)), *(left[j] // items[j] for j in range(k) if items[j])]))
        if n:
            plan.append((n, items))
            left = left - n * items
    while left.any():
        items, room = np.zeros(k, int), capacity
        for j in np.argsort(-sizes, kind="stable"):
            take = int(min(left[j], room // sizes[j]))
            items[j] += take
            room -= take * int(sizes[j])
        n = int(min(left[j] // items[j] for j in range(k) if items[j]))
        plan.append((n, items))
        left = left - n * items
    return plan


def _from(content: tuple, bins: int) -> tuple:
    """The content of a class without its first bins."""
    return tuple((length, rank + bins) for length, rank in content)


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, last rank + 1, first sequence, offset): the items of
    a length with ranks in the range go, one each, to consecutive sequences.

    Large lengths are sorted, cut into groups of equal cardinality and rounded up to
    the group's largest; configurations are optimised for these few sizes; the actual
    items then take the places in order, which splits the bins into classes of equal
    content; small lengths go by best fit, longest first, into the least room that
    holds them, whole classes at a time.
    """
    counts = {int(n): int(c) for n, c in counts.items() if c}
    used = dict.fromkeys(counts, 0)
    classes: list[tuple[int, tuple]] = []  # bins, content ((length, first rank), ...)
    if counts.get(capacity):
        classes.append((counts[capacity], ((capacity, 0),)))
        used[capacity] = counts[capacity]
    floor = capacity * LARGE
    large = [(n, counts[n]) for n in sorted(counts, reverse=True) if floor < n < capacity]
    total = sum(c for _, c in large)
    if total:
        ends = sorted({total * (g + 1) // min(groups, total) for g in range(min(groups, total))})
        runs, at, members = iter(large), 0, []
        length, have = next(runs)
        for e in ends:
            own = []
            while at < e:
                if not have:
                    length, have = next(runs)
                n = min(have, e - at)
                own.append([length, n])
                at, have = at + n, have - n
            members.append(own)
        merged: list[list] = []
        for own in members:  # groups that round to one size are one
            if merged and merged[-1][0][0] == own[0][0]:
                merged[-1] += own
            else:
                merged.append(own)
        sizes = np.array([own[0][0] for own in merged])
        need = np.array([sum(n for _, n in own) for own in merged])
        for n, items in _configurations(sizes, need, capacity):
            current = [(n, ())]
            for j in np.nonzero(items)[0]:
                for _ in range(int(items[j])):
                    split, own = [], merged[j]
                    for c, content in current:
                        done = 0
                        while c:
                            m = min(c, own[0][1])
                            length = own[0][0]
                            split.append((m, (*_from(content, done), (length, used[length]))))
                            done += m
                            used[length] += m
                            own[0][1] -= m
                            if not own[0][1]:
                                own.pop(0)
                            c -= m
                    current = split
            classes += current
    open_: list[tuple[int, int]] = []  # room, place in classes
    for i, (_, content) in enumerate(classes):
        room = capacity - sum(n for n, _ in content)
        if room:
            insort(open_, (room, i))
    for s in sorted((n for n in counts if n <= floor), reverse=True):
        while used[s] < counts[s]:
            left = counts[s] - used[s]
            at = bisect_left(open_, (s, -1))
            if at < len(open_):
                room, i = open_.pop(at)
                bins, content = classes[i]
                m = min(bins, left)
                if m < bins:
                    classes.append((bins - m, _from(content, m)))
                    insort(open_, (room, len(classes) - 1))
                classes[i] = (m, (*content, (s, used[s])))
                used[s] += m
                if room > s:
                    insort(open_, (room - s, i))
            else:
                per = min(capacity // s, left)
                bins = left // per
                classes.append((bins, tuple((s, used[s] + j * bins) for j in range(per))))
                used[s] += per * bins
                if capacity > per * s:
                    insort(open_, (capacity - per * s, len(classes) - 1))
    rows, first = [], 0
    for bins, content in classes:
        offset = 0
        for length, rank in content:
            rows.append((length, rank, rank + bins, first, offset))
            offset += length
        first += bins
    return sorted(rows)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (length 1 to
    ``capacity``). Only the histogram of lengths, at most ``capacity`` rows, meets the
    driver. Pieces are numbered within their length by a range sort, so a length
    shared by most rows spreads; ties and repeated rows take any order among them."""
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = np.array(plan(counts, capacity) or [(0, 0, 0, 0, 0)], np.int64)
    key = rows[:, 0] * (1 << 44) + rows[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank = b["rn"].to_numpy(np.int64) - 1
            k = np.searchsorted(key, b["length"].to_numpy(np.int64) * (1 << 44) + rank, side="right") - 1
            b["sequence_id"] = rows[k, 3] + rank - rows[k, 1]
            b["offset"] = rows[k, 4]
            yield b.drop(columns="rn")

    ranked = numbered(cut, ["length"], ["k1", "k2", "piece"], "rn")
    names = [*cut.columns, "rn"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.select(*names).mapInPandas(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places; the written pieces are numbered.

    Null text counts as empty (one piece, the end mark); a document longer than
    ``capacity`` is cut into pieces of that length; repeated rows are packed again;
    documents of one length are interchangeable; only doc_id and text are read; an empty
    table gives no rows.
    """
    return pack(stage_table(pieces(docs, tokenizer, capacity)), capacity)
