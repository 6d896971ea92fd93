"""SimHash near duplicates by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, stage_table
from .common import link_buckets, row_key, whole

THRESHOLD = 4
#: Blocks of the fingerprint and how many of them make a part: of four differing bits
#: at most one lies in the best part. Fewer anchors suit fewer fingerprints; the
#: second layout's are 32 times as many, for tables above ``MANY`` fingerprints.
LAYOUTS = [(3, 1), (5, 2)]
MANY = 1 << 21
CODE = 15
_UPPER = bytes(range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str, width: int = 4) -> int:
    """Majority of the bits of the XXH64 (seed 42) of each word shingle."""
    words = text.encode("utf-8", "surrogatepass").translate(_UPPER).split()
    n = len(words)
    if not n:
        return 0
    shingles = [b" ".join(words)] if n < width else map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))
    digest, seed = xxhash.xxh64_digest, 42
    raw = np.frombuffer(b"".join([digest(s, seed) for s in shingles]), np.uint8).reshape(-1, 8)
    m = len(raw)
    ones = np.concatenate([np.bincount(raw[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > m).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``fp`` (long, the 64 bits) to documents; null text counts as empty."""
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.array([fingerprint(t) for t in s], np.uint64).view(np.int64))
    return docs.withColumn("fp", of(whole(text)))


def _columns() -> np.ndarray:
    """Parity checks of the perfect Hamming code of length 15: bit i has syndrome i+1."""
    return np.arange(1, CODE + 1)


def _syndrome(x: np.ndarray) -> np.ndarray:
    s = np.zeros(x.shape, np.int64)
    for i, c in enumerate(_columns()):
        s ^= np.where((x >> i) & 1, c, 0)
    return s


def _flip(x: np.ndarray, syndrome: np.ndarray) -> np.ndarray:
    """Nearest code word: the bit whose check equals the syndrome is flipped."""
    return np.where(syndrome > 0, x ^ (1 << np.maximum(syndrome - 1, 0)), x)


def anchors(value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The home anchor of each value of a part, and all anchors within covering radius
    plus one differing bit.

    The covering code of a part is the Hamming code on its first 15 bits (radius 1)
    times all words on the others (radius 0). A value within one bit of x has x's home
    within distance 2 on the coded bits with the rest equal, or within distance 1 with
    one other bit off.
    """
    low, rest = value & ((1 << CODE) - 1), value >> CODE
    near = _flip(low, _syndrome(low))
    home = near | (rest << CODE)
    out = [home]
    for i in range(width - CODE):
        out.append(home ^ (1 << (CODE + i)))
    for i in range(CODE):  # code words at distance two lie next to a neighbour of the value
        y = low ^ (1 << i)
        out.append(_flip(y, _syndrome(y)) | (rest << CODE))
    return home, np.stack(out, axis=1)


def parts(layout: tuple[int, int]) -> list[list[tuple[int, int]]]:
    """Bit ranges (first, width) of each part: every choice of blocks."""
    blocks, chosen = layout
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [[(cuts[b], cuts[b + 1] - cuts[b]) for b in c] for c in combinations(range(blocks), chosen)]


def covered(fps: DataFrame, layout: tuple[int, int] = LAYOUTS[0]) -> DataFrame:
    """bucket, node, home: each fingerprint at every anchor due."""
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            node = pdf["node"].to_numpy(np.int64)
            v = node.view(np.uint64)
            for k, ranges in enumerate(parts(layout)):
                value, width = np.zeros(len(v), np.int64), 0
                for at, w in ranges:
                    value |= ((v >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64) << width
                    width += w
                home, each = anchors(value, width)
                each = np.sort(each, axis=1)
                fresh = np.ones(each.shape, bool)
                fresh[:, 1:] = each[:, 1:] != each[:, :-1]
                yield pd.DataFrame({"bucket": each[fresh] + (k << 40), "node": np.repeat(node, fresh.sum(axis=1)),
                                    "home": (each == home[:, None])[fresh]})
    return fps.select("node").mapInPandas(spread, "bucket long, node long, home boolean")


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """k1, k2, doc_id, fp, root, component_id for each row of ``docs``.

    Equal fingerprints are folded to one node with its least doc_id first, so
    copies never meet as pairs; then anchors bring every pair within the threshold
    together (the layouts suit
    thresholds up to 4). root names the component and component_id is the
    least doc_id reachable; a null doc_id counts as the largest value, so a component of
    nulls has a null id. Repeated rows get equal verdicts; a very long text is one
    fingerprint; null and empty texts have fingerprint zero; an empty table gives an
    empty result.
    """
    if threshold > THRESHOLD:
        raise ValueError("the layouts leave at most one of four differing bits in a part")
    own = stage_table(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
                      .select(*row_key(), "doc_id", "fp"))
    nodes = cut_lineage(own.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumnRenamed("fp", "node"))
    members = stage_table(covered(nodes.select("node"), LAYOUTS[nodes.count() > MANY]))
    close = F.bit_count(F.col("x.node").bitwiseXOR(F.col("y.node"))) <= threshold
    roots = link_buckets(members, close)
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    label = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(label, "root").select(F.col("node").alias("fp"), "root", "component_id")
    return own.join(by_fp, "fp").select("k1", "k2", "doc_id", "fp", "root", "component_id")
