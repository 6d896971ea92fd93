"""Embedding near duplicates by E8 lattice hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .common import star_components

LEAST = 0.98
TABLES, PROBES = 10, 3
#: Lattice cells per unit of projected distance, and members of a cell compared at once.
SCALE, BLOCK = 0.75, 1024


def lattice_points(x: np.ndarray) -> np.ndarray:
    """For each row of 8 numbers, ``PROBES`` points of E8 (doubled, so integers): the
    nearest one, the nearest of the other coset of D8, and the nearest one's neighbour
    across its weakest wall."""
    def even(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest point of D8, and the one with the two most doubtful roundings changed."""
        r = np.rint(y)
        order = np.argsort(-np.abs(y - r), axis=1)
        rows = np.arange(len(y))
        step = np.where(y - r >= 0, 1.0, -1.0)

        def flip(z: np.ndarray, k: int) -> np.ndarray:
            z = z.copy()
            z[rows, order[:, k]] += step[rows, order[:, k]]
            return z

        odd = (r.sum(axis=1) % 2 != 0)[:, None]
        return np.where(odd, flip(r, 0), r), np.where(odd, flip(r, 1), flip(flip(r, 0), 1))

    a, a2 = even(x)
    b, b2 = even(x - 0.5)
    b, b2 = b + 0.5, b2 + 0.5
    first = (((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None]
    near, other, second = np.where(first, a, b), np.where(first, b, a), np.where(first, a2, b2)
    return np.rint(2 * np.stack([near, other, second], axis=1)).astype(np.int64)


def cells(vectors: np.ndarray, seed: int = 11) -> np.ndarray:
    """Cell numbers (rows, tables, probes) of unit vectors. The projections are drawn
    from the seed and the dimension, so every task draws the same."""
    n, dim = vectors.shape
    rng = np.random.default_rng([seed, dim])
    out = np.empty((n, TABLES, PROBES), np.int64)
    for t in range(TABLES):
        x = vectors @ rng.standard_normal((dim, 8)) * SCALE + rng.random(8)
        points = lattice_points(x).astype(np.uint64)
        h = np.full((n, PROBES), t + 1, np.uint64)
        for i in range(8):
            h = (h ^ points[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, t] = h.view(np.int64)
    return out


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of batches sorted by ``keys``; a group may span batches."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        v = b[keys].to_numpy()
        cut = np.nonzero((v[1:] != v[:-1]).any(axis=1))[0] + 1
        for i, (lo, hi) in enumerate(zip([0, *cut], [*cut, len(b)], strict=True)):
            part = b.iloc[lo:hi]
            if i == 0 and held and (held[-1][keys].iloc[-1].to_numpy() == v[0]).all():
                held.append(part)
                continue
            if held:
                yield pd.concat(held) if len(held) > 1 else held[0]
            held = [part]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _compare(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links of each sub-cell. A pair that meets in several cells is counted in the
        first table it shares, in the least shared cell of that table."""
        out = []
        for g in _groups(batches, ["cell", "sub"]):
            node, copies = g["node"].to_numpy(np.int64), g["copies"].to_numpy(np.int64)
            label, side = g["label"].to_numpy(), g["me"].to_numpy()
            x = np.stack(g["unit"].to_numpy())
            all_cells = np.stack(g["cells"].to_numpy()).reshape(len(g), TABLES, PROBES)
            cell, table = int(g["cell"].iloc[0]), int(g["tab"].iloc[0])
            s = x @ x.T
            ok = s >= least
            ok &= label[:, None] == label[None, :]
            if g["cross"].iloc[0]:
                ok &= side[:, None] != side[None, :]
            i, j = np.nonzero(np.triu(ok, 1))
            if not len(i):
                continue
            count = np.ones(len(i), bool)
            for t in range(table):
                for p in range(PROBES):
                    count &= ~(all_cells[i, t, p][:, None] == all_cells[j, t]).any(axis=1)
            mine = all_cells[i, table]
            shared = (mine[:, :, None] == all_cells[j, table][:, None, :]).any(axis=2)
            count &= np.where(shared, mine, np.iinfo(np.int64).max).min(axis=1) == cell
            links = np.bincount(i[count], copies[j[count]], len(g)) + np.bincount(j[count], copies[i[count]], len(g))
            root = np.arange(len(g))
            while True:  # least label of the group's components
                now = root.copy()
                np.minimum.at(now, i, root[j])
                np.minimum.at(now, j, root[i])
                now = now[now]
                if (now == root).all():
                    break
                root = now
            linked = np.zeros(len(g), bool)
            linked[i] = linked[j] = True
            out.append(pd.DataFrame({"node": node[linked], "links": links[linked].astype(np.int64), "root": node[root][linked]}))
            if len(out) >= 2000:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)
    return run


def group(vectors: DataFrame, least: float = LEAST, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors``.

    Equal vectors of a label are folded to one node with a count first. Each node goes
    to its lattice cells and their neighbours in several tables; cells held by one node
    are dropped before vectors are fetched; a cell of many nodes is cut into blocks
    that meet pairwise in sub-cells, so none is held whole and no pair is lost. Every
    pair that meets is verified by its cosine in double precision and counted once.
    Vectors that are null, zero, or hold null or non-finite parts, and rows without a
    label, link with nothing: they have 0 links and are their own component. Vectors of
    different lengths never meet. Rows with one vec_id are separate vectors. A null
    vec_id comes last as a component's name. Only the three named columns are read; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    good = F.col("label").isNotNull() & F.col("e").isNotNull() & ~F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("e", lambda v: v != 0)
    rows = stage_table(vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("e0"), F.col(label).alias("label"))
                       .withColumn("e", F.transform("e0", lambda v: v.cast("double"))).drop("e0")
                       .withColumn("good", F.coalesce(good, F.lit(False)))
                       .withColumn("h1", F.xxhash64("e")).withColumn("h2", F.xxhash64(F.lit("e"), "e")))
    folded = rows.filter("good").groupBy("label", "h1", "h2").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.any_value("e").alias("e"))
    nodes = stage_table(folded.withColumn("node", F.monotonically_increasing_id()))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            unit, own = [None] * len(b), [None] * len(b)
            size = b["e"].map(len).to_numpy()
            for d in np.unique(size):
                at = np.nonzero(size == d)[0]
                v = np.stack(b["e"].to_numpy()[at]).astype(np.float64)
                v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow
                v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
                c = cells(v).reshape(len(at), -1)
                for k, i in enumerate(at):
                    unit[i], own[i] = v[k], c[k]
            yield pd.DataFrame({"node": b["node"], "label": b["label"].astype(str), "copies": b["copies"], "unit": unit, "cells": own})

    placed = stage_table(nodes.select("node", F.col("label").cast("string").alias("label"), "copies", "e").mapInPandas(
        hashed, "node long, label string, copies long, unit array<double>, cells array<long>"))
    dim = F.size("unit")
    in_cells = placed.select("node", "label", dim.alias("dim"), F.posexplode("cells").alias("slot", "cell")).select(
        "node", "label", "dim", F.floor(F.col("slot") / PROBES).cast("int").alias("tab"), "cell").distinct()
    key = ["label", "dim", "tab", "cell"]
    full = in_cells.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    blocks: Column = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = in_cells.join(full, key).select("node", *key, blocks.alias("b")).withColumn("me", F.pmod(F.xxhash64("node"), F.col("b")).cast("int"))
    subs = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda x: F.least(x, F.col("me")) * F.col("b") + F.greatest(x, F.col("me")))
    spread = mine.withColumn("sub", F.explode(subs)).withColumn("cross", F.expr("sub div b <> sub % b"))
    met = (spread.join(placed.select("node", "copies", "unit", "cells"), "node")
           .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "label", "dim", "tab", "cell", "sub"))
    # groups are told apart by cell and sub; label and dimension go into the number
    met = met.withColumn("group", F.xxhash64("label", "dim", "tab", "cell")).sortWithinPartitions("group", "cell", "sub")
    found = stage_table(met.select("cell", "sub", "tab", "me", "cross", "label", "node", "copies", "unit", "cells")
                        .mapInPandas(_compare(least), "node long, links long, root long"))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = star_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    label_of = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = (named.join(label_of, "root").join(counted, "node", "left")
               .select("label", "h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    linked = rows.filter("good").select("vec_id", "label", "h1", "h2").join(by_node, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
