"""Ordering helpers that keep a hot key out of a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each key with their rank; with None all rows, unranked. The rank filter is pushed below the shuffle
    as a group limit, so each task ships at most ``k`` rows of a key."""
    if k is None:
        return df
    w = W.partitionBy(*keys).orderBy(*order) if keys else W.partitionBy(F.lit(1)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def running(df: DataFrame, keys: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """Running total of ``amount`` per key in ascending ``order`` (a total order).

    Rows are range-partitioned, summed per partition, and each partition starts
    from the total of the ones before it, so a key of any size spreads.
    """
    ranged = cut_lineage(
        df.withColumn("_amount", amount)
        .repartitionByRange(*keys, *order)
        .withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part", *keys).agg(F.sum("_amount").alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(
        W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.sum("_amount").over(
        W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return (ranged.withColumn("_inside", inside).join(before, ["_part", *keys])
            .withColumn(name, F.col("_before") + F.col("_inside"))
            .drop("_part", "_amount", "_inside", "_before"))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    return running(df, keys, order, F.lit(1).cast("bigint"), name)
