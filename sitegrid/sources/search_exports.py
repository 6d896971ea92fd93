"""Search-performance exports: CSV files in several languages and number styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V

DIMENSIONS = ["query", "page", "date", "country", "device"]
METRICS = ["clicks", "impressions", "ctr", "position"]


def header_map(columns: list[str]) -> dict[str, str]:
    """Our name for each recognised header; the first column of a kind wins."""
    found: dict[str, str] = {}
    for c in columns:
        plain = c.strip().lower().removeprefix("﻿").replace('"', "").replace("'", "")
        for key, names in V.SEARCH_HEADERS.items():
            if plain in names:
                found.setdefault(key, c)
    return found


def number(text: Column) -> Column:
    """Counts and decimals in either locale: ``1,234`` is a count, ``1,23`` a decimal."""
    s = F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit("%"), F.lit("")))
    decimal_comma = s.rlike(r",\d{1,2}$") & ~s.rlike(r"\.\d")
    plain = F.when(decimal_comma, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(
        F.replace(s, F.lit(","), F.lit("")))
    return F.coalesce(plain.try_cast("double"), F.lit(0.0))


def rate(text: Column) -> Column:
    n = number(text)
    return F.when(F.contains(F.coalesce(text, F.lit("")), F.lit("%")) | (n > 1), n / 100).otherwise(n)


def typed_rows(table: DataFrame, hint: str | None = None) -> DataFrame:
    """A string-typed export to dimension, key, clicks, impressions, ctr, position.

    Raises when the header has neither metric or no dimension.
    """
    names = header_map(table.columns)
    if "clicks" not in names and "impressions" not in names:
        raise ValueError(f"no clicks or impressions column in {table.columns[:6]}")
    dim = next((d for d in DIMENSIONS if d in names), hint if hint in DIMENSIONS else None)
    if dim is None or dim not in names:
        raise ValueError(f"no dimension column in {table.columns[:6]}")

    def col(metric: str) -> Column:
        return F.col(f"`{names[metric]}`") if metric in names else F.lit("")

    def whole(metric: str) -> Column:
        return F.floor(number(col(metric)) + 0.5).cast("bigint")

    rows = table.select(
        F.lit(dim).alias("dimension"), F.trim(F.col(f"`{names[dim]}`")).alias("key"),
        whole("clicks").alias("clicks"), whole("impressions").alias("impressions"),
        rate(col("ctr")).alias("ctr"), number(col("position")).alias("position"),
        *([F.col("file")] if "file" in table.columns else []))
    derived = F.when((F.col("ctr") == 0) & (F.col("impressions") > 0),
                     F.col("clicks") / F.col("impressions")).otherwise(F.col("ctr"))
    return rows.filter(F.col("key") != "").withColumn("ctr", derived)


def read_search_export(spark: SparkSession, path: str, hint: str | None = None) -> DataFrame:
    """One table: quoted fields, embedded commas and either line ending."""
    table = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True,
                           ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return typed_rows(table, hint)


def read_search_exports(spark: SparkSession, paths: list[str]) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """(tables by dimension, errors). The last file of a dimension wins; a file
    that cannot be used becomes an error row. The loop is over files, not rows."""
    tables: dict[str, DataFrame] = {}
    errors: list[tuple[str, str]] = []
    for path in paths:
        try:
            rows = read_search_export(spark, path)
            tables[dimension_of(rows)] = rows
        except ValueError as e:
            errors.append((path, str(e)))
    return tables, errors


def dimension_of(rows: DataFrame) -> str:
    """The dimension a table carries, read from its first row."""
    first = rows.select("dimension").head()
    if first is None:
        raise ValueError("no data rows")
    return first["dimension"]


def as_dimension(rows: DataFrame, dimension: str) -> DataFrame:
    """Rows of one dimension under its own column name, for the analyses."""
    return rows.filter(F.col("dimension") == dimension).withColumnRenamed("key", dimension).drop("dimension")
