"""Shared pieces of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.components import link_buckets, link_families, star_components

__all__ = ["SPACE", "let", "link_buckets", "link_families", "row_key", "star_components", "whole", "words_of"]

#: White space of the word rule, and its complement, in Java and Python regex.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses
    it, also inside lambdas. (A plain alias would be inlined into each use.)"""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def whole(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """``k1, k2``: identifier and hash of the text. Neither is null; rows equal in
    both columns share a key and so share every verdict."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("k1"), F.xxhash64(whole(text)).alias("k2")]
