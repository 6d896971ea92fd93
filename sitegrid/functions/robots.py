"""Matching paths against robots patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern_regex(pattern: Column) -> Column:
    """Anchored regex of a robots pattern.

    Each ``*`` skips to the first later occurrence of the next literal piece and
    does not go back, hence the atomic groups.
    """
    ends = pattern.endswith("$")
    body = F.regexp_replace(pattern, r"\$$", "")
    pieces = F.split(body, r"\*")
    quoted = F.transform(pieces, lambda p: F.regexp_replace(p, r"([\\^$.|?+()\[\]{}])", r"\\$1"))
    tail = F.filter(F.slice(quoted, F.lit(2), F.size(quoted)), lambda p: p != "")
    tail = F.transform(tail, lambda p: F.concat(F.lit("(?>.*?"), p, F.lit(")")))
    close = F.when(ends & ~body.endswith("*"), F.lit("$")).otherwise(F.lit(""))
    return F.concat(F.lit("^"), quoted[0], F.array_join(tail, ""), close)


def is_plain(pattern: Column) -> Column:
    """No wildcard and no end anchor: a prefix test is enough."""
    return (F.instr(pattern, "*") == 0) & ~pattern.endswith("$")


def rule_matches(path: Column, rule: Column) -> Column:
    """``rule`` is a struct with fields path, rx, plain. For single patterns; tables of rules
    go through ``path_matches``, which gives the same."""
    return F.when(rule["path"] == "", F.lit(False)).when(
        rule["plain"], F.startswith(path, rule["path"])).otherwise(F.regexp_like(path, rule["rx"]))


def pattern_pieces(pattern: Column) -> Column:
    """Literal pieces of a robots pattern between its wildcards; the first may be empty."""
    pieces = F.split(F.regexp_replace(pattern, r"\$$", ""), r"\*")
    return F.concat(F.slice(pieces, 1, 1), F.filter(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: p != ""))


def is_anchored(pattern: Column) -> Column:
    """The last piece must end the path."""
    return pattern.endswith("$") & ~pattern.endswith("*$")


def path_matches(path: Column, rule: Column) -> Column:
    """``rule`` is a struct with fields path, pieces, anchored, plain. Pieces are found one
    after another: each ``*`` skips to the first later occurrence of the next piece and
    does not go back. No expression is compiled for a row."""
    def step(at: Column, piece: Column) -> Column:
        return F.when(at >= 0, F.coalesce(F.nullif(F.position(piece, path, at + 1), F.lit(0)) + F.length(piece) - 1, F.lit(-1))).otherwise(-1)

    first = rule["pieces"][0]
    start = F.when(F.startswith(path, first), F.length(first)).otherwise(-1)
    end = F.aggregate(F.slice(rule["pieces"], F.lit(2), F.size(rule["pieces"])), start, step)
    return F.when(rule["path"] == "", F.lit(False)).when(rule["plain"], F.startswith(path, rule["path"])).otherwise(
        F.when(rule["anchored"], end == F.length(path)).otherwise(end >= 0))
