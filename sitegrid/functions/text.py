"""Text column functions: tokens, hashes, shingles, widths, sentences."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V


def half_up(x: Column) -> Column:
    """Round half toward plus infinity, as a whole number."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def half_up_to(x: Column, digits: int) -> Column:
    scale = float(10 ** digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, half_up(part * F.lit(100.0) / whole)).otherwise(F.lit(0).cast("bigint"))


def upper_quantile(value: str, q: float) -> Column:
    """Element at floor(n*q) of the ascending order: the discrete quantile read
    from the descending side. Partial maps hold distinct values, so callers pass
    whole-number columns with few of them (milliseconds, words, links)."""
    return F.expr(f"percentile_disc({round(1 - q, 6)}) WITHIN GROUP (ORDER BY {value} DESC)")


def collapse(text: Column) -> Column:
    """Whitespace runs as one space; single spaces are passed over."""
    return F.regexp_replace(text, f"[{V.WS}&&[^ ]]{V.WS}*| {V.WS}+", " ")


def squash(text: Column) -> Column:
    """Collapse whitespace runs and trim."""
    return F.trim(collapse(text))


def word_count(text: Column) -> Column:
    return squashed_word_count(squash(text))


def squashed_word_count(text: Column) -> Column:
    """Words of text that is already collapsed and trimmed."""
    gaps = F.length(text) - F.length(F.translate(text, " ", ""))
    return F.when(text == "", F.lit(0)).otherwise(gaps + 1)


def content_hash(text: Column) -> Column:
    # the runs that stay, joined: looking for what goes ([^a-z0-9 ]+) takes five times as long
    plain = F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9 ]+"), F.lit(0)), "")
    return F.sha1(plain)


def alnum_tokens(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; adjacent projections are
    collapsed by the optimizer, which would otherwise recompute it per element."""
    return F.transform(F.array(value), body)[0]


def whole_shingles(text: Column) -> Column:
    """Every distinct window of five words of the whole text."""
    n = V.SHINGLE_WORDS

    def windows(w: Column) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i + 1, n), " ")))

    return bind(alnum_tokens(text), windows)


def whole_shingle_hashes(text: Column) -> Column:
    """``whole_shingles`` as 64-bit hashes of their words, for comparing sets."""
    n = V.SHINGLE_WORDS

    def windows(w: Column) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])))

    return bind(alnum_tokens(text), windows)


def shingles(text: Column) -> Column:
    """Overlapping word windows, distinct, capped, then evenly sampled: the form of the
    registered query ``shingles``, whose SQL states these cuts."""
    n, step, cap = V.SHINGLE_WORDS, V.SHINGLE_STEP, V.SHINGLE_CAP

    def windows(w: Column) -> Column:
        last = F.floor((F.size(w) - n) / step).cast("int")
        at = F.when(F.size(w) >= n, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat_ws(" ", *[w[i * step + k] for k in range(n)]))

    def sample(s: Column) -> Column:
        every = F.greatest(F.lit(1), F.ceil(F.size(s) / cap)).cast("int")
        return F.filter(s, lambda _, i: i % every == 0)

    distinct = bind(alnum_tokens(text), lambda w: F.slice(F.array_distinct(windows(w)), 1, cap * 4))
    return bind(distinct, sample)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0),
                  F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def long_words(text: Column, shortest: int = 3) -> Column:
    return F.array_distinct(F.filter(alnum_tokens(text), lambda w: F.length(w) >= shortest))


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def pixel_units(text: Column) -> Column:
    """Width in hundredths of the font size."""
    narrow, wide = _count_of(text, V.NARROW_CHARS), _count_of(text, V.WIDE_CHARS)
    upper, digit = _count_of(text, V.UPPER_CHARS), _count_of(text, V.DIGIT_CHARS)
    rest = F.length(text) - narrow - wide - upper - digit
    return (narrow * V.NARROW_W + wide * V.WIDE_W + upper * V.UPPER_W
            + digit * V.DIGIT_W + rest * V.OTHER_W)


def pixel_width(text: Column, size: int = 20) -> Column:
    return F.floor((pixel_units(text) * size + 50) / 100).cast("int")


def phones(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(V.PHONE), F.lit(0))
    digits = F.transform(found, lambda p: F.regexp_replace(F.regexp_replace(p, "[^0-9]", ""), "^1", ""))
    return F.array_distinct(F.filter(digits, lambda d: F.length(d) == 10))


def title_head(title: Column) -> Column:
    """Title up to its first separator character."""
    return F.split(title, "[|–—-]", 2)[0]


def split_sentences(text: Column) -> Column:
    """Sentences over 30 characters with a Latin letter; common abbreviations do
    not end one."""
    # looked for from the stop, which is rarer than the words before it
    guarded = F.regexp_replace(collapse(text), V.ABBREVIATED_STOP, "\u0001 ")
    parts = F.split(guarded, r" (?<=[.!?] )")
    parts = F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit("."))))
    return F.filter(parts, lambda s: (F.length(s) > 30) & s.rlike("[A-Za-z]"))


def first_sentences(text: Column, n: int) -> Column:
    """First ``n`` terminated sentences, at most 200 characters."""
    found = F.regexp_extract_all(squash(text), F.lit(r"[^.!?]+[.!?]+"), F.lit(0))
    return F.substring(F.trim(F.array_join(F.slice(found, 1, n), " ")), 1, 200)


def escape_regex(literal: Column) -> Column:
    return F.regexp_replace(literal, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def detect_platform(html: Column, headers: Column, low: Column | None = None) -> Column:
    """Labels of every fingerprint that matches, catalogue order, distinct.
    Literal searches do the work; a regex runs only behind one. ``low``: a column
    that already holds the html in lower case."""
    lines = F.array_join(
        F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")

    def found(label: str, literals: list[str], low: Column) -> Column:
        tests = [F.contains(low, F.lit(lit)) for lit in literals]
        tests += [F.contains(html, F.lit(lit)) for lit in V.HTML_CASED_LITERALS.get(label, [])]
        if label in V.HTML_PATTERNS:
            guard, rx = V.HTML_PATTERNS[label]
            tests.append(F.contains(low, F.lit(guard)) & html.rlike(rx))
        return F.when(reduce(or_, tests), F.lit(label))

    def labels(text: Column) -> Column:
        return F.array(*[found(n, lits, text) for n, lits in V.HTML_LITERALS])

    in_html = bind(F.lower(html), labels) if low is None else labels(low)
    in_headers = F.array(*[F.when(F.coalesce(lines, F.lit("")).rlike(rx), F.lit(n))
                           for n, rx in V.HEADER_FINGERPRINTS])
    return F.array_distinct(F.array_compact(F.concat(in_html, in_headers)))


def slug_words(url: Column) -> Column:
    from .urls import last_segment
    seg = last_segment(url)
    words = F.regexp_replace(F.regexp_replace(seg, "[-_]+", " "), r"\.\w+$", "")
    return F.when(seg == "", F.lit("Home")).otherwise(F.initcap(words))
