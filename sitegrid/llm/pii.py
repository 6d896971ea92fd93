"""Personal data, also behind disguises, with places in the source text."""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, whole

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters drawn like Latin ones.
_LOOKALIKE = str.maketrans(
    "аеорсухіјѕԁһкмтвнАЕОРСУХІЈЅКМТВНοαενικρτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ＠",
    "aeopcyxijsdhkmtbhAEOPCYXIJSKMTBHoaevikptuABEZHIKMNOPTYX@")
# Full-width forms and decimal digits of any script, by rule.
_LOOKALIKE |= {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_LOOKALIKE |= {c: 48 + unicodedata.decimal(chr(c)) for c in range(128, sys.maxunicode + 1) if unicodedata.decimal(chr(c), None) is not None}
_DIGITS = {w: str(d) for d, w in enumerate("zero one two three four five six seven eight nine".split())}

# Only ASCII letters, whatever the case rules of other scripts take for them.
_WORD = f"(?a:{'|'.join(_DIGITS)})"
_BOXED_DOT, _SPACED_DOT = r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*", r"(?<=[a-z0-9])\x20+dot\x20+(?=[a-z0-9])"
#: One pass of rewrites: bracketed and spaced at / dot, and spelled digits (see ``normalise``).
_REWRITE = re.compile(
    rf"(?P<at>\s*[\[({{<]\s*(?:at|@)\s*[\])}}>]\s*)|(?P<dot>{_BOXED_DOT})"
    rf"|(?P<bare>(?<=[a-z0-9])\x20+at\x20+(?=[a-z0-9-]+(?:(?:\x20+dot\x20+|\.)[a-z0-9-]+)+))|(?P<sdot>{_SPACED_DOT})"
    rf"|(?P<digits>\b{_WORD}(?:[\x20-]+{_WORD})*\b)", re.I)
_DOT_NEXT = re.compile(rf"{_BOXED_DOT}|{_SPACED_DOT}|\.(?=[a-z0-9])", re.I)
_DOT_BEFORE = re.compile(r"(?<=[a-z0-9]\.)", re.I)
#: Without one of these nothing is rewritten: each case of the rewrites has its own here.
_HINT = re.compile(rf"[\[({{<]\s*(?:at|dot|@|\.)\s*[\])}}>]|\x20dot\x20|\x20at\x20+[a-z0-9-]+\.[a-z0-9-]"
                   rf"|\b{_WORD}(?:\.[a-z0-9]|[\x20-]+{_WORD}[\x20-]+{_WORD}[\x20-])|[a-z0-9]\.{_WORD}\b", re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end): leftmost matches of each kind that do not overlap."""
    out = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            # the name is the run of its characters that ends at the sign
            a = m.start()
            while a > done and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append((a, 0, m.end()))
                done = m.end()
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def normalise(text: str) -> tuple[str, list[int], list[int], list[int]] | None:
    """Text without disguises and its alignment, or None when nothing changes.

    The letter transducer keeps lengths; the phrase transducer rewrites runs. The
    alignment is three lists: where a segment starts in the result, where in the
    source, and its source length (-1: copied character by character). Spelled digits
    are rewritten in runs of four or more, and in any run next to a dot or its disguise.
    """
    plain = text if text.isascii() else text.translate(_LOOKALIKE)
    if not _HINT.search(plain):
        return None if plain is text or plain == text else (plain, [0], [0], [-1])
    pieces, to, source, size, at, n, dot = [], [], [], [], 0, 0, -1

    def put(piece: str, a: int, length: int) -> None:
        nonlocal n
        if piece:
            pieces.append(piece)
            to.append(n)
            source.append(a)
            size.append(length)
            n += len(piece)

    for m in _REWRITE.finditer(plain):
        kind = m.lastgroup
        words = list(re.finditer(r"[A-Za-z]+", m[0])) if kind == "digits" else []
        if 0 < len(words) < 4 and m.start() != dot and not _DOT_NEXT.match(plain, m.end()) and not _DOT_BEFORE.match(plain, m.start()):
            continue
        put(plain[at:m.start()], at, -1)
        if words:
            for w in words:
                put(_DIGITS[w[0].lower()], m.start() + w.start(), len(w[0]))
        else:
            put("@" if kind in ("at", "bare") else ".", m.start(), len(m[0]))
            dot = m.end() if kind in ("dot", "sdot") else dot
        at = m.end()
    put(plain[at:], at, -1)
    return "".join(pieces), to, source, size


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans found only after normalising, in source characters. A span that meets a
    base span of its kind is left out: base spans stay as they are."""
    done = normalise(text)
    if done is None:
        return []
    plain, to, source, size = done

    def place(i: int, last: bool) -> int:
        k = bisect_right(to, i) - 1
        if size[k] < 0:
            return source[k] + i - to[k] + last
        return source[k] + (size[k] if last else 0)

    out = []
    for a, kind, b in detect(plain):
        start, end = place(a, False), place(b - 1, True)
        if text[start:end] != plain[a:b] and not any(k == kind and s < end and start < e for s, k, e in base):
            out.append((start, kind, end))
    return out


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """k1, k2, doc_id, base and found per row: arrays of (start, kind, end), code
    points, end exclusive, by start and kind; found holds base and disguised spans.

    Null and empty texts have none; repeated rows repeat; whole texts are searched,
    one document at a time, without a shuffle.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def lists(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
        flat = [s for r in rows for s in r]
        ends = [0]
        for r in rows:
            ends.append(ends[-1] + len(r))
        values = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.int64()), pa.array([s[1] for s in flat], pa.int32()),
                                             pa.array([s[2] for s in flat], pa.int64())], ["start", "kind", "end"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values).cast(span)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, found = [], []
            for t in b.column("text"):
                t = t.as_py()
                own = detect(t)
                base.append(own)
                found.append(sorted(own + disguised(t, own)))
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), b.column("doc_id"), lists(base), lists(found)],
                                             ["k1", "k2", "doc_id", "base", "found"])

    t = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).select(*row_key(), "doc_id", whole().alias("text"))
    one = "array<struct<start:long,kind:int,end:long>>"
    return t.mapInArrow(search, f"k1 long, k2 long, doc_id long, base {one}, found {one}")
