"""URL column functions."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..fixed_values import TRACKING_PARAMS

_ABSOLUTE = r"(?i)^https?://[^/?#]"
# already in normal form, unless it ends in index.html
_NORMAL = r"^https?://[a-z0-9.-]+/[^?#]*\z"
# of two addresses with a NUL between them: the same up to the third slash, and hosts of
# lower case without port or user that differ by more than www
_SAME_START = r"^([a-z][a-z0-9+.-]*://[^/\x00]*)(?:/[^\x00]*)?\x00\1(?:/[^\x00]*)?\z"
_OTHER_HOST = (r"^[a-z][a-z0-9+.-]*://(?:www\.)?+([a-z0-9.-]+)(?:[/?#][^\x00]*)?\x00"
               r"[a-z][a-z0-9+.-]*://(?:www\.)?+(?!\1(?:[/?#]|\z))[a-z0-9.-]+(?:[/?#][^\x00]*)?\z")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    """Host with port, lower case; empty when the value is not an absolute URL."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def hostname(url: Column) -> Column:
    return F.regexp_replace(authority(url), r":\d*$", "")


def bare_host(url: Column) -> Column:
    return F.regexp_replace(hostname(url), r"^www\.", "")


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def path(url: Column) -> Column:
    p = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def query_string(url: Column) -> Column:
    """Query without its question mark; empty when there is none."""
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def path_and_query(url: Column) -> Column:
    q = query_string(url)
    return F.concat(path(url), F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))


def section(url: Column) -> Column:
    """First path segment, ``/`` at the root."""
    seg = F.regexp_extract(path(url), r"^/*([^/]*)", 1)
    return F.when(seg == "", F.lit("/")).otherwise(seg)


def last_segment(url: Column) -> Column:
    return F.regexp_extract(path(url), r"([^/]+)/*$", 1)


def param_keys(url: Column) -> Column:
    """Sorted query keys, comma separated; empty without a query."""
    pairs = F.filter(F.split(query_string(url), "&"), lambda p: p != "")
    return F.array_join(F.array_sort(F.transform(pairs, lambda p: F.substring_index(p, "=", 1))), ",")


def is_absolute(url: Column) -> Column:
    return url.rlike(_ABSOLUTE)


def normalise_absolute(url: Column) -> Column:
    """Canonical form of an absolute http(s) URL, native expressions only.

    Lower-cases scheme and host, drops the default port, the fragment, tracking
    parameters and a trailing ``index.html``; NULL for anything else.
    """
    sch = scheme(url)
    host = authority(url)
    host = F.when(sch == "https", F.regexp_replace(host, r":443$", "")).otherwise(
        F.regexp_replace(host, r":80$", ""))
    pth = path(url)
    pth = F.when(pth.endswith("/index.html"), F.regexp_replace(pth, r"index\.html$", "")).otherwise(pth)
    keys = F.array(*[F.lit(k) for k in TRACKING_PARAMS])
    kept = F.filter(
        F.split(query_string(url), "&"),
        lambda p: (p != "") & ~F.array_contains(keys, F.substring_index(p, "=", 1)),
    )
    kept = F.transform(kept, lambda p: F.when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("="))))
    qs = F.array_join(kept, "&")
    out = F.concat(sch, F.lit("://"), host, pth,
                   F.when(qs == "", F.lit("")).otherwise(F.concat(F.lit("?"), qs)))
    normal = ~url.endswith("/index.html") & url.rlike(_NORMAL)
    return F.when(normal, url).when(is_absolute(url), out)


def resolve_url(raw: str | None, base: str | None) -> str | None:
    """Row helper used inside Arrow batches: resolve against a base, then canonicalise."""
    if raw is None:
        return None
    try:
        joined = urljoin(base or "", raw.strip())
        parts = urlsplit(joined)
        sch = parts.scheme.lower()
        if not sch:
            return None
        if sch not in ("http", "https"):
            return joined.split("#", 1)[0]
        host = (parts.hostname or "").lower()
        if not host or re.search(r"[\s<>\[\]^|%]", host):
            return None
        port = parts.port
        if port and port != (443 if sch == "https" else 80):
            host = f"{host}:{port}"
        pth = quote(parts.path or "/", safe="/%:@!$&'()*+,;=~-._[]|^")
        if pth != "/" and pth.endswith("/index.html"):
            pth = pth[: -len("index.html")]
        query = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k not in TRACKING_PARAMS]
        qs = urlencode(query, safe="*")
        return f"{sch}://{host}{pth}" + (f"?{qs}" if qs else "")
    except ValueError:
        return None


@F.pandas_udf(StringType())
def normalise_url(raw: pd.Series, base: pd.Series) -> pd.Series:
    """Relative or absolute reference against a base URL."""
    return pd.Series([resolve_url(r, b) for r, b in zip(raw, base)], dtype="object")


def same_site(a: Column, b: Column, subdomains: bool = False) -> Column:
    # nearly all pairs are told by one pattern, which reads each address once (a filter
    # computes its arguments at every place they stand in); the rest is taken apart
    pair = F.concat(a, F.lit("\x00"), b)
    ha, hb = hostname(a), hostname(b)
    known = (ha != "") & (hb != "")
    same = (ha == hb) | (bare_host(a) == bare_host(b))
    if subdomains:
        def tail(h: Column) -> Column:
            return F.substring_index(h, ".", -2)
        return F.when(pair.rlike(_SAME_START), F.lit(True)).otherwise(known & (same | (tail(ha) == tail(hb))))
    return F.when(pair.rlike(_SAME_START), F.lit(True)).when(pair.rlike(_OTHER_HOST), F.lit(False)).otherwise(known & same)
