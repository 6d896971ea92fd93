"""Main text of web pages: structure, and differences between neighbouring pages."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from ..session import cut_lineage, stage_table

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<raw>script|style|noscript|template|textarea|svg|math|iframe|title)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?/][^>]*>|(?P<text>[^<]+|<)", re.I | re.S)
_ATTR = re.compile(r"""\b(?P<name>class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\s>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Elements and name parts of what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub "
                   "sup time tt u var wbr".split())
CHROME_TAGS = frozenset("nav aside form footer head button select dialog menu object canvas audio video map fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr "
    "masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promos promotion related replies respond share "
    "sharing sidebar social sponsor sponsored sponsors subscribe toolbar widget widgets".split())
#: Compounds with one of these name a layout or a state: has-sidebar, ad-free, comments-open.
LAYOUT_PARTS = frozenset("has no non not with without free less hide hidden open opened closed enabled disabled on off".split())
#: What a name of chrome may be compounded with inside an article: share-buttons,
#: related-posts, ad-slot. With any other word (related-work, notice-period) it is a topic.
HOLDER_PARTS = frozenset("area article articles bar block bottom box button buttons container content form holder icon icons inline inner item items "
                         "left link links list media message panel placeholder post posts right row section signup slot stories story strip text title top "
                         "unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that may hold a whole page.
WRAPPERS = frozenset("form fieldset object".split())
HARD, SOFT, COMMENTS = 1, 2, 3
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies".split())
MAIN_TAGS = frozenset(["article", "main"])
#: Mirrors: at most one part in so many of either text is its own, and lines of so many
#: characters hold half of what is shared (menus and notices are short lines).
OWN, LONG = 5, 80
#: Tags that end at the next start of a block when left open.
LOOSE = frozenset("p li dt dd option tr td th thead tbody".split())


def _chrome(tag: str, attrs: str, in_main: bool) -> int:
    """HARD for what is no content wherever it stands, SOFT (COMMENTS) for what its names
    say and its text may refute, else 0. Names of headings say nothing, as they are made of
    the heading's words; inside an article a name counts if it consists of chrome alone."""
    if tag in CHROME_TAGS and tag not in WRAPPERS or (tag == "header" and not in_main):
        return HARD
    if tag in ("html", "body", "main") or tag in HEADINGS or not attrs:
        return SOFT if tag in WRAPPERS else 0
    names: set[str] = set()
    soft = tag in WRAPPERS
    for m in _ATTR.finditer(attrs):
        name, value = m["name"].lower(), m["a"] or m["b"] or m["c"] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return HARD
        if name == "role":
            soft |= value.lower().strip() in CHROME_ROLES
        else:
            for compound in value.split():
                parts = {x.lower() for x in _PART.findall(compound)}
                topic = in_main and not parts <= CHROME_NAMES | HOLDER_PARTS
                if not topic and not parts & LAYOUT_PARTS:
                    names |= parts
            soft |= not in_main and "header" in names and tag != "article"
    if names & COMMENT_NAMES:
        return COMMENTS
    return SOFT if soft or tag != "article" and names & CHROME_NAMES else 0


def lines_of(page: str) -> list[tuple[str, int]]:
    """Text blocks in page order, each with 2 for the article, 1 for text that may be
    content, 0 for what the structure marks as none. White space inside a block is one
    space; character references are decoded.

    An element that only its names mark stays if it holds a main, most of the text of
    articles, or most of the text with hardly an article beside it (of comments: nearly
    all). Text outside articles is measured by its long lines, by all where none is long. A declared article is all of the content unless it
    holds under a quarter of it.
    """
    blocks: list[tuple[str, bool, int, bool]] = []  # text, hard, innermost soft element, within main
    stack: list[tuple[str, bool, int, bool]] = []  # tag, then as above
    softs: list[list] = []  # parent, whether comments, whether a main is inside
    text: list[str] = []

    def state() -> tuple[bool, int, bool]:
        return stack[-1][1:] if stack else (False, -1, False)

    def flush() -> None:
        if text:
            block = " ".join("".join(text).split())
            text.clear()
            if block:
                blocks.append((block, *state()))

    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            text.append(html.unescape(m["text"]))
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
            continue
        if m["end"]:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if at is not None:
                # a loose end does not close what encloses its own block
                if tag in INLINE and any(s[0] not in INLINE for s in stack[at + 1:]):
                    continue
                if tag not in INLINE or state() != ((stack[at - 1][1:]) if at else (False, -1, False)):
                    flush()
                del stack[at:]
            elif tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
            while stack and (stack[-1][0] in INLINE or (stack[-1][0] in LOOSE and tag in LOOSE | {"div", "article", "section", "footer", "nav", "aside"}
                                                        and not (stack[-1][0] in ("li", "td", "th", "dd") and tag not in LOOSE)
                                                        and (tag == "p") <= (stack[-1][0] == "p"))):
                stack.pop()
        if tag in VOID or m["attrs"].endswith("/") and tag in INLINE:
            continue
        hard, soft, main = state()
        why = 0 if hard else _chrome(tag, m["attrs"], main)
        if why and tag in INLINE:
            flush()
        if why in (SOFT, COMMENTS):
            softs.append([soft, why == COMMENTS, False])
            soft = len(softs) - 1
        hard |= why == HARD
        if tag == "main" and not hard and soft >= 0:
            softs[soft][2] = True
        stack.append((tag, hard, soft, main or tag in MAIN_TAGS))
    flush()
    return _decide(blocks, softs)


def _decide(blocks: list[tuple[str, bool, int, bool]], softs: list[list]) -> list[tuple[str, int]]:
    """Kinds of the blocks of a page, see ``lines_of``."""
    long = any(len(t) >= LONG for t, hard, _, _ in blocks if not hard)
    weights = [0 if hard or long and len(t) < LONG and not main else len(t) for t, hard, _, main in blocks]
    every, articles = sum(weights), sum(w for w, b in zip(weights, blocks, strict=True) if b[3])
    held, told = [0] * len(softs), [0] * len(softs)
    for w, (_, _, soft, main) in zip(weights, blocks, strict=True):
        if soft >= 0:
            held[soft] += w
            told[soft] += w * main
    for k in range(len(softs) - 1, -1, -1):  # an element comes after what encloses it
        parent = softs[k][0]
        if parent >= 0:
            held[parent] += held[k]
            told[parent] += told[k]
            softs[parent][2] |= softs[k][2]
    stays: list[bool] = []
    for k, (parent, comments, has_main) in enumerate(softs):
        most = 10 * held[k] > 9 * every if comments else (2 * held[k] > every and 10 * (articles - told[k]) <= held[k]) or (2 * told[k] > articles and 4 * told[k] > every)
        stays.append((has_main or most) and (parent < 0 or stays[parent]))
    kinds = [0 if hard or soft >= 0 and not stays[soft] else 1 + main for _, hard, soft, main in blocks]
    declared, kept = (sum(w for w, k in zip(weights, kinds, strict=True) if k >= least) for least in (2, 1))
    if 2 in kinds and 4 * declared >= kept:
        kinds = [2 * (k == 2) for k in kinds]
    return [(b[0], k) for b, k in zip(blocks, kinds, strict=True)]


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of one longest common subsequence with ``b``: row by row over the
    bits of a big integer, or by matching pairs where the bit table would be large."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo:len(a) - hi], b[lo:len(b) - hi]
    where: dict[int, list[int]] = defaultdict(list)
    for j, v in enumerate(y):
        where[v].append(j)
    middle: list[int] = []
    if len(x) * len(y) <= 1 << 30:
        masks = {v: sum(1 << j for j in at) for v, at in where.items()}
        full, row, rows = (1 << len(y)) - 1, (1 << len(y)) - 1, []
        for v in x:
            u = row & masks.get(v, 0)
            row = ((row + u) | (row - u)) & full
            rows.append(row)
        j = len(y) - 1
        # zero bits of row i mark where the length grows along y
        for i in range(len(x) - 1, -1, -1):
            above = rows[i - 1] if i else full
            while j >= 0 and rows[i] >> j & 1:
                j -= 1
            if j < 0:
                break
            if bin(rows[i] & ((1 << (j + 1)) - 1)).count("1") != bin(above & ((1 << (j + 1)) - 1)).count("1"):
                middle.append(i)
                j -= 1
        middle.reverse()
    else:
        ends: list[int] = []
        links: list[tuple] = []
        for i, v in enumerate(x):
            for j in reversed(where.get(v, [])):
                k = bisect_left(ends, j)
                link = (i, links[k - 1] if k else None)
                if k == len(ends):
                    ends.append(j)
                    links.append(link)
                else:
                    ends[k], links[k] = j, link
        node = links[-1] if links else None
        while node:
            middle.append(node[0])
            node = node[1]
        middle.reverse()
    return [*range(lo), *(lo + i for i in middle), *range(len(a) - hi, len(a))]


def _url(c: Column) -> tuple[Column, Column]:
    """Host and path of an address, without port, user and query; empty if missing."""
    u = F.coalesce(c, F.lit(""))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*:|[?#].*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^//([^/]*)", 1), r"^.*@|:\d*$", ""))
    return host, F.regexp_replace(rest, r"^//[^/]*", "")


def compare(a: list[int], a_sizes: list[int], b: list[int], b_sizes: list[int]) -> tuple[list[int], list[int], bool, bool]:
    """Places in each of two pages of their common lines, and for each whether the other
    is a mirror of it: equal in what may be content, or nearly so with long text in common,
    or holding all of it, long text included. A size is four times the characters of a
    line plus its kind."""
    places = common_lines(a, b)
    others, j = [], 0
    for i in places:
        while b[j] != a[i]:
            j += 1
        others.append(j)
        j += 1
    text_a, text_b = (sum(s >> 2 for s in sizes if s & 3) for sizes in (a_sizes, b_sizes))
    shared = [a_sizes[i] >> 2 for i in places if a_sizes[i] & 3]
    own_a, own_b = text_a - sum(shared), text_b - sum(b_sizes[k] >> 2 for k in others if b_sizes[k] & 3)
    long = 2 * sum(n for n in shared if n >= LONG) >= sum(shared)
    near = OWN * own_a <= text_a and OWN * own_b <= text_b and long or own_a == own_b == 0
    return places, others, near or own_a == 0 and long, near or own_b == 0 and long


def _beyond(starts: DataFrame) -> DataFrame:
    """Of rows rn with a mark where a run starts: the last row before a row's run and
    the first after it. Range partitions, each continued from its neighbours."""
    ranged = cut_lineage(starts.select("rn", F.when(F.col("start"), F.col("rn")).alias("s")).repartitionByRange("rn")
                         .withColumn("part", F.spark_partition_id()))
    order = W.orderBy("part")
    parts = ranged.groupBy("part").agg(F.max("s").alias("hi"), F.min("s").alias("lo")).select(
        "part", F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1)).alias("hi"),
        F.min("lo").over(W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)).alias("lo"))
    w = W.partitionBy("part")
    inside = ranged.select("rn", "part", F.max("s").over(w.orderBy("rn").rowsBetween(W.unboundedPreceding, 0)).alias("first"),
                           F.min("s").over(w.orderBy(F.desc("rn")).rowsBetween(W.unboundedPreceding, -1)).alias("next"))
    return inside.join(parts, "part").select("rn", (F.coalesce("first", "hi") - 1).alias("before"), F.coalesce("next", "lo").alias("after"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row.

    Blocks are read once per page; what the structure marks as menu, header, footer,
    sidebar, notice, advert, form or comment goes. Pages with text are sorted by host and
    path (a range sort, so a host of any size spreads) and each is aligned with the one of
    its two neighbours of the same host that shares more of its path; lines in their
    longest common subsequence are deleted, as a template repeats them, whatever their
    share of the page. Mirrors share their content too (see ``compare``): they are passed
    over, run by run, up to the nearest page of the host that is none, and a page whose
    host has mirrors only keeps its lines. Text inside a declared article is never
    deleted. Null html counts as empty, a null or odd URL as a page of the empty host;
    repeated rows repeat (identical pages are mirrors of each other). A very long page is
    read whole; an empty table gives no rows; other columns are not read.
    """
    t = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(page), F.lit("")).alias("html"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh64_intdigest
        for b in batches:
            all_lines = [lines_of(h) for h in b["html"]]
            yield pd.DataFrame({
                "page_id": b["page_id"], "url": b["url"],
                "marks": [np.array([digest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x, _ in ls], np.int64) for ls in all_lines],
                "sizes": [np.array([4 * len(x) + k for x, k in ls], np.int64) for ls in all_lines],
                "lines": [[x for x, k in ls if k] for ls in all_lines]})

    kind = pages.select(page_id).schema.fields[0].dataType.simpleString()
    host, path = _url(F.col("url"))
    known = stage_table(t.mapInPandas(read, f"page_id {kind}, url string, marks array<long>, sizes array<long>, lines array<string>")
                        .withColumns({"host": host, "path": path, "id": F.monotonically_increasing_id()}), compression="zstd")
    some = known.filter(F.size("marks") > 0)
    order = numbered(some.select("id", "host", "path"), [], ["host", "path", "id"], "rn")
    placed = stage_table(order.join(some.select("id", "marks", "sizes"), "id").select("id", "rn", "host", "path", "marks", "sizes"), compression="zstd")
    sides = [placed.select(*[F.col(c).alias(f"{c}_{x}") for c in placed.columns]) for x in "ab"]

    def differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def depth(a: str, b: str) -> int:
            x, y, n = a.split("/"), b.split("/"), 0
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
            return n

        def gone(sizes: list[int], places: list[int]) -> list[int] | None:
            """Places among the lines that are kept of the open ones; None if all is declared."""
            if not any(s & 3 == 1 for s in sizes):
                return None
            place = np.cumsum([s & 3 > 0 for s in sizes]) - 1
            return [int(place[i]) for i in places if sizes[i] & 3 == 1]

        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                a_sizes, b_sizes = list(r.sizes_a), list(r.sizes_b)
                places, others, mirror_a, mirror_b = compare(list(r.marks_a), a_sizes, list(r.marks_b), b_sizes)
                out.append((r.id_a, r.rn_a, r.id_b, r.rn_b, depth(r.path_a, r.path_b), mirror_a, mirror_b, gone(a_sizes, places), gone(b_sizes, others)))
            yield pd.DataFrame(out, columns=["id_a", "rn_a", "id_b", "rn_b", "depth", "mirror_a", "mirror_b", "gone_a", "gone_b"])

    def compared(pairs: DataFrame) -> DataFrame:
        return stage_table(pairs.filter("host_a = host_b").drop("host_a", "host_b").mapInPandas(
            differ, "id_a long, rn_a long, id_b long, rn_b long, depth int, mirror_a boolean, mirror_b boolean, gone_a array<int>, gone_b array<int>"))

    def options(found: DataFrame, x: str, y: str) -> DataFrame:
        return found.filter(F.col(f"gone_{x}").isNotNull()).select(
            F.col(f"id_{x}").alias("id"), F.col(f"rn_{x}").alias("rn"), F.col(f"mirror_{x}").alias("mirror"), F.col(f"gone_{x}").alias("gone"),
            F.struct("depth", F.col(f"rn_{x}") > F.col(f"rn_{y}")).alias("near"))

    def chosen(choice: DataFrame) -> DataFrame:
        """The lines to delete of each page, null where only mirrors were met."""
        return stage_table(choice.groupBy("id", "rn").agg(F.max_by(F.when(~F.col("mirror"), F.col("gone")), F.when(~F.col("mirror"), F.col("near"))).alias("gone")))

    first = compared(sides[0].join(sides[1], F.col("rn_a") + 1 == F.col("rn_b")))
    done = [chosen(options(first, "a", "b").unionByName(options(first, "b", "a")))]
    left = done[0].filter("gone is null").select("id", "rn")
    if not left.isEmpty():
        follows = first.filter("mirror_a and mirror_b").select(F.col("rn_b").alias("rn"), F.lit(False).alias("start"))
        runs = stage_table(_beyond(placed.select("rn").join(follows, "rn", "left").select("rn", F.coalesce("start", F.lit(True)).alias("start"))))
        turn = stage_table(left.join(runs, "rn"))
        while not turn.isEmpty():
            aims = turn.select(F.col("rn").alias("rn_a"), F.explode(F.array("before", "after")).alias("rn_b")).filter("rn_b is not null")
            met = compared(aims.join(sides[0], "rn_a").join(sides[1], "rn_b"))
            done.append(chosen(options(met, "a", "b")))
            # on to the runs behind, on the sides where the host goes on
            on = met.filter("mirror_a").select(F.col("rn_a").alias("rn"), "rn_b").join(
                done[-1].filter("gone is null").select("id", "rn"), "rn").join(runs.withColumnRenamed("rn", "rn_b"), "rn_b")
            turn = stage_table(on.groupBy("id", "rn").agg(F.max(F.when(F.col("rn_b") < F.col("rn"), F.col("before"))).alias("before"),
                                                          F.max(F.when(F.col("rn_b") > F.col("rn"), F.col("after"))).alias("after")))
    gone = done[0]
    for more in done[1:]:
        gone = gone.unionByName(more)
    gone = gone.filter("gone is not null").select("id", "gone")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)))
    out = known.select("id", "page_id", "url", "lines").join(gone, "id", "left").select("page_id", "url", F.array_join(kept, "\n").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
