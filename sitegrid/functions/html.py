"""Markup walk: one HTML document to the page fields that need element structure.

Spark partitions the pages and hands Arrow batches to ``markup``; everything
that a regular expression can read stays in native column expressions.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .. import fixed_values as V
from ..schemas import MARKUP
from .urls import resolve_url

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HEAD_ONLY = {"html", "head", "title", "meta", "link", "script", "style", "base", "noscript", "template"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "font", "i", "kbd", "label", "mark", "p", "q", "s",
           "small", "span", "strike", "strong", "sub", "sup", "tt", "u"}
_PAGES = 64
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_WS = re.compile(V.WS + "+")
_NO_FETCH = re.compile(r"(mailto:|tel:|javascript:|#)", re.I)
_NOFOLLOW = re.compile(r"\bnofollow\b", re.A)


def _squash(text: str) -> str:
    if "\ufeff" in text:   # the only one of V.WS that split() does not know
        return _WS.sub(" ", text).strip()
    return " ".join(text.split())


class _Walk(HTMLParser):
    """Keeps the open elements on a stack, with the text sinks they feed."""

    def __init__(self, base: str | None):
        super().__init__(convert_charrefs=True)
        self.base = base
        self.open: list[tuple[str, frozenset, list | None]] = []
        self.inside = dict.fromkeys(("head", "nav", "foot", "boiler", "main"), 0)
        self.body_seen = self.main_seen = False
        self.text_body: list[str] = []
        self.text_main: list[str] = []
        self.text_raw: list[str] = []
        self.text_noscript: list[str] = []
        self.sinks: list[list] = []
        self.titles: list[list] = []
        self.headings: list[tuple[int, list]] = []
        self.anchors: list[dict] = []
        self.images: list[dict] = []
        self.ld_blocks: list[list] = []
        self.script_text: list[list] = []
        self.scripts = 0
        self.descriptions: list[str] = []
        self.robots: list[dict] = []
        self.canonicals: list[str] = []
        self.hreflang: list[dict] = []
        self.itemtypes: list[str] = []
        self.og: dict[str, str] = {}
        self.lang = self.viewport = self.charset = self.prev = self.next = None
        self.crumb = self.author = False

    def updatepos(self, i, j):
        """Lines and columns are not asked for."""
        return j

    # -- elements -----------------------------------------------------------------
    def handle_starttag(self, tag, attrs):
        a: dict[str, str] = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag == "html" and a.get("lang") and self.lang is None:
            self.lang = a["lang"]
        if tag not in _HEAD_ONLY and not self.inside["head"]:
            self.body_seen = True
        self._note(tag, a)
        if tag == "a":
            self._close_nearest("a")
        elif tag in _HEADINGS:
            while self.open and self.open[-1][0] in _HEADINGS:
                self._pop()
        sink = self._sink(tag, a)
        if tag in _VOID:
            return
        marks = self._marks(tag, a)
        for m in marks:
            self.inside[m] += 1
        self.open.append((tag, marks, sink))
        if sink is not None:
            self.sinks.append(sink)

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag in _INLINE:
            self._close_nearest(tag)
        elif any(t == tag for t, _, _ in self.open):
            while self.open and self._pop() != tag:
                pass

    def _pop(self, at: int = -1) -> str:
        tag, marks, sink = self.open.pop(at)
        for m in marks:
            self.inside[m] -= 1
        if sink is not None:
            self.sinks[:] = [s for s in self.sinks if s is not sink]
        return tag

    def _close_nearest(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._pop(i)
                return

    def _marks(self, tag, a) -> frozenset:
        role = a.get("role", "")
        classes = a.get("class", "").split()
        marks = set()
        if tag == "head":
            marks.add("head")
        if tag in ("nav", "header") or role == "navigation":
            marks.add("nav")
        if tag == "footer" or role == "contentinfo":
            marks.add("foot")
        if tag in V.BOILERPLATE_TAGS or role in V.BOILERPLATE_ROLES:
            marks.add("boiler")
        is_main = tag in V.MAIN_TAGS or role == "main" or any(c in V.MAIN_CLASSES for c in classes)
        if is_main and not self.main_seen and not self.inside["boiler"] and "boiler" not in marks:
            self.main_seen = True
            marks.add("main")
        return frozenset(marks)

    def _note(self, tag, a):
        ident = (a.get("class", "") + "\n" + a.get("id", "")).lower()
        if "breadcrumb" in ident or (tag == "nav" and "readcrumb" in a.get("aria-label", "").lower()):
            self.crumb = True
        if a.get("rel", "").lower() == "author" or "author" in a.get("class", "").lower() \
                or a.get("itemprop") == "author":
            self.author = True
        if "itemtype" in a:
            self.itemtypes.append(a["itemtype"].rsplit("/", 1)[-1])
        if tag == "meta":
            name, content = a.get("name"), a.get("content")
            if name == "description":
                self.descriptions.append(content or "")
            elif name == "viewport" and self.viewport is None:
                self.viewport = content or None
            if name and name.lower() in ("robots", "googlebot"):
                self.robots.append({"name": name.lower(), "content": (content or "").lower().strip()})
            if "charset" in a and self.charset is None:
                self.charset = a["charset"] or None
            if a.get("property", "").startswith("og:"):
                self.og.setdefault(a["property"][3:], content or None)
        elif tag == "link":
            rel, href = a.get("rel", "").lower(), a.get("href")
            if rel == "canonical" and href:
                self.canonicals.append(resolve_url(href, self.base))
            elif rel == "alternate" and "hreflang" in a:
                self.hreflang.append({"lang": a["hreflang"], "href": resolve_url(href, self.base)})
            elif rel in ("prev", "next") and getattr(self, rel) is None:
                setattr(self, rel, href or None)
        elif tag == "img":
            src = a.get("src") or a.get("data-src") or a.get("data-lazy-src") or ""
            self.images.append({
                "src": resolve_url(src, self.base) if src else None, "raw_src": src, "alt": a.get("alt"),
                "has_alt": "alt" in a, "width": a.get("width") or None, "height": a.get("height") or None,
                "loading": a.get("loading", "").lower() or None, "index": len(self.images),
                "above_fold": len(self.images) < V.ABOVE_FOLD_IMAGES,
                "decorative": a.get("role") == "presentation" or a.get("aria-hidden") == "true",
            })
            for link in self.anchors[-1:]:
                if any(t == "a" for t, _, _ in self.open) and link["img_alt"] is None:
                    link["img_alt"] = (a.get("alt") or "").strip()

    def _sink(self, tag, a) -> list | None:
        sink: list = []
        if tag == "title":
            if self.inside["head"] or not self.body_seen:
                self.titles.append(sink)
                return sink
        elif tag in _HEADINGS:
            self.headings.append((int(tag[1]), sink))
            return sink
        elif tag == "a":
            self.anchors.append({
                "a": a, "text": sink, "img_alt": None,
                "nav": self.inside["nav"] > 0 or a.get("role") == "navigation",
                "foot": self.inside["foot"] > 0 or a.get("role") == "contentinfo",
            })
            return sink
        elif tag == "noscript":
            return self.text_noscript
        elif tag == "script":
            self.scripts += 1
            if a.get("type", "").lower() == "application/ld+json":
                self.ld_blocks.append(sink)
            if "src" not in a:
                self.script_text.append(sink)
            return sink
        return None

    # -- text ----------------------------------------------------------------------
    def handle_data(self, data):
        for sink in self.sinks:
            sink.append(data)
        if self.inside["head"] or (not self.body_seen and self.open
                                   and self.open[-1][0] in ("title", "script", "style", "noscript")):
            return
        self.text_raw.append(data)
        if not self.inside["boiler"]:
            self.text_body.append(data)
            if self.inside["main"]:
                self.text_main.append(data)


def _link(entry: dict, base: str | None) -> dict:
    a = entry["a"]
    href, rel = a.get("href") or None, a.get("rel", "").lower()
    anchor = _squash("".join(entry["text"])) or (entry["img_alt"] or "") or a.get("aria-label", "").strip()
    out = {"href": href, "resolved": None, "anchor": anchor, "rel": rel, "nofollow": False, "in_nav": False,
           "in_footer": False, "no_href": href is None, "special": False}
    if href is None:
        return out
    if _NO_FETCH.match(href):
        out["special"] = True
        return out
    out.update(resolved=resolve_url(href, base), nofollow=bool(_NOFOLLOW.search(rel)),
               in_nav=entry["nav"], in_footer=entry["foot"])
    return out


def _no_constant(name):
    raise ValueError(f"{name} is not JSON")


def walk(html: str | None, base: str | None) -> dict | None:
    if html is None:
        return None
    w = _Walk(base)
    w.feed(html)
    w.close()
    blocks, errors = [], []
    for block in w.ld_blocks:
        try:
            parsed = json.loads("".join(block), parse_constant=_no_constant)
            blocks += [json.dumps(o, ensure_ascii=False) for o in (parsed if isinstance(parsed, list) else [parsed])]
        except ValueError as e:
            errors.append(str(e)[:160])
    return {
        "title": "".join(w.titles[0]).strip() if w.titles else "", "title_count": len(w.titles),
        "meta_description": w.descriptions[0].strip() if w.descriptions else "",
        "meta_description_count": len(w.descriptions),
        "lang": w.lang, "viewport": w.viewport, "charset": w.charset, "meta_robots": w.robots,
        "tag_canonicals": [c for c in w.canonicals if c],
        "headings": [{"level": lv, "text": _squash("".join(t))} for lv, t in w.headings],
        "links": [_link(e, base) for e in w.anchors], "images": w.images,
        "jsonld": blocks, "jsonld_errors": errors,
        "microdata_types": list(dict.fromkeys(w.itemtypes)), "hreflang": w.hreflang,
        "prev": w.prev, "next": w.next,
        "og": {k: w.og.get(k) for k in ("title", "description", "image", "type")},
        "body_text": _squash("".join(w.text_main if w.main_seen else w.text_body)),
        "raw_body_text_length": len(_squash("".join(w.text_raw))),
        "script_count": w.scripts, "inline_script_bytes": sum(len("".join(t)) for t in w.script_text),
        "has_noscript_content": len("".join(w.text_noscript).strip()) > 200,
        "has_breadcrumb_el": w.crumb, "has_author_el": w.author,
    }


@F.arrow_udf(MARKUP)
def _markup(html: pa.Array, base: pa.Array) -> pa.Array:
    """Walks a few pages at a time: of a batch of thousands only the columns are held."""
    kind = to_arrow_type(MARKUP)
    parts = [pa.array([walk(h.as_py(), b.as_py()) for h, b in zip(html[i:i + _PAGES], base[i:i + _PAGES])], type=kind)
             for i in range(0, len(html), _PAGES)]
    return pa.concat_arrays(parts) if parts else pa.array([], type=kind)


# Never pushed into filters or evaluated twice.
markup = _markup.asNondeterministic()


def register_sql(spark) -> None:
    """Makes the walk available to SQL as ``html_extract(html, base_url)``."""
    spark.udf.register("html_extract", _markup)
