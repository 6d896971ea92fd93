"""Column types of the tables the operators exchange."""

from pyspark.sql import types as T

_s, _i, _l, _b, _d = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType()


def _struct(**fields):
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


HEADING = _struct(level=_i, text=_s)
LINK = _struct(href=_s, resolved=_s, anchor=_s, rel=_s, nofollow=_b, in_nav=_b, in_footer=_b,
               no_href=_b, special=_b)
IMAGE = _struct(src=_s, raw_src=_s, alt=_s, has_alt=_b, width=_s, height=_s, loading=_s,
                index=_i, above_fold=_b, decorative=_b)
HREFLANG = _struct(lang=_s, href=_s)
DIRECTIVE = _struct(name=_s, content=_s)
SOCIAL = _struct(title=_s, description=_s, image=_s, type=_s)

# what the markup walk yields for one page
MARKUP = _struct(
    title=_s, title_count=_i, meta_description=_s, meta_description_count=_i,
    lang=_s, viewport=_s, charset=_s, meta_robots=T.ArrayType(DIRECTIVE),
    tag_canonicals=T.ArrayType(_s), headings=T.ArrayType(HEADING), links=T.ArrayType(LINK),
    images=T.ArrayType(IMAGE), jsonld=T.ArrayType(_s), jsonld_errors=T.ArrayType(_s),
    microdata_types=T.ArrayType(_s), hreflang=T.ArrayType(HREFLANG), prev=_s, next=_s, og=SOCIAL,
    body_text=_s, raw_body_text_length=_i, script_count=_i, inline_script_bytes=_i,
    has_noscript_content=_b, has_breadcrumb_el=_b, has_author_el=_b,
)

PAGES_RAW = _struct(
    run_id=_s, site=_s, url=_s, final_url=_s, depth=_i, linked_from=T.ArrayType(_s), status=_i, hops=_i,
    content_type=_s, bytes=_l, response_ms=_i, error=_s, discovered_via=_s, robots_allowed=_b,
    robots_rule=_s, headers=T.MapType(_s, _s), html=_s,
)
CRAWLS = _struct(run_id=_s, site=_s, start_url=_s, origin=_s, robots_status=_i, truncated=_b, queue_left=_l)
ROBOTS_TXT = _struct(run_id=_s, site=_s, status=_i, body=_s)
HOPS = T.StructType([T.StructField(n, t) for n, t in
                     [("run_id", _s), ("site", _s), ("from", _s), ("to", _s), ("status", _i)]])
SITEMAP_DOCS = _struct(run_id=_s, site=_s, url=_s, body=_s)
SITEMAP = _struct(run_id=_s, site=_s, loc=_s, lastmod=_s, priority=_s, source=_s)
ROBOTS_RULES = _struct(run_id=_s, site=_s, grp=_i, agent=_s, type=_s, path=_s)
FINDINGS = _struct(
    run_id=_s, site=_s, rule=_s, severity=_s, stage=_s, owner=_s, effort=_s, evidence=_s, n_urls=_l,
    title=_s, example_url=_s, what=_s, why=_s, fix=_s, acceptance=_s,
)
