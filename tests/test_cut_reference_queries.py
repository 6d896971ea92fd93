"""The queries on titles and headings whose last reference lacks its semicolon, and the addresses
that hold a year: what HTML and the reference's rule say where the SQL is narrower."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import normal

SF = "/root/testdata/sf0.001"
NAMES = ["crawl_export", "draft_titles", "extract_pages", "site_profile", "subjects", "title_px", "title_widths"]


@pytest.fixture(scope="module", params=["amp", "quot"])
def folders(request, tmp_path_factory):
    out = {}
    for tag, end in (("cut", ""), ("whole", ";")):
        out[tag] = tmp_path_factory.mktemp(request.param + tag)
        ref = f"&{request.param}{end}"
        duckdb.connect().execute(f"""COPY (SELECT page_id, url, replace(replace(html, '</title>', '{ref}</title>'), '</h1>', '{ref}</h1>') AS html
          FROM '{SF}/pages.parquet') TO '{out[tag]}/pages.parquet'""")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_both_forms_decode_alike(spark, folders, name):
    cut, whole = (entry.queries()[name](spark, str(folders[tag])) for tag in ("cut", "whole"))
    got = normal(whole.columns, [tuple(r) for r in whole.collect()])
    assert normal(cut.columns, [tuple(r) for r in cut.collect()]) == got
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folders['whole']}/pages.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    assert got == normal([d[0] for d in cur.description], cur.fetchall())


def test_a_year_in_the_address_is_news(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (p_partkey + 1950 AS p_partkey) FROM '{SF}/part.parquet') TO '{tmp_path}/part.parquet'")
    years, n = con.execute(f"SELECT count(*) FILTER (WHERE p_partkey BETWEEN 2000 AND 2099), count(*) FROM '{tmp_path}/part.parquet'").fetchone()
    got = {r.kind: r.n for r in entry.queries()["serp_page_kinds"](spark, str(tmp_path)).collect()}
    assert years == 100 and got == {"news": 3 * years, "other": 3 * (n - years)}
