"""The step that the duplicate queries share: hashes, one reading of the texts, exact prefixes."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sitegrid.functions import text as X
from sitegrid.operators import dedupe
from tools.check import TABLES, normal

SF = "/root/testdata/sf0.001"


def test_content_hash_is_that_of_the_plain_text(spark):
    texts = ["", " ", "A b-C, d", "Ünïcode über 9 z", "``a` {b}\nc\td", None, "İß ſ K"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.sha1(F.regexp_replace(F.lower("t"), "[^a-z0-9 ]+", ""))
    assert df.filter(~X.content_hash(F.col("t")).eqNullSafe(plain)).count() == 0


def test_shingle_hashes_count_as_the_shingles(spark):
    df = spark.createDataFrame([("a b c d e f a b c d e f",), ("a b c d",), ("",), ("one two, three four five",)], "t string")
    t = F.col("t")
    assert df.filter(F.size(X.whole_shingles(t)) != F.size(X.whole_shingle_hashes(t))).count() == 0


def test_texts_are_read_once(spark):
    """Counting and listing both took the key from the text: two scans of it."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(url):
        seen.add(1)
        return url[:1]

    rows = spark.createDataFrame([("r", "s", u) for u in ("a1", "a2", "b1")], "run_id string, site string, url string")
    got = dedupe.duplicate_members(rows.withColumn("k", key.asNondeterministic()("url")), "k").collect()
    assert sorted((r.url, r.n, r.first_url) for r in got) == [("a1", 2, "a1"), ("a2", 2, "a1")]
    assert seen.value == 3


def test_sites_and_empty_texts_stay_apart(spark):
    text = "one two three four five six seven eight nine ten"
    rows = spark.createDataFrame([("r", s, f"{s}{i}", t, f"{i}") for s in ("p", "q") for i, t in enumerate([text, text + " x", "short"])]
                                 + [("r", None, "n0", text, "0"), ("r", None, "n1", text + " x", "1")],
                                 "run_id string, site string, url string, body_text string, content_hash string")
    rows = rows.withColumn("shingles", X.whole_shingle_hashes(F.col("body_text")))
    pairs = dedupe.near_duplicates(rows).select("site", "url_a", "url_b").collect()
    assert sorted(tuple(r) for r in pairs) == [("p", "p0", "p1"), ("q", "q0", "q1")]
    families = dedupe.near_duplicate_families(rows).select("site", "url", "representative", "family_size").collect()
    assert sorted(tuple(r) for r in families) == [(s, f"{s}{i}", f"{s}0", 2) for s in ("p", "q") for i in (0, 1)]


@pytest.mark.parametrize("name", ["duplicate_members", "duplicate_docs", "near_duplicates", "near_duplicate_families"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(cols, cur.fetchall())
