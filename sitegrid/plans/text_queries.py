"""Queries over document text: measures, sentences, summaries, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text as X
from ..operators import answers as J
from ..operators import summarise as N
from ..sources import documents as SD
from . import adapters as A
from .registry import query
from .sql import ANSWERS, pct, px, rx, squash, words_of

_SQ = squash("text")


@query("text_measures", f"""WITH t AS (SELECT doc_id, {_SQ} AS s FROM documents) SELECT doc_id, {words_of('s')} AS words, {px('s')} AS px,
  sha1(regexp_replace(lower(s), '[^a-z0-9 ]+', '', 'g')) AS hash FROM t""")
def text_measures(spark, sf):
    s = X.squash(F.col("text"))
    return A.table(spark, sf, "documents").select(
        "doc_id", X.word_count(F.col("text")).cast("bigint").alias("words"), X.pixel_width(s).alias("px"), X.content_hash(s).alias("hash"))


@query("phones", f"""WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(unnest(regexp_extract_all(text, {rx(V.PHONE)})), '[^0-9]', '', 'g'), '^1', '') AS phone FROM documents)
  SELECT DISTINCT doc_id, phone FROM p WHERE length(phone) = 10""")
def phones(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", F.explode(X.phones(F.col("text"))).alias("phone"))


_J = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''))"


@query("jaccard", f"""WITH d AS (SELECT doc_id, {_J.format(x="text")} AS a, {_J.format(x="substr(text, 1, 200)")} AS b FROM documents)
  SELECT doc_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) ELSE 0.0 END AS score FROM d""")
def jaccard(spark, sf):
    d = A.table(spark, sf, "documents")
    a, b = X.alnum_tokens(F.col("text")), X.alnum_tokens(F.substring("text", 1, 200))
    return d.select("doc_id", F.round(X.jaccard(a, b), 6).alias("score"))


@query("platforms", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'WordPress,Elementor' WHEN page_id % 3 = 1 THEN 'BigCommerce,Next.js' ELSE '' END AS platform FROM pages""")
def platforms(spark, sf):
    i = F.col("page_id")
    mark = F.when(i % 3 == 0, "/WP-Content/themes/elementor.css").when(
        i % 3 == 1, "cdn11.bigcommerce.com __NEXT_DATA__").otherwise("individual division __next_data__")
    p = A.table(spark, sf, "pages").select("page_id", F.concat("html", mark).alias("html"))
    return p.select("page_id", F.array_join(X.detect_platform(F.col("html"), F.create_map().cast("map<string,string>")), ",").alias("platform"))


# --- sentences ---------------------------------------------------------------------------------

_ABBR = r"\b(Mr|Mrs|Ms|Dr|Prof|Inc|Ltd|Co|vs|etc|e\.g|i\.e|St|No)\.\s"
_SENT = rf"""st AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '[\s\x{{00a0}}]+', ' ', 'g'), '{_ABBR}', '\1' || chr(1) || ' ', 'g'),
  '([.!?]) +', '\1' || chr(2), 'g'), chr(2)), lambda s: trim(replace(s, chr(1), '.'))), lambda s: length(s) > 30 AND regexp_matches(s, '[A-Za-z]')) AS s FROM documents),
sn AS (SELECT doc_id, len(s) AS n, unnest(s) AS sentence, unnest(range(len(s))) AS i FROM st)"""
_STOP = "[" + ",".join(f"'{w}'" for w in V.SUMMARY_STOP.split()) + "]"
_TF = f"""{_SENT}, wd AS (SELECT doc_id, i, word FROM (SELECT doc_id, i, unnest(regexp_extract_all(lower(sentence), '[a-z][a-z''-]+')) AS word FROM sn) WHERE length(word) > 2 AND word NOT IN (SELECT unnest({_STOP}))),
fr AS (SELECT doc_id, word, count(*) AS n FROM wd GROUP BY ALL)"""


@query("split_sentences", f"WITH {_SENT} SELECT doc_id, CAST(i AS INTEGER) AS i, sentence FROM sn")
def split_sentences(spark, sf):
    return N.sentences(A.table(spark, sf, "documents")).select("doc_id", "i", "sentence")


@query("term_frequency", f"WITH {_TF} SELECT doc_id, word, n FROM fr")
def term_frequency(spark, sf):
    return N.term_frequency(A.table(spark, sf, "documents"), k=None)


@query("top_terms", f"WITH {_TF} SELECT doc_id, word, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS INTEGER) AS rank FROM fr) WHERE rank <= 12")
def top_terms(spark, sf):
    return N.term_frequency(A.table(spark, sf, "documents"), k=12)


@query("sentence_scores", f"""WITH {_TF}, pk AS (SELECT doc_id, max(n) AS peak FROM fr GROUP BY doc_id),
  tf AS (SELECT wd.doc_id, wd.i, sum(fr.n) AS mass, count(*) AS m FROM wd JOIN fr USING (doc_id, word) GROUP BY ALL)
  SELECT sn.doc_id, CAST(sn.i AS INTEGER) AS i, round(coalesce(mass::DOUBLE / m / peak, 0.0) * (CASE WHEN sn.i = 0 THEN 1.35::DOUBLE WHEN sn.i = 1 THEN 1.15::DOUBLE WHEN sn.i < sn.n * 0.3::DOUBLE THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END)
  * (CASE WHEN length(sentence) > 260 THEN 0.8::DOUBLE WHEN length(sentence) < 60 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END), 6) AS score
  FROM sn LEFT JOIN tf USING (doc_id, i) LEFT JOIN pk USING (doc_id)""")
def sentence_scores(spark, sf):
    return N.score_sentences(A.table(spark, sf, "documents")).select("doc_id", "i", F.round("score", 6).alias("score"))


@query("summarize")
def summarize(spark, sf):
    return N.summarize(A.table(spark, sf, "documents")).select("doc_id", "summary")


@query("excerpt")
def excerpt(spark, sf):
    return N.excerpt(A.table(spark, sf, "documents")).select("doc_id", "summary")


# --- answers ----------------------------------------------------------------------------------------

_SC = f"""{ANSWERS}, sc AS (SELECT *, ok AND regexp_matches(answer, '(?i)(^|[^a-z0-9])Acme([^a-z0-9]|$)') AS named, ok AND regexp_matches(answer, '(?i)(^|[^a-z0-9.-])acme\\.com([^a-z0-9-]|$)') AS cited,
  CASE conv_id % 5 WHEN 0 THEN 10.0::DOUBLE WHEN 1 THEN 5.0::DOUBLE END AS sentiment FROM ans)"""


def _scored(spark, sf):
    return J.score_answers(A.answers(spark, sf), "Acme", "https://www.acme.com/", ["Beta Works"])


@query("score_answers", f"""WITH {_SC} SELECT conv_id, turn, coalesce(named, FALSE) AS named, coalesce(cited, FALSE) AS cited, CASE WHEN ok AND named THEN sentiment ELSE -1.0::DOUBLE END AS sentiment,
  CASE WHEN ok AND named THEN 1 ELSE 0 END AS position FROM sc""")
def score_answers(spark, sf):
    no = F.lit(False)
    return _scored(spark, sf).select("conv_id", "turn", F.coalesce("named", no).alias("named"), F.coalesce("cited", no).alias("cited"),
                                     F.coalesce("sentiment", F.lit(-1.0)).alias("sentiment"), F.coalesce("position", F.lit(0)).alias("position"))


@query("visibility_score", f"""WITH {_SC} SELECT run_id, CAST(floor(count(*) FILTER (WHERE named)::DOUBLE / count(*) FILTER (WHERE ok) * 60 + count(*) FILTER (WHERE cited)::DOUBLE / count(*) FILTER (WHERE ok) * 40 + 0.5::DOUBLE) AS BIGINT) AS score,
  {pct('count(*) FILTER (WHERE named)', 'count(*) FILTER (WHERE ok)')} AS named_rate, {pct('count(*) FILTER (WHERE cited)', 'count(*) FILTER (WHERE ok)')} AS cited_rate,
  count(*) FILTER (WHERE ok) AS answered, count(*) AS attempted FROM sc GROUP BY run_id""")
def visibility_score(spark, sf):
    return J.visibility_score(_scored(spark, sf)).drop("sentiment")


@query("visibility_by_prompt", f"""WITH {_SC}, r AS (SELECT prompt, run_id, count(*) AS n, count(*) FILTER (WHERE named) AS named, count(*) FILTER (WHERE cited) AS cited FROM sc WHERE ok GROUP BY ALL)
  SELECT prompt, {pct('sum(named)', 'sum(n)')} AS visibility, {pct('sum(cited)', 'sum(n)')} AS cited_rate, CAST(sum(n) AS BIGINT) AS samples,
  coalesce(CASE WHEN count(*) >= 2 THEN CAST(floor((arg_max(named, run_id) - arg_min(named, run_id))::DOUBLE / greatest(1, arg_min(named, run_id)) * 100 + 0.5::DOUBLE) AS BIGINT) END, -999) AS trend FROM r GROUP BY prompt""")
def visibility_by_prompt(spark, sf):
    v = J.visibility_by_prompt(_scored(spark, sf))
    return v.select("prompt", "visibility", "cited_rate", "samples", F.coalesce("trend", F.lit(-999)).alias("trend"))


@query("share_of_voice")
def share_of_voice(spark, sf):
    return J.share_of_voice(_scored(spark, sf), "Acme")


@query("brand_mentions", f"""WITH {_SC} SELECT run_id, count(*) FILTER (WHERE named) AS acme, count(*) FILTER (WHERE regexp_matches(answer, '(?i)(^|[^a-z0-9])Beta Works([^a-z0-9]|$)')) AS beta FROM sc WHERE ok GROUP BY run_id""")
def brand_mentions(spark, sf):
    b = _scored(spark, sf).filter(F.col("error").isNull())
    return b.groupBy("run_id").agg(
        F.count_if(F.array_contains("brands", "Acme")).alias("acme"), F.count_if(F.array_contains("brands", "Beta Works")).alias("beta"))


@query("suggest_prompts", """SELECT s_name AS name, CAST(len(list_distinct(['best repair in ' || s_nationkey, 'how do I choose a repair', 'is ' || s_name || ' any good', s_name || ' alternatives', 'who should I use for repairs in ' || s_nationkey])) AS BIGINT) AS n FROM supplier""")
def suggest_prompts(spark, sf):
    b = A.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.array(F.lit("Repairs")).alias("services"),
                                              F.array(F.col("s_nationkey").cast("string")).alias("locations"))
    return J.suggest_prompts(b).groupBy("name").agg(F.count("*").alias("n"))


# --- saved documents -----------------------------------------------------------------------------------

@query("read_serp_pages", """SELECT p_name || ' ' || p_partkey AS query, CAST(i AS INTEGER) AS position, 'https://r' || i || '.example.com/' || p_partkey AS url, 'Result ' || i || ' & more' AS title
  FROM part, (SELECT unnest([1, 2, 3]) AS i)""")
def read_serp_pages(spark, sf):
    return SD.read_serp_pages(serp_pages(spark, sf))


def serp_pages(spark, sf):
    k = F.col("p_partkey").cast("string")
    links = [F.concat(F.lit(f'<div><a rel="nofollow" class="result__a" href="//go?uddg=https%3A%2F%2Fr{i}.example.com%2F'), k,
                      F.lit(f'&amp;x=1">Result <b>{i}</b> &amp; more</a></div>')) for i in (1, 2, 3)]
    return A.table(spark, sf, "part").select(F.concat("p_name", F.lit(" "), k).alias("query"), F.concat(*links).alias("html"))


@query("read_behaviour", """SELECT 'Dead Click Count' AS metric, CAST(sum(event_id % 1500) AS DOUBLE) AS value FROM events UNION ALL SELECT 'sessions', CAST(sum(user_id) AS DOUBLE) FROM events
  UNION ALL SELECT 'bot_sessions', CAST(count(*) AS DOUBLE) FROM events""")
def read_behaviour(spark, sf):
    return SD.behaviour_rows(behaviour_docs(spark, sf)).groupBy("metric").agg(F.sum("value").alias("value"))


def behaviour_docs(spark, sf):
    e = A.table(spark, sf, "events")
    n = F.format_number(F.col("event_id") % 1500, 0)
    doc = F.concat(F.lit('[{"metricName":"Dead Click Count","information":[{"Browser":"X","Dead Click Count":"'), n,
                   F.lit('"}]},{"metricName":"Traffic","information":[{"totalSessionCount":"'), F.col("user_id").cast("string"),
                   F.lit('","totalBotSessionCount":"1"}]}]'))
    return e.select(F.concat(F.lit("site"), (F.col("user_id") % 3).cast("string")).alias("site"), doc.alias("json"))


@query("read_field_metrics", """SELECT 'https://c' || c_custkey AS site, 'largest_contentful_paint' AS metric, 2 AS points, 2000.0::DOUBLE + c_custkey % 900 AS first FROM customer""")
def read_field_metrics(spark, sf):
    f = SD.field_rows(field_docs(spark, sf))
    return f.groupBy("site", "metric").agg(F.count("p75").alias("points"), F.min_by("p75", "period_end").alias("first"))


def field_docs(spark, sf):
    k = F.col("c_custkey")
    doc = F.concat(
        F.lit('{"record":{"key":{"origin":"https://c'), k.cast("string"), F.lit(
            '","formFactor":"PHONE"},"collectionPeriods":[{"lastDate":{"year":2026,"month":1,"day":3}},{"lastDate":{"year":2026,"month":1,"day":10}},'
            '{"lastDate":{"year":2026,"month":1,"day":17}}],"metrics":{"largest_contentful_paint":{"percentilesTimeseries":{"p75s":['),
        (F.lit(2000) + k % 900).cast("string"), F.lit(",null,"), (F.lit(2000) + k % 2500).cast("string"), F.lit("]}}}}}"))
    return A.table(spark, sf, "customer").select(doc.alias("json"))


@query("read_lab_results", """SELECT 'https://l' || s_suppkey AS url, CAST(s_nationkey * 4 AS INTEGER) AS performance, s_suppkey % 300 > 100 AS slow, s_nationkey % 2 = 1 AS failed FROM supplier""")
def read_lab_results(spark, sf):
    t = SD.lab_rows(lab_docs(spark, sf))
    slow = t["opportunities"].select("url", F.lit(True).alias("slow")).distinct()
    failed = t["failed_seo"].select("url", F.lit(True).alias("failed")).distinct()
    return t["scores"].select("url", "performance").join(slow, "url", "left").join(failed, "url", "left").fillna(False, ["slow", "failed"])


def lab_docs(spark, sf):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    doc = F.concat(
        F.lit('{"id":"https://l'), k.cast("string"), F.lit('","lighthouseResult":{"categories":{"performance":{"score":'), (n / 25.0).cast("string"),
        F.lit('},"seo":{"score":1,"auditRefs":[{"id":"meta-description"}]}},"audits":{"unused-css":{"id":"unused-css","title":"Unused","score":0.5,"details":{"type":"opportunity","overallSavingsMs":'),
        (k % 300).cast("string"), F.lit('}},"meta-description":{"id":"meta-description","title":"Meta","score":'),
        F.when(n % 2 == 1, "0").otherwise("1"), F.lit("}}}}"))
    return A.table(spark, sf, "supplier").select(doc.alias("json"))
