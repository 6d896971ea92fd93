"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, contamination, embeddings, extract, lines, packing, phrases, pii, quality, runs, secrets, simhash, suffixes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 2)) AS i, ws FROM w WHERE len(ws) > 2),
tri AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM g),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, w.source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
        coalesce(n_lines, 0) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base, 10 * n_symbols > n_words AS symbols,
        10 * n_dup_lines > 3 * n_lines AS dup_lines, word_chars < 3 * n_words OR word_chars > 10 * n_words AS word_length FROM m),
h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (bad) AS k FROM (
        SELECT source, unnest(['symbols', 'dup_lines', 'word_length']) AS rule, unnest([symbols, dup_lines, word_length]) AS bad FROM f)
      GROUP BY ALL),
p AS (SELECT rule, count(*) - 1 AS within, sum(n) AS nn, sum(k) / sum(n) AS p, sum(n * n) AS n2, sum(k * k / n) AS kk, sum(k) AS k
      FROM h GROUP BY rule),
q AS (SELECT rule, p, least(greatest(coalesce((CASE WHEN p * (1 - p) <> 0 THEN (kk - k * p) / (p * (1 - p)) END - within)
        / nullif(nn - n2 / nn - within, 0), 0), 1e-6), 1 - 1e-6) AS share FROM p),
bad AS (SELECT source, rule FROM h JOIN q USING (rule) WHERE (k + p * (1 / share - 1)) / (n + 1 / share - 1) > 0.5)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base AS base_failed,
  NOT (base OR EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM f.source AND
    ((rule = 'symbols' AND symbols) OR (rule = 'dup_lines' AND dup_lines) OR (rule = 'word_length' AND word_length)))) AS kept
FROM f
"""


@query("op1_host_rules", QUALITY_SQL)
def op1_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents", "doc_id", "text", "source"), keep=["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_simhash_anchors")
def op7_simhash_anchors(spark: SparkSession, folder: str) -> DataFrame:
    grouped = simhash.group(table(spark, folder, "documents", "doc_id", "text"))
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _digest(spans: Column, kinds: list[str], at: str = "kind") -> Column:
    name = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s[at]), s["start"], s["end"])), ",")


def _secret_sql() -> str:
    def found(no: int, rule: str) -> str:
        _, pattern, group, least = secrets.RULES[rule]
        p = pattern.replace("'", "''")
        return f"""SELECT doc_id, {no} AS no, '{rule}' AS rule, unnest(range(1, len(f) + 1)) AS i, unnest(gaps) AS gap, unnest(f) AS len, unnest(g) AS size, {least} AS least
          FROM (SELECT doc_id, list_transform(string_split_regex(t, '{p}'), lambda x: length(x))[:-2] AS gaps, list_transform(regexp_extract_all(t, '{p}'), lambda x: length(x)) AS f,
            list_transform(regexp_extract_all(t, '{p}', {group}), lambda x: length(x)) AS g FROM d WHERE regexp_matches(t, '{p}'))"""
    parts = " UNION ALL ".join(found(no, r) for no, r in enumerate(secrets.RULES))
    counts = ", ".join(f"count(*) FILTER (rule = '{r}') AS n_{r}" for r in secrets.BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({parts}),
      s AS (SELECT *, sum(gap + len) OVER (PARTITION BY doc_id, no ORDER BY i) AS stop FROM m),
      k AS (SELECT doc_id, rule, no, CAST(stop - len AS BIGINT) AS a, rule || ':' || CAST(stop - len AS BIGINT) || ':' || CAST(stop AS BIGINT) AS said FROM s WHERE size >= least),
      g AS (SELECT doc_id, {counts}, string_agg(said, ',' ORDER BY a, no) AS spans, string_agg(said, ',' ORDER BY a, no) FILTER (no < {len(secrets.BASE)}) AS base FROM k GROUP BY doc_id)
      SELECT doc_id, {", ".join(f"coalesce(n_{r}, 0) AS n_{r}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


@query("op4_blob_ledger", _secret_sql())
def op4_blob_ledger(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find(table(spark, folder, "documents", "doc_id", "text"))
    base = F.filter("found", lambda s: s["kind"] < len(secrets.BASE))
    return found.select(
        "doc_id", *[_count("found", i).alias(f"n_{k}") for i, k in enumerate(secrets.BASE)],
        F.sha2(secrets.spelled(base), 256).alias("base_sha256"), secrets.spelled(F.col("found")).alias("spans"))


@query("op8_deobfuscate")
def op8_deobfuscate(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", *[_count("base", i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
        F.sha2(_digest(F.col("base"), pii.KINDS), 256).alias("base_sha256"), _digest(F.col("found"), pii.KINDS).alias("spans"))


@query("op9_linear_grouping")
def op9_linear_grouping(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, folder, "documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op3_distinct_words")
def op3_distinct_words(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, folder, "documents", "doc_id", "text"), ranks, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, ranks)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op10_e8_lattice")
def op10_e8_lattice(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.group(table(spark, folder, "embeddings", "vec_id", "embedding", "label"))


@query("op5_page_differences")
def op5_page_differences(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract(table(spark, folder, "pages", "page_id", "url", "html"))


@query("op2_fuzzy_lines")
def op2_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.dedupe_lines(table(spark, folder, "documents", "doc_id", "text"))
    return found.select("doc_id", "line", F.lpad(F.lower(F.hex("root")), 16, "0").alias("class_id"), "kept")


@query("op6_two_stage_suffixes")
def op6_two_stage_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, folder, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                        (F.col("n_removed") > 0).alias("has_repeats"))


@query("op11_maximal_pairs")
def op11_maximal_pairs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.find_runs(table(spark, folder, "documents", "doc_id", "text"), rewrite=True)
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                        F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


_LOWERED = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"

COLLOCATION_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM g) GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT *, array_to_string(ws[1:j], ' ') AS x, array_to_string(ws[j + 1:], ' ') AS y FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c)),
s AS (SELECT cut.lang, cut.phrase, a, j, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM cut JOIN f AS l ON l.lang = cut.lang AND l.phrase = x JOIN f AS r ON r.lang = cut.lang AND r.phrase = y),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, phrase, max(a) AS m FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase
           FROM c WHERE k = 3) GROUP BY lang, phrase),
kept AS (SELECT best.*, n.n FROM best JOIN n USING (lang) LEFT JOIN longer USING (lang, phrase) WHERE m IS NULL OR 100 * m < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


@query("op12_three_way_quicksort", COLLOCATION_SQL)
def op12_three_way_quicksort(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents", "text", "lang"))


CONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array({_LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM bw),
dw AS (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n),
hit AS (SELECT DISTINCT doc_id, n, i, item_id FROM (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM dw) JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS spot FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
       FROM (SELECT DISTINCT doc_id, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op13_prefix_filter", CONTAMINATION_SQL)
def op13_prefix_filter(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination.decontaminate(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
