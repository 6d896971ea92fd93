"""The corpus pipeline: quality rules, line and document deduplication, secrets, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrid.llm import lines, packing, quality, secrets, simhash
from sitegrid.llm.common import row_key
from sitegrid.llm.queries import tokenizer_path
from sitegrid.session import stage_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule, or a failing host's own rule, rejects go. Null and
    empty texts fail the base rule; repeated rows are judged alike; a null source is a
    host of its own; an empty table stays empty."""
    return quality.judge(docs).filter("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of near equal lines stays, the first by doc_id (null
    first) and place; rows that repeat in both columns share their verdict. Every document
    stays, with an empty text if it loses all lines; a null text stays null."""
    return lines.without_repeats(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the least doc_id (nulls last), then the
    least hash of the text; of rows equal in both, one."""
    found = stage_table(simhash.group(docs).select("k1", "k2", "root", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("order")))
    keep = found.groupBy("root").agg(F.min(F.struct("order", "k2", "k1")).alias("k"))
    rows = docs.select(F.struct("*").alias("row"), *row_key())
    chosen = rows.join(keep.select("k.k1", "k.k2").hint("shuffle_hash"), ["k1", "k2"], "left_semi")
    return chosen.dropDuplicates(["k1", "k2"]).select("row.*")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, null and empty texts and
    repeated rows as they are."""
    found = stage_table(secrets.find(docs).filter(F.size("found") > 0).select("k1", "k2", "found").dropDuplicates(["k1", "k2"]))
    rows = docs.select(F.struct("*").alias("row"), *row_key()).join(found, ["k1", "k2"], "left")
    masked = F.when(F.col("found").isNull(), F.col("row.text")).otherwise(secrets.redact(F.col("row.text"), F.col("found")))
    return rows.withColumn("row", F.col("row").withField("text", masked)).select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048. A null text is one piece, the
    end mark; repeated rows are packed again; an empty table gives no pieces."""
    packed = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans), ("best_fit_packing", best_fit_packing),
]

#: Fingerprints, signatures and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
