"""Registered queries of the corpus operators, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import (
    decontaminate, grace_dedup, jaccard_forest, license_scan, merkle, mixing, packing, sharding, surrogates, toxicity,
    url_filter, warc, whitening,
)
from cohortlens.llm.common import read
from cohortlens.llm.tokens import BYTE_BPE, BYTE_RANKS


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents")).drop("detections")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer, ranks = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(BYTE_RANKS)
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer, ranks)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS code FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first_id FROM p),
digits AS (
  SELECT *, [substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((CAST('0x' || substr(code, CAST(1 + (i // 8) * 10 AS INTEGER), 10) AS BIGINT) >> CAST(35 - (i % 8) * 5 AS INTEGER)) & 31 AS INTEGER), 1)
    FOR i IN range(0, 32)] AS d
  FROM g
)
SELECT page_id, strlen(html) AS payload_bytes, list_aggregate(d, 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM digits
"""


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(read(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_forest.near_duplicates(read(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.mark_duplicates(read(spark, sf_dir, "documents"))


OP9_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (
  SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
    max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
    count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
  FROM documents
)
"""


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == toxicity.HELD_OUT
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "evidence", F.size("passages").alias("n_passages"),
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(read(spark, sf_dir, "documents"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.words_taken(read(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = whitening.whiten(read(spark, sf_dir, "embeddings"))
    return scored.withColumn("deviation", whitening.long_or_null("deviation"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_url_filter": op1,
    "op2_license_scan": op2,
    "op3_decontaminate": op3,
    "op4_pack": op4,
    "op5_warc": op5,
    "op6_shards": op6,
    "op7_surrogates": op7,
    "op8_jaccard_forest": op8,
    "op9_exact_dedup": op9,
    "op10_toxicity": op10,
    "op11_merkle_manifest": op11,
    "op12_pivotal_mix": op12,
    "op13_feast_whitening": op13,
    "pipeline": _pipeline,
}
ORACLES = {"op5_warc": OP5_SQL, "op9_exact_dedup": OP9_SQL, "op11_merkle_manifest": merkle.SQL}
