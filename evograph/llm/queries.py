"""The queries opN_<name>: each operator over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evograph.llm import bpe, cross_polytope, hard_negatives, license_scan, merkle, multiset_hash, packing, quality_knn, quality_rules, simhash, token_counts, toxicity, warc
from evograph.llm.common import load


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(load(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality_rules.apply(docs, quality_rules.fit(docs, load(spark, sf_dir, "labels")))


def op6_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.fingerprint_pairs(load(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.labelled(load(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality_knn.score(docs, quality_knn.fit(docs, load(spark, sf_dir, "labels")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(load(spark, sf_dir, "documents"))


def op13_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_warc, op3_token_counts, op4_packing, op5_quality_rules, op6_multiset_hash, op7_license_scan, op8_toxicity, op9_quality_knn, op10_byte_bpe, op11_hard_negatives, op12_merkle, op13_cross_polytope)
}

ORACLE_SQL = {
    "op2_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS n, sha1(payload) AS digest FROM p),
k AS (SELECT digest, max(page_id) AS keep FROM d WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM d LEFT JOIN k USING (digest)""",
    "op6_multiset_hash": multiset_hash.ORACLE_SQL,
    "op7_license_scan": license_scan.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op12_merkle": merkle.ORACLE_SQL,
}
