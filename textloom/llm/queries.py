"""The registered queries of the training-data operators, over their whole tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, decontamination, fingerprints, language_id, pii, secret_scan, sharding, simhash_dedup, toxicity, url_filter
from textloom.llm.common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.score_urls(table(spark, sf_dir, "pages"), url_filter.train())


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"), pii.train())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxic_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.classify(docs, language_id.train(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_url_filter": op2_url_filter,
    "op3_decontamination": op3_decontamination,
    "op4_sharding": op4_sharding,
    "op5_pii": op5_pii,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_language_id": op10_language_id,
}
ORACLES: dict[str, str] = {
    "op1_fingerprints": fingerprints.oracle(),
    "op2_url_filter": url_filter.oracle(),
    "op3_decontamination": decontamination.oracle(),
    "op4_sharding": sharding.oracle(),
}
