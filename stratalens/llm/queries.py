"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import class_lm, decontaminate, licenses, ngram_join, oracles, packing, pii, quality, substring_dedup, token_counts, token_output


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based log-probability of every document."""
    return class_lm.class_scores(_table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings removed from every document."""
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    return decontaminate.decontamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written Simple-8b coded and read back."""
    return token_output.token_output(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, before and after its personal data is edited out."""
    return token_counts.edited_counts(_table(spark, sf_dir, "documents")).drop("leaf_chars", "leaf_tokens")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms in every document."""
    return pii.pii(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in windows of 2048."""
    return packing.pack(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_class_lm": op2_class_lm,
    "op3_ngram_join": op3_ngram_join,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_token_output": op6_token_output,
    "op7_token_counts": op7_token_counts,
    "op8_pii": op8_pii,
    "op9_license_scan": op9_license_scan,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": oracles.quality_sql(),
    "op4_substring_dedup": oracles.substring_sql(),
    "op5_decontamination": oracles.decontamination_sql(),
}
