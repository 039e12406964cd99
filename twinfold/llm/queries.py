"""The queries of the training-data operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, gru_lm, hilbert, html_text, line_dedup, near_dup, packing, quality, secrets, token_files
from .common import documents, scratch


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), out, end_id=2)
    return token_files.read_digest(spark, out)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(documents(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op6_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = hilbert.shard_documents(documents(spark, sf_dir), 24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_counts(documents(spark, sf_dir), min_words=1)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.components(documents(spark, sf_dir), 85, 100)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_html_extraction": op2_html_extraction,
    "op3_quality_rules": op3_quality_rules,
    "op4_secret_scan": op4_secret_scan,
    "op5_decontamination": op5_decontamination,
    "op6_hilbert_sharding": op6_hilbert_sharding,
    "op7_line_dedup": op7_line_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": quality.ORACLE,
    "op8_near_dedup": near_dup.ORACLE,
}
