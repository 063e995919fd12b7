"""The corpus operators as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audit, chat, decontamination, lines, mixing, neighbours, quality, resampling, sharding, simhash, toxicity, urls, vectors
from .common import read


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(read(spark, sf_dir, "conversations"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(read(spark, sf_dir, "documents"), 16)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.digest(read(spark, sf_dir, "embeddings"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(read(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.digest(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.digest(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_sharding": op3_sharding,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_url_filters": op9_url_filters,
    "op10_line_dedup": op10_line_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}
ORACLES: dict[str, str] = {
    "op2_chat_formatting": chat.ORACLE,
    "op4_embedding_near_dedup": vectors.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op9_url_filters": urls.ORACLE,
    "op11_filter_audit": audit.ORACLE,
    "op13_nearest_neighbours": neighbours.ORACLE,
}
