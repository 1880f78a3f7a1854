"""The queries of this subpackage: (spark, sf_dir) to a whole result, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import decontaminate, mixing, quality_rules, secrets, url_filter
from assayer.llm.common import read
from assayer.llm.html_text import extract_pages
from assayer.llm.langid import identify
from assayer.llm.quality_model import score_quality
from assayer.llm.simhash import simhash_components
from assayer.llm.tokens import count_tokens


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return leaks.withColumn("score", F.round("score", 6))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(read(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(read(spark, sf_dir, "documents"))


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_order(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_url_filters, op3_benchmark_decontamination, op4_simhash_near_dedup, op5_quality_rules,
        op6_secret_scans, op7_pfair_mixing, op8_language_id, op9_token_counts, op10_quality_classifier,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": url_filter.ORACLE_SQL,
    "op3_benchmark_decontamination": decontaminate.oracle_sql(),
    "op5_quality_rules": quality_rules.oracle_sql(),
    "op6_secret_scans": secrets.oracle_sql(),
    "op7_pfair_mixing": mixing.oracle_sql(),
}
