"""The registered queries of this subpackage: thin calls of the operators on their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontaminate, packing, pii, quality_model, quality_rules, secrets, simhash, suffix_dedup, toxicity, url_filter
from granary.llm.common import table


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.query(table(spark, sf_dir, "pages"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.query(table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1,
    "op2_quality": op2,
    "op3_url_filter": op3,
    "op4_secrets": op4,
    "op5_decontamination": op5,
    "op6_packing": op6,
    "op7_pii": op7,
    "op8_quality_rules": op8,
    "op9_simhash": op9,
    "op10_suffix_dedup": op10,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": url_filter.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
}
