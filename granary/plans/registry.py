"""Registered queries over the driver tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register(
    "dedup_stats",
    """SELECT source, count(*) AS objects, sum(strlen(text))::BIGINT AS logical_bytes, sum(strlen(text)) FILTER (WHERE first)::BIGINT AS unique_bytes,
       count(*) FILTER (WHERE first) AS unique_objects
       FROM (SELECT source, text, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) = 1 AS first FROM documents) GROUP BY source""",
)
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "documents").groupBy("source", F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("bytes"))
    return per.groupBy("source").agg(
        F.sum("n").alias("objects"),
        F.sum(F.col("n") * F.col("bytes")).alias("logical_bytes"),
        F.sum("bytes").cast("long").alias("unique_bytes"),
        F.count("*").alias("unique_objects"),
    )
