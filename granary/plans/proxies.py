"""The driver tables in the roles of a content-addressed store, and the same views in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.plans.registry import table

_REF_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")


def objects(spark: SparkSession, d: str) -> DataFrame:
    """(bucket, key, version_id, sha, etag, size): a document is an object."""
    return table(spark, d, "documents").select(
        F.col("source").alias("bucket"),
        F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("key"),
        F.col("doc_id").alias("version_id"),
        F.sha2("text", 256).alias("sha"),
        F.md5("text").alias("etag"),
        F.octet_length("text").cast("long").alias("size"),
    )


OBJECTS = """objects AS (SELECT source AS bucket, lang || '/' || doc_id::VARCHAR AS "key", doc_id AS version_id, sha256(text) AS sha, md5(text) AS etag, strlen(text)::BIGINT AS size FROM documents)"""


def keys(spark: SparkSession, d: str) -> DataFrame:
    """(key, size): a page is an object under host and path."""
    return table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("key"), F.octet_length("html").cast("long").alias("size"))


KEYS = """keys AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS "key", strlen(html)::BIGINT AS size FROM pages)"""


def refs(spark: SparkSession, d: str) -> DataFrame:
    """(version_id, ord, sha, length, pack): a line is a chunk reference; its place is made unique by all its columns."""
    w = Window.partitionBy("l_orderkey").orderBy(*_REF_ORDER)
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("version_id"),
        F.row_number().over(w).alias("ord"),
        F.col("l_partkey").alias("sha"),
        F.col("l_quantity").cast("long").alias("length"),
        F.col("l_suppkey").alias("pack"),
    )


REFS = f"""refs AS (SELECT l_orderkey AS version_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_REF_ORDER)})::INT AS ord, l_partkey AS sha, l_quantity::BIGINT AS length, l_suppkey AS pack FROM lineitem)"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    """(key, version_id, ts, size): an order is a version of its customer's key."""
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("ts"), F.floor("o_totalprice").cast("long").alias("size")
    )


VERSIONS = """versions AS (SELECT o_custkey AS "key", o_orderkey AS version_id, o_orderdate AS ts, floor(o_totalprice)::BIGINT AS size FROM orders)"""


def stored(spark: SparkSession, d: str) -> DataFrame:
    """(sha, logical): a part is a stored chunk."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("sha"), F.col("p_size").cast("long").alias("logical"))


STORED = """stored AS (SELECT p_partkey AS sha, p_size::BIGINT AS logical FROM part)"""


def packs(spark: SparkSession, d: str) -> DataFrame:
    """(pack, now): a supplier is a pack, its nation's region the tier."""
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("pack"), (F.col("n_regionkey") % 3).alias("now"))


PACKS = """packs AS (SELECT s_suppkey AS pack, n_regionkey % 3 AS now FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def live_versions(spark: SparkSession, d: str) -> DataFrame:
    """(version_id): versions that are open or finished; the others are gone."""
    return table(spark, d, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("version_id"))


LIVE = """live_versions AS (SELECT o_orderkey AS version_id FROM orders WHERE o_orderstatus <> 'F')"""


def sql(*views: str, query: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + query
