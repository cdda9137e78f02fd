"""Descriptors kept as JSON lines, read by fixed schemas: manifests, snapshots, measurement rows, object frontiers.

Nothing is inferred. A descriptor of another format version, or one that doesn't parse, is an error and not a row of nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST_VERSION = SNAPSHOT_VERSION = 1
MANIFEST = "manifest_format_version int, version_id string, total_length bigint, object_sha256 string, etag string, content_type string, metadata map<string,string>, chunks array<struct<sha256:string,length:bigint>>"
SNAPSHOT = "snapshot_format_version int, id string, created string, src_bucket string, src_prefix string, entries array<struct<key:string,version_id:string,manifest_sha:string>>"
REPORT = "family string, format string, rep string, index string, logical bigint, incremental bigint, packed bigint, reuse bigint, new bigint, status string"
FRONTIER = "object string, day int, size bigint, key string, tier string, sketch array<string>"


def _strict(spark: SparkSession, path: str, schema: str, version: str | None = None, known: int | None = None) -> DataFrame:
    held = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if version is None:
        return held
    wrong = F.raise_error(F.concat(F.lit(f"{version} isn't {known}: "), F.coalesce(F.col(version).cast("string"), F.lit("null")))).cast("int")
    return held.withColumn(version, F.when(F.col(version) == known, F.col(version)).otherwise(wrong)).filter(F.col(version).isNotNull())


def manifests(spark: SparkSession, path: str) -> DataFrame:
    return _strict(spark, path, MANIFEST, "manifest_format_version", MANIFEST_VERSION)


def chunk_refs(manifests: DataFrame) -> DataFrame:
    """(version_id, ord, sha, length, start): every chunk reference of manifests, repeats included, with its place in the object."""
    rows = manifests.select("version_id", F.posexplode("chunks").alias("ord", "chunk")).select("version_id", "ord", F.col("chunk.sha256").alias("sha"), F.col("chunk.length").alias("length"))
    w = Window.partitionBy("version_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("length").over(w), F.lit(0)))


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    return _strict(spark, path, SNAPSHOT, "snapshot_format_version", SNAPSHOT_VERSION)


def snapshot_entries(snapshots: DataFrame) -> DataFrame:
    """(id, key, version_id, manifest_sha)."""
    return snapshots.select("id", F.explode("entries").alias("e")).select("id", "e.*")


def reports(spark: SparkSession, path: str) -> DataFrame:
    return _strict(spark, path, REPORT)


def frontier(spark: SparkSession, path: str) -> DataFrame:
    return _strict(spark, path, FRONTIER)


def series(frontier: DataFrame) -> DataFrame:
    """Objects in order of their days within a key, each with its stage: (key, stage, object, day, size)."""
    stage = F.row_number().over(Window.partitionBy("key").orderBy("day", "object")) - 1
    return frontier.select("key", stage.alias("stage"), "object", "day", "size")
