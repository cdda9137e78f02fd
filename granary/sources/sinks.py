"""Writers: objects to chunks and manifests, packs in locality order, bundles, and versioned tables that publish by rename."""

from __future__ import annotations

import json
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import content


def put_objects(objects: DataFrame, stored: DataFrame, **sizes) -> tuple[DataFrame, DataFrame]:
    """(new chunks (sha, length), manifests (version_id, sha, size, chunks)) of objects (version_id, body): only chunks that aren't stored."""
    refs = content.chunk_map(objects, "version_id", "body", **sizes)
    new = refs.groupBy("sha").agg(F.max("length").alias("length")).join(stored.select("sha"), "sha", "left_anti")
    chunks = refs.groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("ord", "sha", "length"))).alias("c"))
    whole = objects.select("version_id", F.sha2("body", 256).alias("sha"), F.octet_length("body").cast("long").alias("size"))
    empty = F.array().cast("array<struct<sha:string,length:bigint>>")
    manifests = whole.join(chunks, "version_id", "left").select("version_id", "sha", "size", F.coalesce(F.transform("c", lambda x: F.struct(x["sha"].alias("sha"), x["length"].alias("length"))), empty).alias("chunks"))
    return new, manifests


def write_packs(chunks: DataFrame, order: list[str], path: str, packs: int) -> None:
    """Chunk rows laid down in first-reference order: ranges of the order, sorted inside; one shuffle."""
    chunks.repartitionByRange(packs, *order).sortWithinPartitions(*order).write.parquet(path)


def deflated(body, level: int = 6):
    """struct<codec, body>: DEFLATE kept only if it saves a sixteenth at least."""
    def one(x) -> tuple[int | None, bytes | None]:
        if x is None:
            return None, None
        z = zlib.compressobj(level, zlib.DEFLATED, -15)
        small = z.compress(bytes(x)) + z.flush()
        return (1, small) if len(x) - len(small) >= len(x) / 16 and len(x) else (0, bytes(x))

    @F.pandas_udf("codec int, body binary")
    def pack(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(b) for b in x], columns=["codec", "body"]).astype({"codec": "Int32"})

    return F.when(body.isNotNull(), pack(body))


def bundle(manifests: DataFrame, chunks: DataFrame, base: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifests, chunks) to ship; against a base only chunks that it lacks, and which of its chunks are referred to is a semi join."""
    wanted = manifests.select(F.explode("chunks").alias("c")).select("c.sha").distinct()
    payload = chunks.join(wanted, "sha", "left_semi")
    return manifests, payload if base is None else payload.join(base.select("sha"), "sha", "left_anti")


def import_bundle(manifests: DataFrame, payload: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks the store will hold; fails on a digest that doesn't match or a chunk that neither side has."""
    proved = payload.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("sha"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("digest of "), "sha"))))
    have = proved.select("sha").union(stored.select("sha"))
    lost = manifests.select(F.explode("chunks").alias("c")).select("c.sha").distinct().join(have, "sha", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"chunk {lost[0].sha} is in neither bundle nor store")
    return proved.join(stored.select("sha"), "sha", "left_anti")


class Versioned:
    """A table whose versions are folders and whose current one is named by a small file, replaced by rename.

    Writers name the version that they saw; a commit that another has overtaken is refused. One driver commits at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        if not self._fs.exists(self._at("CURRENT")):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/CURRENT").first().value)["version"]

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.current()}")

    def commit(self, df: DataFrame, seen: str | None) -> str:
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        if self.current() != seen:
            self._fs.delete(self._at(name), True)
            raise ValueError("another version was committed")
        out = self._fs.create(self._at("CURRENT.next"), True)
        out.write(bytearray(json.dumps({"version": name}).encode()))
        out.close()
        self._fs.delete(self._at("CURRENT"), False)
        if not self._fs.rename(self._at("CURRENT.next"), self._at("CURRENT")):
            raise OSError("the new version could not be named")
        return name
