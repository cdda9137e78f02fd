"""Readers over files made of the driver's documents: what is read must be what was put in."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import sqlite3
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.content import varint
from granary.operators.storage import place
from granary.plans import proxies as px
from granary.plans.registry import register, table
from granary.sources import readers, sinks, tables

#: Documents in a file.
FILE = 20
Rows = list[tuple[int, bytes]]


def _tar(rows: Rows) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for k, body in rows:
            info = tarfile.TarInfo(str(k))
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


def _zip(rows: Rows) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, body in rows:
            z.writestr(str(k), body)
    return out.getvalue()


def _sqlite(rows: Rows) -> bytes:
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (k INTEGER, body TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?)", [(k, b.hex()) for k, b in rows])
    db.commit()
    return db.serialize()


def _journal(rows: Rows) -> bytes:
    return b"".join(readers.journal_frame(i, 1, struct.pack("<q", k) + b) for i, (k, b) in enumerate(rows, 1))


def _car(rows: Rows) -> bytes:
    out = bytearray(varint(3) + b"hdr")
    for k, b in rows:
        body = struct.pack("<q", k) + b
        cid = b"\x01\x55\x12\x20" + hashlib.sha256(body).digest()
        out += varint(len(cid) + len(body)) + cid + body
    return bytes(out)


def _safetensors(rows: Rows) -> bytes:
    head, at = {}, 0
    for k, b in rows:
        head[str(k)] = {"dtype": "U8", "shape": [len(b)], "data_offsets": [at, at + len(b)]}
        at += len(b)
    text = json.dumps(head).encode()
    return struct.pack("<Q", len(text)) + text + b"".join(b for _, b in rows)


def _git(rows: Rows) -> bytes:
    body = b"".join(struct.pack("<qq", k, len(b)) + b for k, b in rows[:1])
    return zlib.compress(b"blob %d\0" % len(body) + body)


def made(docs: DataFrame, build: Callable[[Rows], bytes], size: int = FILE) -> DataFrame:
    """(path, content): a file of each ``size`` documents (doc_id, text) of neighbouring ids."""
    held = docs.groupBy(F.floor(F.col("doc_id") / size).alias("part")).agg(F.array_sort(F.collect_list(F.struct("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body")))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = [build([(r["doc_id"], r["body"]) for r in rows]) for rows in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([str(p) for p in b.column(0).to_pylist()], pa.string()), pa.array(content, pa.binary())], names=["path", "content"])

    return held.mapInArrow(run, "path string, content binary")


def _after_id(body: str) -> tuple[Column, Column]:
    """The id in a body's first eight bytes, and the rest."""
    head = F.hex(F.substring(body, 1, 8))
    turned = F.concat(*[F.substring(head, 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.conv(turned, 16, 10).cast("long"), F.substring(body, 9, 1 << 30)


_EVERY = "SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents"


def _read(spark, d: str, kind: str, build: Callable[[Rows], bytes], size: int = FILE) -> DataFrame:
    reader, schema = readers.READERS[kind]
    return readers.expanded(made(table(spark, d, "documents").select("doc_id", "text"), build, size), reader, schema)


def _named(kind: str, build: Callable[[Rows], bytes]) -> Callable:
    return lambda spark, d: _read(spark, d, kind, build).select(F.col("name").cast("long").alias("doc_id"), F.sha2("body", 256).alias("sha"))


def _alone(kind: str, build: Callable[[Rows], bytes]) -> Callable:
    """A file a document, whose path is its id."""
    return lambda spark, d: _read(spark, d, kind, build, 1).select(F.col("path").cast("long").alias("doc_id"), F.sha2("body", 256).alias("sha"))


def _zstd(rows: Rows) -> bytes:
    import zstandard

    return zstandard.compress(rows[0][1])


register("read_tar", _EVERY)(_named("tar", _tar))
register("read_zip", _EVERY)(_named("zip", _zip))
register("read_gzip", _EVERY)(_alone("deflate", lambda rows: gzip.compress(rows[0][1], mtime=0)))
register("read_zlib", _EVERY)(_alone("deflate", lambda rows: zlib.compress(rows[0][1])))
register("read_zstd", _EVERY)(_alone("packed", _zstd))


@register("read_sqlite", _EVERY)
def read_sqlite(spark, d):
    row = F.from_json("row", "k bigint, body string")
    return _read(spark, d, "sqlite", _sqlite).select(row.alias("r")).select(F.col("r.k").alias("doc_id"), F.sha2(F.unhex("r.body"), 256).alias("sha"))


@register("read_journal", _EVERY)
def read_journal(spark, d):
    key, body = _after_id("payload")
    return _read(spark, d, "journal", _journal).select(key.alias("doc_id"), F.sha2(body, 256).alias("sha"))


@register("read_car", _EVERY)
def read_car(spark, d):
    key, body = _after_id("body")
    return _read(spark, d, "car", _car).select(key.alias("doc_id"), F.sha2(body, 256).alias("sha"))


@register("read_git_objects", "SELECT min(doc_id) AS doc_id, sha256(coalesce(arg_min(text, doc_id), '')) AS sha FROM documents GROUP BY doc_id // 20")
def read_git_objects(spark, d):
    """The first document of each file as a loose object."""
    key, body = _after_id("body")
    return _read(spark, d, "git", _git).select(key.alias("doc_id"), F.sha2(F.substring(body, 9, 1 << 30), 256).alias("sha"))


@register("read_safetensors", "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS size FROM documents")
def read_safetensors(spark, d):
    return _read(spark, d, "safetensors", _safetensors).select(F.col("tensor").cast("long").alias("doc_id"), "size")


@register("manifest_scan", px.sql(px.REFS, query="SELECT version_id, ord - 1 AS ord, sha::VARCHAR AS sha, length, (sum(length) OVER (PARTITION BY version_id ORDER BY ord) - length)::BIGINT AS start FROM refs"))
def manifest_scan(spark, d):
    """Manifests written as JSON lines and scanned: every chunk reference with its place."""
    r = px.refs(spark, d)
    chunk = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("sha").cast("string").alias("sha256"), F.col("length").cast("long").alias("length")))), lambda x: F.struct(x["sha256"].alias("sha256"), x["length"].alias("length")))
    m = r.groupBy(F.col("version_id").cast("string").alias("version_id")).agg(chunk.alias("chunks"), F.sum("length").cast("long").alias("total_length")).withColumn("manifest_format_version", F.lit(tables.MANIFEST_VERSION))
    path = place(spark)
    m.write.json(path)
    found = tables.chunk_refs(tables.manifests(spark, path))
    return found.select(F.col("version_id").cast("long").alias("version_id"), F.col("ord").cast("long").alias("ord"), "sha", "length", "start")


@register("snapshot_scan", px.sql(px.OBJECTS, query="""SELECT bucket AS id, count(*) AS entries, sum(version_id)::BIGINT AS versions FROM objects GROUP BY 1"""))
def snapshot_scan(spark, d):
    """Snapshots of buckets as JSON descriptors, scanned again."""
    o = px.objects(spark, d)
    entry = F.collect_list(F.struct("key", F.col("version_id").cast("string").alias("version_id"), F.col("sha").alias("manifest_sha")))
    s = o.groupBy(F.col("bucket").alias("id")).agg(entry.alias("entries")).withColumn("snapshot_format_version", F.lit(tables.SNAPSHOT_VERSION))
    path = place(spark)
    s.write.json(path)
    e = tables.snapshot_entries(tables.snapshots(spark, path))
    return e.groupBy("id").agg(F.count("*").alias("entries"), F.sum(F.col("version_id").cast("long")).alias("versions"))


@register("report_rows", "SELECT l_returnflag AS family, l_linestatus AS format, count(*) AS n FROM lineitem GROUP BY 1, 2")
def report_rows(spark, d):
    """Measurement rows as JSON lines, read by their schema."""
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("format"), F.col("l_quantity").cast("long").alias("logical"), F.col("l_partkey").cast("long").alias("packed"))
    path = place(spark)
    x.write.json(path)
    return tables.reports(spark, path).groupBy("family", "format").agg(F.count("*").alias("n"))


#: Chunk sizes for short documents.
_SMALL = {"least": 64, "target": 256, "most": 1024, "small": 255, "large": 127}


@register("objects_put", "SELECT doc_id AS version_id, strlen(text)::BIGINT AS size, strlen(text)::BIGINT AS in_chunks FROM documents WHERE strlen(text) > 0")
def objects_put(spark, d):
    """Documents put into an empty store: each manifest's chunks add up to its object."""
    objects = table(spark, d, "documents").filter("text <> ''").select(F.col("doc_id").alias("version_id"), F.encode("text", "UTF-8").alias("body"))
    _, manifests = sinks.put_objects(objects, spark.createDataFrame([], "sha string, length long"), **_SMALL)
    return manifests.select("version_id", F.col("size").cast("long").alias("size"), F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + c["length"]).alias("in_chunks"))


@register("packs_written", px.sql(px.REFS, query="SELECT sha, min(version_id) AS version_id FROM refs GROUP BY 1"))
def packs_written(spark, d):
    """Distinct chunks laid down in packs by first reference, and read again."""
    r = px.refs(spark, d)
    first = r.groupBy("sha").agg(F.min(F.struct("version_id", "ord")).alias("f")).select("sha", "f.version_id", "f.ord")
    path = place(spark)
    sinks.write_packs(first, ["version_id", "ord"], path, 4)
    return spark.read.schema(first.schema).parquet(path).select("sha", "version_id")


@register("adaptive_deflate", "SELECT doc_id, true AS exact, true AS pays FROM documents WHERE text IS NOT NULL")
def adaptive_deflate(spark, d):
    """Bodies deflated where that saves a sixteenth at least, and read again."""
    x = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("body"))
    return x.withColumn("z", sinks.deflated(F.col("body"))).select(
        "doc_id", (_inflated("z.codec", "z.body") == F.col("body")).alias("exact"), F.when(F.col("z.codec") == 1, 16 * F.octet_length("z.body") <= 15 * F.octet_length("body")).otherwise(F.col("z.body") == F.col("body")).alias("pays")
    )


@F.pandas_udf(T.BinaryType())
def _inflated(codec: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([zlib.decompress(b, -15) if c == 1 else bytes(b) for c, b in zip(codec, body, strict=True)])
