"""Readers and writers by round trip, damage included."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import pickle
import sqlite3
import struct
import tarfile
import zipfile
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard

from granary.functions.content import varint
from granary.operators.retention import latest
from granary.sources import readers as rd
from granary.sources import sinks
from granary.streaming import journal as sj

BODIES = {"a.txt": b"hello " * 50, "d/b.bin": bytes(range(256)), "empty": b""}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")

    def put(name, data):
        (root / name).write_bytes(data)

    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w") as f:
        for n, b in BODIES.items():
            i = tarfile.TarInfo(n)
            i.size = len(b)
            f.addfile(i, io.BytesIO(b))
    put("x.tar", t.getvalue())
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        for n, b in BODIES.items():
            f.writestr(n, b)
    put("x.zip", z.getvalue())
    put("x.gz", gzip.compress(BODIES["a.txt"]))
    put("x.zst", zstandard.compress(BODIES["a.txt"]))
    db = sqlite3.connect(root / "x.sqlite")
    db.execute("CREATE TABLE t (a INTEGER, b TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"v{i}") for i in range(100)])
    db.commit()
    db.close()
    table = pa.table({"a": [1, 2, None], "b": ["x", "y", "z"]})
    with pa.OSFile(str(root / "x.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    pq.write_table(table, root / "x.parquet")
    head = json.dumps({"w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}}).encode()
    put("x.safetensors", struct.pack("<Q", len(head)) + head + bytes(24))
    name = b"blk.w"
    gguf = b"GGUF" + struct.pack("<IQQ", 3, 1, 1) + struct.pack("<Q", 3) + b"k.s" + struct.pack("<I", 8) + struct.pack("<Q", 2) + b"hi"
    gguf += struct.pack("<Q", len(name)) + name + struct.pack("<IQQIQ", 2, 2, 4, 0, 0)
    put("x.gguf", gguf + bytes(-len(gguf) % 32) + bytes(32))
    cid = b"\x01\x55\x12\x20" + hashlib.sha256(b"block").digest()
    block = varint(len(cid) + 5) + cid + b"block"
    put("x.car", varint(3) + b"hdr" + block)
    put("x.git", zlib.compress(b"blob 5\0hello"))
    put("x.pickle", pickle.dumps({"a": io.BytesIO}))
    put("x.journal", b"".join(rd.journal_frame(i, 1 + i % 3, b"p" * i) for i in range(1, 30)))
    put("torn.journal", b"".join(rd.journal_frame(i, 1, b"p" * i) for i in range(1, 9))[:-3])
    return root


def test_readers(spark, folder):
    rows = lambda kind, glob: rd.read(spark, kind, str(folder), glob).collect()
    for kind, glob in (("tar", "*.tar"), ("zip", "*.zip")):
        assert {r.name: bytes(r.body) for r in rows(kind, glob)} == BODIES
    assert [(r.codec, bytes(r.body)) for r in rows("deflate", "*.gz")] == [("gzip", BODIES["a.txt"])]
    assert [(r.codec, bytes(r.body)) for r in rows("packed", "*.zst")] == [("zstd", BODIES["a.txt"])]
    assert len(rows("sqlite", "*.sqlite")) == 100 and json.loads(rows("sqlite", "*.sqlite")[0].row) == {"a": 0, "b": "v0"}
    assert b"".join(bytes(r.body) for r in sorted(rows("sqlite_pages", "*.sqlite"), key=lambda r: r.page_no)) == (folder / "x.sqlite").read_bytes()
    assert {(r.column, r.rows, r.nulls) for r in rows("arrow", "*.arrow")} == {("a", 3, 1), ("b", 3, 0)}
    assert {(r.column, r.n) for r in rows("parquet", "*.parquet")} == {("a", 3), ("b", 3)}
    assert [(r.tensor, r.dtype, r.shape, r.size) for r in rows("safetensors", "*.safetensors")] == [("w", "F32", [2, 3], 24)]
    assert [(r.tensor, r.shape, r.size) for r in rows("gguf", "*.gguf")] == [("blk.w", [2, 4], 32)]
    assert [(bytes(r.body), r.size) for r in rows("car", "*.car")] == [(b"block", 5)]
    assert [(r.kind, bytes(r.body)) for r in rows("git", "*.git")] == [("blob", b"hello")]
    assert "_io.BytesIO" in {r.name for r in rows("pickle", "*.pickle")}
    assert [(r.seq, len(r.payload)) for r in sorted(rows("journal", "x.journal"), key=lambda r: r.seq)] == [(i, i) for i in range(1, 30)]
    assert len(rows("journal", "torn.journal")) == 7
    kinds = {r.path.rpartition("/")[2]: r.kind for r in rd.detected(rd.files(spark, str(folder))).collect()}
    assert kinds["x.tar"] == "tar" and kinds["x.zip"] == "zip" and kinds["x.sqlite"] == "sqlite" and kinds["x.parquet"] == "parquet" and kinds["x.safetensors"] == "raw"


def test_journal_damage():
    good = b"".join(rd.journal_frame(i, 1, b"abc") for i in range(1, 5))
    assert [r[0] for r in rd.journal_frames(good[: len(good) - 1])] == [1, 2, 3]
    for bad in (good[:30] + bytes([good[30] ^ 1]) + good[31:], b"XXXX" + good[4:], good + rd.journal_frame(9, 1, b"")):
        with pytest.raises(ValueError):
            list(rd.journal_frames(bad))


def test_objects_to_bundle_and_back(spark):
    objects = spark.createDataFrame([(i, bytes([i % 3]) * 3000) for i in range(6)], "version_id long, body binary")
    none = spark.createDataFrame([], "sha string, length long")
    new, manifests = sinks.put_objects(objects, none, least=64, target=256, most=1024, small=255, large=127)
    assert manifests.filter("aggregate(chunks, 0L, (a, c) -> a + c.length) = size").count() == 6
    assert sinks.put_objects(objects, new, least=64, target=256, most=1024, small=255, large=127)[0].count() == 0
    payload = spark.createDataFrame([("x", b"1")], "sha string, payload binary").limit(0)
    shipped, chunks = sinks.bundle(manifests, new, base=new.limit(1))
    assert chunks.count() == new.count() - 1
    with pytest.raises(ValueError, match="neither"):
        sinks.import_bundle(shipped, payload, new.limit(1))


def test_adaptive_deflate(spark):
    import os

    df = spark.createDataFrame([(0, b"a" * 999), (1, os.urandom(999)), (2, b"")], "id int, b binary")
    assert {r.id: r.z.codec for r in df.select("id", sinks.deflated(df["b"]).alias("z")).collect()} == {0: 1, 1: 0, 2: 0}


def test_versioned_table(spark, tmp_path):
    t = sinks.Versioned(spark, str(tmp_path / "t"))
    first = t.commit(spark.range(3).toDF("id"), None)
    second = t.commit(spark.range(5).toDF("id"), first)
    assert t.read().count() == 5 and t.current() == second
    with pytest.raises(ValueError, match="another"):
        t.commit(spark.range(9).toDF("id"), first)
    assert t.read().count() == 5


def test_stream_state_over_batches(spark, tmp_path):
    rows = [(i, i % 7, f"t{i % 3}") for i in range(200)]
    for k in range(4):
        spark.createDataFrame(rows[k * 50 : k * 50 + 50], "seq long, key long, type string").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    schema = "seq long, key long, type string"
    stream = sj.source(spark, str(tmp_path / "in"), schema, "*.parquet", files_per_batch=1)
    out = sj.drained(sj.folded(stream, "key", "seq", ["type"]), str(tmp_path / "out"), str(tmp_path / "state"), mode="update")
    assert out.select("batch").distinct().count() == 4
    last = {r.key: r.seq for r in out.groupBy("key").agg({"seq": "max"}).withColumnRenamed("max(seq)", "seq").collect()}
    want = {r.key: r.seq for r in latest(spark.createDataFrame(rows, schema), ["seq"]).collect()}
    assert last == want


def test_stream_appends_only_new_chunks(spark, tmp_path):
    path = str(tmp_path / "chunks")
    written = []
    table = lambda: spark.read.parquet(path) if written else None

    def write(df):
        df.write.mode("append").parquet(path)
        written.append(1)

    batch = sj.new_chunks_only(table, write)
    batch(spark.createDataFrame([("a",), ("b",), ("a",)], "sha string"), 0)
    batch(spark.createDataFrame([("b",), ("c",)], "sha string"), 1)
    assert sorted(r.sha for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
