"""Readers of container formats over Spark's binaryFile source.

``files`` lists and reads through Spark, so any store that Spark reads will do. A reader is a function from bytes to rows;
``expanded`` runs it in Arrow batches. Damaged input fails with the file's path; nothing is skipped.
"""

from __future__ import annotations

import gzip
import io
import json
import pickletools
import sqlite3
import struct
import tarfile
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from granary.functions.content import crc32c, read_varint


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, content) of all files below ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length", "content")


def expanded(held: DataFrame, read: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """(path, *schema): the rows that ``read`` makes of each file's content."""
    fields = T._parse_datatype_string(schema)
    out = T.StructType([T.StructField("path", T.StringType()), *fields.fields])
    kinds = [to_arrow_type(f.dataType) for f in fields.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    rows = list(read(content.as_py() or b""))
                except Exception as e:
                    raise ValueError(f"{path}: {e}") from e
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], names=out.names)

    return held.select("path", "content").mapInArrow(run, out)


def tar_members(data: bytes) -> Iterator[tuple]:
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t:
            if m.islnk() or m.issym():
                raise ValueError(f"link {m.name}")
            if m.isfile():
                yield m.name, m.offset_data, m.size, t.extractfile(m).read()


def zip_members(data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for m in z.infolist():
            if not m.is_dir():
                yield m.filename, m.header_offset, m.file_size, z.read(m)


MEMBERS = "name string, offset bigint, size bigint, body binary"


def inflated(data: bytes) -> Iterator[tuple]:
    """gzip, zlib or raw DEFLATE, told by the first bytes."""
    kind = "gzip" if data[:2] == b"\x1f\x8b" else "zlib" if len(data) > 1 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0 else "deflate"
    yield kind, gzip.decompress(data) if kind == "gzip" else zlib.decompress(data, 15 if kind == "zlib" else -15)


def unpacked(data: bytes) -> Iterator[tuple]:
    """Zstandard frames, LZ4 frames, Snappy and Brotli by their marks; others as they are."""
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        yield "zstd", zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).readall()
    elif data[:4] == b"\x04\x22\x4d\x18":
        yield "lz4", pa.CompressedInputStream(pa.BufferReader(data), "lz4").read()
    else:
        yield "raw", data


CODED = "codec string, body binary"


def sqlite_pages(data: bytes) -> Iterator[tuple]:
    if data[:16] != b"SQLite format 3\0":
        raise ValueError("no SQLite header")
    size = int.from_bytes(data[16:18], "big")
    size = 65536 if size == 1 else size
    if size < 512 or len(data) % size:
        raise ValueError("page size")
    for i in range(0, len(data), size):
        yield i // size + 1, data[i : i + size]


PAGES = "page_no bigint, body binary"


def sqlite_rows(data: bytes) -> Iterator[tuple]:
    """(table, row as JSON) of all tables."""
    with tempfile.NamedTemporaryFile() as f:
        f.write(data)
        f.flush()
        db = sqlite3.connect(f"file:{f.name}?mode=ro&immutable=1", uri=True)
        try:
            for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
                found = db.execute('SELECT * FROM "' + name.replace('"', '""') + '"')
                columns = [c[0] for c in found.description]
                for r in found:
                    yield name, json.dumps(dict(zip(columns, (x.hex() if isinstance(x, bytes) else x for x in r), strict=True)))
        finally:
            db.close()


ROWS = "table string, row string"


def arrow_rows(data: bytes) -> Iterator[tuple]:
    """(batch, buffers' bytes, rows) of an Arrow IPC file or stream."""
    opened = pa.ipc.open_file(data) if data[:6] == b"ARROW1" else pa.ipc.open_stream(data)
    batches = [opened.get_batch(i) for i in range(opened.num_record_batches)] if data[:6] == b"ARROW1" else list(opened)
    for i, b in enumerate(batches):
        for name, c in zip(b.schema.names, b.columns, strict=True):
            yield i, name, str(c.type), len(c), c.null_count, sum(x.size for x in c.buffers() if x is not None)


ARROW = "batch int, column string, type string, rows bigint, nulls bigint, bytes bigint"


def parquet_chunks(data: bytes) -> Iterator[tuple]:
    """Footer of a Parquet file: a row for each column chunk."""
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(io.BytesIO(data)).metadata
    for g in range(meta.num_row_groups):
        for c in range(meta.num_columns):
            x = meta.row_group(g).column(c)
            yield g, x.path_in_schema, x.physical_type, x.compression, x.num_values, x.total_compressed_size, x.total_uncompressed_size, x.dictionary_page_offset or x.data_page_offset


PARQUET = "row_group int, column string, type string, codec string, n bigint, packed bigint, unpacked bigint, offset bigint"


class _Compact:
    """Structs of the compact protocol as dicts by field number; lists as lists."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def number(self) -> int:
        n, self.at = read_varint(self.data, self.at)
        return n >> 1 ^ -(n & 1)

    def value(self, kind: int):
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            self.at += 1
            return int.from_bytes(self.data[self.at - 1 : self.at], "little", signed=True)
        if kind in (4, 5, 6):
            return self.number()
        if kind == 7:
            self.at += 8
            return self.data[self.at - 8 : self.at]
        if kind == 8:
            n, self.at = read_varint(self.data, self.at)
            self.at += n
            return self.data[self.at - n : self.at]
        if kind in (9, 10):
            head = self.data[self.at]
            self.at += 1
            n = head >> 4
            if n == 15:
                n, self.at = read_varint(self.data, self.at)
            return [self.value(head & 15) for _ in range(n)]
        if kind == 12:
            return self.struct()
        raise ValueError("type of a field")

    def struct(self) -> dict:
        out, field = {}, 0
        while True:
            head = self.data[self.at]
            self.at += 1
            if not head:
                return out
            field = field + (head >> 4) if head >> 4 else self.number()
            out[field] = self.value(head & 15)


#: Fixed values of the format.
_PAGE_KINDS = {0: "data", 1: "index", 2: "dictionary", 3: "data_v2"}


def parquet_pages(data: bytes) -> Iterator[tuple]:
    """Pages of a Parquet file: each column chunk is walked from header to header."""
    for g, column, _, codec, _, size, _, at in parquet_chunks(data):
        end, page = at + size, 0
        while at < end:
            c = _Compact(data, at)
            head = c.struct()
            unpacked_, packed_ = head[2], head[3]
            own = head.get(5) or head.get(7) or head.get(8) or {}
            if packed_ < 0 or c.at + packed_ > end:
                raise ValueError(f"{column}: page beyond its chunk")
            yield g, column, page, _PAGE_KINDS[head[1]], codec, at, c.at - at, packed_, unpacked_, own.get(1, 0)
            at, page = c.at + packed_, page + 1


PAGES_OF_PARQUET = "row_group int, column string, page int, kind string, codec string, offset bigint, header bigint, packed bigint, unpacked bigint, n bigint"


def safetensors(data: bytes) -> Iterator[tuple]:
    n = int.from_bytes(data[:8], "little")
    if 8 + n > len(data):
        raise ValueError("header beyond the end")
    pairs = json.loads(data[8 : 8 + n], object_pairs_hook=_unique)
    for name, t in pairs.items():
        if name != "__metadata__":
            a, b = t["data_offsets"]
            if not 0 <= a <= b <= len(data) - 8 - n:
                raise ValueError(f"{name}: place")
            yield name, t["dtype"], [int(x) for x in t["shape"]], 8 + n + a, b - a


def _unique(pairs: list) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key twice")
    return dict(pairs)


TENSORS = "tensor string, dtype string, shape array<bigint>, offset bigint, size bigint"


def gguf(data: bytes) -> Iterator[tuple]:
    """Tensors of a GGUF file, version 2 or 3."""
    if data[:4] != b"GGUF" or struct.unpack_from("<I", data, 4)[0] not in (2, 3):
        raise ValueError("no GGUF header")
    n_tensors, n_pairs = struct.unpack_from("<QQ", data, 8)
    at, align = 24, 32
    sizes = {0: 1, 1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 1, 10: 8, 11: 8, 12: 8}

    def text(at: int) -> tuple[str, int]:
        n = struct.unpack_from("<Q", data, at)[0]
        return data[at + 8 : at + 8 + n].decode(), at + 8 + n

    def value(kind: int, at: int) -> tuple[object, int]:
        if kind == 8:
            return text(at)
        if kind == 9:
            inner, n = struct.unpack_from("<IQ", data, at)
            at += 12
            for _ in range(n):
                _, at = value(inner, at)
            return None, at
        return int.from_bytes(data[at : at + sizes[kind]], "little"), at + sizes[kind]

    for _ in range(n_pairs):
        name, at = text(at)
        kind = struct.unpack_from("<I", data, at)[0]
        v, at = value(kind, at + 4)
        if name == "general.alignment":
            align = int(v)
    found = []
    for _ in range(n_tensors):
        name, at = text(at)
        dims = struct.unpack_from("<I", data, at)[0]
        shape = list(struct.unpack_from(f"<{dims}Q", data, at + 4))
        at += 4 + 8 * dims
        kind, offset = struct.unpack_from("<IQ", data, at)
        at += 12
        found.append((name, str(kind), shape, offset))
    start = -(-at // align) * align
    ends = sorted({*(o for *_, o in found), len(data) - start})
    for name, kind, shape, offset in found:
        yield name, kind, shape, start + offset, next((e for e in ends if e > offset), offset) - offset


def car_blocks(data: bytes) -> Iterator[tuple]:
    """(cid, offset, size, body) of a CAR file, version 1 or 2."""
    if data[:11] == bytes.fromhex("0aa16776657273696f6e02"):
        offset, size = struct.unpack_from("<QQ", data, 11 + 16)
        yield from ((c, offset + o, n, b) for c, o, n, b in car_blocks(data[offset : offset + size]))
        return
    n, at = read_varint(data)
    at += n
    while at < len(data):
        n, at = read_varint(data, at)
        end = at + n
        if end > len(data):
            raise ValueError("block beyond the end")
        p = at
        if data[p : p + 2] == b"\x12\x20":
            p += 34
        else:
            for _ in range(3):
                _, p = read_varint(data, p)
            size, p = read_varint(data, p)
            p += size
        yield data[at:p].hex(), p, end - p, data[p:end]
        at = end


BLOCKS = "cid string, offset bigint, size bigint, body binary"


def git_object(data: bytes) -> Iterator[tuple]:
    """A loose object: its kind, size and body."""
    raw = zlib.decompress(data)
    head, _, body = raw.partition(b"\0")
    kind, _, size = head.partition(b" ")
    if int(size) != len(body):
        raise ValueError("size")
    import hashlib

    yield kind.decode(), hashlib.sha1(raw).hexdigest(), len(body), body


GIT = "kind string, sha1 string, size bigint, body binary"


def pickle_names(data: bytes) -> Iterator[tuple]:
    """Names that a pickle would import; it is read, never run."""
    strings: list[str] = []
    for op, arg, at in pickletools.genops(data):
        if op.name == "GLOBAL":
            yield at, arg.replace(" ", ".")
        elif op.name == "STACK_GLOBAL":
            yield at, ".".join(strings[-2:])
        elif isinstance(arg, str):
            strings.append(arg)


NAMES = "offset bigint, name string"

#: A frame: magic, version, type, a spare byte, sequence, payload length; then the payload and its CRC-32C; big-endian.
FRAME = struct.Struct(">4sHBxQI")
MOST_PAYLOAD = 64 << 20


def journal_frames(data: bytes, magic: bytes = b"GRNJ", version: int = 1, after: int = 0) -> Iterator[tuple]:
    """(seq, type, payload, end). A torn tail ends the journal; any other damage, or a gap in the sequence, is an error."""
    at, last = 0, after
    while at + FRAME.size <= len(data):
        m, v, kind, seq, n = FRAME.unpack_from(data, at)
        if m != magic or v != version or n > MOST_PAYLOAD:
            raise ValueError(f"bad frame at {at}")
        end = at + FRAME.size + n + 4
        if end > len(data):
            return
        if crc32c(data[at : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            raise ValueError(f"checksum at {at}")
        if seq != last + 1:
            raise ValueError(f"sequence {seq} after {last}")
        yield seq, kind, data[at + FRAME.size : end - 4], end
        at, last = end, seq


JOURNAL = "seq bigint, type int, payload binary, end bigint"


def journal_frame(seq: int, kind: int, payload: bytes, magic: bytes = b"GRNJ", version: int = 1) -> bytes:
    head = FRAME.pack(magic, version, kind, seq, len(payload)) + payload
    return head + crc32c(head).to_bytes(4, "big")


READERS: dict[str, tuple[Callable[[bytes], Iterator[tuple]], str]] = {
    "tar": (tar_members, MEMBERS),
    "zip": (zip_members, MEMBERS),
    "deflate": (inflated, CODED),
    "packed": (unpacked, CODED),
    "sqlite_pages": (sqlite_pages, PAGES),
    "sqlite": (sqlite_rows, ROWS),
    "arrow": (arrow_rows, ARROW),
    "parquet": (parquet_chunks, PARQUET),
    "parquet_pages": (parquet_pages, PAGES_OF_PARQUET),
    "safetensors": (safetensors, TENSORS),
    "gguf": (gguf, TENSORS),
    "car": (car_blocks, BLOCKS),
    "git": (git_object, GIT),
    "pickle": (pickle_names, NAMES),
    "journal": (journal_frames, JOURNAL),
}


def read(spark: SparkSession, kind: str, path: str, glob: str | None = None) -> DataFrame:
    """Rows of all files of a kind below ``path``."""
    reader, schema = READERS[kind]
    return expanded(files(spark, path, glob), reader, schema)


def detected(held: DataFrame) -> DataFrame:
    """(path, kind) by the first bytes; unknown is raw."""
    x = F.col("content")
    starts = lambda b: F.substring(x, 1, len(b)) == F.lit(b)
    kind = F.lit("raw")
    for name, mark in (("git", b"\x78\x01"), ("car", bytes.fromhex("0aa16776657273696f6e02")), ("gguf", b"GGUF"), ("parquet", b"PAR1"), ("arrow", b"ARROW1"), ("sqlite", b"SQLite format 3\0"), ("zstd", b"\x28\xb5\x2f\xfd"), ("lz4", b"\x04\x22\x4d\x18"), ("zip", b"PK\x03\x04"), ("gzip", b"\x1f\x8b")):
        kind = F.when(starts(mark), name).otherwise(kind)
    return held.select("path", F.when(F.substring(x, 258, 5) == F.lit(b"ustar"), "tar").otherwise(kind).alias("kind"))
