"""Readers of layered formats: LevelDB tables, git packs, OCI images."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.content import crc32c, read_varint
from granary.sources import readers

#: The last eight bytes of a table, and what masks a block's checksum: fixed values of the format.
TABLE_MAGIC, MASK_DELTA = 0xDB4775248B80FB57, 0xA282EAD8


def _block(data: bytes, offset: int, size: int) -> bytes:
    body, kind = data[offset : offset + size], data[offset + size]
    want = int.from_bytes(data[offset + size + 1 : offset + size + 5], "little")
    c = crc32c(body + bytes([kind]))
    if ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF != want:
        raise ValueError(f"block checksum at {offset}")
    if kind == 0:
        return body
    if kind == 1:
        n, _ = read_varint(body)
        return pa.decompress(body, decompressed_size=n, codec="snappy", asbytes=True)
    raise ValueError(f"block codec {kind}")


def _entries(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Keys share prefixes with the one before; restart points, at the end, aren't needed for a scan."""
    end = len(block) - 4 - 4 * int.from_bytes(block[-4:], "little")
    at, key = 0, b""
    while at < end:
        shared, at = read_varint(block, at)
        fresh, at = read_varint(block, at)
        size, at = read_varint(block, at)
        key = key[:shared] + block[at : at + fresh]
        at += fresh
        yield key, block[at : at + size]
        at += size


def table_records(data: bytes) -> Iterator[tuple]:
    """(key, seq, kind, value) of a sorted table with internal keys, in order."""
    if len(data) < 48 or int.from_bytes(data[-8:], "little") != TABLE_MAGIC:
        raise ValueError("no table footer")
    at = len(data) - 48
    _, at = read_varint(data, at)
    _, at = read_varint(data, at)
    offset, at = read_varint(data, at)
    size, _ = read_varint(data, at)
    for _, handle in _entries(_block(data, offset, size)):
        o, p = read_varint(handle)
        n, _ = read_varint(handle, p)
        for key, value in _entries(_block(data, o, n)):
            tag = int.from_bytes(key[-8:], "little")
            yield key[:-8], tag >> 8, tag & 255, value


RECORDS = "key binary, seq bigint, kind int, value binary"
_KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}


def _patched(base: bytes, delta: bytes) -> bytes:
    size, at = read_varint(delta)
    if size != len(base):
        raise ValueError("delta of another base")
    want, at = read_varint(delta, at)
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            take = [0, 0]
            for field, bits in ((0, range(4)), (1, range(4, 7))):
                for shift, bit in enumerate(bits):
                    if op >> bit & 1:
                        take[field] |= delta[at] << 8 * shift
                        at += 1
            offset, n = take[0], take[1] or 0x10000
            out += base[offset : offset + n]
        elif op:
            out += delta[at : at + op]
            at += op
        else:
            raise ValueError("delta command 0")
    if len(out) != want:
        raise ValueError("delta size")
    return bytes(out)


def git_pack(data: bytes) -> Iterator[tuple]:
    """(sha1, kind, offset, size, depth, body) of a pack; delta chains are resolved by offset or by id within it."""
    if data[:4] != b"PACK" or hashlib.sha1(data[:-20]).digest() != data[-20:]:
        raise ValueError("no pack, or a damaged one")
    at = 12
    raw: dict[int, tuple] = {}
    for _ in range(int.from_bytes(data[8:12], "big")):
        begin, b = at, data[at]
        at += 1
        kind, shift = b >> 4 & 7, 4
        while b & 128:
            b = data[at]
            at += 1
            shift += 7
        base: object = None
        if kind == 6:
            b = data[at]
            at += 1
            back = b & 127
            while b & 128:
                b = data[at]
                at += 1
                back = (back + 1 << 7) | b & 127
            base = begin - back
        elif kind == 7:
            base = data[at : at + 20].hex()
            at += 20
        z = zlib.decompressobj()
        body = z.decompress(data[at:])
        at = len(data) - len(z.unused_data)
        raw[begin] = (kind, base, body)
    done: dict[int, tuple[str, str, int, bytes]] = {}
    ids: dict[str, int] = {}
    left = dict(raw)
    while left:
        ready = [o for o, (k, base, _) in left.items() if k < 6 or base in done or base in ids]
        if not ready:
            raise ValueError("a delta's base isn't in the pack")
        for o in ready:
            k, base, body = left.pop(o)
            if k < 6:
                kind, depth = _KINDS[k], 0
            else:
                _, kind, depth, under = done[base if k == 6 else ids[base]]
                body, depth = _patched(under, body), depth + 1
            sha = hashlib.sha1(f"{kind} {len(body)}\0".encode() + body).hexdigest()
            done[o] = (sha, kind, depth, body)
            ids[sha] = o
    for o in sorted(done):
        sha, kind, depth, body = done[o]
        yield sha, kind, o, len(body), depth, body


PACK = "sha1 string, kind string, offset bigint, size bigint, depth int, body binary"
readers.READERS |= {"table": (table_records, RECORDS), "git_pack": (git_pack, PACK)}


def oci_layers(blobs: DataFrame, root: str, most_depth: int = 4) -> DataFrame:
    """(manifest, ord, digest, media_type, size, stored) of all layers and configs below a root document; blobs (digest, body string).

    An index lists manifests, which may be indexes again; each round joins one level to its documents.
    """
    entry = "struct<mediaType:string,digest:string,size:bigint>"
    schema = f"manifests array<{entry}>, config {entry}, layers array<{entry}>"
    front = blobs.filter(F.col("digest") == root)
    out = None
    for _ in range(most_depth):
        doc = front.select("digest", F.from_json("body", schema, {"mode": "FAILFAST"}).alias("d"))
        own = doc.filter("d.layers IS NOT NULL").select(F.col("digest").alias("manifest"), F.posexplode(F.concat(F.array("d.config"), "d.layers")).alias("ord", "e"))
        out = own if out is None else out.unionByName(own)
        front = blobs.join(doc.filter("d.manifests IS NOT NULL").select(F.explode("d.manifests").alias("e")).select("e.digest").distinct(), "digest", "left_semi")
    have = blobs.select("digest", F.lit(True).alias("stored"))
    flat = out.select("manifest", "ord", F.col("e.digest").alias("digest"), F.col("e.mediaType").alias("media_type"), F.col("e.size").alias("size"))
    return flat.join(have, "digest", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))
