"""Content functions over bytes: content-defined chunks, sketches, deltas, checksums, codecs of small integers and floats.

Plain functions on bytes and arrays come first; ``*_udf`` and ``*_map`` wrap them as Arrow operators.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the chunk format: least, target and greatest size, masks below and from the target.
LEAST, TARGET, MOST = 16 * 1024, 64 * 1024, 256 * 1024
MASK_SMALL, MASK_LARGE = (1 << 16) - 1, (1 << 15) - 1
#: Seed of the gear table. A store's seed is part of its format; pass it to get that store's chunks.
SEED = b"granary/gear"


@lru_cache(maxsize=8)
def gear(seed: bytes = SEED) -> np.ndarray:
    """Entry i: the first eight bytes, big-endian, of the SHA-256 of ``seed/i``."""
    return np.array([int.from_bytes(hashlib.sha256(seed + b"/%d" % i).digest()[:8], "big") for i in range(256)], dtype=np.uint64)


def cuts(data: bytes, seed: bytes = SEED, least: int = LEAST, target: int = TARGET, most: int = MOST, small: int = MASK_SMALL, large: int = MASK_LARGE) -> list[int]:
    """Ends of chunks.

    A shift by one at each byte leaves only the last sixteen bytes in the low sixteen bits that are tested, and no test comes
    before the least size, so the hash at every place is a sum of sixteen shifted table values, whatever the chunk's start;
    candidates are found for the whole buffer at once and then walked from cut to cut.
    """
    n = len(data)
    width = max(small, large).bit_length()
    if least < width:
        raise ValueError("the least chunk must cover the tested bits")
    t = (gear(seed) & np.uint64((1 << width) - 1)).astype(np.uint32)
    out: list[int] = []
    start = 0
    block = 4 << 20
    hits_small: list[np.ndarray] = []
    hits_large: list[np.ndarray] = []
    for at in range(0, n, block):
        low = max(0, at - width + 1)
        b = t[np.frombuffer(data, np.uint8, min(n, at + block) - low, low)]
        h = np.zeros(len(b), np.uint32)
        for k in range(min(width, len(b))):
            h[k:] += b[: len(b) - k] << np.uint32(k)
        h = h[at - low :]
        hits_small.append(np.flatnonzero((h & np.uint32(small)) == 0) + at + 1)
        hits_large.append(np.flatnonzero((h & np.uint32(large)) == 0) + at + 1)
    s = np.concatenate(hits_small) if hits_small else np.empty(0, np.int64)
    g = np.concatenate(hits_large) if hits_large else np.empty(0, np.int64)
    while start < n:
        end = min(n, start + most)
        i = np.searchsorted(s, start + least)
        if i < len(s) and s[i] < start + target:
            end = min(end, int(s[i]))
        else:
            j = np.searchsorted(g, start + target)
            if j < len(g):
                end = min(end, int(g[j]))
        out.append(end)
        start = end
    return out


def fixed_cuts(data: bytes, size: int = TARGET) -> list[int]:
    return [*range(size, len(data), size), len(data)] if data else []


def chunks_of(data: bytes, ends: list[int]) -> list[tuple[int, int, int, str]]:
    """(ord, start, length, sha256) of each chunk."""
    starts = [0, *ends[:-1]] if ends else []
    return [(i, s, e - s, hashlib.sha256(data[s:e]).hexdigest()) for i, (s, e) in enumerate(zip(starts, ends, strict=True))]


def chunk_map(objects: DataFrame, id_col: str, body: str, fixed: int | None = None, **sizes) -> DataFrame:
    """(id, ord, start, length, sha) of the chunks of binary or string ``body``, by content or of a fixed size."""
    kept = objects.select(F.col(id_col), F.col(body))
    kind = kept.schema[0].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ord", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("sha", T.StringType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            found: list[tuple[int, int, int, str]] = []
            for i, x in enumerate(b.column(1).cast(pa.binary())):
                data = x.as_py() or b""
                c = chunks_of(data, fixed_cuts(data, fixed) if fixed else cuts(data, **sizes))
                rows += [i] * len(c)
                found += c
            cols = list(zip(*found, strict=True)) if found else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *[pa.array(v, t) for v, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)]], names=schema.names)

    return kept.mapInArrow(split, schema)


_MUL = 0x9E3779B97F4A7C15


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_features(data: bytes, k: int = 64, width: int = 16) -> np.ndarray:
    """The ``k`` least distinct mixed hashes of all 16-byte windows, ascending, unsigned."""
    n = len(data) - width + 1
    if n <= 0 or not 0 < k <= 64:
        return np.empty(0, np.uint64)
    b = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * np.uint64(_MUL) + b[i : i + n]
    return np.unique(_spread(h))[:k]


def block_features(data: bytes, block: int = 4096, most: int = 64) -> np.ndarray:
    """The least feature of each block, up to ``most``."""
    out = [shingle_features(data[i : i + block], 1) for i in range(0, len(data), block)]
    return np.concatenate(out)[:most] if out else np.empty(0, np.uint64)


def coarse_features(data: bytes) -> np.ndarray:
    """Four features of each fourth byte, its two low bits dropped, at all alignments."""
    b = np.frombuffer(data, np.uint8)
    return np.concatenate([shingle_features((b[p::4] & 0xFC).tobytes(), 4) for p in range(4)])


def super_features(sketch: np.ndarray) -> np.ndarray:
    """One feature of each four neighbours of an ascending sketch."""
    return np.array([fnv1a(sketch[i : i + 4].astype("<u8").tobytes(), ANCHOR_BASIS) for i in range(0, len(sketch) - 3, 4)], np.uint64)


def edge_features(data: bytes) -> np.ndarray:
    """Of the first and last 32 bytes; of shorter inputs four shingles."""
    if len(data) < 32:
        return shingle_features(data, 4)
    return np.array([fnv1a(data[:32], ANCHOR_BASIS), fnv1a(data[-32:], ANCHOR_BASIS)], np.uint64)


#: High bits of each band of sign features: a fixed value.
SIGN_TAG = 0x5353474E00000000


def sign_features(data: bytes) -> np.ndarray:
    """Eight bands of sixty-four sampled sign bits of little-endian floats; none under 256 bytes."""
    if len(data) < 256:
        return np.empty(0, np.uint64)
    i = np.arange(64)
    off = i * (len(data) - 4) // 63
    off -= off % 4
    bits = (np.frombuffer(data, np.uint8)[off + 3] >> 7).astype(np.uint64)
    sketch = np.bitwise_or.reduce(bits << i.astype(np.uint64))
    band = np.arange(8, dtype=np.uint64)
    return _spread(np.uint64(SIGN_TAG) | band << np.uint64(8) | (sketch >> (band * np.uint64(8))) & np.uint64(255))


def feature_map(objects: DataFrame, id_col: str, body: str, kind: str = "shingle", k: int = 64) -> DataFrame:
    """(feature, id): postings of each object."""
    how = {"shingle": lambda d: shingle_features(d, k), "block": block_features, "coarse": coarse_features, "sign": sign_features, "super": lambda d: super_features(shingle_features(d, k)), "edge": edge_features}[kind]
    kept = objects.select(F.col(id_col).alias("id"), F.col(body))
    schema = T.StructType([T.StructField("feature", T.LongType()), T.StructField("id", kept.schema[0].dataType)])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [how(x.as_py() or b"") for x in b.column(1).cast(pa.binary())]
            rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
            f = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(f), b.column(0).take(pa.array(rows))], names=["feature", "id"])

    return kept.mapInArrow(sketch, schema)


# ---- deltas ----------------------------------------------------------------


def delta(base: bytes, target: bytes, block: int = 16, least: int = 32) -> list[tuple[int, int, bytes | None]]:
    """COPY (offset, length, None) and ADD (0, length, bytes) that make ``target`` of ``base``: blocks of the base are indexed, matches grow both ways."""
    index: dict[bytes, int] = {}
    for i in range(0, len(base) - block + 1, block):
        index.setdefault(base[i : i + block], i)
    ops: list[tuple[int, int, bytes | None]] = []
    at = begun = 0
    while at + block <= len(target):
        hit = index.get(target[at : at + block])
        if hit is None:
            at += 1
            continue
        a, b, n = hit, at, block
        while a + n < len(base) and b + n < len(target) and base[a + n] == target[b + n]:
            n += 1
        while a and b > begun and base[a - 1] == target[b - 1]:
            a, b, n = a - 1, b - 1, n + 1
        if n < least:
            at += 1
            continue
        if b > begun:
            ops.append((0, b - begun, target[begun:b]))
        ops.append((a, n, None))
        at = begun = b + n
    if begun < len(target):
        ops.append((0, len(target) - begun, target[begun:]))
    return ops


def apply_delta(base: bytes, ops: list[tuple[int, int, bytes | None]]) -> bytes:
    return b"".join(base[o : o + n] if lit is None else lit for o, n, lit in ops)


def delta_map(pairs: DataFrame, id_col: str, base: str, target: str) -> DataFrame:
    """(id, target_bytes, copied, added, ops, exact): what a delta costs, proved by applying it."""
    kept = pairs.select(F.col(id_col), F.col(base), F.col(target))
    schema = T.StructType([T.StructField(id_col, kept.schema[0].dataType), *[T.StructField(c, T.LongType()) for c in ("target_bytes", "copied", "added", "ops")], T.StructField("exact", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x, y in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                x, y = x or b"", y or b""
                ops = delta(x, y)
                rows.append((len(y), sum(n for _, n, lit in ops if lit is None), sum(n for _, n, lit in ops if lit is not None), len(ops), apply_delta(x, ops) == y))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.bool_())], names=schema.names)

    return kept.mapInArrow(run, schema)


def xor_residual(base: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Bits in which equally shaped arrays differ; applied to the base again it gives the target."""
    kind = f"u{base.dtype.itemsize}"
    return base.view(kind) ^ target.view(kind)


def byte_planes(x: np.ndarray) -> np.ndarray:
    """Row i: byte i of each element, so that like bytes lie together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)


def from_planes(planes: np.ndarray, dtype: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


# ---- checksums, integers, floats -------------------------------------------


@lru_cache(maxsize=1)
def crc32c_table() -> list[int]:
    out = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        out.append(c)
    return out


#: Rows with which a byte of each is taken at once; fewer go on one by one.
TOGETHER = 24


def folded_bytes(rows: list[bytes], start: int, step: Callable[[np.ndarray, np.ndarray], np.ndarray], alone: Callable[[int, bytes], int], dtype: type = np.uint64) -> np.ndarray:
    """A running value of each row: ``step`` takes the values so far and a byte of each row, so all rows go ahead together.

    ``alone`` takes the value and what is left of the last few, longest rows.
    """
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    order = np.argsort(-size, kind="stable")
    flat = np.frombuffer(b"".join(rows), np.uint8)
    begin = (np.cumsum(size) - size)[order]
    value = np.full(len(rows), start, dtype)
    # rows that have a byte at a place are the first ones of the order
    more = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), "right")
    for at, n in enumerate(more.tolist()):
        if n < TOGETHER:
            for i in range(n):
                value[i] = alone(int(value[i]), rows[order[i]][at:])
            break
        value[:n] = step(value[:n], flat[begin[:n] + at])
    out = np.empty_like(value)
    out[order] = value
    return out


def _crc32c_on(c: int, data: bytes) -> int:
    t = crc32c_table()
    for b in data:
        c = c >> 8 ^ t[(c ^ b) & 255]
    return c


def crc32c_all(rows: list[bytes]) -> np.ndarray:
    t = np.array(crc32c_table(), np.uint32)
    return folded_bytes(rows, 0xFFFFFFFF, lambda c, b: c >> np.uint32(8) ^ t[(c ^ b) & np.uint32(255)], _crc32c_on, np.uint32) ^ np.uint32(0xFFFFFFFF)


def crc32c(data: bytes) -> int:
    return int(crc32c_all([data])[0])


#: Offset bases: of FNV-1a, and of the anchor hash, which is the same but for it. Fixed values.
FNV_BASIS, ANCHOR_BASIS = 14695981039346656037, 1469598103934665603


#: Fixed value.
FNV_PRIME = 1099511628211


def _fnv1a_on(h: int, data: bytes) -> int:
    for b in data:
        h = (h ^ b) * FNV_PRIME & (1 << 64) - 1
    return h


def fnv1a_all(rows: list[bytes], basis: int = FNV_BASIS) -> np.ndarray:
    return folded_bytes(rows, basis, lambda h, b: (h ^ b) * np.uint64(FNV_PRIME), _fnv1a_on)


def fnv1a(data: bytes, basis: int = FNV_BASIS) -> int:
    return int(fnv1a_all([data], basis)[0])


def record_cuts(keys: list[bytes], sizes: np.ndarray, target: int, most: int) -> np.ndarray:
    """Indexes of records that close a group: by a hash of the key with probability size / target, or at ``most`` bytes since the last.

    A record's size is that of key and value and four bytes. Hash cuts are found for all records at once; the running size then
    only says where a group between two of them is too long.
    """
    size = np.fromiter(map(len, keys), np.uint64, len(keys)) + np.asarray(sizes, np.uint64) + np.uint64(4)
    h = fnv1a_all(keys)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    share = np.uint64(((1 << 64) - 1) // target)
    by_hash = (size >= target) | (h < np.where(size < target, size, np.uint64(0)) * share)
    upto = np.cumsum(size).astype(np.int64)
    out: list[int] = []
    start = 0
    for end in [*np.flatnonzero(by_hash).tolist(), len(keys)]:
        while True:
            full = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most))
            if full >= end:
                break
            out.append(full)
            start = full + 1
        if end < len(keys):
            out.append(end)
        start = end + 1
    return np.array(out, np.int64)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, next place)."""
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7
        if shift > 63:
            raise ValueError("varint over 64 bits")


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-(v.bitwiseAND(F.lit(1))))


def bfloat16(x: np.ndarray) -> np.ndarray:
    """Bits of float32 rounded to nearest, ties to even; NaN stays a quiet NaN."""
    u = np.ascontiguousarray(x, np.float32).view(np.uint32).astype(np.uint64)
    out = ((u + np.uint64(0x7FFF) + ((u >> np.uint64(16)) & np.uint64(1))) >> np.uint64(16)).astype(np.uint16)
    return np.where(np.isnan(x), ((u >> np.uint64(16)) | np.uint64(0x40)).astype(np.uint16), out)


def ordered_key(x: np.ndarray) -> np.ndarray:
    """Unsigned keys that sort as the floats do, negative before positive."""
    u = np.ascontiguousarray(x, np.float32).view(np.uint32)
    return np.where(u >> 31, ~u, u | np.uint32(0x80000000))


def _bytes_of(x: pd.Series) -> list[bytes]:
    return [b"" if b is None else b.encode() if isinstance(b, str) else bytes(b) for b in x]


@F.pandas_udf(T.LongType())
def crc32c_udf(x: pd.Series) -> pd.Series:
    return pd.Series(crc32c_all(_bytes_of(x)).astype(np.int64)).where(x.notna(), None).astype("Int64")


@F.pandas_udf(T.LongType())
def fnv1a_udf(x: pd.Series) -> pd.Series:
    return pd.Series(fnv1a_all(_bytes_of(x)).view(np.int64)).where(x.notna(), None).astype("Int64")


@F.pandas_udf(T.StringType())
def sha3_256(x: pd.Series) -> pd.Series:
    """Lower-case hex of SHA3-256; of text its UTF-8."""
    return x.map(lambda b: None if b is None else hashlib.sha3_256(b.encode() if isinstance(b, str) else bytes(b)).hexdigest())


def half_value(bits: Column) -> Column:
    """The double that 16 bits of IEEE half precision stand for."""
    sign = F.when(bits.bitwiseAND(F.lit(0x8000)) != 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent, fraction = F.shiftright(bits.bitwiseAND(F.lit(0x7C00)), 10), bits.bitwiseAND(F.lit(0x3FF))
    special = F.when(fraction == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    normal = sign * (1 + fraction / 1024) * F.pow(F.lit(2.0), exponent - 15)
    return F.when(exponent == 31, special).when(exponent == 0, sign * fraction * 2.0**-24).otherwise(normal)


def half_bits(x: np.ndarray) -> np.ndarray:
    """Bits of half precision, rounded to nearest, ties to even."""
    return np.ascontiguousarray(x, np.float64).astype(np.float16).view(np.uint16)
