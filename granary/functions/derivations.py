"""Derivations: steps that make a payload of others byte by byte, and exact residuals of numbers against a prediction.

A step is a dict with its kind and what it needs; a pipeline's first step takes all inputs, each further one the output before.
Quantised blocks are those of the public GGML formats.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Numbers in a quantised block. Fixed value.
BLOCK = 32
#: Bytes that a step may make at most.
MOST_OUTPUT = 1 << 31


def _elements(data: bytes, width: int) -> np.ndarray:
    if width < 1 or len(data) % width:
        raise ValueError("length is no multiple of the element's")
    return np.frombuffer(data, np.uint8).reshape(-1, width)


def swapped(data: bytes, width: int) -> bytes:
    return _elements(data, width)[:, ::-1].tobytes()


def permuted(data: bytes, width: int, dims: list[int], axes: list[int]) -> bytes:
    """Elements of a grid in another order of its axes: axis ``i`` of the result is ``axes[i]`` of the input."""
    held = _elements(data, width)
    if len(held) != int(np.prod(dims, dtype=np.int64)) or sorted(axes) != list(range(len(dims))):
        raise ValueError("grid or axes")
    return held.reshape(*dims, width).transpose(*axes, len(dims)).tobytes()


def converted(data: bytes, source: str, target: str) -> bytes:
    """Numbers of a dtype as those of another, by NumPy's casts; ``bf16`` too, rounded to nearest, ties to even."""
    if source == "bf16":
        x = (np.frombuffer(data, "<u2").astype(np.uint32) << np.uint32(16)).view(np.float32)
    else:
        x = np.frombuffer(data, np.dtype(source).newbyteorder("<"))
    if target == "bf16":
        from granary.functions.content import bfloat16

        return bfloat16(x.astype(np.float32)).astype("<u2").tobytes()
    with np.errstate(over="ignore", invalid="ignore"):
        return x.astype(np.dtype(target).newbyteorder("<")).tobytes()


def _blocks(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, "<f4")
    if len(x) % BLOCK:
        raise ValueError("numbers are no multiple of a block")
    return x.reshape(-1, BLOCK)


def _inverse(d: np.ndarray) -> np.ndarray:
    return np.divide(np.float32(1), d, out=np.zeros_like(d), where=d != 0)


def q8_0(data: bytes) -> bytes:
    """Blocks of a half-precision scale and 32 signed bytes: the greatest magnitude is 127, halves round away from zero."""
    x = _blocks(data)
    d = (np.abs(x).max(axis=1, initial=0) / np.float32(127)).astype(np.float32)
    y = x * _inverse(d)[:, None]
    q = (np.sign(y) * np.floor(np.abs(y) + np.float32(0.5))).astype(np.int8)
    return np.concatenate([d.astype("<f2").view(np.uint8).reshape(-1, 2), q.view(np.uint8)], axis=1).tobytes()


def q4_0(data: bytes) -> bytes:
    """Blocks of a half-precision scale and 32 nibbles, the first half's low: the number of greatest magnitude is -8 scales."""
    x = _blocks(data)
    top = np.take_along_axis(x, np.abs(x).argmax(axis=1)[:, None], axis=1)[:, 0] if len(x) else np.empty(0, np.float32)
    d = (top / np.float32(-8)).astype(np.float32)
    q = np.minimum(15, (x * _inverse(d)[:, None] + np.float32(8.5)).astype(np.int32)).astype(np.uint8)
    packed = q[:, : BLOCK // 2] | q[:, BLOCK // 2 :] << 4
    return np.concatenate([d.astype("<f2").view(np.uint8).reshape(-1, 2), packed], axis=1).tobytes()


def gathered(data: bytes, width: int, index: list[int]) -> bytes:
    return _elements(data, width)[np.array(index, np.int64)].tobytes()


def scattered(dense: bytes, validity: bytes, width: int, slots: int, first: int = 0) -> bytes:
    """Slots of which those with a set bit (lowest first) take the next dense value, zeros elsewhere."""
    valid = np.unpackbits(np.frombuffer(validity, np.uint8), bitorder="little")[:slots].astype(bool)
    if len(valid) != slots:
        raise ValueError("bitmap too short")
    out = np.zeros((slots, width), np.uint8)
    out[valid] = _elements(dense, width)[first : first + int(valid.sum())]
    return out.tobytes()


def _plain(data: bytes) -> tuple[np.ndarray, bytes]:
    """Lengths and bytes of values that each follow their length of four bytes."""
    lengths, parts, at = [], [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        if at + 4 + n > len(data):
            raise ValueError("value beyond the end")
        lengths.append(n)
        parts.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return np.array(lengths, np.int64), b"".join(parts)


STEPS: dict[str, Callable[[list[bytes], dict], bytes]] = {
    "perm": lambda x, s: permuted(x[0], s["width"], s["dims"], s["axes"]),
    "bswap": lambda x, s: swapped(x[0], s["width"]),
    "convert": lambda x, s: converted(x[0], s["source"], s["target"]),
    "q8_0": lambda x, s: q8_0(x[0]),
    "q4_0": lambda x, s: q4_0(x[0]),
    "slice": lambda x, s: x[0][s["offset"] : s["offset"] + s["length"]],
    "concat": lambda x, s: b"".join(x),
    "gather": lambda x, s: gathered(x[0], s["width"], s["index"]),
    "prepend": lambda x, s: s["literal"] + x[0],
    "inflate": lambda x, s: zlib.decompress(x[0], -15),
    "plain_offsets": lambda x, s: np.r_[0, np.cumsum(_plain(x[0])[0])].astype("<i4").tobytes(),
    "plain_data": lambda x, s: _plain(x[0])[1],
    "scatter": lambda x, s: scattered(x[0], x[1], s["width"], s["slots"], s.get("first", 0)),
}


def applied(steps: list[dict], inputs: list[bytes]) -> bytes:
    """The pipeline's output; a slice beyond its input, an unknown kind or too much output is an error."""
    held = inputs
    for s in steps:
        if s["kind"] not in STEPS:
            raise ValueError(f"kind {s['kind']}")
        if s["kind"] == "slice" and not 0 <= s["offset"] <= s["offset"] + s["length"] <= len(held[0]):
            raise ValueError("slice beyond its input")
        held = [STEPS[s["kind"]](held, s)]
        if len(held[0]) > MOST_OUTPUT:
            raise ValueError("output too large")
    return held[0]


def derived(components: DataFrame, steps: list[dict], id_col: str = "id", inputs: str = "inputs") -> DataFrame:
    """(id, body) of (id, inputs array<binary>): the pipeline on each row."""
    kind = components.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [applied(steps, list(x)) if x is not None else None for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=[id_col, "body"])

    return components.select(id_col, inputs).mapInArrow(run, T.StructType().add(id_col, kind).add("body", T.BinaryType()))


def _key(u: np.ndarray) -> np.ndarray:
    """Bits of floats as unsigned numbers in the floats' order."""
    top = u.dtype.type(1 << (8 * u.dtype.itemsize - 1))
    return np.where(u & top, ~u, u | top)


def _unkey(k: np.ndarray) -> np.ndarray:
    top = k.dtype.type(1 << (8 * k.dtype.itemsize - 1))
    return np.where(k & top, k ^ top, ~k)


def _folded(d: np.ndarray) -> np.ndarray:
    """Small differences of either sign as small unsigned numbers."""
    s = d.view(f"i{d.dtype.itemsize}")
    return ((s << 1) ^ (s >> (8 * s.dtype.itemsize - 1))).view(d.dtype)


def _unfolded(z: np.ndarray) -> np.ndarray:
    return (z >> z.dtype.type(1)) ^ (z.dtype.type(0) - (z & z.dtype.type(1)))


#: kind -> (residual of target and prediction bits, target of residual and prediction bits)
RESIDUALS: dict[str, tuple[Callable, Callable]] = {
    "key": (lambda t, p: _folded(_key(t) - _key(p)), lambda r, p: _unkey(_unfolded(r) + _key(p))),
    "sub": (lambda t, p: _folded(t - p), lambda r, p: _unfolded(r) + p),
    "xor": (lambda t, p: t ^ p, lambda r, p: r ^ p),
}


def predicted(base: np.ndarray, a: float = 1.0, c: float = 0.0) -> np.ndarray:
    """``a x + c`` in double precision, rounded to the base's own type."""
    return base if (a, c) == (1.0, 0.0) else (a * base.astype(np.float64) + c).astype(base.dtype)


def residual(kind: str, base: np.ndarray, target: np.ndarray, a: float = 1.0, c: float = 0.0) -> np.ndarray:
    """Unsigned numbers from which, with the base, the target comes back bit by bit."""
    bits = f"u{target.dtype.itemsize}"
    return RESIDUALS[kind][0](np.ascontiguousarray(target).view(bits), np.ascontiguousarray(predicted(base, a, c)).view(bits))


def restored(kind: str, base: np.ndarray, held: np.ndarray, a: float = 1.0, c: float = 0.0) -> np.ndarray:
    return RESIDUALS[kind][1](held, np.ascontiguousarray(predicted(base, a, c)).view(held.dtype)).view(base.dtype)
