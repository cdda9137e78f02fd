"""Content functions against serial versions and round trips."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.functions import content as ct
from granary.operators.planner import POLICIES, Case


def serial_cuts(data, least, target, most, small, large):
    gear, out, at = [int(x) for x in ct.gear()], [], 0
    while at < len(data):
        h, end = 0, len(data)
        for size, b in enumerate(data[at : at + most], 1):
            h = (h << 1) + gear[b] & (1 << 64) - 1
            if size == most or size >= least and h & (large if size >= target else small) == 0:
                end = at + size
                break
        out.append(end)
        at = end
    return out


SIZES = {"least": 64, "target": 256, "most": 1024, "small": 255, "large": 127}


@settings(deadline=None, max_examples=60)
@given(st.binary(max_size=3000), st.integers(1, 256))
def test_cuts(data, alphabet):
    data = bytes(b % alphabet for b in data)
    assert ct.cuts(data, **SIZES) == serial_cuts(data, **SIZES)


def test_cuts_of_full_size():
    r = random.Random(1)
    full = {"least": ct.LEAST, "target": ct.TARGET, "most": ct.MOST, "small": ct.MASK_SMALL, "large": ct.MASK_LARGE}
    for data in (r.randbytes(900_000), bytes(600_000), b"text line\n" * 40_000, bytes(x & 3 for x in r.randbytes(400_000))):
        assert ct.cuts(data) == serial_cuts(data, **full)


def test_insertion_keeps_chunks():
    r = random.Random(2)
    base = r.randbytes(4 << 20)
    edited = base[:1_500_000] + r.randbytes(4096) + base[1_500_000:]
    share = lambda how: sum(c[2] for c in ct.chunks_of(edited, how(edited)) if c[3] in {x[3] for x in ct.chunks_of(base, how(base))}) / len(edited)
    assert share(ct.cuts) > 0.9 > 0.5 > share(ct.fixed_cuts)


@settings(deadline=None, max_examples=60)
@given(st.binary(max_size=400), st.binary(max_size=200), st.integers(0, 400))
def test_delta_round_trip(base, extra, at):
    target = base[:at] + extra + base[at:]
    assert ct.apply_delta(base, ct.delta(base, target)) == target


def test_features():
    def slow(b, k):
        mul, top = 0x9E3779B97F4A7C15, (1 << 64) - 1
        seen = set()
        for i in range(len(b) - 15):
            h = 0
            for v in b[i : i + 16]:
                h = h * mul + v + 1 & top
            h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & top
            h = (h ^ h >> 27) * 0x94D049BB133111EB & top
            seen.add(h ^ h >> 31)
        return sorted(seen)[:k]

    b = random.Random(3).randbytes(500)
    assert ct.shingle_features(b, 8).tolist() == slow(b, 8)
    assert len(ct.super_features(ct.shingle_features(b, 16))) == 4 and len(ct.edge_features(b)) == 2 and len(ct.edge_features(b[:20])) == 4
    assert len(ct.shingle_features(b"short")) == 0 and len(ct.sign_features(b)) == 8 and len(ct.sign_features(b[:99])) == 0


def test_small_codecs():
    assert ct.crc32c(b"123456789") == 0xE3069283 and ct.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    for n in (0, 127, 128, 2**63 + 5):
        assert ct.read_varint(ct.varint(n)) == (n, len(ct.varint(n)))
    with pytest.raises(ValueError):
        ct.read_varint(b"\xff" * 11)
    f = np.array([1.5, -2.25, 3e38, float("nan"), 1e-40, 0.0, -0.0, float("inf")], np.float32)
    assert ct.from_planes(ct.byte_planes(f), np.dtype(np.float32)).tobytes() == f.tobytes()
    g = np.sort(np.array([-3, -1, 0, 2, 5, 1e-30], np.float32))
    assert (np.diff(ct.ordered_key(g).astype(np.int64)) > 0).all()
    assert ct.bfloat16(np.array([1.0, 1.00390625, 1.01171875], np.float32)).tolist() == [0x3F80, 0x3F80, 0x3F82]
    x = ct.xor_residual(f, f[::-1].copy())
    assert (f.view(np.uint32) ^ x).tobytes() == f[::-1].tobytes()


def test_policies():
    r = random.Random(4)
    for _ in range(25):
        stages = [[("plain", {f"p{s}": r.randint(50, 300)}, []), ("rep", {str(r.randint(0, 9)): r.randint(10, 90) for _ in range(3)}, [str(x) for x in range(r.randint(0, 4))])] for s in range(4)]
        cost = {p: sum(c for _, c in Case(stages, True).run(p)) for p in POLICIES}
        assert cost["oracle"] == min(cost.values())
        every = min(sum(c for _, c in walk(stages, bits)) for bits in range(16))
        assert cost["oracle"] == every


def walk(stages, bits):
    have = set()
    for i, s in enumerate(stages):
        c = s[bits >> i & 1]
        yield c[0], Case.cost(c, have)
        have |= c[1].keys()
