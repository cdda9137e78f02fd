"""Envelopes, batch checksums, page walks, deferred work and generated corpora against plain versions."""

from __future__ import annotations

import hashlib
import io
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from granary.functions import content, envelope
from granary.operators import derive, graph, planner
from granary.sources import generated, readers


def test_envelopes_round_trip_and_refuse_changes():
    pick = random.Random(1)
    for _ in range(60):
        base = bytes(pick.choice(b"abcd") for _ in range(pick.randint(0, 600)))
        target = base[pick.randint(0, 50) :] + bytes(pick.choice(b"xyz") for _ in range(pick.randint(0, 80))) + base[: pick.randint(0, 200)]
        held = envelope.over(base, target)
        stored = {hashlib.sha256(base).digest(): base}
        assert envelope.decode(held, stored.get) == target
        ops = [(0, o, n, lit) for o, n, lit in content.delta(base, target)]
        least, most = envelope.bounds(ops, len(target))
        assert least <= len(held) <= most
        assert set(envelope.bases_of(held)) <= set(stored)
        at = pick.randrange(len(held))
        try:
            assert envelope.decode(held[:at] + bytes([held[at] ^ 1]) + held[at + 1 :], stored.get) == target
        except (ValueError, IndexError, zlib.error):
            pass


def test_chains_of_envelopes():
    bodies = [b"start of it all " * 20]
    for k in range(6):
        bodies.append(bodies[-1] + b"and more %d" % k)
    name = [hashlib.sha256(b).digest() for b in bodies]
    envelopes = {name[k]: envelope.over(bodies[k - 1], bodies[k]) for k in range(1, 7)}
    assert envelope.resolved(name[6], envelopes, {name[0]: bodies[0]}) == bodies[6]
    with pytest.raises(ValueError, match="too long"):
        envelope.resolved(name[6], envelopes, {name[0]: bodies[0]}, most=3)
    with pytest.raises(ValueError, match="missing"):
        envelope.resolved(name[6], envelopes, {})
    parts = [bodies[6][i : i + 100] for i in range(0, len(bodies[6]), 100)]
    made = list(envelope.windows(bodies[5], iter(parts)))
    assert b"".join(envelope.decode(x, {name[5]: bodies[5]}.get) for x in made) == bodies[6] and len(made) == len(parts)


def plain_crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def plain_fnv(data: bytes) -> int:
    h = 14695981039346656037
    for b in data:
        h = (h ^ b) * 1099511628211 % (1 << 64)
    return h


def test_checksums_of_batches():
    pick = random.Random(2)
    rows = [bytes(pick.randrange(256) for _ in range(pick.randint(0, 90))) for _ in range(80)] + [b"", b"123456789", bytes(2000)]
    assert content.crc32c_all(rows).tolist() == [plain_crc32c(r) for r in rows]
    assert content.fnv1a_all(rows).tolist() == [plain_fnv(r) for r in rows]
    assert content.crc32c(b"123456789") == 0xE3069283 and content.crc32c_all([]).tolist() == [] and content.fnv1a(b"a") == 0xAF63DC4C8601EC8C


@pytest.mark.parametrize("most", [300, 2000, 1 << 40])
def test_record_cuts(most):
    pick = random.Random(3)
    keys = [bytes(pick.randrange(256) for _ in range(pick.randint(1, 30))) for _ in range(900)]
    sizes = np.array([pick.choice((0, 5, 40, 700)) for _ in keys])
    want, held, target = [], 0, 512
    for i, (k, n) in enumerate(zip(keys, sizes.tolist(), strict=True)):
        size = len(k) + n + 4
        held += size
        h = plain_fnv(k)
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)
        h ^= h >> 32
        if held >= most or size >= target or h < size * (((1 << 64) - 1) // target):
            want.append(i)
            held = 0
    assert content.record_cuts(keys, sizes, target, most).tolist() == want and content.record_cuts([], np.empty(0, int), 5, 5).tolist() == []


def test_half_floats(spark):
    bits = np.arange(1 << 16, dtype=np.uint16)
    want = bits.view(np.float16).astype(np.float64)
    got = spark.range(1 << 16).select(F.col("id").cast("int").alias("id")).select("id", content.half_value(F.col("id")).alias("v")).toPandas().sort_values("id")["v"].to_numpy()
    assert np.array_equal(got, want, equal_nan=True)
    finite = want[np.isfinite(want)]
    assert np.array_equal(content.half_bits(finite), bits[np.isfinite(want)])


def test_sha3(spark):
    got = spark.createDataFrame([("abc",), ("",), (None,)], "t string").select(content.sha3_256("t").alias("h")).collect()
    assert [r.h for r in got] == [hashlib.sha3_256(b"abc").hexdigest(), hashlib.sha3_256(b"").hexdigest(), None]


@pytest.mark.parametrize("version", ["1.0", "2.0"])
def test_parquet_pages(version):
    t = pa.table({"a": list(range(5000)), "b": [None if i % 3 else f"v{i % 7}" for i in range(5000)]})
    out = io.BytesIO()
    pq.write_table(t, out, row_group_size=2000, data_page_size=512, data_page_version=version, compression="zstd", write_batch_size=100)
    pages = list(readers.parquet_pages(out.getvalue()))
    meta = pq.ParquetFile(io.BytesIO(out.getvalue())).metadata
    for g in range(meta.num_row_groups):
        for c in range(2):
            x = meta.row_group(g).column(c)
            mine = [p for p in pages if p[0] == g and p[1] == x.path_in_schema]
            assert sum(p[9] for p in mine if p[3].startswith("data")) == x.num_values
            assert sum(p[6] + p[7] for p in mine) == x.total_compressed_size and sum(p[6] + p[8] for p in mine) == x.total_uncompressed_size
    assert len(pages) > 20


def test_deferred_work(spark):
    rows = [("k", i, c) for i, c in enumerate("aabcadbbe", 1)] + [("j", 1, "z")]
    got = planner.deferred(spark.createDataFrame(rows, "key string, seq long, content string"), room=2, every=4, budget=1).collect()
    assert {(r.key, r.content, r.first, r.arrivals, r.how, r.at) for r in got} == {
        ("k", "a", 1, 2, "forced", 4),  # c finds the queue full
        ("k", "b", 3, 1, "tick", 4),
        ("k", "c", 4, 1, "forced", 6),  # d finds it full
        ("k", "a", 5, 1, "forced", 7),  # b finds it full
        ("k", "d", 6, 1, "tick", 8),
        ("k", "b", 7, 2, "waiting", None),
        ("k", "e", 9, 1, "waiting", None),
        ("j", "z", 1, 1, "waiting", None),
    }


def test_generated_chains_repeat(spark):
    a = {tuple(r) for r in generated.chains(spark, 3, 5, 40, seed=1).collect()}
    assert a == {tuple(r) for r in generated.chains(spark, 3, 5, 40, seed=1).repartition(7).collect()} and len(a) == 600
    body = {(x, v, c): b for x, v, c, b in a}
    changed = sum(body[x, v, c] != body[x, v - 1, c] for x, v, c in body if v)
    assert 20 < changed < 90 and a != {tuple(r) for r in generated.chains(spark, 3, 5, 40, seed=2).collect()}


def test_ends_of_trees_and_chains(spark):
    for slot in (None, -1):
        with pytest.raises(Exception, match="slots"):
            graph.merkle_levels(spark.createDataFrame([(0, "a"), (1, "b"), (slot, "c")], "slot long, hash string"))
    chain = spark.createDataFrame([(n, n - 1 if n else None) for n in range(20)], "obj long, base long")
    assert {r.id: r.depth for r in derive.chain_bases(chain, "obj", 19).collect()} == {n: n for n in range(20)}
    for bad in (chain, spark.createDataFrame([(1, 2), (2, 1)], "obj long, base long")):
        with pytest.raises(Exception, match="too long or cyclic"):
            derive.chain_bases(bad, "obj", 8).collect()


def test_scatter(spark):
    rows = [([1.0, 2.0, 3.0], [True, False, True, None, True]), ([], [False]), ([5.0], []), ([1.0], [True, True])]
    got = spark.createDataFrame(rows, "v array<double>, m array<boolean>").select(derive.scatter(F.col("v"), F.col("m")).alias("s")).collect()
    assert [r.s for r in got] == [[1.0, None, 2.0, None, 3.0], [None], [], [1.0, None]]


def test_group_plans():
    from granary.operators.selection import Instance

    # two objects share a chunk, so giving it up frees nothing until both do
    raw = [("a", 0, {"x": 100, "p": 10}), ("a", 0, {"x": 100, "q": 10}), ("a", 0, {"r": 50})]
    delta = [("b", 0, {"d1": 40}), ("b", 0, {"d2": 40}), ("b", 0, {"d3": 80})]
    case = Instance([[raw[i], delta[i]] for i in range(3)])
    assert case.cost([0, 0, 0]) == 170 and case.of_kind("b") == [1, 1, 0] and case.cost(case.pure()) == 130
    assert case.exclusive() == [0, 0, 0]  # frees 70 by its rule and adds 160
    assert case.marginal() == [1, 1, 0] and case.exact() == [1, 1, 0] and case.best_of_two() == [1, 1, 0]
    alone = Instance([[("a", 0, {"x": 90}), ("c", 0, {"z": 30})], [("a", 0, {"y": 90}), ("c", 0, {"z": 30})]])
    assert alone.exclusive() == [1, 1] and alone.cost(alone.exclusive()) == 30


def test_derivation_steps():
    from granary.functions import derivations as dv

    x = np.arange(64, dtype="<f4") - 20.5
    raw = x.tobytes()
    back = [{"kind": "perm", "width": 4, "dims": [2, 4, 8], "axes": [2, 0, 1]}, {"kind": "perm", "width": 4, "dims": [8, 2, 4], "axes": [1, 2, 0]}, {"kind": "bswap", "width": 4}, {"kind": "bswap", "width": 4}]
    assert dv.applied(back, [raw]) == raw
    assert np.array_equal(np.frombuffer(dv.applied(back[:1], [raw]), "<f4").reshape(8, 2, 4), x.reshape(2, 4, 8).transpose(2, 0, 1))
    assert dv.applied([{"kind": "concat"}, {"kind": "prepend", "literal": b"h"}, {"kind": "slice", "offset": 1, "length": 3}], [b"ab", b"cd"]) == b"abc"
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    assert dv.applied([{"kind": "inflate"}], [z.compress(raw) + z.flush()]) == raw
    plain = b"".join(len(v).to_bytes(4, "little") + v for v in (b"xy", b"", b"abc"))
    assert np.frombuffer(dv.applied([{"kind": "plain_offsets"}], [plain]), "<i4").tolist() == [0, 2, 2, 5] and dv.applied([{"kind": "plain_data"}], [plain]) == b"xyabc"
    assert dv.scattered(b"aabbcc", bytes([0b1011]), 2, 5) == b"aabb\0\0cc\0\0"
    assert np.frombuffer(dv.converted(x.tobytes(), "f4", "f2"), "<f2").tolist() == x.astype("f2").tolist()
    assert np.frombuffer(dv.converted(dv.converted(np.float32([1.0, -2.5]).tobytes(), "f4", "bf16"), "bf16", "f4"), "<f4").tolist() == [1.0, -2.5]
    for bad in ([{"kind": "slice", "offset": 2, "length": 9}], [{"kind": "no"}], [{"kind": "bswap", "width": 3}]):
        with pytest.raises(ValueError):
            dv.applied(bad, [b"abcd"])


def test_quantised_blocks():
    from granary.functions import derivations as dv

    pick = np.random.default_rng(4)
    x = np.concatenate([pick.normal(size=(5, 32)), np.zeros((1, 32)), np.full((1, 32), -3.0)]).astype("<f4")
    for made, size, of in ((dv.q8_0(x.tobytes()), 34, 127), (dv.q4_0(x.tobytes()), 18, 8)):
        assert len(made) == size * len(x)
        for row, block in zip(x, np.frombuffer(made, np.uint8).reshape(-1, size), strict=True):
            d = np.frombuffer(block[:2].tobytes(), "<f2")[0].astype(np.float32)
            q = block[2:].view(np.int8).astype(int) if size == 34 else np.r_[block[2:] & 15, block[2:] >> 4].astype(int) - 8
            assert np.abs(q).max() in (0, of) and np.abs(row - d * q).max() <= abs(d) * (0.51 if size == 34 else 1.01) + 1e-6


@pytest.mark.parametrize("kind", ["key", "sub", "xor"])
def test_residuals_are_exact(kind):
    from granary.functions import derivations as dv

    pick = np.random.default_rng(5)
    for dtype in (np.float16, np.float32, np.float64):
        base = np.r_[pick.normal(size=500), 0.0, -0.0, np.inf, -np.inf, np.nan, 1e-7].astype(dtype)
        target = np.r_[base[:250] * dtype(1.01), base[250:][::-1]].astype(dtype)
        for a, c in ((1.0, 0.0), (1.01, 0.5)):
            with np.errstate(all="ignore"):
                held = dv.residual(kind, base, target, a, c)
                assert dv.restored(kind, base, held, a, c).tobytes() == target.tobytes()
        near = dv.residual(kind, base[:250], (base[:250] * dtype(1.001)).astype(dtype))
        far = dv.residual(kind, base[:250], base[:250][::-1].copy())
        assert np.median(near.astype(float)) < np.median(far.astype(float))


def test_descriptors_are_strict(spark, tmp_path):
    from granary.sources import tables

    def put(name: str, *lines: str) -> str:
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text("\n".join(lines))
        return str(tmp_path / name)

    good = '{"manifest_format_version":1,"version_id":"v","chunks":[{"sha256":"a","length":3},{"sha256":"b","length":0},{"sha256":"a","length":3}]}'
    refs = tables.chunk_refs(tables.manifests(spark, put("good", good))).collect()
    assert [(r.ord, r.sha, r.length, r.start) for r in sorted(refs, key=lambda r: r.ord)] == [(0, "a", 3, 0), (1, "b", 0, 3), (2, "a", 3, 3)]
    for name, line in (("other", good.replace(":1,", ":2,", 1)), ("none", '{"version_id":"v","chunks":[]}'), ("broken", good[:-5])):
        with pytest.raises(Exception):
            tables.manifests(spark, put(name, good, line)).collect()
    frontier = put("frontier", *(json.dumps({"object": f"o{k}", "day": k % 3, "size": k, "key": "k"}) for k in range(4)))
    assert {(r.object, r.stage) for r in tables.series(tables.frontier(spark, frontier)).collect()} == {("o0", 0), ("o3", 1), ("o1", 2), ("o2", 3)}
