"""Layered formats: a table built by hand, a real git pack, an OCI image; exact plans against all choices."""

from __future__ import annotations

import itertools
import json
import random
import subprocess

import pyarrow as pa
import pytest

from granary.functions.content import crc32c, varint
from granary.operators import derive as dv
from granary.operators.selection import Instance
from granary.sources import archives, readers


def block(entries, snappy=False):
    body, last = b"", b""
    for i, (k, v) in enumerate(entries):
        shared = 0 if i % 4 == 0 else next((n for n, (a, b) in enumerate(zip(k, last, strict=False)) if a != b), min(len(k), len(last)))
        body += varint(shared) + varint(len(k) - shared) + varint(len(v)) + k[shared:] + v
        last = k
    body += (0).to_bytes(4, "little") + (1).to_bytes(4, "little")
    kind = 0
    if snappy:
        body, kind = pa.compress(body, codec="snappy", asbytes=True), 1
    c = crc32c(body + bytes([kind]))
    return body, bytes([kind]) + (((c >> 15 | c << 17) + archives.MASK_DELTA) & 0xFFFFFFFF).to_bytes(4, "little")


def table(records):
    data, index = b"", []
    for i in range(0, len(records), 10):
        part = [(k + (s << 8 | t).to_bytes(8, "little"), v) for k, s, t, v in records[i : i + 10]]
        body, tail = block(part, snappy=i % 20 == 0)
        index.append((part[-1][0], varint(len(data)) + varint(len(body))))
        data += body + tail
    body, tail = block(index)
    foot = varint(0) + varint(0) + varint(len(data)) + varint(len(body))
    return data + body + tail + foot.ljust(40, b"\0") + archives.TABLE_MAGIC.to_bytes(8, "little")


def test_table(spark, tmp_path):
    records = [(b"key%04d" % i, i + 1, i % 2, b"v" * i) for i in range(57)]
    data = table(records)
    assert list(archives.table_records(data)) == records
    (tmp_path / "x.sst").write_bytes(data)
    assert readers.read(spark, "table", str(tmp_path), "*.sst").count() == 57
    with pytest.raises(ValueError, match="checksum"):
        list(archives.table_records(data[:20] + bytes([data[20] ^ 1]) + data[21:]))
    with pytest.raises(ValueError, match="footer"):
        list(archives.table_records(data[:-1]))


def test_git_pack(tmp_path):
    run = lambda *a, **k: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", *a], cwd=tmp_path, check=True, capture_output=True, **k).stdout
    run("init", "-q")
    text = "".join(f"line {i}\n" for i in range(3000))
    for i in range(4):
        (tmp_path / "f").write_text(text.replace("line 7\n", f"changed {i}\n"))
        run("add", "f")
        run("commit", "-qm", f"c{i}")
    ids = run("rev-list", "--objects", "--all")
    pack = run("pack-objects", "--stdout", "-q", input=b"\n".join(x.split()[0] for x in ids.splitlines()) + b"\n")
    found = list(archives.git_pack(pack))
    assert {r[0] for r in found} == {x.split()[0].decode() for x in ids.splitlines()} and max(r[4] for r in found) >= 1
    for sha, kind, _, _, _, body in found:
        assert run("cat-file", kind, sha) == body
    with pytest.raises(ValueError):
        list(archives.git_pack(pack[:50] + bytes([pack[50] ^ 1]) + pack[51:]))


def test_oci_walk(spark):
    layer = lambda n: {"mediaType": "layer", "digest": f"sha256:l{n}", "size": n}
    manifest = lambda *n: json.dumps({"config": {"mediaType": "config", "digest": "sha256:c", "size": 1}, "layers": [layer(x) for x in n]})
    index = lambda *d: json.dumps({"manifests": [{"mediaType": "m", "digest": x, "size": 1} for x in d]})
    blobs = [("root", index("a", "i2")), ("i2", index("b")), ("a", manifest(1, 2)), ("b", manifest(2, 3)), ("other", manifest(9)), ("sha256:l1", ""), ("sha256:c", "{}")]
    rows = archives.oci_layers(spark.createDataFrame(blobs, "digest string, body string"), "root").collect()
    assert {(r.manifest, r.ord, r.digest, r.stored) for r in rows} == {
        ("a", 0, "sha256:c", True), ("a", 1, "sha256:l1", True), ("a", 2, "sha256:l2", False), ("b", 0, "sha256:c", True), ("b", 1, "sha256:l2", False), ("b", 2, "sha256:l3", False)
    }


def test_exact_plan_is_the_best():
    r = random.Random(1)
    for _ in range(40):
        case = Instance([[(str(i), r.randint(0, 9), {str(c): 5 + c for c in r.sample(range(6), r.randint(1, 3))}) for i in range(r.randint(1, 3))] for _ in range(5)])
        best = min(case.cost(list(p)) for p in itertools.product(*[range(len(s)) for s in case.objects]))
        assert case.cost(case.exact()) == best <= case.cost(case.beam()) <= case.cost(case.refine()) <= case.cost(case.marginal())


def test_derive_edges(spark):
    index = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "native_key string, component int")
    assert {r.native_key: r.component for r in dv.resolved(index, spark.createDataFrame([("b",), ("z",)], "native_key string")).collect()} == {"b": 3, "z": None}
    with pytest.raises(Exception, match="ambiguous"):
        dv.resolved(index, index).collect()
    mtf = {r.o: r.code for r in dv.move_to_front(spark.createDataFrame([(1, i, s) for i, s in enumerate("abbac")], "k int, o int, s string"), "k", "o", "s").collect()}
    assert mtf == {0: 0, 1: 1, 2: 0, 3: 1, 4: 2}
    import numpy as np

    x = np.arange(100, dtype=np.float32)
    assert dv.residual_entropy(x, x) == 0 and dv.residual_entropy(x, x[::-1].copy()) > 0
