"""SimHash near-duplicates through vantage-point trees.

Fingerprints link at three differing bits or fewer, and a component is what links reach. Equal fingerprints are one point, so
a group of copies costs one point however large it is.

A vantage-point tree splits points by their Hamming distance to a vantage point at the median; the triangle inequality says
that a query within ``r`` of a point is within ``r`` of it in distance to any vantage point, so a branch is pruned unless the
query's distance reaches it within ``r``. Over all 64 bits distances crowd around 32 and few branches can be pruned. The
fingerprint is therefore split in two halves of 32 bits with one tree each: two fingerprints at three bits or fewer have a half
with at most one differing bit, so each tree is searched with ``r = 1``, where about a fourth of the queries at a node must go
both ways, and whole fingerprints are compared at the leaves. Both trees together find every pair.

The top of each tree, built on the driver from a sample of ``SAMPLED`` points a shard, deals the points into shards, of which
there are as many as the points need; a point is owned by one shard and queries each shard whose boundary lies within ``r``. A
shard builds the rest of its tree and returns not its pairs but a spanning forest of them, at most one edge for each of its
points: components are the same and a dense group makes no quadratic output. Points whose halves are all equal are parted by
whole fingerprints instead, with ``r = 3``, in the top and in the shards, so that they don't fill one shard or one leaf.
Components over all shards come from min-label rounds with pointer jumping over the forest's edges.

A fingerprint or component that many documents have is counted before it is joined, and its documents stay where they are.

Defined results: a null or empty text has fingerprint zero, linked like any other. A null ``doc_id`` counts in no minimum; a
component of nulls has a null ``component_id``. Repeated rows are separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import ascii_lower, dropped, let, small_batches, spread_join, words, written

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Points to a shard, about; a shard is one task's memory. At most a factor 1.3 of them at each level of the top are asked of two shards.
SHARD_POINTS = 250_000
#: Points a shard from which the top of a tree is built on the driver: one in SHARD_POINTS / SAMPLED of all, eight bytes each.
SAMPLED = 64
#: Points of a leaf, compared directly.
LEAF = 64


def shingle_hashes(text: bytes, n: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Of UTF-8 ``text``: ASCII lower case, words between ASCII white space, XXH64 of each ``n``-word shingle, repeats included."""
    w = text.lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not w:
        return np.empty(0, np.uint64)
    grams = [b" ".join(w)] if len(w) < n else map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, seed) for g in grams), dtype=np.uint64, count=max(1, len(w) - n + 1))


def majority(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):  # long texts in blocks
        ones += np.unpackbits(h[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint(text: bytes, n: int = SHINGLE, seed: int = SEED) -> int:
    return majority(shingle_hashes(text, n, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = SHINGLE) -> DataFrame:
    """(id, fp): the signed 64-bit pattern of each document's fingerprint."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py(), n) if t.is_valid else 0 for t in b.column(1).cast(pa.binary())), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text)).mapInArrow(of, f"id {kind}, fp bigint")


def _half(x: np.ndarray, tree: int) -> np.ndarray:
    return (x >> np.uint64(32 * tree)) & np.uint64(0xFFFFFFFF)


#: What of a fingerprint a node measures: the lower or upper half, or all of it.
WHOLE = 2


def _part(x: np.ndarray, kind: int) -> np.ndarray:
    return x if kind == WHOLE else _half(x, kind)


def _even(part: np.ndarray) -> tuple[int, int] | None:
    """A vantage point and a distance with points on both sides, as even as can be; None if all points are equal."""
    best = None
    for v in part[:: max(1, len(part) // 5)][:6]:
        d = np.bitwise_count(part ^ v)
        mid = int(np.median(d))
        for mu in (mid, mid - 1):
            inside = int(np.count_nonzero(d <= mu))
            if 0 < inside < len(part) and (best is None or abs(2 * inside - len(part)) < best[0]):
                best = (abs(2 * inside - len(part)), int(v), mu)
    return best and (best[1], best[2])


def _cut(points: np.ndarray, tree: int) -> tuple[int, int, int] | None:
    """(kind, vantage, distance) that parts the points, by their halves if those differ."""
    for kind in (tree, WHOLE):
        found = _even(_part(points, kind))
        if found:
            return kind, *found
    return None


class Node(NamedTuple):
    kind: int
    vantage: int
    distance: int
    near: Node | int
    far: Node | int


def top(sample: np.ndarray, tree: int, shards: int) -> Node | int:
    """A tree whose leaves are shards' numbers."""
    count = iter(range(2 * shards))

    def grow(points: np.ndarray, n: int) -> Node | int:
        cut = _cut(points, tree) if n > 1 and len(points) > 1 else None
        if cut is None:
            return next(count)
        kind, v, mu = cut
        near = np.bitwise_count(_part(points, kind) ^ np.uint64(v)) <= mu
        return Node(kind, v, mu, grow(points[near], n // 2), grow(points[~near], n // 2))

    return grow(sample, shards)


def _reach(kind: int, within: int) -> int:
    """How far two points within the distance, of which the tree must find those alike in its half, differ in what a node measures."""
    return within if kind == WHOLE else within // 2


def routed(points: np.ndarray, node: Node | int, within: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, rows that it owns or that query it, whether it owns them)."""

    def walk(node, rows: np.ndarray, own: np.ndarray):
        if not len(rows):
            return
        if isinstance(node, int):
            yield node, rows, own
            return
        kind, v, mu, near, far = node
        radius = _reach(kind, within)
        d = np.bitwise_count(_part(points[rows], kind) ^ np.uint64(v)).astype(np.int16)
        for child, reach, inside in ((near, d <= mu + radius, d <= mu), (far, d > mu - radius, d > mu)):
            yield from walk(child, rows[reach], own[reach] & inside[reach])

    yield from walk(node, np.arange(len(points)), np.ones(len(points), dtype=bool))


def forest(points: np.ndarray, own: np.ndarray, tree: int, within: int = RADIUS) -> np.ndarray:
    """Edges (pairs of rows) that join just the rows that pairs within the distance join, of which one row at least is owned."""
    parent = np.arange(len(points))
    edges: list[np.ndarray] = []

    def roots(i: np.ndarray) -> np.ndarray:
        x = parent[i]
        while True:
            y = parent[x]
            if (x == y).all():
                parent[i] = x
                return x
            x = y

    def join(i: np.ndarray, j: np.ndarray) -> None:
        """Each round every root takes at most one lower root, so pairs that are joined already cost one look and no loop."""
        while len(i):
            x, y = roots(i), roots(j)
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            high, first = np.unique(np.maximum(x, y), return_index=True)
            parent[high] = np.minimum(x, y)[first]
            if len(first):
                edges.append(np.column_stack([i[first], j[first]]))

    def compare(p: np.ndarray, q: np.ndarray) -> None:
        step = max(1, (1 << 20) // max(1, len(p)))
        for at in range(0, len(q), step):  # a block of a million distances at a time
            some = q[at : at + step]
            a, b = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[p][None, :]) <= within)
            i, j = some[a], p[b]
            join(i[i != j], j[i != j])

    stack = [(np.nonzero(own)[0], np.arange(len(points)))]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        cut = _cut(points[p], tree) if len(p) > LEAF else None
        if cut is None:
            compare(p, q)
            continue
        kind, v, mu = cut
        radius = _reach(kind, within)
        dp, dq = (np.bitwise_count(_part(points[x], kind) ^ np.uint64(v)).astype(np.int16) for x in (p, q))
        stack += [(p[dp <= mu], q[dq <= mu + radius]), (p[dp > mu], q[dq > mu - radius])]
    return np.concatenate(edges) if edges else np.empty((0, 2), dtype=np.int64)


def links(points: DataFrame, within: int = RADIUS) -> DataFrame:
    """(a, b): edges between distinct fingerprints ``fp`` that join the same points as all pairs within the distance."""
    n = points.count()
    shards = 1
    while shards < n / SHARD_POINTS:
        shards *= 2
    spark = points.sparkSession
    trees: list = [0, 0]
    if shards > 1:  # by hash of the fingerprint, the same in every run
        share = min(1.0, SAMPLED * shards / n)
        at = points.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < int(share * (1 << 40))).toArrow().column("fp").to_numpy()
        sample = np.sort(at).view(np.uint64)
        trees = [top(sample, t, shards) for t in (0, 1)]
    held = spark.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t in (0, 1):
                for shard, rows, own in routed(x, held.value[t], within):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), 2 * shard + t, dtype=np.int64)), pa.array(x[rows].view(np.int64)), pa.array(own)], names=["shard", "fp", "own"])

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy()
        e = forest(fp.view(np.uint64), pdf["own"].to_numpy(), int(key[0]) % 2, within)
        return pd.DataFrame({"a": fp[e[:, 0]], "b": fp[e[:, 1]]})

    dealt = points.select("fp").mapInArrow(deal, "shard bigint, fp bigint, own boolean")
    return dealt.groupBy("shard").applyInPandas(solve, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of ``edges`` (a, b) the smallest node of its component.

    Each round a node takes the smallest label around it and then that label's own label, so chains halve; every round is a
    written table, and those before it go. The driver sees only the number of labels that changed.
    """
    e = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = written(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        around = spread_join(e, labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        near = written(labels.join(around, labels["node"] == around["a"]).select("node", F.col("root").alias("was"), F.least("root", "m").alias("via")))
        far = spread_join(near, labels.select(F.col("node").alias("via"), F.col("root").alias("far")), "via", "left")
        new = written(far.select("node", "was", F.least("via", F.coalesce("far", "via")).alias("root")))
        changed = new.filter(F.col("root") != F.col("was")).count()
        dropped(near, labels)
        labels = new
        if not changed:
            dropped(e)
            return labels.select("node", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", within: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id): each document's fingerprint and the smallest id that links reach from it."""
    fps = written(fingerprints(docs, id_col, text, shingle))
    points = written(fps.groupBy("fp").agg(F.min("id").alias("least")))
    edges = written(links(points.select("fp"), within))
    roots = components(edges)
    dropped(edges)
    held = written(points.join(roots, points["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = held.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = spread_join(held, written(least), "root").select("fp", "component_id")
    return spread_join(fps, written(of_fp), "fp").select("id", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    """``op9_simhash``."""
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group: that with the smallest id; the columns of ``docs``. Rows without id are kept; repeated rows of one id are one document.

    Small documents share fingerprints by chance more easily than long ones: a text of fewer than three words has one shingle,
    and those without a word all have fingerprint zero. They link like any other.
    """
    found = near_duplicates(docs, id_col, text)
    gone = found.filter(F.col("id") != F.col("component_id")).select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")


def fingerprint_columns(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp) in built-in functions only, for a check on small tables: 64 sums over the shingles' hashes."""
    w = words(ascii_lower(F.coalesce(F.col(text), F.lit(""))))
    grams = lambda x: F.when(F.size(x) < SHINGLE, F.array(F.array_join(x, " "))).otherwise(F.transform(F.sequence(F.lit(1), F.size(x) - SHINGLE + 1), lambda i: F.array_join(F.slice(x, i, SHINGLE), " ")))
    hashed = let(w, lambda x: F.when(F.size(x) > 0, F.transform(grams(x), lambda g: F.xxhash64(g))).otherwise(F.array().cast("array<bigint>")))
    bit = lambda h, i: F.aggregate(h, F.lit(0), lambda a, x: a + F.getbit(x, i).cast("int"))
    fp = let(hashed, lambda h: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.when(2 * bit(h, i) > F.size(h), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))))
    return docs.select(F.col(id_col).alias("id"), fp.alias("fp"))
