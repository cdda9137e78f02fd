"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Words are those of ``simhash``: ASCII lower case, between ASCII white space. A shorter text has its whole word sequence as its
one shingle. Documents link at the similarity, and a group is what links reach.

Candidates come from two sources, and each is confirmed on the words themselves:

1. SimHash. Fingerprints of five-word shingles link through the vantage-point trees of ``simhash``. Copies with few changes,
   most of all, are found and joined there.
2. For links that lie beyond its three bits, a prefix filter that loses none. Under any total order of shingles, two sets of
   similarity ``t`` share one of their first ``n - ceil(t n) + 1``, and what follows that shared place must suffice for ``t``.
   The order is by a count of shingles over all documents in ``CELLS`` cells, then by hash: rare ones first, so few texts meet
   under one. Pairs that links already join are left out.

Exact copies are one node. A shingle under which many texts meet first gives pairs with one of them, and only then those pairs
that links don't join yet, so a dense group costs about a pair for each member. Texts that meet under a shingle are dealt in
blocks of about ``BLOCK``, and blocks are compared two by two, so no task holds them all.

Defined results: null and empty texts have no shingles and are copies of each other. Rows without an id link nothing. Repeated
rows of one id are one document, linked by any of their texts. Empty tables have no groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import dropped, small_batches, spread_join, written
from granary.llm.simhash import components, links, majority, shingle_hashes

SHINGLE = 5
#: Similarity as a fraction: shared shingles times the second are at least those of both times the first.
ALIKE = (4, 5)
#: Cells in which shingles are counted, four bytes each; slabs in which they are added up.
CELLS, SLABS = 1 << 20, 64
#: Texts under a shingle that are compared with each other at once, and rounds of one against all for those with more.
FEW, STARS = 12, 2
#: Texts of a block, about. A cell with more than one in HOT_SHARE of all shingles is hot, and its shingles' texts are dealt to SALTS.
BLOCK, HOT_SHARE, SALTS = 4096, 2000, 64


def shingles(text: bytes) -> set[bytes]:
    w = text.lower().split()
    if len(w) < SHINGLE:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)), strict=False)))


def alike(x: set[bytes], y: set[bytes]) -> bool:
    shared = len(x & y)
    return shared * ALIKE[1] >= (len(x) + len(y) - shared) * ALIKE[0]


def frequencies(docs: DataFrame) -> np.ndarray:
    """How often shingles of each cell occur in all texts, each counted once a text; CELLS numbers come to the driver."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.uint32)
        for b in batches:
            for t in b.column(0).cast(pa.binary()):
                if t.is_valid:
                    np.add.at(total, (np.unique(shingle_hashes(t.as_py(), SHINGLE)) & np.uint64(CELLS - 1)).astype(np.int64), 1)
        slabs = total.reshape(SLABS, -1)
        some = np.flatnonzero(slabs.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([slabs[i].tobytes() for i in some], pa.binary())], names=["slab", "counts"])

    def add(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS // SLABS, np.uint64)
        for b in parts:
            for x in b.column("counts"):
                total += np.frombuffer(x.as_buffer(), np.uint32)
        counts = np.minimum(total, np.uint64((1 << 32) - 1)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["slab", "counts"])

    out = np.zeros((SLABS, CELLS // SLABS), np.uint32)
    found = docs.select("text").mapInArrow(of, "slab int, counts binary").groupBy("slab").applyInArrow(add, "slab int, counts binary").toArrow()
    for slab, counts in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        out[slab] = np.frombuffer(counts, np.uint32)
    return out.ravel()


def prefix(h: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first of the distinct hashes in the common order, of which two similar sets share one."""
    n = len(h)
    if not n:
        return h
    order = np.lexsort((h, often[(h & np.uint64(len(often) - 1)).astype(np.int64)]))
    return h[order[: n - -(-n * ALIKE[0] // ALIKE[1]) + 1]]


def signatures(docs: DataFrame, kind: str, often: np.ndarray) -> DataFrame:
    """(id, copy, n, fp, keys) of (id, text): a digest of the words, the number of shingles, the fingerprint and the prefix."""
    held = docs.sparkSession.sparkContext.broadcast(often)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            copy, count, fps, keys = [], [], [], []
            for t in b.column(1).cast(pa.binary()):
                text = t.as_py() if t.is_valid else b""
                h = shingle_hashes(text, SHINGLE)
                fps.append(majority(h))
                h = np.unique(h)
                copy.append(xxhash.xxh3_128_digest(b" ".join(text.lower().split())))
                count.append(len(h))
                keys.append(prefix(h, held.value).view(np.int64))
            fp = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(copy, pa.binary()), pa.array(count, pa.int32()), pa.array(fp), pa.array(keys, pa.list_(pa.int64()))], names=["id", "copy", "n", "fp", "keys"])

    return docs.mapInArrow(of, f"id {kind}, copy binary, n int, fp bigint, keys array<bigint>")


def pairs_of(n: np.ndarray, pos: np.ndarray, root: np.ndarray, block: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs with unlike roots, near enough sizes and enough after the shared place, of one block or of two."""
    m = len(n)
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    every = np.arange(m)
    if m > FEW and turn < STARS:
        rows = np.array([m // 2 if turn else int(np.argmin(pos))])
    else:
        rows = every
    two = block.min() != block.max()
    a, b = [], []
    step = max(1, (1 << 22) // m)
    for at in range(0, len(rows), step):
        x = rows[at : at + step, None]
        y = every[None, :]
        least, most = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        shared = np.minimum(n[x] - pos[x], n[y] - pos[y])  # at most, from the place where both hold the shingle
        ok = (root[x] != root[y]) & (least * ALIKE[1] >= most * ALIKE[0]) & (shared * (ALIKE[0] + ALIKE[1]) >= (n[x] + n[y]) * ALIKE[0])
        if len(rows) == m:
            ok &= x < y
            if two:
                ok &= block[x] != block[y]
        i, j = np.nonzero(ok)
        a.append(rows[at + i])
        b.append(j)
    return np.concatenate(a), np.concatenate(b)


def confirmed(pairs: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
    """Those of pairs (a, b) of ids whose texts are alike."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, set())
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(3).cast(pa.binary()).to_pylist(), strict=True):
                if x != last[0]:
                    last = (x, shingles(x or b""))
                keep.append(alike(last[1], shingles(y or b"")))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(sure, f"a {kind}, b {kind}")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids of (id, fp): those of one fingerprint with its least, and the least of linked ones."""
    points = written(nodes.groupBy("fp").agg(F.min("id").alias("least")))  # small rows
    same = spread_join(nodes, points, "fp").filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    linked = links(points.select("fp"))
    ends = linked.join(points.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(points.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    return same.unionAll(ends.select(*_ordered("x", "y"))).distinct()


def met(nodes: DataFrame, kind: str, often: np.ndarray) -> DataFrame:
    """(key, i, j, m) of (id, n, keys, root): texts of unlike roots under each shingle that several have, of blocks i and j.

    Rows are sorted by shingle once and pass through; a shingle's texts are held up to a block. Those of more, and of hot cells,
    are counted and dealt in blocks of which each two meet.
    """
    hot = np.flatnonzero(often > max(1, int(often.sum(dtype=np.uint64)) // HOT_SHARE)).tolist()
    is_hot = F.col("key").bitwiseAND(F.lit(CELLS - 1)).isin(hot) if hot else F.lit(False)
    rows = nodes.select(F.posexplode("keys").alias("pos", "key"), "n", F.col("id").alias("node"), "root")
    rows = rows.withColumn("dealt", F.when(is_hot, F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).otherwise(F.lit(-1)))
    member = f"struct<n:int,pos:int,node:{kind},root:{kind},block:int>"
    most = BLOCK

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over: tuple | None = None  # the shingle whose texts are more than a block
        waiting: list[pa.RecordBatch] = []

        def lists(t: pa.Table, starts: np.ndarray, big: np.ndarray) -> pa.RecordBatch:
            c = {x: t.column(x).combine_chunks() for x in ("key", "n", "pos", "node", "root")}
            fields = [c["n"].cast(pa.int32()), c["pos"].cast(pa.int32()), c["node"], c["root"], pa.array(np.zeros(len(t), np.int32))]
            values = pa.StructArray.from_arrays(fields, names=["n", "pos", "node", "root", "block"])
            bounds = pa.array(np.r_[starts, len(t)].astype(np.int32))
            return pa.RecordBatch.from_arrays([c["key"].take(pa.array(starts)), pa.array(big), pa.ListArray.from_arrays(bounds, values)], names=["key", "big", "m"])

        def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """Complete groups, or a part of one that is too large."""
            nonlocal over
            key, dealt = t.column("key").to_numpy(), t.column("dealt").to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (dealt[1:] != dealt[:-1])])
            size = np.diff(np.r_[starts, len(t)])
            big = (dealt[starts] >= 0) | (size > most)
            if over is not None:
                big[0] |= over == (key[0], dealt[0])
            root = t.column("root").to_numpy()
            unlike = np.add.reduceat(root != np.repeat(root[starts], size), starts) > 0
            kept = big | ((size > 1) & unlike)
            if kept.any():
                part = t.filter(pa.array(np.repeat(kept, size)))
                yield lists(part, np.cumsum(size[kept]) - size[kept], big[kept])

        def held(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal over, waiting
            key, dealt = t.column("key").to_numpy(), t.column("dealt").to_numpy()
            cut = len(t) if last else int(np.flatnonzero((key != key[-1]) | (dealt != dealt[-1]))[-1] + 1) if ((key != key[-1]) | (dealt != dealt[-1])).any() else 0
            if cut:
                yield from whole(t.slice(0, cut))
                over = None if over != (key[-1], dealt[-1]) else over
            rest = t.slice(cut)
            if len(rest) > most or (len(rest) and over == (key[-1], dealt[-1])):
                yield lists(rest, np.zeros(1, np.int64), np.ones(1, bool))
                over, rest = (key[-1], dealt[-1]), rest.slice(len(rest))
            waiting = rest.to_batches() if len(rest) else []

        for b in batches:
            if b.num_rows:
                yield from held(pa.Table.from_batches([*waiting, b]), False)
        if waiting:
            yield from held(pa.Table.from_batches(waiting), True)

    found = written(rows.repartition("key", "dealt").sortWithinPartitions("key", "dealt").mapInArrow(gather, f"key bigint, big boolean, m array<{member}>"))
    few = found.filter("NOT big").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "m")
    large = found.filter("big")
    if large.isEmpty():
        return few
    counts = written(large.groupBy("key").agg(F.sum(F.size("m")).alias("n_key")).filter("n_key > 1"))
    large = spread_join(large, counts, "key").withColumn("blocks", F.ceil(F.col("n_key") / BLOCK).cast("int"))
    large = large.select("key", "blocks", F.explode("m").alias("x")).withColumn("own", F.pmod(F.xxhash64("x.node", F.lit(1)), F.col("blocks")).cast("int"))
    large = large.select("key", "own", "x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    one = F.struct("x.n", "x.pos", "x.node", "x.root", F.col("own").alias("block"))
    large = large.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(one).alias("m"))
    return few.unionAll(large.filter(F.exists("m", lambda x: x["root"] != F.get("m", F.lit(0))["root"])))


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, root): ids that have a near copy and the least id of their group."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL")
    often = frequencies(texts)
    held = written(signatures(texts, kind, often))
    least = held.groupBy("copy").agg(F.min("id").alias("a"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = written(least.select("copy", F.col("a").alias("id"), "n", "fp", "keys"))
    copies = spread_join(held.select("id", "copy"), nodes.select("copy", F.col("id").alias("a")), "copy")
    edges = written(copies.filter("id <> a").select("a", F.col("id").alias("b")).distinct())
    dropped(held)
    pairs = written(by_fingerprint(nodes.select("id", "fp")))
    edges = written(edges.unionAll(confirmed(pairs, texts, kind)))
    roots = components(edges)
    rooted = nodes.select("id", "n", "keys").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    shared = written(met(rooted, kind, often))
    member = F.struct("x.n", "x.pos", "x.node", F.coalesce("root", "x.node").alias("root"), "x.block")
    for turn in range(STARS + 1):

        def split(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for m in b.column(0):
                    f = m.values
                    node = f.field("node")
                    x, y = pairs_of(*(f.field(c).to_numpy(zero_copy_only=False) for c in ("n", "pos", "root", "block")), turn)
                    for i in range(0, len(x), 1 << 16):
                        yield pa.RecordBatch.from_arrays([node.take(pa.array(x[i : i + (1 << 16)])), node.take(pa.array(y[i : i + (1 << 16)]))], names=["x", "y"])

        pairs = written(shared.select("m").mapInArrow(split, f"x {kind}, y {kind}").select(*_ordered("x", "y")).distinct())
        if not pairs.isEmpty():
            edges = written(edges.unionAll(confirmed(pairs, texts, kind)))
            roots = components(edges)
        many = shared.filter(F.size("m") > FEW)
        if turn == STARS or many.isEmpty():
            return roots
        again = many.select("key", "i", "j", F.explode("m").alias("x")).withColumn("node", F.col("x.node")).join(roots, "node", "left")
        again = again.groupBy("key", "i", "j").agg(F.sort_array(F.collect_list(member)).alias("m"))
        shared = written(again.filter(F.exists("m", lambda x: x["root"] != F.get("m", F.lit(0))["root"])))
    return roots


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group: that with the smallest id; the columns of ``docs``. Rows without id are kept."""
    gone = groups(docs, id_col, text).filter("node <> root").select(F.col("node").alias(id_col))
    return docs.join(gone, id_col, "left_anti")
