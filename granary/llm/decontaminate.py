"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the benchmark's windows: ten consecutive words of an item, or a shorter item's whole word sequence. For
patterns of one length ``m`` a shift table says, by the hash of the block of the last two words under the search position, how
far the search may move without missing a match: ``s`` for a block at distance ``s`` from the end of some pattern, ``m - 1`` for
an unknown block, the least where blocks share a place. Where the shift is 0 the hash of the window's last and first blocks
names a bucket of patterns, and the words themselves are compared. A text of prose is passed over nine words at a time and no
hash decides a match.

Tables are arrays of word numbers, built once on the driver and held once by a worker. A benchmark of more than ``BLOCK_BYTES``
of text is dealt in groups by hash; driver and workers hold one group's tables at a time, and each group is a pass over the
documents, written in between. Documents aren't shuffled.

Defined results: null and empty texts have no words and no hits. Items without words, or without an id, have no windows; without
items nothing is hit. Equal windows of several items count for each. Repeated rows and a null ``doc_id`` are passed through one
by one; empty tables give no hits or no rows. Columns of ``docs`` may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import dropped, small_batches, written

WINDOW = 10
#: UTF-8 bytes of item texts, about, whose tables are held at a time: some ten bytes for each of their words.
BLOCK_BYTES = 32 << 20
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased; all others become spaces.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEPT).split()


def _place(bits: int, *parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p, odd in zip(parts, _ODD, strict=False):
        h = (h ^ p.astype(np.uint64)) * odd
        h ^= h >> np.uint64(29)
    return (h * _ODD[0] >> np.uint64(64 - bits)).astype(np.int64)


class WuManber:
    """Patterns of one length: the strings of ``m`` word numbers of ``flat`` at ``starts``. Number 0 is in none."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, m: int):
        self.m, self.block = m, min(2, m)
        self.most = m - self.block + 1
        self.bits = int(np.clip(len(starts) * 16, 1 << 10, 1 << 24) - 1).bit_length()
        self.shift = np.full(1 << self.bits, self.most, np.uint8)
        for end in range(self.block, m + 1):
            np.minimum.at(self.shift, self._block(flat, starts + end - self.block), m - end)
        bucket = self._bucket(flat, starts)
        order = np.argsort(bucket, kind="stable")
        self.starts = starts[order]
        self.first = np.searchsorted(bucket[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.flat = flat.tobytes()

    def _block(self, w: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _place(self.bits, w[at], w[at + self.block - 1])

    def _bucket(self, w: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _place(self.bits, w[at], w[at + self.block - 1], w[at + self.m - self.block], w[at + self.m - 1])

    def search(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``w``, place in ``flat``) of each occurrence of each pattern."""
        m, n = self.m, len(w) - self.m + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        blocks = np.arange(m - self.block, len(w) - self.block + 1)
        step = self.shift[self._block(w, blocks)]
        step[(w[blocks] == 0) | (w[blocks + self.block - 1] == 0)] = self.most
        step = step.tobytes()
        stops, at = [], 0
        while at < n:
            s = step[at]
            if not s:
                stops.append(at)
                s = 1
            at += s
        where, which = [], []
        if stops:
            held, size = w.tobytes(), 4 * m
            stop = np.array(stops)
            b = self._bucket(w, stop)
            lo, hi = self.first[b], self.first[b + 1]
            some = np.flatnonzero(hi > lo)
            for i, a, z in zip(stop[some].tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
                own = held[4 * i : 4 * i + size]
                for p in self.starts[a:z].tolist():
                    if self.flat[4 * p : 4 * p + size] == own:
                        where.append(i)
                        which.append(p)
        return np.array(where, np.int64), np.array(which, np.int64)


class Benchmark:
    """The tables of a group of items (id, text)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        number: dict[bytes, int] = {}
        flat: list[int] = []
        first: list[int] = []
        starts: dict[int, list[int]] = {}
        for _, text in items:
            w = words_of(text)
            first.append(len(flat))
            if w:
                m = min(window, len(w))
                starts.setdefault(m, []).extend(range(len(flat), len(flat) + len(w) - m + 1))
                flat.extend(number.setdefault(x, len(number) + 1) for x in w)
        self.items = [i for i, _ in items]
        self.first = np.array(first, np.int64)
        self.words = b" ".join(number)
        held = np.array(flat, np.int32)
        self.by_length = [WuManber(held, np.array(starts[m], np.int32), m) for m in sorted(starts)]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "number"}

    @cached_property
    def number(self) -> dict[bytes, int]:
        return {w: i + 1 for i, w in enumerate(self.words.split(b" "))} if self.words else {}

    def searched(self, texts: list[bytes | None]) -> tuple[list[int], list[list[int]], list[list[str]]]:
        """Of each text: its words, places inside occurrences as disjoint [start, end, start, end ...], and items found."""
        get, ids, sizes = self.number.get, [], []
        for t in texts:
            w = words_of(t) if t else []
            sizes.append(len(w))
            ids.extend(get(x, 0) for x in w)
            ids.append(0)  # in no pattern: none reaches from a text into the next
        w = np.array(ids, np.int32)
        begin = np.r_[0, np.cumsum(np.array(sizes, np.int64) + 1)]
        change = np.zeros(len(w) + 1, np.int64)
        doc_of, item_of = [], []
        for table in self.by_length:
            where, which = table.search(w)
            np.add.at(change, where, 1)
            np.add.at(change, where + table.m, -1)
            doc_of.append(np.searchsorted(begin, where, "right") - 1)
            item_of.append(np.searchsorted(self.first, which, "right") - 1)
        spans: list[list[int]] = [[] for _ in texts]
        items: list[list[str]] = [[] for _ in texts]
        inside = np.r_[False, np.cumsum(change) > 0]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        for d, a, z in zip((np.searchsorted(begin, edges[::2], "right") - 1).tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            spans[d] += (a - int(begin[d]), z - int(begin[d]))
        if doc_of:
            n = max(1, len(self.items))
            for x in np.unique(np.concatenate(doc_of) * n + np.concatenate(item_of)).tolist():
                items[x // n].append(self.items[x % n])
        return sizes, spans, [sorted(set(x)) for x in items]


def joined(spans: list[int]) -> int:
    """Places inside a union of [start, end, start, end ...]."""
    total = reach = 0
    for a, z in sorted(zip(spans[::2], spans[1::2], strict=True)):
        total += max(0, z - max(a, reach))
        reach = max(reach, z)
    return total


def groups_of(bench: DataFrame, item_id: str, text: str, window: int) -> Iterator[tuple[Benchmark, bool]]:
    """Tables of about BLOCK_BYTES of items one after the other, and whether they are the last; the driver holds one group."""
    held = bench.filter(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t"))
    size = held.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first().n
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        part = held if n == 1 else held.filter(F.pmod(F.xxhash64("i"), F.lit(n)) == k)
        yield Benchmark([(r.i, r.t.encode()) for r in part.collect()], window), k == n - 1


def contamination(docs: DataFrame, bench: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", item_id: str = "item_id", bench_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``carry`` columns of ``docs`` and n_words, n_hit, items (array of ids as strings, sorted): words, words inside occurrences, items found."""
    spark = docs.sparkSession
    small_batches(spark)
    names = [f"__c{i}" for i in range(len(carry))]
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], F.col(text).alias("__text"))
    own = held.select(*names).schema.fields
    found, passes = T.ArrayType(T.StringType()), 0
    for tables, last in groups_of(bench, item_id, bench_text, window):
        shared = spark.sparkContext.broadcast(tables)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, last: bool = last, first: bool = not passes) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(len(names)).cast(pa.binary()).to_pylist()
                n_words, spans, items = shared.value.searched(texts)
                if not first:
                    spans = [x + y for x, y in zip(b.column(len(names) + 1).to_pylist(), spans, strict=True)]
                    items = [sorted({*x, *y}) for x, y in zip(b.column(len(names) + 2).to_pylist(), items, strict=True)]
                if last:
                    out = [pa.array(n_words, pa.int64()), pa.array([joined(x) for x in spans], pa.int64()), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *out], names=[*names, "n_words", "n_hit", "items"])
                else:
                    out = [pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*b.columns[: len(names) + 1], *out], names=[*names, "__text", "spans", "items"])

        if last:
            done = held.mapInArrow(scan, T.StructType([*own]).add("n_words", T.LongType()).add("n_hit", T.LongType()).add("items", found))
        else:
            more = written(held.mapInArrow(scan, T.StructType([*own]).add("__text", T.StringType()).add("spans", T.ArrayType(T.LongType())).add("items", found)))
            shared.destroy()
            if passes:
                dropped(held)
            held, passes = more, passes + 1
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], "n_words", "n_hit", "items")


def query(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``op5_decontamination``."""
    found = contamination(docs, bench)
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", bench_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with their own columns: batches pass through with the others' rows taken out."""
    small_batches(docs.sparkSession)
    place, passes = docs.columns.index(text), 0
    for tables, last in groups_of(bench, item_id, bench_text, window):
        shared = docs.sparkSession.sparkContext.broadcast(tables)

        def sift(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, spans, _ = shared.value.searched(b.column(place).cast(pa.binary()).to_pylist())
                yield b.filter(pa.array([not x for x in spans], pa.bool_()))

        clean = docs.mapInArrow(sift, docs.schema)
        if not last:
            clean = written(clean)
            shared.destroy()
            if passes:
                dropped(docs)
        docs, passes = clean, passes + 1
    return docs


ORACLE = r"""
WITH bw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
pat AS (SELECT DISTINCT item, len(w) AS m, array_to_string(w, ' ') AS p FROM bw WHERE len(w) BETWEEN 1 AND 9
        UNION SELECT DISTINCT item, 10, array_to_string(w[i:i+9], ' ') FROM (SELECT item, w, unnest(range(1, len(w) - 8)) AS i FROM bw WHERE len(w) >= 10)),
dw AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
ms AS (SELECT DISTINCT m FROM pat),
occ AS (SELECT k, i, m, item FROM (SELECT k, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM dw, ms WHERE len(w) >= m) x JOIN pat USING (m) WHERE array_to_string(w[i:i+m-1], ' ') = p),
hit AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + m)) AS j FROM occ) GROUP BY k),
its AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM occ) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (k) LEFT JOIN its USING (k)
"""
