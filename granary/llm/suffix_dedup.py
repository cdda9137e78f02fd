"""Repeated byte strings by prefix-free parsing, over a corpus dealt to many tasks.

Removed is each byte that a string of ``LENGTH`` bytes covers which also starts anywhere else, in another document or the same.

Parsing. A rolling hash of ``TRIGGER`` bytes is computed at each place; the place with the least hash in a string of
``LENGTH`` bytes is its trigger. Every string has one, and equal strings have it at the same offset, so text is cut into
phrases alike wherever it occurs, without stretches that have no trigger. The strings that share a trigger begin in a run; the
run with what its last string covers is a phrase in its context. Phrases overlap by ``LENGTH - 1`` bytes, so that each string
lies in one phrase, and no string's order depends on the phrase that follows.

Order. In the corpus order of all strings, which suffix arrays of dictionary and parse combine to, equal strings are
neighbours: those of one phrase's occurrences in the parse, and those of different phrases in the dictionary.

1. The parse: its phrases are sorted by trigger and context, 64 bits of hash each, as numbers of the dictionary's entries. A
   phrase that occurs twice makes all its strings repeated, and text that is copied whole ends here. A trigger that occurs in
   one phrase only has no string in another. How the parse goes on after a phrase would order its occurrences among
   themselves; they are equal strings, so nothing depends on it, and it isn't computed.
2. The dictionary: different phrases of one trigger. Suffixes are sorted by prefix doubling on the bytes themselves, to a depth
   of ``LENGTH``; equal neighbours are the repeated strings.

Hot groups. A task settles phrases that it holds twice itself and sends one of them on, so a passage that a third of all
documents share is one row from each task. A trigger that a task finds in more than ``HOT_LOCAL`` different phrases, or all
tasks in more than ``HOT_TOTAL``, is not gathered: its strings are sorted by hashes of 128 bits instead of their bytes, spread
over all partitions and again settled first where they repeat within a task; of such a trigger a task sends one row under its
key. All strings are compared in either way.

Texts are numbered and written once; every later step reads that table, so a row's number doesn't depend on how files are split.
They cross a shuffle twice, compressed, keyed by number.

Defined results: a null text counts as empty: 0 bytes, none removed. Texts under ``LENGTH`` bytes are kept whole. Repeated rows
are documents of their own, and so copies of each other. A null ``doc_id`` is passed through. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import small_batches, written

LENGTH, TRIGGER = 200, 64
HOT_LOCAL, HOT_TOTAL = 64, 10_000
#: Phrases that a task holds before it settles them; bytes of contexts whose suffixes are sorted at a time, about.
HELD, DICTIONARY_BYTES = 1 << 18, 1 << 20
#: Places of a long text that are parsed at a time.
STRETCH = 1 << 17
PENDING, TWIN, COVERED, MARKER, EDGE, EDGE_TWIN = range(6)
_ALL = (1 << 64) - 1


@lru_cache(maxsize=4)
def _scheme(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random bytes' values, powers of an odd base and of its inverse, mod 2**64."""
    rng = np.random.default_rng(seed)
    values = rng.integers(0, _ALL, 256, dtype=np.uint64, endpoint=True)
    base = int(rng.integers(0, _ALL, dtype=np.uint64)) & ~7 | 5
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.ones(STRETCH + 4 * LENGTH, np.uint64)
        k = 1
        while k < len(p):
            m = min(k, len(p) - k)
            p[k : k + m] = p[:m] * np.uint64(pow(b, k, 1 << 64))
            k *= 2
        out.append(p)
    return values, *out


class Rolling:
    """Hashes of any substrings of some bytes, no longer than a stretch and its margin."""

    def __init__(self, b: np.ndarray, seed: int):
        values, self.power, inverse = _scheme(seed)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(values[b] * inverse[: len(b)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.power[start]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours, from the running minima of blocks to either side."""
    n = len(v)
    p = np.full(-(-n // w) * w, np.uint64(_ALL))
    p[:n] = v
    p = p.reshape(-1, w)
    ahead = np.minimum.accumulate(p, axis=1).ravel()
    back = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def phrases(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, context, start, count, offset) by stretch: hash of the trigger, of trigger and context; the run of string starts, and the trigger's place after the first."""
    total = len(text) - LENGTH + 1
    for at in range(0, max(0, total), STRETCH):
        b = np.frombuffer(text, np.uint8, min(STRETCH + LENGTH - 1, len(text) - at), at)
        r = Rolling(b, 1)
        i = np.arange(len(b) - TRIGGER + 1)
        h = r.of(i, i + TRIGGER)
        trigger = (_window_min((_mix(h) & np.uint64(_ALL ^ 0xFFFFFF)) | i.astype(np.uint64), LENGTH - TRIGGER + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1]])
        last = np.r_[first[1:], len(trigger)] - 1
        a = trigger[first]
        shape = ((a - first) << 16 | (last - first)).astype(np.uint64)
        context = _mix(r.of(first, last + LENGTH) + _mix(shape + np.uint64(1)))
        yield _mix(h[a]), context, first + at, last - first + 1, a - first


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of the half-open intervals."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return s[first], e[np.r_[first[1:], len(s)] - 1]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each row, rows of each group)."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new |= np.r_[True, s[1:] != s[:-1]] if len(s) else new
    g = np.empty(len(order), np.int64)
    g[order] = np.cumsum(new) - 1
    return g, np.bincount(g)


def _covered_rows(uid: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts, joined within each document."""
    if not len(uid):
        return uid, start, count
    u, s, n = [], [], []
    order = np.lexsort((start, uid))
    uid, start, count = uid[order], start[order], count[order]
    cut = np.flatnonzero(np.r_[True, uid[1:] != uid[:-1]])
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(uid)], strict=True):
        a, b = merged(start[i:j], start[i:j] + count[i:j])
        u.append(np.full(len(a), uid[i]))
        s.append(a)
        n.append(b - a)
    return np.concatenate(u), np.concatenate(s), np.concatenate(n)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of (uid, text), settled where the task itself can settle them."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    names = ["key", "context", "uid", "start", "count", "offset", "kind", "hot"]

    def rows(key, context, uid, start, count, offset, kind, hot) -> pa.RecordBatch:
        n = len(key)
        full = lambda x, t: np.full(n, x, t) if np.isscalar(x) else x.astype(t)
        return pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(full(context, np.uint64).view(np.int64)), pa.array(full(uid, np.int64)), pa.array(full(start, np.int32)), pa.array(full(count, np.int32)), pa.array(full(offset, np.int16)), pa.array(full(kind, np.int8)), pa.array(full(hot, np.bool_))],
            names=names,
        )

    def settle() -> Iterator[pa.RecordBatch]:
        key, context, start, count, offset, uid = (np.concatenate(x) for x in zip(*held, strict=True))
        g, n = _groups(context, key)
        by_key, _ = _groups(key)
        twin = n[g] >= 2
        others = np.bincount(by_key, ~twin)[by_key]
        hot = others > HOT_LOCAL
        one = np.zeros(len(key), bool)
        one[np.unique(g, return_index=True)[1]] = True
        pick = lambda m: (key[m], context[m], uid[m], start[m], count[m], offset[m])
        # of no use to others: dealt by place, not by key
        u, s, c = _covered_rows(uid[twin], start[twin].astype(np.int64), count[twin].astype(np.int64))
        spread = _mix(u.astype(np.uint64) * np.uint64(STRETCH + 1) + s.astype(np.uint64))
        yield rows(spread, 0, u, s, c, 0, COVERED, False)
        # strings are compared whatever others hold: dealt by place, and one row of the key tells the others
        place = _mix(uid.astype(np.uint64) * np.uint64(STRETCH + 1) + start.astype(np.uint64))
        for m, kind in ((~twin & hot, EDGE), (twin & one & hot, EDGE_TWIN)):
            yield rows(place[m], 0, uid[m], start[m], count[m], offset[m], kind, True)
        yield rows(np.unique(key[hot]), 0, -1, 0, 0, 0, MARKER, True)
        m = twin & one & ~hot
        yield rows(*pick(m), TWIN, False)
        m = ~twin & ~hot
        yield rows(*pick(m), PENDING, False)

    for b in batches:
        for u, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            if t.is_valid:
                for found in phrases(t.as_py()):
                    held.append((*found, np.full(len(found[0]), u, np.int64)))
                    size += len(found[0])
                    if size >= HELD:
                        yield from settle()
                        held, size = [], 0
    if held:
        yield from settle()


def settled(texts: DataFrame) -> DataFrame:
    """(uid, start, count, offset, covered, compare, hot) of phrases with covered strings or strings to compare (1: unknown, 2: known to be repeated)."""
    schema = "key bigint, context bigint, uid bigint, start int, count int, offset smallint, kind tinyint, hot boolean"
    rows = texts.mapInArrow(_parsed, schema)
    by_context = Window.partitionBy("key", "context")
    by_key = Window.partitionBy("key")
    seen = rows.withColumn("first", F.row_number().over(by_context.orderBy("uid", "start")) == 1)
    seen = seen.withColumn("n_context", F.count("*").over(by_context)).withColumns({"n_key": F.count("*").over(by_key), "any_hot": F.max("hot").over(by_key)})
    kind, more = F.col("kind"), F.col("n_key") > F.col("n_context")
    twin = (kind == PENDING) & (F.col("n_context") > 1)
    compare = (
        F.when(kind == EDGE, 1)
        .when(kind == EDGE_TWIN, 2)
        .when((kind == PENDING) & (F.col("n_context") == 1) & more, 1)
        .when(((kind == TWIN) | twin) & F.col("first") & more, 2)
        .otherwise(0)
    )
    seen = seen.select("uid", "start", "count", "offset", ((kind == COVERED) | twin).alias("covered"), compare.alias("compare"), (F.col("any_hot") | (F.col("n_key") > HOT_TOTAL)).alias("hot"))
    return seen.filter("covered OR compare > 0")


def repeated_starts(contexts: list[bytes], counts: list[int]) -> np.ndarray:
    """For the first ``count`` string starts of each context, one after the other, whether the string starts twice in all contexts.

    Suffixes are ranked by prefix doubling, from eight bytes on; two ranks of 128 bytes that overlap are the rank of 200.
    """
    body = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    n = len(body) - 8
    rank = np.unique(np.ndarray((n,), ">u8", body.tobytes(), 0, (1,)).astype(np.uint64), return_inverse=True)[1].astype(np.int64)
    depth = 8

    def pair(gap: int) -> np.ndarray:
        after = np.zeros(n, np.int64)
        after[: max(0, n - gap)] = rank[gap:] + 1
        return np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)

    while 2 * depth <= LENGTH:
        rank = pair(depth)
        depth *= 2
    lengths = np.array([len(c) for c in contexts])
    n_of = np.array(counts)
    base = np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(n_of) - n_of), n_of)
    starts = base + np.arange(int(n_of.sum()))
    if depth < LENGTH:
        code = rank[starts] * (n + 2) + rank[starts + LENGTH - depth]
    else:
        code = rank[starts]
    _, inverse, times = np.unique(code, return_inverse=True, return_counts=True)
    return times[inverse] > 1


_COMPARED = "k1 bigint, k2 bigint, uid bigint, start int, count int, flag tinyint, body binary"
COLD, COLD_TWIN, STRING, STRING_TWIN, DONE = 1, 2, 3, 4, 5


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (uid, packed text, phrases to compare): contexts, and strings of hot triggers."""
    names = ["k1", "k2", "uid", "start", "count", "flag", "body"]
    strings: list[tuple[np.ndarray, ...]] = []
    size = 0

    def strings_settled() -> Iterator[pa.RecordBatch]:
        h1, h2, uid, start, known = (np.concatenate(x) for x in zip(*strings, strict=True))
        g, n = _groups(h2, h1)
        twice = n[g] > 1
        one = np.zeros(len(h1), bool)
        one[np.unique(g, return_index=True)[1]] = True
        u, s, c = _covered_rows(uid[twice & ~known], start[twice & ~known], np.ones(int((twice & ~known).sum()), np.int64))
        spread = _mix(u.astype(np.uint64) * np.uint64(STRETCH + 1) + s.astype(np.uint64))
        for k1, k2, a, b, count, flag in (
            (spread, np.zeros(len(u), np.uint64), u, s, c, np.full(len(u), DONE)),
            (h1[one], h2[one], uid[one], start[one], np.ones(int(one.sum()), np.int64), np.where(twice | known, STRING_TWIN, STRING)[one]),
        ):
            yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(a), pa.array(b.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(flag.astype(np.int8)), pa.nulls(len(a), pa.binary())], names=names)

    for batch in batches:
        cold: list[tuple] = []
        for u, z, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = unpacked(z)
            for p in asked:
                s, n = p["start"], p["count"]
                body = text[s : s + n - 1 + LENGTH]
                b = np.frombuffer(body, np.uint8)
                if p["hot"]:
                    i = np.arange(n)
                    h1, h2 = (_mix(Rolling(b, seed).of(i, i + LENGTH)) for seed in (2, 3))
                    strings.append((h1, h2, np.full(n, u, np.int64), i + s, np.full(n, p["compare"] == 2)))
                    size += n
                    if size >= HELD:
                        yield from strings_settled()
                        strings, size = [], 0
                else:
                    a = np.array([p["offset"]])
                    key = int(_mix(Rolling(b, 1).of(a, a + TRIGGER)).view(np.int64)[0])
                    cold.append((key, 0, u, s, n, COLD_TWIN if p["compare"] == 2 else COLD, body))
        if cold:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int8(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*cold, strict=True), kinds, strict=True)], names=names)
    if strings:
        yield from strings_settled()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of covered string starts of rows that come sorted by k1, k2."""
    waiting: list[pa.RecordBatch] = []
    size = 0

    def solved(t: pa.Table) -> Iterator[pa.RecordBatch]:
        k1, k2, uid, start, count, flag = (t.column(i).to_numpy() for i in range(6))
        u, s, n = [uid[flag == DONE]], [start[flag == DONE].astype(np.int64)], [count[flag == DONE].astype(np.int64)]
        m = (flag == STRING) | (flag == STRING_TWIN)
        if m.any():
            g, times = _groups(k2[m], k1[m])
            hit = (times[g] > 1) & (flag[m] == STRING)
            u.append(uid[m][hit]), s.append(start[m][hit].astype(np.int64)), n.append(np.ones(int(hit.sum()), np.int64))
        m = np.flatnonzero((flag == COLD) | (flag == COLD_TWIN))
        if len(m):
            again = repeated_starts([x.as_py() for x in t.column(6).take(pa.array(m))], count[m].tolist())
            owner = np.repeat(m, count[m])
            place = np.arange(len(owner)) - np.repeat(np.cumsum(count[m]) - count[m], count[m])
            hit = again & (flag[owner] == COLD)
            u.append(uid[owner[hit]]), s.append(start[owner[hit]].astype(np.int64) + place[hit]), n.append(np.ones(int(hit.sum()), np.int64))
        a, b, c = _covered_rows(*(np.concatenate(x) for x in (u, s, n)))
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int32)), pa.array(c.astype(np.int32))], names=["uid", "start", "count"])

    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size < DICTIONARY_BYTES:
            continue
        t = pa.Table.from_batches(waiting)
        k = t.column(0).to_numpy()
        whole = int(np.searchsorted(k, k[-1]))  # the last key may go on
        if whole:
            yield from solved(t.slice(0, whole))
            waiting = t.slice(whole).combine_chunks().to_batches()
            size = sum(x.nbytes for x in waiting)
    if waiting:
        yield from solved(pa.Table.from_batches(waiting))


def packed(text: bytes) -> bytes:
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def unpacked(z: bytes) -> bytes:
    return pa.decompress(z[8:], decompressed_size=int.from_bytes(z[:8], "little"), codec="zstd", asbytes=True)


def numbered(docs: DataFrame, carry: list[str], text: str) -> DataFrame:
    """``carry``, a number (``uid``) and the text of each row, written."""
    return written(docs.select(*carry, F.monotonically_increasing_id().alias("uid"), F.col(text).alias("text")))


def compressed(texts: DataFrame) -> DataFrame:
    """The table with ``z`` in the place of its last column, the text, as it crosses a shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = pa.array([packed(t.as_py()) if t.is_valid else None for t in b.column(b.num_columns - 1).cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], z], names=[*b.schema.names[:-1], "z"])

    return texts.mapInArrow(pack, T.StructType(texts.schema.fields[:-1]).add("z", T.BinaryType()))


def covered(texts: DataFrame) -> DataFrame:
    """(uid, runs): array<struct<start, count>> of starts of repeated strings, by row of a table of :func:`numbered`."""
    found = written(settled(texts.select("uid", "text")))
    asked = found.filter("compare > 0").groupBy("uid").agg(F.collect_list(F.struct("start", "count", "offset", "compare", "hot")).alias("asked"))
    opened = compressed(texts.select("uid", "text")).join(asked.hint("shuffle_hash"), "uid").select("uid", "z", "asked").mapInArrow(_opened, _COMPARED)
    more = opened.repartition("k1").sortWithinPartitions("k1", "k2").mapInArrow(_compared, "uid bigint, start int, count int")
    runs = found.filter("covered").select("uid", "start", "count").unionAll(more)
    return runs.groupBy("uid").agg(F.collect_list(F.struct("start", "count")).alias("runs"))


def deduplicated(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``carry`` columns with n_bytes, n_removed, n_spans and kept (binary): what is left of each text."""
    small_batches(docs.sparkSession)
    names = [f"__c{i}" for i in range(len(carry))]
    safe = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], F.col(text).alias("text"))
    texts = numbered(safe, names, "text")
    joined = compressed(texts).join(covered(texts).hint("shuffle_hash"), "uid", "left").select(*names, "z", "runs")
    schema = T.StructType(joined.schema.fields[:-2])
    for c in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(c, T.LongType())
    schema = schema.add("kept", T.BinaryType())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for z, runs in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                t = unpacked(z) if z is not None else b""
                start = np.array([r["start"] for r in runs or ()], np.int64)
                count = np.array([r["count"] for r in runs or ()], np.int64)
                s, e = merged(start, start + count - 1 + LENGTH)
                n_bytes.append(len(t))
                n_removed.append(int((e - s).sum()))
                n_spans.append(len(s))
                kept.append(b"".join(t[i:j] for i, j in zip([0, *e.tolist()], [*s.tolist(), len(t)], strict=True)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=schema.names)

    return joined.mapInArrow(cut, schema).select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], "n_bytes", "n_removed", "n_spans", "kept")


def query(docs: DataFrame) -> DataFrame:
    """``op10_suffix_dedup``."""
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
