"""Derived content and plans over representations: reassembly, derivations, envelopes, state diffs, bases, replay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import content
from granary.operators import graph
from granary.operators.storage import cut


def reassembled(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(version_id, body) of references (version_id, ord, sha) and chunks (sha, payload), in order; a missing chunk makes the body null."""
    j = refs.join(chunks, "sha", "left")
    parts = j.groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("ord", "payload"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["payload"]), "")
    return parts.select("version_id", F.when(~F.exists("p", lambda x: x["payload"].isNull()), whole).alias("body"))


def proved(bodies: DataFrame, expected: DataFrame) -> DataFrame:
    """(version_id, exact): digest and size of what was put together against those wanted (version_id, sha, size)."""
    j = expected.join(bodies, "version_id", "left")
    return j.select("version_id", F.coalesce((F.sha2("body", 256) == F.col("sha")) & (F.octet_length("body") == F.col("size")), F.lit(False)).alias("exact"))


def gather(values: Column, index: Column) -> Column:
    return F.transform(index, lambda i: F.get(values, i))


def scatter(values: Column, valid: Column) -> Column:
    """Values spread to where ``valid`` is true, null elsewhere; the running count of valid places says which."""
    # places of valid ones in order: the k-th takes the k-th value, so one sort by place puts all in order again
    places = F.filter(F.transform(valid, lambda v, i: F.when(v, i)), lambda i: i.isNotNull())
    put = F.zip_with(places, F.slice(values, F.lit(1), F.size(places)), lambda i, v: F.struct(i.alias("i"), v.alias("v")))
    none = F.filter(F.transform(valid, lambda v, i: F.struct(i.alias("i"), F.when(F.lit(False), F.get(values, F.lit(0))).alias("v"), F.coalesce(v, F.lit(False)).alias("x"))), lambda s: ~s["x"])
    rest = F.transform(none, lambda s: F.struct(s["i"].alias("i"), s["v"].alias("v")))
    return F.transform(F.sort_array(F.concat(put, rest)), lambda s: s["v"])


def offsets_of(lengths: Column) -> Column:
    """Running sums, one more than there are lengths."""
    return F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))


def swapped(x: Column, width: int) -> Column:
    """Bytes of each element of ``width`` in reverse."""
    n = F.octet_length(x) / width
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.array_join(F.reverse(F.regexp_extract_all(F.hex(F.substring(x, i * width + 1, F.lit(width))), F.lit("(..)"), F.lit(1))), "")), ""))


def move_to_front(values: DataFrame, by: str, order: str, symbol: str) -> DataFrame:
    """(by, order, code): index of each symbol in a list that moves it to the front; a new symbol's code is the list's length."""
    held = values.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, symbol))).alias("s"))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def code(s: pd.Series) -> pd.Series:
        def one(row) -> list[int]:
            front: list = []
            out = []
            for x in row:
                v = x[symbol]
                i = front.index(v) if v in front else len(front)
                out.append(i)
                if i < len(front):
                    front.pop(i)
                front.insert(0, v)
            return out

        return s.map(one)

    held = held.select(by, F.transform("s", lambda x: x[order]).alias("o"), code("s").alias("c"))
    zipped = F.arrays_zip(F.col("o"), F.col("c"))
    return held.select(by, F.explode(zipped).alias("z")).select(by, F.col("z.o").alias(order), F.col("z.c").alias("code"))


def state_diff(want: DataFrame, have: DataFrame) -> DataFrame:
    """(path, change) of states (path, kind, size, sha, mode): missing, extra, type, content or mode; a type mismatch ends a path's checks."""
    names = ("kind", "size", "sha", "mode")
    l, r = want.select("path", *[F.col(c).alias(f"l_{c}") for c in names], F.lit(True).alias("l")), have.select("path", *[F.col(c).alias(f"r_{c}") for c in names], F.lit(True).alias("r"))
    j = l.join(r, "path", "full_outer")
    same = lambda c: F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    change = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").when(~same("kind"), "type").when(~(same("size") & same("sha")), "content").when(~same("mode"), "mode")
    return j.select("path", change.alias("change")).filter("change IS NOT NULL")


def ambiguous(index: DataFrame) -> DataFrame:
    """(native_key, n): keys of an index (native_key, component) that name more than one component."""
    return index.groupBy("native_key").agg(F.count_distinct("component").alias("n")).filter("n > 1")


def resolved(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(native_key, component) of wanted keys; fails on one that is ambiguous."""
    one = index.groupBy("native_key").agg(F.min("component").alias("component"), F.max("component").alias("other"))
    j = wanted.select("native_key").distinct().join(one, "native_key", "left")
    return j.select("native_key", F.when(F.col("component") == F.col("other"), F.col("component")).when(F.col("component").isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("ambiguous key"))).alias("component"))


def placed(targets: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, how, source) of the cheapest placement: same identity, same bytes, same values in any order (equal signature), else raw.

    Of both sides (id, ident, sha, signature). Rungs are tried in turn; only what is left goes on.
    """
    out, left = None, targets
    for how, key in (("identity", "ident"), ("bytes", "sha"), ("layout", "signature")):
        have = stored.groupBy(key).agg(F.min("id").alias("source"))
        hit = left.join(have, key).select("id", F.lit(how).alias("how"), "source")
        left = left.join(have, key, "left_anti")
        out = hit if out is None else out.unionByName(hit)
    return out.unionByName(left.select("id", F.lit("raw").alias("how"), F.lit(None).cast(stored.schema["id"].dataType).alias("source")))


def best_base(pairs: DataFrame, id_col: str) -> DataFrame:
    """(id, base, cost): of candidate bases (id, base, base_body, body) the one whose delta adds least; the object alone if none saves.

    Candidates are a top-k of the similarity index, so a target has a bounded number of them.
    """
    schema = f"{id_col} bigint, base bigint, cost bigint, raw bigint"

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            cost = [sum(n if lit is not None else 8 for _, n, lit in content.delta((x or "").encode(), (y or "").encode())) for x, y in zip(cols[2], cols[3], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cost, pa.int64()), pa.array([len((y or "").encode()) for y in cols[3]], pa.int64())], names=[id_col, "base", "cost", "raw"])

    priced = pairs.select(id_col, "base", "base_body", "body").mapInArrow(price, schema)
    best = priced.groupBy(id_col).agg(F.min(F.struct("cost", "base")).alias("m"), F.max("raw").alias("raw"))
    keep = F.col("m.cost") < F.col("raw")
    return best.select(id_col, F.when(keep, F.col("m.base")).alias("base"), F.when(keep, F.col("m.cost")).otherwise(F.col("raw")).alias("cost"))


def chain_bases(chosen: DataFrame, id_col: str, most: int = 8) -> DataFrame:
    """(id, depth): delta chain lengths of (id, base); a chain over ``most``, or one without an end, is an error of the plan and fails."""
    found = graph.chain_depths(chosen.select(F.col(id_col).alias("node"), F.col("base").alias("parent")))
    bad = F.col("cyclic") | (F.col("depth") > most)
    depth = F.when(bad, F.raise_error(F.concat(F.lit("delta chain too long or cyclic at "), F.col("node").cast("string"))).cast("int")).otherwise(F.col("depth"))
    return found.select(F.col("node").alias("id"), depth.alias("depth"))


def union_totals(needed: DataFrame, stored: DataFrame, record: int = 36) -> DataFrame:
    """One row: bytes and records of stored chunks (sha, pack, bytes) at each stage: now, after garbage collection, after a repack of packs under half live.

    Collection drops packs without a live chunk; dead bytes of partly live packs stay until they are repacked.
    """
    j = stored.join(needed.select("sha").distinct().withColumn("live", F.lit(True)), "sha", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    per = j.groupBy("pack").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("live"), F.col("bytes"))), F.lit(0)).alias("live"), F.count(F.when(F.col("live"), 1)).alias("live_n"))
    after_gc = F.when(F.col("live_n") > 0, F.col("bytes")).otherwise(0)
    after_repack = F.when(2 * F.col("live") > F.col("bytes"), F.col("bytes")).otherwise(F.col("live"))
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name)
    return per.agg(total(F.col("bytes"), "now"), total(after_gc, "after_gc"), total(after_repack, "after_repack"), total(F.col("live"), "live"), total(record * F.col("live_n"), "records"))


#: Ticks of the replay that are handed on at once.
TICKS_AT_ONCE = 1 << 16


def replayed(events: DataFrame, key: str = "key", every: int = 7, last: int = 3) -> DataFrame:
    """(key, day, live, dead, collected) at each tick of a lineage (key, day, seq, bytes): arrivals are kept, the one ``last`` before goes, every second tick collects.

    Lineages run apart and in order. A state is sums up to two arrivals, so ticks are made some at a time, however many a lineage has.
    """
    held = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("day", "seq", "bytes"))).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, found = b.column(1), b.column(1).flatten()
            day, size = (found.field(name).to_numpy() for name in ("day", "bytes"))
            n = lists.value_lengths().to_numpy().astype(np.int64)
            start = np.cumsum(n) - n
            first = day[start]
            ticks = (day[start + n - 1] - first) // every + 1
            place = np.cumsum(ticks) - ticks
            tick = np.repeat(place, n) + (day - np.repeat(first, n)) // every  # the first one after each arrival
            total = np.concatenate([[0], np.cumsum(size)])
            for at in range(0, int(ticks.sum()), TICKS_AT_ONCE):
                t = np.arange(at, min(at + TICKS_AT_ONCE, int(ticks.sum())))
                of = np.searchsorted(place, t, "right") - 1
                nth = t - place[of] + 1
                begin = start[of]

                def gone(come: np.ndarray, begin=begin) -> np.ndarray:
                    return total[np.maximum(come - last, begin)] - total[begin]  # noqa: B023

                come = np.searchsorted(tick, t, "right")
                lost, swept = gone(come), gone(np.searchsorted(tick, t - nth % 2, "right"))  # before a lineage's first tick nothing is gone
                cols = [b.column(0).take(pa.array(of)), *(pa.array(c) for c in (first[of] + nth * every, total[come] - total[begin] - lost, lost - swept, swept))]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "day", "live", "dead", "collected"])

    return held.mapInArrow(run, f"{key} bigint, day bigint, live bigint, dead bigint, collected bigint")


def compacted(runs: DataFrame, tombstones: DataFrame, newest: int = 64) -> DataFrame:
    """Runs of postings (run, feature, id) as one: distinct, without dead ids, the newest of each feature."""
    live = runs.select("feature", "id").distinct().join(tombstones.select("id"), "id", "left_anti")
    w = Window.partitionBy("feature").orderBy(F.desc("id"))
    return live.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= newest).select("feature", "id")


def pruned_discovery(edges: DataFrame, start: DataFrame, have: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node) reachable from ``start`` that the peer lacks: a node it has stops the walk, for it has all below."""
    front = cut(start.select("node").distinct().join(have.select("node"), "node", "left_anti"))
    found = front
    for _ in range(most_rounds):
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(have.select("node"), "node", "left_anti").join(found, "node", "left_anti"))
        if front.isEmpty():
            return found
        found = found.unionByName(front)
    raise ValueError(f"no end after {most_rounds} rounds")


def residual_entropy(base: np.ndarray, target: np.ndarray) -> float:
    """Bytes that an ideal order-0 coder needs for the byte planes of the difference."""
    total = 0.0
    for plane in content.byte_planes(content.xor_residual(base, target)):
        c = np.bincount(plane, minlength=256).astype(float)
        c = c[c > 0]
        total += float(-(c * np.log2(c / c.sum())).sum()) / 8
    return total


def restored(spans: DataFrame, backing: DataFrame) -> DataFrame:
    """(id, body) of spans (id, ord, sha, offset, length) over backing chunks (sha, payload); null where a span leaves its chunk or the chunk isn't there."""
    j = spans.join(backing, "sha", "left")
    inside = (F.col("offset") >= 0) & (F.col("length") > 0) & (F.col("offset") + F.col("length") <= F.char_length("payload"))
    part = F.when(inside, F.substring("payload", F.col("offset") + 1, F.col("length")))
    out = j.select("id", "ord", part.alias("part")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "part"))).alias("p"))
    return out.select("id", F.when(~F.exists("p", lambda x: x["part"].isNull()), F.array_join(F.transform("p", lambda x: x["part"]), "")).alias("body"))
