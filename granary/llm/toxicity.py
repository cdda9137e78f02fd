"""Toxicity by class-conditional Kneser-Ney models.

Two character models of order six over the UTF-8 bytes of lower-cased text, one learned from toxic and one from ordinary
labelled documents. Each takes a fixed discount from its own counts and backs off to the same lower-order distribution: shared
continuation counts (in how many contexts a string of five bytes occurs, then of four, and so on down to a byte) gathered from
all documents, labelled or not. An expression that a class has hardly seen gets nearly the same probability from both and says
little.

    log P_toxic(x | context) - log P_ordinary(x | context)

is the evidence of a byte. Toxic expressions are a few words in long ordinary texts, so log-likelihoods are compared normalised
by length twice: over the whole text, and over its most toxic window. A logistic fit turns both into a score. It is made on a
fold of labelled documents with class models that leave the fold out; the models that score have it in.

Counting: each task sums distinct grams before the shuffle; a gram is a number of 48 bits, exact. The model that goes to all
tasks holds what labelled text has: its grams, and for each of its contexts the evidence of any other byte, in which the shared
distribution cancels out. In a context that no label has seen both classes are the shared distribution, and the evidence is 0.
So the model is exact for every gram of every document, and bounded by the labelled rows, of which there are at most
``MOST_LABELLED``. Their ids and labels are broadcast, so that no text is shuffled; calibration takes ``MOST_FITTED`` of them.

Defined results: null and empty texts have evidence 0 and get the calibrated prior. A null ``doc_id`` has no label and is not
held out. Repeated rows are scored one by one. Without labels of both classes the score is the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.labelled import held_out, logistic, training
from granary.llm.common import small_batches, written

ORDER = 6
#: Taken from each count of a class, which so leaves what it has seen once or twice to the shared counts; and from a shared count.
DISCOUNT, SHARED_DISCOUNT = 2.0, 0.75
#: Bytes of the window whose mean evidence is the greatest of a text.
WINDOW = 8
#: Evidence is held as a signed byte of so many steps to a nat.
STEPS = 16
#: Labelled rows that are learned from and that calibrate; nine bytes of the model, twice for empty places, for each of their grams.
MOST_LABELLED, MOST_FITTED = 100_000, 20_000
#: The fold of labelled rows that calibrates; the models that it calibrates don't count it.
CALIBRATION = 4
_COUNTS = ("n", "toxic", "ordinary", "late_toxic", "late_ordinary")
_MASK = np.uint64((1 << (8 * ORDER)) - 1)
_EMPTY = np.uint64((1 << 64) - 1)


def grams(text: bytes) -> np.ndarray:
    """Six-byte strings as numbers, the first byte lowest, of the text between spaces."""
    held = b" " + text.lower() + b" \0\0"
    n = len(held) - 2 - ORDER + 1
    return np.ndarray((n,), "<u8", held, 0, (1,)) & _MASK if n > 0 else np.empty(0, np.uint64)


class Table(NamedTuple):
    """Numbers of 48 bits with a signed byte each, in an open-addressed table at most half full: number << 8 | byte + 128."""

    places: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, steps: np.ndarray) -> Table:
        places = np.full(1 << max(4, (2 * len(keys)).bit_length()), _EMPTY)
        held = cls(places)
        rest = keys.astype(np.uint64) << np.uint64(8) | (steps.astype(np.int64) + 128).astype(np.uint64)
        at = held._first(keys.astype(np.uint64))
        while len(rest):
            free = places[at] == _EMPTY
            places[at[free]] = rest[free]
            out = places[at] != rest
            rest, at = rest[out], (at[out] + 1) % len(places)
        return held

    def _first(self, keys: np.ndarray) -> np.ndarray:
        bits = len(self.places).bit_length() - 1
        return ((keys ^ keys >> np.uint64(23)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, whether found) of numbers."""
        at = self._first(keys)
        got = self.places[at]
        hit = got >> np.uint64(8) == keys
        open_ = np.flatnonzero(~hit & (got != _EMPTY))
        at = at[open_]
        while len(open_):
            at = (at + 1) % len(self.places)
            more = self.places[at]
            got[open_] = more
            found = more >> np.uint64(8) == keys[open_]
            hit[open_[found]] = True
            on = ~found & (more != _EMPTY)
            open_, at = open_[on], at[on]
        return (got & np.uint64(255)).astype(np.int16) - 128, hit


class Model(NamedTuple):
    """Steps of grams, and of contexts for the bytes whose grams aren't there."""

    grams: Table
    contexts: Table


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(c, first, axis=0) if len(k) else c


def gram_counts(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(gram, n, toxic, ordinary, late_toxic, late_ordinary) over all texts; known: (id, y, late) of labelled ones, apart where late."""
    held = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(known.select("id", (F.when(F.col("y") > 0, 1).otherwise(2) + F.when(F.col("late"), 2).otherwise(0)).alias("kind"))), "id", "left").select("text", F.coalesce("kind", F.lit(0)).alias("kind"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        sums: list[np.ndarray] = []
        waiting: dict[int, list[np.ndarray]] = {k: [] for k in range(5)}
        size = 0

        def settle() -> None:
            nonlocal keys, sums, size
            for kind, parts in waiting.items():
                if parts:
                    u, n = np.unique(np.concatenate(parts), return_counts=True)
                    c = np.zeros((len(u), 5), np.int64)
                    c[:, 0] = n
                    if kind:
                        c[:, kind] = n
                    keys.append(u)
                    sums.append(c)
                    parts.clear()
            size = 0
            if len(keys) > 12:
                k, c = _summed(keys, sums)
                keys, sums = [k], [c]

        for b in batches:
            for t, kind in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist(), strict=True):
                if t.is_valid:
                    g = grams(t.as_py())
                    waiting[kind].append(g)
                    size += len(g)
                    if size > 1 << 20:
                        settle()
        settle()
        if keys:
            k, c = _summed(keys, sums)
            for i in range(0, len(k), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + (1 << 16)].view(np.int64)), *[pa.array(c[i : i + (1 << 16), j]) for j in range(5)]], names=["gram", *_COUNTS])

    counted = held.mapInArrow(count, "gram bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    return counted.groupBy("gram").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def backoff(counts: DataFrame, discount: float = SHARED_DISCOUNT) -> DataFrame:
    """(suffix, backoff): shared probability of the last of five bytes after the four before it, by recursive continuation counts."""
    levels = [counts.groupBy(F.shiftright("gram", 8).alias("s")).agg(F.count("*").alias("cont"))]
    for _ in range(ORDER - 2):
        levels.append(levels[-1].groupBy(F.shiftright("s", 8).alias("s")).agg(F.count("*").alias("cont")))
    lower = None
    for size, level in zip(range(1, ORDER), reversed(levels), strict=True):
        held = level.withColumn("before", F.col("s").bitwiseAND(F.lit((1 << (8 * (size - 1))) - 1)))
        total = held.groupBy("before").agg(F.sum("cont").alias("total"), F.count("*").alias("kinds"))
        held = held.join(total, "before").withColumn("shorter", F.shiftright("s", 8))
        below = F.lit(1 / 256) if lower is None else F.col("p")
        if lower is not None:
            held = held.join(lower.select(F.col("s").alias("shorter"), "p"), "shorter")
        lower = held.select("s", ((F.greatest(F.col("cont") - discount, F.lit(0.0)) + discount * F.col("kinds") * below) / F.col("total")).alias("p"))
    return lower.select(F.col("s").alias("suffix"), F.col("p").alias("backoff"))


def evidence(counts: DataFrame, shared: DataFrame, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """(gram, llr, other) of the grams of labelled text, and (context, other) of its contexts; shared: :func:`backoff`.

    llr: interpolated Kneser-Ney log ratio of a gram's last byte after its first five; other: that of any byte that neither class
    has seen in the context.
    """
    low = (1 << (8 * (ORDER - 1))) - 1
    seen = counts.filter((F.col("toxic") > 0) | (F.col("ordinary") > 0)).withColumns({"context": F.col("gram").bitwiseAND(F.lit(low)), "suffix": F.shiftright("gram", 8)})
    taken = lambda k: F.sum(F.least(F.col(k), F.lit(discount))).alias(f"{k}_taken")
    own = seen.groupBy("context").agg(F.sum("toxic").alias("toxic_n"), F.sum("ordinary").alias("ordinary_n"), taken("toxic"), taken("ordinary"))

    def left(k: str):
        """What a class leaves to the shared distribution."""
        return F.when(F.col(f"{k}_n") > 0, F.col(f"{k}_taken") / F.col(f"{k}_n")).otherwise(F.lit(1.0))

    contexts = own.withColumn("other", F.log(left("toxic")) - F.log(left("ordinary")))
    joined = seen.join(contexts, "context").join(shared, "suffix")

    def p(k: str):
        n = F.col(f"{k}_n")
        return F.when(n > 0, (F.greatest(F.col(k) - discount, F.lit(0.0)) + F.col(f"{k}_taken") * F.col("backoff")) / n).otherwise(F.col("backoff"))

    return joined.select("gram", (F.log(p("toxic")) - F.log(p("ordinary"))).alias("llr"), "other"), contexts.select("context", "other")


def _steps(llr: Column) -> Column:
    return F.round(F.greatest(F.least(llr * STEPS, F.lit(127.0)), F.lit(-127.0))).cast("tinyint")


def model(counts: DataFrame, shared: DataFrame) -> Model:
    """The evidence of each gram; what comes to the driver is bounded by the labelled rows' grams."""
    grams_, contexts = evidence(counts, shared)
    own = grams_.select("gram", _steps(F.col("llr")).alias("step"), _steps(F.col("other")).alias("other")).filter("step <> other").select("gram", "step")
    rest = contexts.select("context", _steps(F.col("other")).alias("step")).filter("step <> 0")
    return Model(*(Table.of(t.column(0).to_numpy(), t.column(1).to_numpy()) for t in (own.toArrow(), rest.toArrow())))


def steps_of(g: np.ndarray, held: Model) -> np.ndarray:
    """Steps of grams of a text."""
    out, hit = held.grams.find(g)
    at = np.flatnonzero(~hit)
    steps, known = held.contexts.find(g[at] & np.uint64((1 << (8 * (ORDER - 1))) - 1))
    out[at] = np.where(known, steps, 0)
    return out


def statistics(text: bytes, table: Model, window: int = WINDOW) -> tuple[float, float]:
    """Mean evidence of the most toxic window and of the whole text, in nats a byte."""
    g = grams(text)
    if not len(g):
        return 0.0, 0.0
    sums = np.cumsum(steps_of(g, table), dtype=np.int64)
    if len(g) <= window:
        return float(sums[-1]) / window / STEPS, float(sums[-1]) / len(g) / STEPS
    best = max(int(sums[window - 1]), int((sums[window:] - sums[:-window]).max()))
    return best / window / STEPS, float(sums[-1]) / len(g) / STEPS


def measured(docs: DataFrame, table, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, peak, mean) by a broadcast model."""
    held = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([statistics(t.as_py(), table.value) if t.is_valid else (0.0, 0.0) for t in b.column(1).cast(pa.binary())], dtype=np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s[:, 0]), pa.array(s[:, 1])], names=["id", "peak", "mean"])

    return held.mapInArrow(score, f"id {kind}, peak double, mean double")


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(id, peak, mean, score) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    known = written(training(labels, label, MOST_LABELLED, id_col))
    fitted = known.filter(F.col("fold") == CALIBRATION)
    counts = written(gram_counts(docs, known.select("id", "y", (F.col("fold") == CALIBRATION).alias("late")), id_col, text))
    shared = written(backoff(counts))
    early = spark.sparkContext.broadcast(model(counts, shared))
    n = fitted.count()
    if n > MOST_FITTED:
        fitted = fitted.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < int(0.97 * MOST_FITTED / n * (1 << 20)))
    chosen = docs.join(F.broadcast(fitted.select(F.col("id").alias(id_col))), id_col, "left_semi")
    rows = measured(chosen, early, id_col, text).join(F.broadcast(fitted), "id").select("peak", "mean", "y").toArrow()
    early.unpersist()
    x = np.column_stack([rows.column("peak").to_numpy(), rows.column("mean").to_numpy()]).reshape(-1, 2)
    w, mean, scale = logistic(x, rows.column("y").to_numpy().astype(float))
    full = counts.withColumns({"toxic": F.col("toxic") + F.col("late_toxic"), "ordinary": F.col("ordinary") + F.col("late_ordinary")})
    table = spark.sparkContext.broadcast(model(full, shared))
    z = F.lit(float(w[2])) + F.lit(float(w[0] / scale[0])) * (F.col("peak") - float(mean[0])) + F.lit(float(w[1] / scale[1])) * (F.col("mean") - float(mean[1]))
    return measured(docs, table, id_col, text).withColumn("score", 1 / (1 + F.exp(-z)))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``op1_toxicity``."""
    found = scores(docs, labels)
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
