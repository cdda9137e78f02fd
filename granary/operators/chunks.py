"""Chunk references: places, locality, deduplication, transfer sets, diffs.

References are (version_id, ord, sha, length); ``ord`` is unique in a version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def offsets(refs: DataFrame) -> DataFrame:
    """Half-open byte range of each chunk in its object."""
    in_version = Window.partitionBy("version_id").orderBy("ord")
    before = F.coalesce(F.sum("length").over(in_version.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return refs.withColumn("start", before).withColumn("end", F.col("start") + F.col("length"))


def locate(placed: DataFrame, ranges: DataFrame) -> DataFrame:
    """Chunks that byte ranges (version_id, lo, hi), hi inclusive, need, with the slice of each; empty chunks never hold a byte.

    The interval condition rides on an equality of versions, so the join is by hash of the version.
    """
    r = ranges.alias("r")
    hit = placed.alias("c").join(r, (F.col("c.version_id") == F.col("r.version_id")) & (F.col("start") <= F.col("hi")) & (F.col("end") > F.col("lo")) & (F.col("length") > 0))
    cut = F.greatest(F.col("lo") - F.col("start"), F.lit(0))
    upto = F.least(F.col("hi") + 1 - F.col("start"), F.col("length"))
    return hit.select("c.version_id", "lo", "hi", "ord", "sha", cut.alias("from"), (upto - cut).alias("take"))


def contiguous_runs(placed: DataFrame, by: str, at: str, upto: str) -> DataFrame:
    """Gaps and islands: (by, run_start, run_end, n) of physically adjacent records."""
    w = Window.partitionBy(by).orderBy(at, upto)
    new = (F.coalesce(F.max(upto).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) < F.col(at)).cast("int")
    held = placed.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    return held.groupBy(by, "__run").agg(F.min(at).alias("run_start"), F.max(upto).alias("run_end"), F.count("*").alias("n")).drop("__run")


def first_reference_order(refs: DataFrame, order: list[str]) -> DataFrame:
    """(sha, first): each chunk with its earliest reference, by a grouped minimum; sort by ``first`` to lay chunks down."""
    return refs.groupBy("sha").agg(F.min(F.struct(*order)).alias("first"))


def new_bytes(refs: DataFrame, revision: str, order: list[str]) -> DataFrame:
    """(revision, new, reused): bytes of a revision that no earlier revision, or earlier place in it, holds."""
    w = Window.partitionBy("sha").orderBy(revision, *order)
    held = refs.withColumn("__first", F.row_number().over(w) == 1)
    return held.groupBy(revision).agg(
        F.coalesce(F.sum(F.when(F.col("__first"), F.col("length"))), F.lit(0)).alias("new"), F.coalesce(F.sum(F.when(~F.col("__first"), F.col("length"))), F.lit(0)).alias("reused")
    )


def missing(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """(sha, first_seen): wanted chunks that the destination lacks, once each, with the place of the first request."""
    return wanted.groupBy("sha").agg(F.min("pos").alias("first_seen")).join(have.select("sha").distinct(), "sha", "left_anti")


def base_references(target: DataFrame, base: DataFrame) -> DataFrame:
    return target.select("sha").distinct().join(base.select("sha").distinct(), "sha", "left_semi")


def payload_set(target: DataFrame, base: DataFrame) -> DataFrame:
    return target.select("sha").distinct().join(base.select("sha").distinct(), "sha", "left_anti")


def object_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: distinct chunks and bytes shared, only left, only right, and whether both sequences are the same set."""
    left = a.groupBy("sha").agg(F.max("length").alias("l"))
    right = b.groupBy("sha").agg(F.max("length").alias("r"))
    side = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("shared")
    j = left.join(right, "sha", "full_outer").withColumn("side", side).withColumn("bytes", F.coalesce("l", "r"))
    pick = lambda s: F.count(F.when(F.col("side") == s, 1)).alias(f"n_{s}")
    size = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("bytes"))), F.lit(0)).cast("long").alias(f"bytes_{s}")
    return j.agg(*[f(s) for s in ("shared", "left", "right") for f in (pick, size)])


def sequence_multiset_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``a`` beyond those of ``b``, counted with their repeats."""
    return a.select(*columns).exceptAll(b.select(*columns))


def length_conflicts(refs: DataFrame) -> DataFrame:
    """Chunks that are referenced with more than one length."""
    return refs.groupBy("sha").agg(F.count_distinct("length").alias("n_lengths"), F.min("length").alias("least"), F.max("length").alias("most")).filter("n_lengths > 1")


def batches(chunks: DataFrame, by: str, order: list[str], bytes_limit: int, count_limit: int) -> DataFrame:
    """Transfer batches within ``by``: a running count and sum over ordered chunks, cut at either limit."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.count("*").over(w)
    size = F.coalesce(F.sum("length").over(w), F.lit(0))
    batch = F.greatest(F.floor(n / count_limit), F.floor(size / bytes_limit)).cast("long")
    return chunks.withColumn("batch", batch)


def sequence_gaps(journal: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose ``seq`` isn't the one before plus one, with what was expected."""
    w = Window.partitionBy(*by).orderBy("seq")
    return journal.withColumn("expected", F.lag("seq").over(w) + 1).filter(F.col("expected").isNotNull() & (F.col("seq") != F.col("expected")))
