"""Version history: keep-last, latest, as-of, time-to-live. Versions are (key, version_id, seq, ts, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(versions: DataFrame, n: int, key: str = "key", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Every version with its rank from the newest and ``selected`` for pruning beyond ``n``."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return versions.withColumn("rank", F.row_number().over(w)).withColumn("selected", F.col("rank") > n)


def latest(versions: DataFrame, columns: list[str], key: str = "key", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The newest version of each key, as a grouped maximum: no sort, and partial results before the shuffle."""
    return versions.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("v")).select(key, "v.*")


def as_of(versions: DataFrame, at: Column, columns: list[str], key: str = "key", order: tuple[str, ...] = ("seq",), time: str = "ts") -> DataFrame:
    """The state of each key at a point in history: the newest version not after it."""
    return latest(versions.filter(F.col(time) <= at), columns, key, order)


def as_of_join(points: DataFrame, versions: DataFrame, by: str, at: str, time: str, value: str, tie: str) -> DataFrame:
    """``points`` with the ``value`` of the last version of the same key not after ``at``.

    Both sides are laid in one order by key and time and the last value is carried forward: one shuffle, no pair of rows.
    """
    names = points.columns
    p = points.select(*names, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(versions.schema[value].dataType).alias("__v"), F.lit(None).cast(versions.schema[tie].dataType).alias("__tie"))
    empty = [F.lit(None).cast(points.schema[c].dataType).alias(c) if c != by else F.col(by) for c in names]
    v = versions.select(*empty, F.col(time).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"), F.col(tie).alias("__tie"))
    w = Window.partitionBy(by).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return p.unionByName(v).withColumn(f"asof_{value}", F.last("__v", ignorenulls=True).over(w)).filter("__side = 1").select(*names, f"asof_{value}")


def expired(versions: DataFrame, now: Column, days: int, time: str = "ts", key: str = "key", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Versions older than ``days``, but never the newest of a key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return versions.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") > 1) & (F.col(time) < now - F.expr(f"INTERVAL {days} DAYS")))


def last_three(versions: DataFrame, snapshots: bool = False, key: str = "key", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """``deleted_by``: stage ``t`` goes when ``t + 3`` arrives; with ``snapshots`` every fourth stage stays."""
    w = Window.partitionBy(key).orderBy(*order)
    stage = F.row_number().over(w) - 1
    gone = F.lead("version_id", 3).over(w)
    out = versions.withColumn("stage", stage).withColumn("deleted_by", gone)
    return out.withColumn("deleted_by", F.when(F.col("stage") % 4 != 0, F.col("deleted_by"))) if snapshots else out
