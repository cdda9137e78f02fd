"""Synthetic corpora: seeded chains of revisions, the same for a seed wherever and however often they are made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _draw(seed: int, *parts: Column) -> Column:
    """32 hexadecimal digits of a seed and numbers."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def chains(spark: SparkSession, lineages: int, revisions: int, records: int, seed: int = 0, changed: int = 10) -> DataFrame:
    """(lineage, revision, record, body): of each revision after the first about one record in ``changed`` differs from the one before.

    A record's body is a draw of the revision that last changed it. Rows are made in the tasks; nothing comes from the driver.
    """
    n = F.col("id")
    rows = spark.range(lineages * records * revisions).select(F.floor(n / (records * revisions)).alias("lineage"), (F.floor(n / revisions) % records).alias("record"), (n % revisions).alias("revision"))
    at = [F.col(c) for c in ("lineage", "record", "revision")]
    new = (F.col("revision") == 0) | (F.conv(F.substring(_draw(seed, *at), 1, 8), 16, 10).cast("long") % changed == 0)
    w = Window.partitionBy("lineage", "record").orderBy("revision").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = rows.withColumn("made", F.max(F.when(new, F.col("revision"))).over(w))
    return held.select("lineage", "revision", "record", _draw(seed + 1, F.col("lineage"), F.col("record"), F.col("made")).alias("body"))
