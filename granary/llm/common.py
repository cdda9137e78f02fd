"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[^\x20\x09-\x0D]+``: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where it is unset on one machine a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: the lineage ends there and a lost executor costs no recomputation.

    A reading may split the files otherwise than the one before, so ids of rows are made before they are written. The table goes
    with :func:`dropped`, or when the driver's process ends.
    """
    path = f"{shared_dir(df.sparkSession)}/granary-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._granary_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes the files of tables made by :func:`written`, once nothing reads them any more."""
    for df in tables:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._granary_path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: A key with more than one in so many rows is hot: there are at most as many such keys.
HOT_SHARE = 200


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counts: str | None = None) -> DataFrame:
    """``left`` with ``right``, which has a row for each ``key`` at most; both are written tables.

    Rows of hot keys stay where they are and get their at most HOT_SHARE rows of ``right`` by broadcast; no task gets all rows of
    such a key. Null keys meet nothing. counts: the column of ``right`` that holds how many rows of ``left`` a key has.
    """
    if counts is None:
        sizes = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    else:
        sizes = right.select(key, F.col(counts).alias("__n"))
    hot = [r[0] for r in sizes.filter(F.col("__n") > max(1, left.count() // HOT_SHARE)).collect()]
    if not hot:
        return left.join(right, key, how)
    cold = ~F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.filter(cold).join(right, key, how).unionByName(left.filter(~cold).join(F.broadcast(right.filter(F.col(key).isin(hot))), key, how))


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Holds Arrow batches of the session to ``most`` bytes where they are at Spark's default of 64 MB.

    A batch of texts is held by the JVM's writer, on the way, and by the worker, for each task at once.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(name, most)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
