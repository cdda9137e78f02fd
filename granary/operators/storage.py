"""Where iterations keep their rounds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where it is unset on one machine a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def place(spark: SparkSession) -> str:
    """A new folder's name in the shared folder; what is there goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/granary-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)  # only what is there can be marked
    fs.deleteOnExit(at)
    return f"{path}/rows"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the folder of ``spark.checkpoint.dir``, read again; a folder of its own only where none is set.

    A checkpoint computes its plan twice and hands its constraints on to the next round's plan, where they multiply; a table
    has neither fault. The table goes with :func:`dropped`, or when the driver's process ends.
    """
    spark = df.sparkSession
    path = place(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._granary_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes the files of tables made by :func:`cut`, once no plan reads them any more."""
    for df in tables:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._granary_path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
