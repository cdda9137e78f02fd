"""A journal as a stream: current state, gaps, deduplication on arrival, ticks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def folded(stream: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """The last record of each key so far: a streaming maximum whose state is one row a key."""
    return stream.groupBy(key).agg(F.max_by(F.struct(seq, *columns), seq).alias("v")).select(key, "v.*")


def gaps(stream: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, seq, expected) where a key's sequence jumps; state is the last number of each key, arrivals within a batch are put in order."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for n in sorted(int(x) for f in frames for x in f[seq]):
            if last is not None and n > last + 1:
                out.append((k[0], n, last + 1))
            last = n if last is None else max(last, n)
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, seq, "expected"]).astype("int64")

    return stream.select(key, seq).groupBy(key).applyInPandasWithState(step, f"{key} bigint, {seq} bigint, expected bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def deduplicated(stream: DataFrame, columns: list[str], time: str | None = None, late: str | None = None) -> DataFrame:
    """First arrivals; with a watermark the state forgets what can't come any more."""
    if time is not None:
        return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(columns)
    return stream.dropDuplicates(columns)


def ticks(stream: DataFrame, time: str, every: str, by: list[str], late: str) -> DataFrame:
    """Counts in tumbling windows, each given out once, when no more can come."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every), *by).agg(F.count("*").alias("n"))


def new_chunks_only(table: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], key: str = "sha") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends only rows whose key the table doesn't hold yet."""

    def batch(df: DataFrame, _: int) -> None:
        have = table()
        new = df.dropDuplicates([key])
        write(new if have is None else new.join(have.select(key), key, "left_anti"))

    return batch


def source(spark: SparkSession, path: str, schema, glob: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(path)


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs what is there through the stream to its end; the rows it gave out, with the number of the batch that did."""

    def keep(df: DataFrame, n: int) -> None:
        df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n:08d}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    schema = stream.schema.add("batch", "integer")
    return stream.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
