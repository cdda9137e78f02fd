"""Streams over the driver's events, each run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from granary.operators.storage import shared_dir
from granary.plans.chunk_queries import _JOURNAL
from granary.plans import proxies as px
from granary.plans.registry import register, table
from granary.streaming import journal as sj


def _places(spark) -> tuple[str, str]:
    at = f"{shared_dir(spark)}/granary-stream-{uuid.uuid4().hex}"
    return f"{at}/out", f"{at}/state"


def _events(spark, d):
    schema = table(spark, d, "events").schema
    held = sj.source(spark, d, schema, "events.parquet")
    return held.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.col("event_type").alias("type"), "value", F.col("ts").cast("timestamp").alias("ts"))


@register("stream_journal_fold", px.sql(_JOURNAL, query="""SELECT "key", seq, type, value FROM (SELECT *, row_number() OVER (PARTITION BY "key" ORDER BY seq DESC) AS rn FROM j) WHERE rn = 1 AND type <> 'error'"""))
def stream_journal_fold(spark, d):
    out = sj.drained(sj.folded(_events(spark, d), "key", "seq", ["type", "value"]), *_places(spark), mode="update")
    last = out.groupBy("key").agg(F.max_by(F.struct("seq", "type", "value"), "batch").alias("v"))
    return last.select("key", "v.*").filter("type <> 'error'")


@register("stream_seq_gaps", px.sql(_JOURNAL, query="""SELECT "key", seq, expected FROM (SELECT *, lag(seq) OVER (PARTITION BY "key" ORDER BY seq) + 1 AS expected FROM j) WHERE expected IS NOT NULL AND seq > expected"""))
def stream_seq_gaps(spark, d):
    return sj.drained(sj.gaps(_events(spark, d), "key", "seq"), *_places(spark)).select("key", "seq", "expected")


@register("stream_dedup", "SELECT DISTINCT user_id AS \"key\", event_type AS type FROM events")
def stream_dedup(spark, d):
    return sj.drained(sj.deduplicated(_events(spark, d), ["key", "type"]), *_places(spark)).select("key", "type")


@register("stream_ticks")
def stream_ticks(spark, d):
    """Windows that the watermark closes; the last ones stay open, so there is no batch twin."""
    out = sj.drained(sj.ticks(_events(spark, d), "ts", "7 days", ["type"], "1 day"), *_places(spark))
    return out.select(F.col("window.start").alias("tick"), "type", "n")
