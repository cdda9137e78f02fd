"""Chunking, deltas and scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import content as ct
from granary.operators import chunks as ck
from granary.plans.registry import register, table

#: Small sizes for short texts: least, target, greatest; masks of about 1 in 256 and 1 in 128.
SMALL = {"least": 128, "target": 512, "most": 2048, "small": 255, "large": 127}


@register("cdc_chunks")
def cdc_chunks(spark, d):
    """Content-defined chunks of all documents."""
    return ct.chunk_map(table(spark, d, "documents"), "doc_id", "text", **SMALL)


@register("fixed_chunks", """SELECT doc_id, i::INT AS ord, (i * 256)::BIGINT AS "start", least(256, n - i * 256)::BIGINT AS length FROM (SELECT doc_id, strlen(text) AS n, unnest(range(0, (strlen(text) + 255) // 256)) AS i FROM documents)""")
def fixed_chunks(spark, d):
    return ct.chunk_map(table(spark, d, "documents"), "doc_id", "text", fixed=256).select("doc_id", "ord", "start", "length")


@register("cdc_reuse")
def cdc_reuse(spark, d):
    """Bytes of each document that earlier documents' chunks already hold."""
    c = ct.chunk_map(table(spark, d, "documents"), "doc_id", "text", **SMALL)
    return ck.new_bytes(c.withColumnRenamed("doc_id", "version_id"), "version_id", ["ord"])


@register("cdc_proof", "SELECT doc_id, true AS exact FROM documents")
def cdc_proof(spark, d):
    """Chunks cover each text without gap or overlap, and their ends meet its size."""
    docs = table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("size"))
    c = ck.offsets(ct.chunk_map(table(spark, d, "documents"), "doc_id", "text", **SMALL).withColumnRenamed("start", "at").withColumnRenamed("doc_id", "version_id"))
    ok = c.groupBy("version_id").agg((F.bool_and(F.col("at") == F.col("start"))).alias("tiled"), F.max("end").alias("end"))
    return docs.join(ok, docs["doc_id"] == ok["version_id"], "left").select("doc_id", (F.coalesce("tiled", F.lit(True)) & (F.coalesce("end", F.lit(0)) == F.col("size"))).alias("exact"))


@register("delta_apply", """SELECT a.conv_id, strlen(b.text)::BIGINT AS target_bytes, true AS exact FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL""")
def delta_apply(spark, d):
    c = table(spark, d, "conversations").filter("text IS NOT NULL")
    a, b = c.filter("turn = 0").select("conv_id", F.col("text").alias("base")), c.filter("turn = 1").select("conv_id", F.col("text").alias("target"))
    return ct.delta_map(a.join(b, "conv_id"), "conv_id", "base", "target").select("conv_id", "target_bytes", "exact")


@register("checksums", """SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents""")
def checksums(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


_CRC_TABLE = "[" + ", ".join(str(x) for x in ct.crc32c_table()) + "]"


@register(
    "castagnoli",
    f"""WITH p AS (SELECT page_id, list_transform(range(0, strlen(url)), lambda i: ('0x' || substr(hex(encode(url)), 2 * i + 1, 2))::BIGINT) AS b FROM pages)
SELECT page_id, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, {_CRC_TABLE}[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS crc32c,
       (CASE WHEN f >= 9223372036854775808::UHUGEINT THEN f::HUGEINT - 18446744073709551616::HUGEINT ELSE f::HUGEINT END)::BIGINT AS fnv1a
FROM (SELECT *, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(b, lambda x: x::UHUGEINT)), lambda h, x: (xor(h, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS f FROM p)""",
)
def castagnoli(spark, d):
    """CRC-32C and FNV-1a of keys."""
    return table(spark, d, "pages").select("page_id", ct.crc32c_udf("url").alias("crc32c"), ct.fnv1a_udf("url").alias("fnv1a"))


@register("zigzag", """SELECT event_id, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS z, v AS back FROM (SELECT event_id, (event_id % 1000) - 500 AS v FROM events)""")
def zigzag(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 1000 - 500).alias("v")).withColumn("z", ct.zigzag(F.col("v")))
    return e.select("event_id", "z", ct.unzigzag(F.col("z")).alias("back"))


@register("metadata_merge", """SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE source END AS source FROM documents""")
def metadata_merge(spark, d):
    """User metadata as a map: copied, or overlaid by new pairs."""
    old = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    kept = F.map_filter(old, lambda k, _: k != "source")
    merged = F.when(F.col("doc_id") % 2 == 0, F.map_concat(kept, F.create_map(F.lit("source"), F.lit("new")))).otherwise(old)
    return table(spark, d, "documents").withColumn("m", merged).select("doc_id", F.col("m")["lang"].alias("lang"), F.col("m")["source"].alias("source"))


@register("props_projection", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def props_projection(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("validity_to_null", """SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS valid FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)""")
def validity_to_null(spark, d):
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("v", F.lit(True))
    return table(spark, d, "documents").join(lab, "doc_id", "left").select("doc_id", "quality", F.coalesce("v", F.lit(False)).alias("valid"))


@register("key_bitmap", """SELECT l_orderkey % 100 AS grp, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1""")
def key_bitmap(spark, d):
    """Sets as bitmaps by bucket of numbers, joined by or and counted."""
    x = table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("grp"), (F.col("l_orderkey") % 7).alias("part"), "l_suppkey")
    per = x.groupBy("grp", "part", F.bitmap_bucket_number("l_suppkey").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("l_suppkey")).alias("b"))
    return per.groupBy("grp", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("b")).alias("n")).groupBy("grp").agg(F.sum("n").alias("n"))


@register("half_floats", """WITH b AS (SELECT DISTINCT (l_orderkey % 65536)::INT AS bits FROM lineitem), f AS (SELECT bits, CASE WHEN bits >= 32768 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s, (bits // 1024) % 32 AS e, bits % 1024 AS m FROM b)
SELECT bits, CASE WHEN e = 31 AND m = 0 THEN s * 'inf'::DOUBLE WHEN e = 31 THEN NULL WHEN e = 0 THEN s * m * power(2.0::DOUBLE, -24) ELSE s * (1 + m / 1024.0::DOUBLE) * power(2.0::DOUBLE, e - 15) END AS value FROM f""")
def half_floats(spark, d):
    """Bits of half precision as doubles, not-a-number as null."""
    b = table(spark, d, "lineitem").select((F.col("l_orderkey") % 65536).cast("int").alias("bits")).distinct()
    return b.select("bits", F.nullif(ct.half_value(F.col("bits")), F.lit(float("nan"))).alias("value"))


@register("sha3_digests")
def sha3_digests(spark, d):
    return table(spark, d, "documents").select("doc_id", ct.sha3_256("text").alias("sha3"))
