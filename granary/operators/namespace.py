"""Listing, paging, conditional requests, byte ranges, copies, deletes and multipart objects over an object table.

Keys compare bytewise (Spark's default collation). Every order has a tie-break, so pages are stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_prefix(objects: DataFrame, prefix: str) -> DataFrame:
    """Objects whose key starts with ``prefix``; the predicate reaches the scan as a StartsWith filter."""
    return objects.filter(F.col("key").startswith(prefix))


def common_prefix(key: Column, prefix: str, delimiter: str) -> Column:
    """The key up to and with the first delimiter after ``prefix``, or null."""
    at = F.locate(delimiter, key, len(prefix) + 1)
    return F.when(at > 0, F.substring(key, F.lit(1), at + len(delimiter) - 1))


def list_delimited(objects: DataFrame, prefix: str = "", delimiter: str = "/") -> DataFrame:
    """(entry, is_prefix, n): common prefixes with the keys they stand for, and keys without a further delimiter."""
    held = list_prefix(objects, prefix).select("key", common_prefix(F.col("key"), prefix, delimiter).alias("p"))
    return held.groupBy(F.coalesce("p", "key").alias("entry"), F.col("p").isNotNull().alias("is_prefix")).agg(F.count("*").alias("n"))


def page(rows: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """The ``size`` rows after a keyset token, and whether more follow; a top-k, never a full sort."""
    if after is not None:
        less = F.lit(False)
        for i, c in reversed(list(enumerate(order))):
            less = (F.col(c) > F.lit(after[i])) | ((F.col(c) == F.lit(after[i])) & less)
        rows = rows.filter(less)
    found = rows.orderBy(*order).limit(size + 1)
    n = Window.orderBy(*order)
    return found.withColumn("rn", F.row_number().over(n)).withColumn("is_truncated", F.count("*").over(Window.partitionBy()) > size).filter(F.col("rn") <= size).drop("rn")


def encoded_key(key: Column) -> Column:
    """Percent-encoding of each byte but unreserved ones, space as %20, upper-case hex."""
    out = F.url_encode(key)
    for was, now in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


def get_status(etag: Column, if_match: Column, if_none_match: Column) -> Column:
    """412 if If-Match is given and fails; else 304 if If-None-Match is given and holds; else 200. ``*`` matches any object."""
    hit = lambda want: (want == "*") | (want == etag)
    return F.when(if_match.isNotNull() & ~hit(if_match), 412).when(if_none_match.isNotNull() & hit(if_none_match), 304).otherwise(200)


def put_status(exists: Column, etag: Column, if_match: Column, if_none_match: Column) -> Column:
    """Create-only (If-None-Match ``*``) and replace-if (If-Match) writes: 412 where refused."""
    refused = (if_none_match.isNotNull() & exists) | (if_match.isNotNull() & (~exists | (if_match != etag)))
    return F.when(refused, 412).otherwise(200)


def byte_range(spec: Column, size: Column) -> Column:
    """struct<status, lo, hi> of ``bytes=a-b``, ``a-`` or ``-n``: 206 with an inclusive range, 416 if none of it exists, 200 if it is no range."""
    a, b = F.regexp_extract(spec, r"^bytes=([0-9]*)-([0-9]*)$", 1), F.regexp_extract(spec, r"^bytes=([0-9]*)-([0-9]*)$", 2)
    number = lambda x: F.when(x != "", x.cast("long"))
    lo = F.when(a != "", number(a)).otherwise(F.greatest(size - number(b), F.lit(0)))
    hi = F.when(a == "", size - 1).otherwise(F.least(F.coalesce(number(b), size - 1), size - 1))
    bad = (a == "") & (b == "") | ((a != "") & (b != "") & (number(b) < number(a)))
    status = F.when(~spec.rlike(r"^bytes=[0-9]*-[0-9]*$") | bad, 200).when((lo >= size) | ((a == "") & (number(b) == 0)) | (hi < lo), 416).otherwise(206)
    held = lambda x: F.when(status == 206, x)
    return F.struct(status.alias("status"), held(lo).alias("lo"), held(hi).alias("hi"))


def copied(objects: DataFrame, bucket: str, metadata: dict[str, str] | None = None) -> DataFrame:
    """Roots copied to another bucket without payload; metadata merged under COPY, replaced if given under REPLACE."""
    out = objects.withColumn("bucket", F.lit(bucket))
    if metadata is not None:
        pairs = [F.lit(x) for kv in sorted(metadata.items()) for x in kv]
        out = out.withColumn("metadata", F.create_map(*pairs))
    return out


def delete_results(objects: DataFrame, victims: DataFrame) -> DataFrame:
    """(key, status, existed): one row for each distinct requested key; deleting a key that isn't there succeeds."""
    wanted = victims.select("key").distinct()
    have = objects.select("key", F.lit(True).alias("existed"))
    return wanted.join(have, "key", "left").select("key", F.lit("deleted").alias("status"), F.coalesce("existed", F.lit(False)).alias("existed"))


def without(objects: DataFrame, victims: DataFrame) -> DataFrame:
    return objects.join(victims.select("key"), "key", "left_anti")


def latest_parts(parts: DataFrame) -> DataFrame:
    """Of parts (upload_id, part_no, seq, body) the last written of each number."""
    return parts.groupBy("upload_id", "part_no").agg(F.max_by("body", "seq").alias("body"))


def assembled(parts: DataFrame) -> DataFrame:
    """(upload_id, body, size, n_parts, etag): parts in number order; the etag is the MD5 of the parts' binary MD5s with their count."""
    held = F.array_sort(F.collect_list(F.struct("part_no", "body")))
    out = parts.groupBy("upload_id").agg(held.alias("p"))
    sums = F.array_join(F.transform("p", lambda x: F.md5(x["body"])), "")
    return out.select(
        "upload_id",
        F.array_join(F.transform("p", lambda x: x["body"]), "").alias("body"),
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["body"])).alias("size"),
        F.size("p").cast("long").alias("n_parts"),
        F.concat(F.md5(F.unhex(sums)), F.lit("-"), F.size("p").cast("string")).alias("etag"),
    )
