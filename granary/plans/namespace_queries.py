"""Listing, requests and multipart objects over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import namespace as ns
from granary.plans import proxies as px
from granary.plans.registry import register, table


@register("object_hashes", px.sql(px.OBJECTS, query="SELECT version_id, sha, etag, size FROM objects"))
def object_hashes(spark, d):
    return px.objects(spark, d).select("version_id", "sha", "etag", "size")


@register("dup_groups", px.sql(px.OBJECTS, query="SELECT sha, count(*) AS n, min(version_id) AS first, (sum(size) - max(size))::BIGINT AS wasted FROM objects GROUP BY sha HAVING count(*) > 1"))
def dup_groups(spark, d):
    return px.objects(spark, d).groupBy("sha").agg(F.count("*").alias("n"), F.min("version_id").alias("first"), (F.sum("size") - F.max("size")).alias("wasted")).filter("n > 1")


@register("list_prefix", px.sql(px.KEYS, query="""SELECT "key", size FROM keys WHERE starts_with("key", 'blog.')"""))
def list_prefix(spark, d):
    return ns.list_prefix(px.keys(spark, d), "blog.")


@register("list_delimited", px.sql(px.KEYS, query="""SELECT CASE WHEN instr("key", '/') > 0 THEN substr("key", 1, instr("key", '/')) ELSE "key" END AS entry, instr("key", '/') > 0 AS is_prefix, count(*) AS n FROM keys GROUP BY 1, 2"""))
def list_delimited(spark, d):
    return ns.list_delimited(px.keys(spark, d))


@register("list_under_prefix", px.sql(px.OBJECTS, query="""SELECT "key" AS entry, false AS is_prefix, count(*) AS n FROM objects WHERE starts_with("key", 'de/') GROUP BY 1"""))
def list_under_prefix(spark, d):
    return ns.list_delimited(px.objects(spark, d), "de/")


@register("list_page", px.sql(px.OBJECTS, query="""SELECT "key", version_id, total > 100 AS is_truncated FROM (SELECT *, count(*) OVER () AS total FROM objects WHERE "key" > 'de/2' OR ("key" = 'de/2' AND version_id > 2)) ORDER BY 1, 2 LIMIT 100"""))
def list_page(spark, d):
    return ns.page(px.objects(spark, d).select("key", "version_id"), ["key", "version_id"], ("de/2", 2), 100)


@register("list_encoded", """SELECT page_id, url_encode(url || ' ~*+é') AS encoded FROM pages""")
def list_encoded(spark, d):
    return table(spark, d, "pages").select("page_id", ns.encoded_key(F.concat("url", F.lit(" ~*+é"))).alias("encoded"))


_COND = """SELECT version_id, im, inm, CASE WHEN im IS NOT NULL AND NOT (im = '*' OR im = etag) THEN 412 WHEN inm IS NOT NULL AND (inm = '*' OR inm = etag) THEN 304 ELSE 200 END AS status
FROM (SELECT version_id, etag, CASE version_id % 4 WHEN 0 THEN etag WHEN 1 THEN 'x' WHEN 2 THEN '*' END AS im, CASE version_id % 3 WHEN 0 THEN etag WHEN 1 THEN 'y' END AS inm FROM objects)"""


@register("conditional_get", px.sql(px.OBJECTS, query=_COND))
def conditional_get(spark, d):
    v = F.col("version_id")
    im = F.when(v % 4 == 0, F.col("etag")).when(v % 4 == 1, "x").when(v % 4 == 2, "*")
    inm = F.when(v % 3 == 0, F.col("etag")).when(v % 3 == 1, "y")
    o = px.objects(spark, d).select("version_id", "etag", im.alias("im"), inm.alias("inm"))
    return o.select("version_id", "im", "inm", ns.get_status(F.col("etag"), F.col("im"), F.col("inm")).alias("status"))


_PUT = """SELECT version_id, CASE WHEN (inm IS NOT NULL AND have) OR (im IS NOT NULL AND (NOT have OR im <> etag)) THEN 412 ELSE 200 END AS status
FROM (SELECT version_id, etag, version_id % 5 <> 0 AS have, CASE version_id % 3 WHEN 0 THEN etag WHEN 1 THEN 'x' END AS im, CASE WHEN version_id % 7 = 0 THEN '*' END AS inm FROM objects)"""


@register("conditional_put", px.sql(px.OBJECTS, query=_PUT))
def conditional_put(spark, d):
    v = F.col("version_id")
    status = ns.put_status(v % 5 != 0, F.col("etag"), F.when(v % 3 == 0, F.col("etag")).when(v % 3 == 1, "x"), F.when(v % 7 == 0, "*"))
    return px.objects(spark, d).select("version_id", status.alias("status"))


_RANGE = """SELECT version_id, spec, CASE kind WHEN 0 THEN CASE WHEN 10 >= size THEN 416 ELSE 206 END WHEN 1 THEN CASE WHEN 100 >= size THEN 416 ELSE 206 END WHEN 2 THEN 206 WHEN 3 THEN CASE WHEN 2000000 >= size THEN 416 ELSE 206 END ELSE 200 END AS status,
CASE kind WHEN 0 THEN CASE WHEN 10 < size THEN 10 END WHEN 1 THEN CASE WHEN 100 < size THEN 100 END WHEN 2 THEN greatest(size - 50, 0) WHEN 3 THEN CASE WHEN 2000000 < size THEN 2000000 END END::BIGINT AS lo,
CASE kind WHEN 0 THEN CASE WHEN 10 < size THEN least(199, size - 1) END WHEN 1 THEN CASE WHEN 100 < size THEN size - 1 END WHEN 2 THEN size - 1 WHEN 3 THEN CASE WHEN 2000000 < size THEN size - 1 END END::BIGINT AS hi
FROM (SELECT *, version_id % 5 AS kind, CASE version_id % 5 WHEN 0 THEN 'bytes=10-199' WHEN 1 THEN 'bytes=100-' WHEN 2 THEN 'bytes=-50' WHEN 3 THEN 'bytes=2000000-' ELSE 'lines=1-2' END AS spec FROM objects)"""


@register("range_requests", px.sql(px.OBJECTS, query=_RANGE))
def range_requests(spark, d):
    k = F.col("version_id") % 5
    spec = F.when(k == 0, "bytes=10-199").when(k == 1, "bytes=100-").when(k == 2, "bytes=-50").when(k == 3, "bytes=2000000-").otherwise("lines=1-2")
    return px.objects(spark, d).withColumn("spec", spec).withColumn("r", ns.byte_range(F.col("spec"), F.col("size"))).select("version_id", "spec", "r.*")


@register("range_read", """SELECT doc_id, substr(text, 11, 190) AS body FROM documents""")
def range_read(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 11, 190).alias("body"))


@register("delete_batch", px.sql(px.OBJECTS, query="""SELECT v."key", 'deleted' AS status, o."key" IS NOT NULL AS existed FROM (SELECT DISTINCT 'en/' || doc_id::VARCHAR AS "key" FROM documents) v LEFT JOIN (SELECT DISTINCT "key" FROM objects) o USING ("key")"""))
def delete_batch(spark, d):
    victims = table(spark, d, "documents").select(F.concat(F.lit("en/"), F.col("doc_id").cast("string")).alias("key"))
    return ns.delete_results(px.objects(spark, d), victims)


@register("delete_remaining", px.sql(px.OBJECTS, query="""SELECT "key", version_id FROM objects WHERE NOT starts_with("key", 'en/')"""))
def delete_remaining(spark, d):
    victims = table(spark, d, "documents").select(F.concat(F.lit("en/"), F.col("doc_id").cast("string")).alias("key"))
    return ns.without(px.objects(spark, d), victims).select("key", "version_id")


@register("fork_bucket", px.sql(px.OBJECTS, query="""SELECT 'fork' AS bucket, "key", version_id, sha FROM objects WHERE bucket = 'src0'"""))
def fork_bucket(spark, d):
    return ns.copied(px.objects(spark, d).filter("bucket = 'src0'"), "fork").select("bucket", "key", "version_id", "sha")


@register("snapshot_capture", px.sql(px.OBJECTS, query="""SELECT 's1' AS id, "key", version_id, sha FROM objects WHERE starts_with("key", 'fr/')"""))
def snapshot_capture(spark, d):
    return ns.list_prefix(px.objects(spark, d), "fr/").select(F.lit("s1").alias("id"), "key", "version_id", "sha")


_PARTS = """p AS (SELECT conv_id AS upload_id, turn AS part_no, arg_max(text, (len(text), text)) AS body FROM conversations GROUP BY 1, 2)"""


def parts(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("upload_id"), F.col("turn").alias("part_no"), F.struct(F.length("text").alias("n"), "text").alias("seq"), F.col("text").alias("body"))
    return ns.latest_parts(c.filter("body IS NOT NULL"))


@register("multipart_etag", px.sql(_PARTS, query="""SELECT upload_id, md5(unhex(string_agg(md5(body), '' ORDER BY part_no))) || '-' || count(*)::VARCHAR AS etag, count(*) AS n_parts FROM p GROUP BY 1"""))
def multipart_etag(spark, d):
    return ns.assembled(parts(spark, d)).select("upload_id", "etag", "n_parts")


@register("multipart_assemble", px.sql(_PARTS, query="""SELECT upload_id, sha256(string_agg(body, '' ORDER BY part_no)) AS sha, sum(strlen(body))::BIGINT AS size FROM p GROUP BY 1"""))
def multipart_assemble(spark, d):
    return ns.assembled(parts(spark, d)).select("upload_id", F.sha2("body", 256).alias("sha"), "size")


@register("format_magic", """SELECT page_id, CASE WHEN starts_with(lower(html), '<!doctype html') THEN 'html' WHEN starts_with(html, '{') THEN 'json' ELSE 'raw' END AS kind FROM pages""")
def format_magic(spark, d):
    low = F.lower("html")
    return table(spark, d, "pages").select("page_id", F.when(low.startswith("<!doctype html"), "html").when(F.col("html").startswith("{"), "json").otherwise("raw").alias("kind"))


@register("digest_parse", px.sql(px.OBJECTS, query="""SELECT version_id, split_part(dg, ':', 1) AS algo, split_part(dg, ':', 2) AS hex, regexp_full_match(dg, 'sha256:[0-9a-f]{64}') AS ok FROM (SELECT version_id, CASE WHEN version_id % 10 = 0 THEN 'sha256:XYZ' ELSE 'sha256:' || sha END AS dg FROM objects)"""))
def digest_parse(spark, d):
    o = px.objects(spark, d).select("version_id", F.when(F.col("version_id") % 10 == 0, "sha256:XYZ").otherwise(F.concat(F.lit("sha256:"), "sha")).alias("dg"))
    return o.select("version_id", F.split_part("dg", F.lit(":"), F.lit(1)).alias("algo"), F.split_part("dg", F.lit(":"), F.lit(2)).alias("hex"), F.col("dg").rlike("^sha256:[0-9a-f]{64}$").alias("ok"))


@register("human_bytes", px.sql(px.OBJECTS, query="""SELECT version_id, CASE WHEN size >= 1048576 THEN (floor(size / 104857.6) / 10)::VARCHAR || ' MiB' WHEN size >= 1024 THEN (floor(size / 102.4) / 10)::VARCHAR || ' KiB' ELSE size::VARCHAR || ' B' END AS human FROM objects"""))
def human_bytes(spark, d):
    s = F.col("size")
    shown = lambda unit, name: F.concat((F.floor(s / unit).cast("double") / 10).cast("string"), F.lit(name))
    return px.objects(spark, d).select("version_id", F.when(s >= 1048576, shown(104857.6, " MiB")).when(s >= 1024, shown(102.4, " KiB")).otherwise(F.concat(s.cast("string"), F.lit(" B"))).alias("human"))
