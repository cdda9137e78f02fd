"""Statistics, similarity and planning over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import content as ct
from granary.operators import planner as pl
from granary.operators import similarity as sim
from granary.operators import stats as st
from granary.operators.storage import cut
from granary.plans import proxies as px
from granary.plans.registry import register, table


@register("store_stats", px.sql(px.OBJECTS, query="SELECT count(*) AS objects, sum(size)::BIGINT AS logical, count(DISTINCT sha) AS unique_objects, (SELECT sum(m) FROM (SELECT max(size) AS m FROM objects GROUP BY sha))::BIGINT AS unique_bytes FROM objects"))
def store_stats(spark, d):
    per = px.objects(spark, d).groupBy("sha").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return per.agg(F.sum("n").alias("objects"), F.sum(F.col("n") * F.col("size")).alias("logical"), F.count("*").alias("unique_objects"), F.sum("size").alias("unique_bytes"))


@register("latency_stats", """SELECT event_type, count(value) AS n, round(median(value), 6) AS median, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, coalesce(100 * stddev_pop(value) / avg(value), 0) > 10 AS unstable FROM events GROUP BY 1""")
def latency_stats(spark, d):
    s = st.spread(table(spark, d, "events"), ["event_type"], "value")
    return s.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("median",)], "least", "most", *[F.round(c, 6).alias(c) for c in ("mean", "sd")], "unstable")


@register("percentile_table", """SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, quantile_disc(value, 0.999) AS p999 FROM events GROUP BY 1""")
def percentile_table(spark, d):
    return st.percentiles(table(spark, d, "events"), ["event_type"], "value")


_RUNS = """runs AS (SELECT l_returnflag AS family, l_linestatus AS "format", (l_suppkey % 3)::VARCHAR AS rep, l_linenumber - 1 AS index, CASE WHEN l_partkey % 29 = 0 THEN 'error' ELSE 'ok' END AS status,
floor(l_extendedprice)::BIGINT AS logical, l_quantity::BIGINT AS incremental, CASE WHEN l_returnflag <> 'R' OR l_partkey % 31 <> 0 THEN l_quantity::BIGINT * 2 END AS packed FROM lineitem)"""


@register("run_summary", px.sql(_RUNS, query="""SELECT family, "format", rep, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status <> 'error') AS revisions, coalesce(sum(logical) FILTER (WHERE status <> 'error'), 0)::BIGINT AS logical, coalesce(sum(incremental) FILTER (WHERE status <> 'error'), 0)::BIGINT AS incremental,
CASE WHEN bool_and(packed IS NOT NULL) THEN sum(packed) END::BIGINT AS packed FROM runs WHERE index <> 0 GROUP BY 1, 2, 3"""))
def run_summary(spark, d):
    q = F.col("l_quantity").cast("long")
    runs = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("format"), (F.col("l_suppkey") % 3).cast("string").alias("rep"), (F.col("l_linenumber") - 1).alias("index"),
        F.when(F.col("l_partkey") % 29 == 0, "error").otherwise("ok").alias("status"), F.floor("l_extendedprice").cast("long").alias("logical"), q.alias("incremental"),
        F.when((F.col("l_returnflag") != "R") | (F.col("l_partkey") % 31 != 0), q * 2).alias("packed"),
    )
    return st.run_summary(runs)


@register("pivot_speedup", """SELECT l_returnflag, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 6) AS old, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 6) AS new, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O') / avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 6) AS speedup FROM lineitem GROUP BY 1""")
def pivot_speedup(spark, d):
    return st.compared(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "O", "F", "l_quantity").select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("old", "new", "speedup")])


@register("byte_entropy", """SELECT doc_id, round(sum(-c * log2(c / n)) / 8, 6) AS entropy, max(n)::BIGINT AS n FROM (SELECT doc_id, ch, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY doc_id)::DOUBLE AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY doc_id, ch) GROUP BY doc_id""")
def byte_entropy(spark, d):
    chars = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''")
    return st.entropy_bytes(chars, ["doc_id"], F.col("ch")).select("doc_id", F.round("entropy", 6).alias("entropy"), "n")


@register("conditional_entropy", """SELECT l_returnflag, round(sum(e), 6) AS entropy, sum(n)::BIGINT AS n FROM (SELECT l_returnflag, b, sum(-c * log2(c / t)) / 8 AS e, sum(c) AS n FROM (SELECT l_returnflag, b, s, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY l_returnflag, b)::DOUBLE AS t FROM (SELECT l_returnflag, l_quantity::INT AS s, CASE WHEN l_linenumber = 0 THEN 0 ELSE least(floor(log2(l_linenumber)) + 1, 7) END::INT AS b FROM lineitem) GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""")
def conditional_entropy(spark, d):
    held = st.conditional_entropy_bytes(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_quantity").cast("int"), F.col("l_linenumber"))
    return held.select("l_returnflag", F.round("entropy", 6).alias("entropy"), "n")


@register("tensor_signature", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 4) AS l1, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS l2, len(embedding)::INT AS n FROM embeddings""")
def tensor_signature(spark, d):
    s = table(spark, d, "embeddings").select("vec_id", st.signature(F.col("embedding")).alias("s"))
    return s.select("vec_id", F.round("s.l1", 4).alias("l1"), F.round("s.l2", 4).alias("l2"), F.col("s.n").alias("n"))


@register("signature_distance", """WITH s AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS l1, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS l2 FROM embeddings)
SELECT a.vec_id, round(abs(a.l1 - b.l1) / greatest(a.l1, b.l1) + abs(a.l2 - b.l2) / greatest(a.l2, b.l2), 5) AS distance FROM s a JOIN s b ON b.vec_id = a.vec_id + 1""")
def signature_distance(spark, d):
    s = table(spark, d, "embeddings").select("vec_id", st.signature(F.col("embedding")).alias("s"))
    nxt = s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("t"))
    return s.join(nxt, "vec_id").select("vec_id", F.round(sim.signature_distance(F.col("s.l1"), F.col("s.l2"), F.col("t.l1"), F.col("t.l2")), 5).alias("distance"))


@register("affine_fit", """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem GROUP BY 1""")
def affine_fit(spark, d):
    f = st.affine_fit(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return f.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@register("cumulative_curve", px.sql(px.REFS, query="SELECT version_id, ord, (sum(length) OVER (PARTITION BY version_id ORDER BY ord))::BIGINT AS cumulative FROM refs"))
def cumulative_curve(spark, d):
    return st.cumulative(px.refs(spark, d), ["version_id"], ["ord"], "length").select("version_id", "ord", "cumulative")


@register("byte_days", px.sql(px.VERSIONS, query="""SELECT "key", sum(size * date_diff('day', ts::DATE, coalesce(nxt, TIMESTAMP '2000-01-01')::DATE))::BIGINT AS byte_days FROM (SELECT *, lead(ts) OVER (PARTITION BY "key" ORDER BY ts, version_id) AS nxt FROM versions) GROUP BY 1"""))
def byte_days(spark, d):
    return st.byte_days(px.versions(spark, d), ["key"], "ts", "size", ["version_id"], F.lit("2000-01-01").cast("timestamp"))


@register("storage_price", px.sql(px.VERSIONS, query="""SELECT "key", round((sum(size) * 30 / 30.0 + sum(size) * 2.0) * 0.023 / 1e9, 9) AS dollars FROM versions GROUP BY 1"""))
def storage_price(spark, d):
    per = px.versions(spark, d).groupBy("key").agg(F.sum("size").alias("size"))
    return per.select("key", F.round(st.storage_price(F.col("size") * 30, F.col("size"), 2.0, 0.023), 9).alias("dollars"))


@register("placement_histogram", px.sql(px.REFS, query="SELECT pack, floor(length / 10.0)::BIGINT AS bucket, count(*) AS n FROM refs GROUP BY 1, 2"))
def placement_histogram(spark, d):
    return st.placements(px.refs(spark, d), ["pack"], F.col("length"), 10.0)


@register("rank_dictionary", """SELECT doc_id, source, dense_rank() OVER (ORDER BY first)::INT AS code FROM (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY source) AS first FROM documents)""")
def rank_dictionary(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    # one row for each distinct value is ordered, not the column
    codes = docs.groupBy("source").agg(F.min("doc_id").alias("first")).withColumn("code", F.dense_rank().over(Window.orderBy("first")))
    return docs.join(codes, "source").select("doc_id", "source", "code")


# ---- similarity ----

_POST = """post AS (SELECT DISTINCT w AS feature, doc_id AS id FROM (SELECT doc_id, unnest(list_slice(string_split(text, ' '), 1, 200)) AS w FROM documents) WHERE length(w) >= 12)"""
_KEPT = """kept AS (SELECT feature, id FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY id DESC) AS rn FROM post) WHERE rn <= 64)"""


def _postings(spark, d):
    w = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.slice(F.split("text", " "), 1, 200)).alias("feature"))
    return w.filter(F.length("feature") >= 12).select("feature", "id").distinct()


@register("posting_cap", px.sql(_POST, _KEPT, query="SELECT feature, id FROM kept"))
def posting_cap(spark, d):
    return sim.newest(_postings(spark, d))


@register("topk_similar", px.sql(_POST, _KEPT, query="SELECT query, id, hits, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, id DESC) AS rank FROM (SELECT q.id AS query, k.id, count(*) AS hits FROM (SELECT * FROM post WHERE id % 50 = 0) q JOIN kept k USING (feature) WHERE q.id <> k.id GROUP BY 1, 2)) WHERE rank <= 8"))
def topk_similar(spark, d):
    p = _postings(spark, d)
    return sim.candidates(p.filter("id % 50 = 0"), sim.newest(p), 8)


@register("tombstoned_postings", px.sql(_POST, query="SELECT feature, id FROM post WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"))
def tombstoned_postings(spark, d):
    dead = table(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"))
    return sim.alive(_postings(spark, d), dead)


@register("sketch_overlap", """WITH s AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations WHERE text IS NOT NULL) SELECT a.conv_id, a.turn, round(len(list_filter(b.w, lambda x: list_contains(a.w, x))) / len(b.w), 6) AS overlap FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def sketch_overlap(spark, d):
    s = table(spark, d, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", F.split("text", " ").alias("w"))
    nxt = s.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return s.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(sim.overlap(F.col("w"), F.col("v")), 6).alias("overlap"))


@register("bottom_k", """SELECT doc_id, list_slice(list_sort(list_distinct(list_transform(string_split(text, ' '), lambda x: md5(x)))), 1, 8) AS sketch FROM documents""")
def bottom_k(spark, d):
    return table(spark, d, "documents").select("doc_id", sim.bottom_k(F.transform(F.split("text", " "), lambda x: F.md5(x)), 8).alias("sketch"))


@register("sketch_candidates")
def sketch_candidates(spark, d):
    """Bottom-k shingle sketches of all documents; every fiftieth document's nearest by shared features."""
    p = cut(ct.feature_map(table(spark, d, "documents"), "doc_id", "text"))  # read twice
    return sim.candidates(p.filter("id % 50 = 0"), sim.newest(p), 8)


# ---- planning ----


@register("independent_plan", px.sql(px.REFS, px.STORED, query="SELECT obj, scheme, cost FROM (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY cost, scheme) AS rn FROM (SELECT version_id AS obj, pack % 3 AS scheme, (max(ord) + coalesce(sum(length) FILTER (WHERE s.sha IS NULL), 0))::BIGINT AS cost FROM refs LEFT JOIN (SELECT sha FROM stored WHERE sha % 2 = 0) s USING (sha) GROUP BY 1, 2)) WHERE rn = 1"))
def independent_plan(spark, d):
    c = px.refs(spark, d).select(F.col("version_id").alias("obj"), (F.col("pack") % 3).alias("scheme"), F.col("ord").cast("long").alias("read"), F.col("sha").alias("component"), F.col("length").alias("size"))
    return pl.independent(c, px.stored(spark, d).filter("sha % 2 = 0").select(F.col("sha").alias("component")))


@register("marginal_cost", px.sql(px.REFS, px.STORED, query="SELECT obj, sum(size + 96)::BIGINT AS bytes FROM (SELECT DISTINCT version_id AS obj, sha, length AS size FROM refs) WHERE sha NOT IN (SELECT sha FROM stored WHERE sha % 2 = 0) GROUP BY obj"))
def marginal_cost(spark, d):
    w = px.refs(spark, d).select(F.col("version_id").alias("obj"), F.col("sha").alias("component"), F.col("length").alias("size"))
    return pl.marginal(w, px.stored(spark, d).filter("sha % 2 = 0").select(F.col("sha").alias("component")))


@register("releasable", px.sql(px.REFS, query="SELECT obj, sum(size + 96)::BIGINT AS bytes FROM (SELECT sha, length, min(version_id) AS obj, length AS size FROM refs GROUP BY sha, length HAVING count(*) = 1) GROUP BY obj"))
def releasable(spark, d):
    h = px.refs(spark, d).select(F.col("version_id").alias("obj"), F.struct("sha", "length").alias("component"), F.col("length").alias("size"))
    return pl.releasable(h)


@register("fold_tuning", px.sql(px.REFS, """r AS (SELECT version_id % 5 AS fold, pack % 7 AS setting, length::DOUBLE AS cost FROM refs)""", """p AS (SELECT fold, setting, sum(cost) AS s, count(*) AS n FROM r GROUP BY 1, 2)""", """o AS (SELECT *, (sum(s) OVER (PARTITION BY setting) - s) / (sum(n) OVER (PARTITION BY setting) - n) AS other FROM p)""", query="SELECT fold, setting, round(s / n, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY other, setting) AS rn FROM o) WHERE rn = 1"))
def fold_tuning(spark, d):
    r = px.refs(spark, d).select((F.col("version_id") % 5).alias("fold"), (F.col("pack") % 7).alias("setting"), F.col("length").cast("double").alias("cost"))
    return pl.leave_one_fold_out(r).select("fold", "setting", F.round("cost", 6).alias("cost"))


@register("churn_reasons", px.sql(px.OBJECTS, query="SELECT version_id AS id, CASE WHEN version_id % 7 = 0 THEN 'new' WHEN version_id % 7 = 1 THEN 'gone' WHEN version_id % 7 = 2 THEN 'moved' WHEN version_id % 7 = 3 THEN 'repacked' WHEN version_id % 7 = 4 THEN 'changed' ELSE 'same' END AS reason FROM objects"))
def churn_reasons(spark, d):
    o = px.objects(spark, d).select(F.col("version_id").alias("id"), F.lit("b").alias("base"), F.col("size").alias("offset"), F.col("sha").alias("payload"), F.col("etag").alias("raw"))
    m = F.col("id") % 7
    b = o.withColumns({"offset": F.when(m == 2, F.col("offset") + 1).otherwise(F.col("offset")), "payload": F.when(m.isin(3, 4), F.lit("p")).otherwise(F.col("payload")), "raw": F.when(m == 4, F.lit("r")).otherwise(F.col("raw"))})
    return pl.churn(o.filter(m != 0), b.filter(m != 1))


@register("admission_policies")
def admission_policies(spark, d):
    """A customer's orders are stages; line items are objects, whole or as one plain copy; all policies, exact plan included."""
    deals = int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = px.refs(spark, d).select("version_id", (F.col("sha") % 40).alias("id"), "length").repartition("version_id")
    r = r.groupBy("version_id").agg(F.collect_set(F.struct("id")).alias("ids"), F.sum("length").alias("total"))
    v = px.versions(spark, d).select("version_id", F.col("key").cast("string").alias("case"), (F.col("key") % 2 == 0).alias("hinted"), "ts")
    r = r.join(v, "version_id").repartition(deals, "case")
    order, same = Window.partitionBy("case").orderBy("ts", "version_id"), Window.partitionBy("case", "ts", "version_id")
    # an order that is listed twice is one stage of twice its size
    r = r.select("case", "hinted", "ids", F.sum("total").over(same).alias("total"), (F.dense_rank().over(order) - 1).alias("stage"), (F.rank().over(order) == F.row_number().over(order)).alias("once")).filter("once")
    items = F.array_sort(F.transform("ids", lambda x: F.struct(x["id"].cast("string").alias("id"), F.lit(100).cast("long").alias("size"))))
    rep = r.select("case", "hinted", "stage", "total", items.alias("objects"))
    whole = F.array(F.struct(F.concat(F.lit("plain-"), F.col("stage").cast("string")).alias("id"), (F.col("total") * 4).alias("size")))
    of = lambda rank, name, objects, sample: F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name"), objects.alias("objects"), sample.alias("sample"))
    both = F.array(of(0, pl.PLAIN, whole, F.array().cast("array<string>")), of(1, "shared", F.col("objects"), F.transform("objects", lambda x: x["id"])))
    return pl.admission(rep.select("case", "hinted", "stage", F.inline(both)), dealt=True)


@register("plane_fit", """WITH s AS (SELECT l_returnflag, count(*)::DOUBLE AS n, sum(l_quantity::DOUBLE) AS st, sum(l_linenumber::DOUBLE) AS sp, sum((l_suppkey % 10)::DOUBLE) AS sq, sum((l_linenumber * l_linenumber)::DOUBLE) AS pp, sum((l_linenumber * (l_suppkey % 10))::DOUBLE) AS pq,
 sum(((l_suppkey % 10) * (l_suppkey % 10))::DOUBLE) AS qq, sum(l_linenumber * l_quantity::DOUBLE) AS pt, sum((l_suppkey % 10) * l_quantity::DOUBLE) AS qt FROM lineitem GROUP BY 1),
m AS (SELECT *, n * pp - sp * sp AS a11, n * pq - sp * sq AS a12, n * qq - sq * sq AS a22, n * pt - sp * st AS b1, n * qt - sq * st AS b2 FROM s),
f AS (SELECT *, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS a, (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) AS b FROM m)
SELECT l_returnflag, round(a, 6) AS a, round(b, 6) AS b, round((st - a * sp - b * sq) / n, 6) AS c, n::BIGINT AS n FROM f""")
def plane_fit(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_linenumber", (F.col("l_suppkey") % 10).alias("s"))
    f = st.plane_fit(x, ["l_returnflag"], "l_quantity", "l_linenumber", "s")
    return f.select("l_returnflag", *[F.round(c, 6).alias(c) for c in "abc"], "n")


@register("robust_fit", """WITH x AS (SELECT l_suppkey AS k, l_quantity::DOUBLE AS u, (CASE WHEN l_suppkey % 4 = 0 THEN l_quantity WHEN l_suppkey % 4 = 1 THEN 3 * l_quantity + 7 WHEN l_suppkey % 4 = 2 THEN l_quantity + 40 ELSE l_quantity END + CASE WHEN l_linenumber = 7 THEN 1000 ELSE l_linenumber END)::DOUBLE AS v FROM lineitem),
s AS (SELECT k, count(*)::DOUBLE AS n, sum(u) AS su, sum(v) AS sv, sum(u * u) AS uu, sum(u * v) AS uv FROM x GROUP BY 1),
s2 AS (SELECT *, CASE WHEN n * uu - su * su > 0 THEN (n * uv - su * sv) / (n * uu - su * su) ELSE 1.0::DOUBLE END AS sl FROM s),
f AS (SELECT k, 0 AS r, 'identity' AS kind, 1.0::DOUBLE AS a, 0.0::DOUBLE AS c FROM s2 UNION ALL SELECT k, 1, 'affine', sl, (sv - sl * su) / n FROM s2 UNION ALL SELECT k, 2, 'scale', CASE WHEN uu > 0 THEN uv / uu ELSE 1.0 END, 0.0 FROM s2 UNION ALL SELECT k, 3, 'offset', 1.0, (sv - su) / n FROM s2),
b AS (SELECT k, r, kind, sum(CASE WHEN e > 0 THEN length(bin(e)) ELSE 0 END)::BIGINT AS bits FROM (SELECT f.k, r, kind, abs(round(v - a * u - c))::BIGINT AS e FROM f JOIN x ON f.k = x.k) GROUP BY 1, 2, 3)
SELECT k, kind, bits FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY bits, r) AS rn FROM b) WHERE rn = 1""")
def robust_fit(spark, d):
    q, s = F.col("l_quantity"), F.col("l_suppkey") % 4
    y = F.when(s == 1, 3 * q + 7).when(s == 2, q + 40).otherwise(q) + F.when(F.col("l_linenumber") == 7, 1000).otherwise(F.col("l_linenumber"))
    return st.robust_fit(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), q.alias("u"), y.alias("v")), ["k"], "v", "u").select("k", "kind", "bits")


@register("what_if_moved", px.sql(px.REFS, """c AS (SELECT version_id AS obj, sha AS component, length AS size FROM refs)""", """mv AS (SELECT obj, CASE WHEN component % 3 = 0 THEN component ELSE -component END AS component, size FROM c WHERE obj % 10 = 0)""",
"""n AS (SELECT component, max(size) + 96 AS now FROM c GROUP BY 1)""", """t AS (SELECT component, max(size) + 96 AS then_ FROM (SELECT * FROM c WHERE obj % 10 <> 0 UNION ALL SELECT * FROM mv) GROUP BY 1)""",
query="SELECT (coalesce(sum(then_), 0) - coalesce(sum(now), 0))::BIGINT AS live_delta, coalesce(sum(then_) FILTER (WHERE now IS NULL), 0)::BIGINT AS peak_extra FROM n FULL JOIN t USING (component)"))
def what_if_moved(spark, d):
    """Every tenth object held by other components for two thirds of its own."""
    c = px.refs(spark, d).select(F.col("version_id").alias("obj"), F.col("sha").alias("component"), F.col("length").alias("size"))
    moves = c.filter("obj % 10 = 0").withColumn("component", F.when(F.col("component") % 3 == 0, F.col("component")).otherwise(-F.col("component")))
    return pl.what_if(c, moves)


@register("deferred_units", """SELECT user_id AS "key", count(*) AS arrivals FROM events GROUP BY 1""")
def deferred_units(spark, d):
    """Every arrival is in one unit of its user's queue."""
    a = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("content"))
    return pl.deferred(a, 2, 5, 1).groupBy("key").agg(F.sum("arrivals").alias("arrivals"))
