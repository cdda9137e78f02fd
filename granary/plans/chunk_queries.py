"""Chunk references, transfers, diffs, journals and liveness over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.operators import chunks as ck
from granary.operators import liveness as lv
from granary.operators import retention as rt
from granary.plans import proxies as px
from granary.plans.registry import register, table

_PLACED = """placed AS (SELECT *, (coalesce(sum(length) OVER (PARTITION BY version_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "start",
(sum(length) OVER (PARTITION BY version_id ORDER BY ord))::BIGINT AS "end" FROM refs)"""


@register("chunk_offsets", px.sql(px.REFS, _PLACED, query="""SELECT version_id, ord, sha, length, "start", "end" FROM placed"""))
def chunk_offsets(spark, d):
    return ck.offsets(px.refs(spark, d)).select("version_id", "ord", "sha", "length", "start", "end")


@register("range_locate", px.sql(px.REFS, _PLACED, query="""SELECT version_id, ord, sha, greatest(30 - "start", 0)::BIGINT AS "from", (least(80 - "start", length) - greatest(30 - "start", 0))::BIGINT AS take FROM placed WHERE "start" <= 79 AND "end" > 30 AND length > 0"""))
def range_locate(spark, d):
    placed = ck.offsets(px.refs(spark, d))
    ranges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.lit(30).cast("long").alias("lo"), F.lit(79).cast("long").alias("hi")).distinct()
    return ck.locate(placed, ranges).select("version_id", "ord", "sha", "from", "take")


@register("contiguous_runs", px.sql(px.REFS, """pl AS (SELECT pack, sha AS at_, sha + 1 AS upto FROM (SELECT DISTINCT pack, sha FROM refs))""", """n AS (SELECT *, (coalesce(max(upto) OVER (PARTITION BY pack ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) < at_)::INT AS nw FROM pl)""", """r AS (SELECT *, sum(nw) OVER (PARTITION BY pack ORDER BY at_) AS run FROM n)""", query="SELECT pack, min(at_) AS run_start, max(upto) AS run_end, count(*) AS n FROM r GROUP BY pack, run"))
def contiguous_runs(spark, d):
    placed = px.refs(spark, d).select("pack", F.col("sha").alias("at"), (F.col("sha") + 1).alias("upto")).distinct()
    return ck.contiguous_runs(placed, "pack", "at", "upto")


@register("first_ref_order", px.sql(px.REFS, query="SELECT sha, version_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY version_id, ord) AS rn FROM refs) WHERE rn = 1"))
def first_ref_order(spark, d):
    return ck.first_reference_order(px.refs(spark, d), ["version_id", "ord"]).select("sha", "first.*")


@register("new_chunk_cost", px.sql(px.REFS, query="SELECT version_id, (coalesce(sum(length) FILTER (WHERE rn = 1), 0))::BIGINT AS new, (coalesce(sum(length) FILTER (WHERE rn > 1), 0))::BIGINT AS reused FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY version_id, ord) AS rn FROM refs) GROUP BY version_id"))
def new_chunk_cost(spark, d):
    return ck.new_bytes(px.refs(spark, d), "version_id", ["ord"])


@register("negotiate_missing", px.sql(px.REFS, px.STORED, query="SELECT sha, min(version_id * 1000 + ord) AS first_seen FROM refs WHERE sha NOT IN (SELECT sha FROM stored WHERE sha % 3 = 0) GROUP BY sha"))
def negotiate_missing(spark, d):
    wanted = px.refs(spark, d).select("sha", (F.col("version_id") * 1000 + F.col("ord")).alias("pos"))
    return ck.missing(wanted, px.stored(spark, d).filter("sha % 3 = 0"))


def _two(spark, d):
    r = px.refs(spark, d)
    return r.filter("version_id % 2 = 0"), r.filter("version_id % 2 = 1")


@register("base_refs", px.sql(px.REFS, query="SELECT DISTINCT sha FROM refs WHERE version_id % 2 = 0 INTERSECT SELECT DISTINCT sha FROM refs WHERE version_id % 2 = 1"))
def base_refs(spark, d):
    return ck.base_references(*_two(spark, d))


@register("payload_set", px.sql(px.REFS, query="SELECT DISTINCT sha FROM refs WHERE version_id % 7 = 0 EXCEPT SELECT DISTINCT sha FROM refs WHERE version_id % 7 = 1"))
def payload_set(spark, d):
    r = px.refs(spark, d)
    return ck.payload_set(r.filter("version_id % 7 = 0"), r.filter("version_id % 7 = 1"))


@register("object_diff", px.sql(px.REFS, """a AS (SELECT sha, max(length) AS l FROM refs WHERE version_id % 5 = 0 GROUP BY sha)""", """b AS (SELECT sha, max(length) AS r FROM refs WHERE version_id % 5 = 1 GROUP BY sha)""", query="""SELECT count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS n_shared, coalesce(sum(l) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL), 0)::BIGINT AS bytes_shared,
count(*) FILTER (WHERE r IS NULL) AS n_left, coalesce(sum(l) FILTER (WHERE r IS NULL), 0)::BIGINT AS bytes_left, count(*) FILTER (WHERE l IS NULL) AS n_right, coalesce(sum(r) FILTER (WHERE l IS NULL), 0)::BIGINT AS bytes_right FROM a FULL JOIN b USING (sha)"""))
def object_diff(spark, d):
    r = px.refs(spark, d)
    return ck.object_diff(r.filter("version_id % 5 = 0"), r.filter("version_id % 5 = 1"))


@register("seq_chunks_multiset", px.sql(px.REFS, query="SELECT sha, length FROM refs WHERE version_id % 5 = 0 EXCEPT ALL SELECT sha, length FROM refs WHERE version_id % 5 = 1"))
def seq_chunks_multiset(spark, d):
    r = px.refs(spark, d)
    return ck.sequence_multiset_difference(r.filter("version_id % 5 = 0"), r.filter("version_id % 5 = 1"), ["sha", "length"])


@register("chunk_multiset_common", px.sql(px.REFS, query="SELECT sha, length FROM refs WHERE version_id % 5 = 0 INTERSECT ALL SELECT sha, length FROM refs WHERE version_id % 5 = 1"))
def chunk_multiset_common(spark, d):
    r = px.refs(spark, d).select("version_id", "sha", "length")
    return r.filter("version_id % 5 = 0").drop("version_id").intersectAll(r.filter("version_id % 5 = 1").drop("version_id"))


@register("length_conflicts", px.sql(px.REFS, query="SELECT sha, count(DISTINCT length) AS n_lengths, min(length) AS least, max(length) AS most FROM refs GROUP BY sha HAVING count(DISTINCT length) > 1"))
def length_conflicts(spark, d):
    return ck.length_conflicts(px.refs(spark, d))


@register("transfer_batches", px.sql(px.REFS, query="SELECT pack, batch, count(*) AS n, sum(length)::BIGINT AS bytes FROM (SELECT pack, length, greatest(floor(n / 64), floor(size / 2048))::BIGINT AS batch FROM (SELECT pack, length, count(*) OVER w AS n, coalesce(sum(length) OVER w, 0) AS size FROM refs WINDOW w AS (PARTITION BY pack ORDER BY version_id, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) GROUP BY pack, batch"))
def transfer_batches(spark, d):
    b = ck.batches(px.refs(spark, d), "pack", ["version_id", "ord"], 2048, 64)
    return b.groupBy("pack", "batch").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


# ---- versions ----


@register("history_keep_last", px.sql(px.VERSIONS, query="""SELECT "key", version_id, rank::INT AS rank, rank > 3 AS selected FROM (SELECT *, row_number() OVER (PARTITION BY "key" ORDER BY ts DESC, version_id DESC) AS rank FROM versions)"""))
def history_keep_last(spark, d):
    return rt.keep_last(px.versions(spark, d), 3, order=("ts", "version_id")).select("key", "version_id", "rank", "selected")


@register("prune_totals", px.sql(px.VERSIONS, query="""SELECT count(*) FILTER (WHERE rank > 3) AS selected, count(*) FILTER (WHERE rank <= 3) AS retained, (sum(size) FILTER (WHERE rank > 3))::BIGINT AS selected_bytes FROM (SELECT *, row_number() OVER (PARTITION BY "key" ORDER BY ts DESC, version_id DESC) AS rank FROM versions)"""))
def prune_totals(spark, d):
    k = rt.keep_last(px.versions(spark, d), 3, order=("ts", "version_id"))
    return k.agg(F.count(F.when(F.col("selected"), 1)).alias("selected"), F.count(F.when(~F.col("selected"), 1)).alias("retained"), F.sum(F.when(F.col("selected"), F.col("size"))).alias("selected_bytes"))


@register("latest_version", px.sql(px.VERSIONS, query="""SELECT "key", arg_max(version_id, (ts, version_id)) AS version_id, arg_max(size, (ts, version_id)) AS size FROM versions GROUP BY "key" """))
def latest_version(spark, d):
    return rt.latest(px.versions(spark, d), ["version_id", "size"], order=("ts", "version_id"))


@register("asof_restore", px.sql(px.VERSIONS, query="""SELECT "key", arg_max(version_id, (ts, version_id)) AS version_id, arg_max(size, (ts, version_id)) AS size FROM versions WHERE ts <= TIMESTAMP '1996-06-30' GROUP BY "key" """))
def asof_restore(spark, d):
    return rt.as_of(px.versions(spark, d), F.lit("1996-06-30").cast("timestamp"), ["version_id", "size"], order=("ts", "version_id"))


@register("asof_join", px.sql(px.VERSIONS, """p AS (SELECT event_id, user_id AS "key", TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (event_id % 900) AS "at" FROM events)""", query="""SELECT event_id, arg_max(v.version_id, (v.ts, v.version_id)) AS asof_version_id FROM p LEFT JOIN versions v ON v."key" = p."key" AND v.ts <= p."at" GROUP BY event_id"""))
def asof_join(spark, d):
    points = table(spark, d, "events").select("event_id", F.col("user_id").alias("key"), (F.lit("1995-01-01").cast("timestamp") + F.make_dt_interval((F.col("event_id") % 900).cast("int"))).alias("at"))
    return rt.as_of_join(points, px.versions(spark, d), "key", "at", "ts", "version_id", "version_id").select("event_id", "asof_version_id")


@register("ttl_prune", px.sql(px.VERSIONS, query="""SELECT "key", version_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "key" ORDER BY ts DESC, version_id DESC) AS rank FROM versions) WHERE rank > 1 AND ts < TIMESTAMP '1998-01-01' - INTERVAL 400 DAY"""))
def ttl_prune(spark, d):
    return rt.expired(px.versions(spark, d), F.lit("1998-01-01").cast("timestamp"), 400, order=("ts", "version_id")).select("key", "version_id", "rank")


@register("retain_last_three", px.sql(px.VERSIONS, query="""SELECT "key", version_id, stage::INT AS stage, CASE WHEN stage % 4 <> 0 THEN gone END AS deleted_by FROM (SELECT *, row_number() OVER w - 1 AS stage, lead(version_id, 3) OVER w AS gone FROM versions WINDOW w AS (PARTITION BY "key" ORDER BY ts, version_id))"""))
def retain_last_three(spark, d):
    return rt.last_three(px.versions(spark, d), snapshots=True, order=("ts", "version_id")).select("key", "version_id", "stage", "deleted_by")


# ---- journal ----

_JOURNAL = """j AS (SELECT event_id AS seq, user_id AS "key", event_type AS type, value, ts FROM events)"""


def journal(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.col("event_type").alias("type"), "value", "ts")


@register("journal_fold", px.sql(_JOURNAL, query="""SELECT "key", seq, type, value FROM (SELECT *, row_number() OVER (PARTITION BY "key" ORDER BY seq DESC) AS rn FROM j) WHERE rn = 1 AND type <> 'error'"""))
def journal_fold(spark, d):
    return rt.latest(journal(spark, d), ["seq", "type", "value"]).filter("type <> 'error'")


@register("journal_type_counts", px.sql(_JOURNAL, query="SELECT type, count(*) AS n, min(seq) AS first, max(seq) AS last FROM j GROUP BY type"))
def journal_type_counts(spark, d):
    return journal(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


@register("seq_gaps", px.sql(_JOURNAL, query="""SELECT "key", seq, expected FROM (SELECT *, lag(seq) OVER (PARTITION BY "key" ORDER BY seq) + 1 AS expected FROM j) WHERE expected IS NOT NULL AND seq <> expected"""))
def seq_gaps(spark, d):
    return ck.sequence_gaps(journal(spark, d), ["key"]).select("key", "seq", "expected")


@register("tick_windows", """SELECT CAST(DATE '1970-01-01' + (CAST(floor(epoch(ts) / 604800) AS INT) * 7) AS TIMESTAMP) AS tick, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def tick_windows(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "7 days"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("tick"), "event_type", "n")


# ---- liveness ----


def live(spark, d):
    return px.refs(spark, d).join(px.live_versions(spark, d), "version_id", "left_semi").select("sha").distinct()


_LIVE_SHA = """live AS (SELECT DISTINCT sha FROM refs WHERE version_id IN (SELECT version_id FROM live_versions))"""


def _roots(spark, d):
    v = rt.keep_last(px.versions(spark, d), 1, order=("ts", "version_id"))
    snap = px.versions(spark, d).filter("version_id % 11 = 0")
    return lv.roots({"current": v.filter("rank = 1"), "history": v.filter("rank > 1"), "snapshot": snap})


_ROOTS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY "key" ORDER BY ts DESC, version_id DESC) AS rank FROM versions),
roots AS (SELECT 'current' AS scope, version_id FROM ranked WHERE rank = 1 UNION ALL SELECT 'history', version_id FROM ranked WHERE rank > 1 UNION ALL SELECT 'snapshot', version_id FROM versions WHERE version_id % 11 = 0)"""


@register("roots_union", px.sql(px.VERSIONS, _ROOTS, query="SELECT scope, count(*) AS n, count(DISTINCT version_id) AS versions FROM roots GROUP BY scope"))
def roots_union(spark, d):
    return _roots(spark, d).groupBy("scope").agg(F.count("*").alias("n"), F.count_distinct("version_id").alias("versions"))


@register("reachability", px.sql(px.VERSIONS, px.REFS, _ROOTS, query="SELECT sha, count(*) AS n_roots, string_agg(DISTINCT scope, ',' ORDER BY scope) AS scopes FROM (SELECT DISTINCT scope, version_id FROM roots) JOIN (SELECT DISTINCT version_id, sha FROM refs) USING (version_id) GROUP BY sha"))
def reachability(spark, d):
    return lv.reachability(_roots(spark, d), px.refs(spark, d))


@register("gc_candidates", px.sql(px.REFS, px.STORED, px.LIVE, """lv AS (SELECT DISTINCT sha FROM refs WHERE version_id IN (SELECT version_id FROM live_versions WHERE version_id % 3 = 0))""", query="SELECT sha, logical FROM stored WHERE sha NOT IN (SELECT sha FROM lv)"))
def gc_candidates(spark, d):
    alive = px.refs(spark, d).join(px.live_versions(spark, d).filter("version_id % 3 = 0"), "version_id", "left_semi").select("sha").distinct()
    return lv.garbage(px.stored(spark, d), alive)


@register("gc_gated", px.sql(px.REFS, px.STORED, px.LIVE, _LIVE_SHA, query="SELECT sha, logical FROM stored WHERE sha NOT IN (SELECT sha FROM live) AND NOT EXISTS (SELECT 1 FROM live WHERE sha NOT IN (SELECT sha FROM stored))"))
def gc_gated(spark, d):
    alive, have = live(spark, d), px.stored(spark, d)
    return lv.collectable(have, alive, lv.missing(alive, have))


@register("missing_chunks", px.sql(px.REFS, px.STORED, px.LIVE, _LIVE_SHA, query="SELECT sha FROM live WHERE sha NOT IN (SELECT sha FROM stored WHERE sha % 10 <> 0)"))
def missing_chunks(spark, d):
    return lv.missing(live(spark, d), px.stored(spark, d).filter("sha % 10 <> 0"))


@register("verify_issues", px.sql(px.REFS, px.STORED, query="SELECT CASE WHEN logical IS NULL THEN 'missing' ELSE 'invalid' END AS kind, sha FROM (SELECT sha, min(length) AS least, max(length) AS most FROM refs GROUP BY sha) LEFT JOIN (SELECT * FROM stored WHERE sha % 10 <> 0) USING (sha) WHERE logical IS NULL OR least <> logical OR most <> logical"))
def verify_issues(spark, d):
    return lv.verify(px.refs(spark, d), px.stored(spark, d).filter("sha % 10 <> 0"))


@register("verify_deep", px.sql(px.OBJECTS, query="SELECT 'corrupt' AS kind, sha FROM (SELECT sha, min(version_id) AS v FROM objects GROUP BY sha) WHERE v % 9 = 0"))
def verify_deep(spark, d):
    o = table(spark, d, "documents").select(F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("length"), "text", "doc_id")
    have = o.groupBy("sha").agg(F.max("length").alias("logical"), F.min("doc_id").alias("v"), F.first("text").alias("text"))
    # every ninth payload differs from its digest, at the same length
    have = have.select("sha", "logical", F.when(F.col("v") % 9 == 0, F.concat(F.lit("\x00"), F.expr("substring(text, 2)"))).otherwise(F.col("text")).alias("payload"))
    return lv.verify(o.select("sha", "length"), have, deep=True)


@register("manifest_validity", px.sql(px.REFS, query="SELECT version_id, CASE WHEN version_id % 13 = 0 THEN 'digest' WHEN version_id % 11 = 0 THEN 'total' END AS issue FROM (SELECT DISTINCT version_id FROM refs) WHERE version_id % 13 = 0 OR version_id % 11 = 0"))
def manifest_validity(spark, d):
    r = px.refs(spark, d)
    m = r.groupBy("version_id").agg(F.sum("length").alias("total"), F.array_sort(F.collect_list(F.struct("ord", F.sha2(F.col("sha").cast("string"), 256).alias("sha"), "length"))).alias("c"))
    v = F.col("version_id")
    m = m.select("version_id", F.when(v % 13 == 0, "xyz").otherwise(F.sha2(v.cast("string"), 256)).alias("sha"), F.when(v % 11 == 0, F.col("total") + 1).otherwise(F.col("total")).alias("size"), F.transform("c", lambda x: F.struct(x["sha"].alias("sha"), x["length"].alias("length"))).alias("chunks"))
    return lv.manifest_issues(m)


_UTIL = """rec AS (SELECT DISTINCT pack, sha, logical AS stored FROM refs JOIN stored USING (sha)), lv AS (SELECT DISTINCT sha FROM refs WHERE version_id IN (SELECT version_id FROM live_versions WHERE version_id % 3 = 0)),
u AS (SELECT pack, count(lv.sha) AS live_n, count(*) - count(lv.sha) AS dead_n, coalesce(sum(stored) FILTER (WHERE lv.sha IS NOT NULL), 0)::BIGINT AS live_bytes, coalesce(sum(stored) FILTER (WHERE lv.sha IS NULL), 0)::BIGINT AS dead_bytes FROM rec LEFT JOIN lv USING (sha) GROUP BY pack)"""


def _utilisation(spark, d):
    r = px.refs(spark, d)
    records = r.select("pack", "sha").distinct().join(px.stored(spark, d), "sha").select("pack", "sha", F.col("logical").alias("stored"))
    alive = r.join(px.live_versions(spark, d).filter("version_id % 3 = 0"), "version_id", "left_semi").select("sha").distinct()
    return lv.pack_utilisation(records, alive)


@register("pack_utilisation", px.sql(px.REFS, px.STORED, px.LIVE, _UTIL, query="SELECT *, live_n = 0 AS fully_dead, live_n > 0 AND dead_n > 0 AS partly_dead FROM u"))
def pack_utilisation(spark, d):
    return _utilisation(spark, d)


@register("repack_select", px.sql(px.REFS, px.STORED, px.LIVE, _UTIL, query="SELECT pack, live_bytes, dead_bytes FROM u WHERE live_n > 0 AND 100 * live_bytes < 50 * (live_bytes + dead_bytes)"))
def repack_select(spark, d):
    return lv.repack(_utilisation(spark, d)).select("pack", "live_bytes", "dead_bytes")


_TARGETS = """rt AS (SELECT version_id, CASE scope WHEN 'current' THEN 0 WHEN 'snapshot' THEN 1 ELSE 2 END AS rank FROM roots),
tg AS (SELECT sha, min(rank) AS rank, min(rank) < max(rank) AS promoted FROM rt JOIN (SELECT DISTINCT version_id, sha FROM refs) USING (version_id) GROUP BY sha)"""


def _targets(spark, d):
    tiers = _roots(spark, d).select("version_id", F.when(F.col("scope") == "current", 0).when(F.col("scope") == "snapshot", 1).otherwise(2).alias("rank"))
    return lv.target_tiers(tiers, px.refs(spark, d))


@register("tier_targets", px.sql(px.VERSIONS, px.REFS, _ROOTS, _TARGETS, query="SELECT sha, rank, promoted FROM tg"))
def tier_targets(spark, d):
    return _targets(spark, d)


@register("tier_moves", px.sql(px.VERSIONS, px.REFS, px.STORED, px.PACKS, _ROOTS, _TARGETS, """h AS (SELECT sha, min(pack) AS pack FROM refs GROUP BY sha), pl AS (SELECT h.sha, pack, now, logical AS stored, rank AS target FROM h JOIN stored USING (sha) JOIN packs USING (pack) JOIN tg USING (sha))""", query="SELECT pack, count(*) AS n, count(*) FILTER (WHERE target <> now) AS misplaced, coalesce(sum(stored) FILTER (WHERE target <> now), 0)::BIGINT AS misplaced_bytes, CASE WHEN count(*) FILTER (WHERE target <> now) = 0 THEN 'compliant' WHEN count(*) FILTER (WHERE target <> now) = count(*) AND count(DISTINCT target) = 1 THEN 'move' ELSE 'rewrite' END AS action FROM pl GROUP BY pack"))
def tier_moves(spark, d):
    home = px.refs(spark, d).groupBy("sha").agg(F.min("pack").alias("pack"))
    placed = home.join(px.stored(spark, d), "sha").join(px.packs(spark, d), "pack").select("sha", "pack", "now", F.col("logical").alias("stored"))
    return lv.rebalance(_targets(spark, d), placed)


@register("tier_status", px.sql(px.REFS, px.STORED, px.PACKS, """h AS (SELECT sha, min(pack) AS pack FROM refs GROUP BY sha)""", query="SELECT now, count(DISTINCT pack) AS packs, count(*) AS chunks, sum(logical)::BIGINT AS bytes FROM h JOIN stored USING (sha) JOIN packs USING (pack) GROUP BY now"))
def tier_status(spark, d):
    home = px.refs(spark, d).groupBy("sha").agg(F.min("pack").alias("pack"))
    return home.join(px.stored(spark, d), "sha").join(px.packs(spark, d), "pack").groupBy("now").agg(F.count_distinct("pack").alias("packs"), F.count("*").alias("chunks"), F.sum("logical").alias("bytes"))


@register("group_reclaimable", px.sql(px.REFS, """o AS (SELECT sha, length, o_custkey % 50 AS grp FROM refs JOIN orders ON version_id = o_orderkey)""", query="SELECT grp, sum(length)::BIGINT AS bytes, count(*) AS chunks FROM (SELECT sha, max(length) AS length, min(grp) AS grp FROM o GROUP BY sha HAVING min(grp) = max(grp)) GROUP BY grp"))
def group_reclaimable(spark, d):
    r = px.refs(spark, d).select(F.col("version_id").alias("owner"), "sha", "length")
    members = table(spark, d, "orders").select(F.col("o_orderkey").alias("owner"), (F.col("o_custkey") % 50).alias("grp"))
    return lv.group_reclaimable(r.join(members, "owner", "left_semi"), members)


@register("exclusive_bytes", px.sql(px.REFS, query="SELECT owner, sum(length)::BIGINT AS bytes, count(*) AS chunks FROM (SELECT sha, max(length) AS length, min(pack) AS owner FROM refs GROUP BY sha HAVING min(pack) = max(pack)) GROUP BY owner"))
def exclusive_bytes(spark, d):
    return lv.exclusive_bytes(px.refs(spark, d).select(F.col("pack").alias("owner"), "sha", "length"))


@register("inspect_shared", px.sql(px.REFS, """i AS (SELECT sha, max(length) AS length FROM refs WHERE version_id % 20 = 0 GROUP BY sha)""", """x AS (SELECT DISTINCT sha FROM refs WHERE version_id % 20 <> 0)""", query="SELECT count(*) AS chunks, sum(length)::BIGINT AS bytes, count(x.sha) AS shared_chunks, coalesce(sum(length) FILTER (WHERE x.sha IS NOT NULL), 0)::BIGINT AS shared_bytes FROM i LEFT JOIN x USING (sha)"))
def inspect_shared(spark, d):
    r = px.refs(spark, d).select(F.col("version_id").alias("owner"), "sha", "length")
    return lv.shared_bytes(r, r.filter("owner % 20 = 0"))


@register("preferred_copy", px.sql(px.REFS, px.PACKS, query="SELECT sha, now AS rank, pack FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY now, pack) AS rn FROM (SELECT DISTINCT sha, pack FROM refs) JOIN packs USING (pack) WHERE (sha + pack) % 4 <> 0) WHERE rn = 1"))
def preferred_copy(spark, d):
    c = px.refs(spark, d).select("sha", "pack").distinct().join(px.packs(spark, d), "pack")
    return lv.preferred_copy(c.select("sha", F.col("now").alias("rank"), "pack", ((F.col("sha") + F.col("pack")) % 4 != 0).alias("valid")))


@register("repair_plan", px.sql(px.REFS, px.STORED, px.LIVE, _LIVE_SHA, query="SELECT sha, sha % 2 = 0 AS from_peer FROM live WHERE sha NOT IN (SELECT sha FROM stored WHERE sha % 10 <> 0)"))
def repair_plan(spark, d):
    lost = lv.missing(live(spark, d), px.stored(spark, d).filter("sha % 10 <> 0"))
    peer = px.stored(spark, d).filter("sha % 2 = 0").select("sha", F.lit(True).alias("p"))
    return lost.join(peer, "sha", "left").select("sha", F.coalesce("p", F.lit(False)).alias("from_peer"))


@register("replicate_estimate", px.sql(px.REFS, px.STORED, query="SELECT count(*) AS chunks, sum(logical)::BIGINT AS bytes FROM (SELECT DISTINCT sha FROM refs WHERE version_id % 4 = 0 AND sha % 3 <> 0) JOIN stored USING (sha)"))
def replicate_estimate(spark, d):
    wanted = px.refs(spark, d).filter("version_id % 4 = 0").select("sha", F.lit(0).alias("pos"))
    return ck.missing(wanted, px.stored(spark, d).filter("sha % 3 = 0")).join(px.stored(spark, d), "sha").agg(F.count("*").alias("chunks"), F.sum("logical").alias("bytes"))


@register("root_revalidation", px.sql(px.OBJECTS, query="SELECT version_id, sha = CASE WHEN version_id % 17 = 0 THEN md5(sha) ELSE sha END AS ok FROM objects"))
def root_revalidation(spark, d):
    o = px.objects(spark, d)
    logged = o.select("version_id", F.when(F.col("version_id") % 17 == 0, F.md5("sha")).otherwise(F.col("sha")).alias("logged"))
    return o.join(logged, "version_id").select("version_id", (F.col("sha") == F.col("logged")).alias("ok"))


@register("page_accounting", px.sql(px.REFS, _PLACED, query="""SELECT version_id, count(DISTINCT p)::BIGINT AS pages FROM (SELECT version_id, unnest(range("start" // 16, ("end" - 1) // 16 + 1)) AS p FROM placed WHERE length > 0) GROUP BY 1"""))
def page_accounting(spark, d):
    p = ck.offsets(px.refs(spark, d)).filter("length > 0")
    return p.select("version_id", F.explode(F.sequence(F.floor(F.col("start") / 16), F.floor((F.col("end") - 1) / 16))).alias("p")).groupBy("version_id").agg(F.count_distinct("p").alias("pages"))


@register("gap_segments", px.sql(px.REFS, """pl AS (SELECT pack, sha AS at_, sha + 1 AS upto FROM (SELECT DISTINCT pack, sha FROM refs))""", query="SELECT pack, prev AS gap_start, at_ AS gap_end FROM (SELECT *, lag(upto) OVER (PARTITION BY pack ORDER BY at_) AS prev FROM pl) WHERE prev < at_"))
def gap_segments(spark, d):
    placed = px.refs(spark, d).select("pack", F.col("sha").alias("at"), (F.col("sha") + 1).alias("upto")).distinct()
    w = Window.partitionBy("pack").orderBy("at")
    return placed.withColumn("prev", F.lag("upto").over(w)).filter("prev < at").select("pack", F.col("prev").alias("gap_start"), F.col("at").alias("gap_end"))
