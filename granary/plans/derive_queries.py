"""Reassembly, derivations, diffs of states, bases, totals and replay over the driver tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from granary.functions import content as ct
from granary.operators import chunks as ck
from granary.operators import derive as dv
from granary.operators import similarity as sim
from granary.operators import stats as st
from granary.operators.storage import cut
from granary.plans import proxies as px
from granary.plans.registry import register, table

SMALL = {"least": 128, "target": 512, "most": 2048, "small": 255, "large": 127}


@register("reassemble_prove", "SELECT doc_id AS version_id, doc_id % 40 <> 0 AS exact FROM documents WHERE text <> ''")
def reassemble_prove(spark, d):
    """Each text from its pieces; one in forty has a piece that isn't stored."""
    docs = table(spark, d, "documents").filter("text <> ''")
    at = F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / 200).cast("int"))
    parts = docs.select(F.col("doc_id").alias("version_id"), F.posexplode(F.transform(at, lambda i: F.substring("text", i * 200 + 1, F.lit(200)))).alias("ord", "payload"))
    lost = (F.col("version_id") % 40 == 0) & (F.col("ord") == 0)
    # the lost piece's address is no digest, so no equal piece, of this text or another, stands in for it
    parts = parts.withColumn("sha", F.when(lost, F.concat(F.lit("lost/"), F.col("version_id").cast("string"))).otherwise(F.sha2("payload", 256)))
    stored = parts.filter(~lost).groupBy("sha").agg(F.first("payload").alias("payload"))
    want = docs.select(F.col("doc_id").alias("version_id"), F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size"))
    return dv.proved(dv.reassembled(parts.select("version_id", "ord", "sha"), stored), want)


@register("gather_scatter", """SELECT vec_id, embedding[3] AS g0, embedding[1] AS g1, embedding[1] AS s0, embedding[2] AS s2, 2 AS nulls, len(embedding)::BIGINT + 1 AS total FROM embeddings""")
def gather_scatter(spark, d):
    e = table(spark, d, "embeddings")
    index, valid = F.array(F.lit(2), F.lit(0), F.lit(1)), F.array(F.lit(True), F.lit(False), F.lit(True), F.lit(False))
    e = e.withColumns({"g": dv.gather(F.col("embedding"), index), "s": dv.scatter(F.col("embedding"), valid), "o": dv.offsets_of(F.array(F.size("embedding").cast("long"), F.lit(1).cast("long")))})
    return e.select("vec_id", F.col("g")[0].alias("g0"), F.col("g")[1].alias("g1"), F.col("s")[0].alias("s0"), F.col("s")[2].alias("s2"), F.size(F.filter("s", lambda x: x.isNull())).alias("nulls"), F.col("o")[2].alias("total"))


@register("byte_swap", """SELECT doc_id, upper(substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2)) AS swapped FROM (SELECT doc_id, md5(text) AS h FROM documents)""")
def byte_swap(spark, d):
    return table(spark, d, "documents").select("doc_id", F.hex(dv.swapped(F.unhex(F.substring(F.md5("text"), 1, 16)), 4)).alias("swapped"))


@register("slice_concat", """SELECT doc_id, substr(text, 6, 10) || substr(text, 1, 5) AS derived FROM documents""")
def slice_concat(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.substring("text", 6, 10), F.substring("text", 1, 5)).alias("derived"))


@register("text_codecs", """SELECT doc_id, hex(encode(lang)) AS h, base64(encode(lang)) AS b, sha1(text) AS s FROM documents""")
def text_codecs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.hex("lang").alias("h"), F.base64(F.encode("lang", "UTF-8")).alias("b"), F.sha1("text").alias("s"))


@register("popcounts", """SELECT event_id, bit_count(event_id)::INT AS n, bit_count(event_id & 255)::INT AS low FROM events""")
def popcounts(spark, d):
    return table(spark, d, "events").select("event_id", F.bit_count("event_id").alias("n"), F.bit_count(F.col("event_id").bitwiseAND(F.lit(255))).alias("low"))


@register("state_diff", px.sql(px.OBJECTS, query="SELECT \"key\" AS path, CASE version_id % 9 WHEN 0 THEN 'missing' WHEN 1 THEN 'extra' WHEN 2 THEN 'type' WHEN 3 THEN 'content' ELSE 'mode' END AS change FROM objects WHERE version_id % 9 <= 4"))
def state_diff(spark, d):
    o = px.objects(spark, d).select(F.col("key").alias("path"), F.lit("file").alias("kind"), "size", "sha", F.lit(420).alias("mode"), (F.col("version_id") % 9).alias("m"))
    m = F.col("m")
    have = o.filter(m != 0).withColumns({"kind": F.when(m == 2, "link").otherwise(F.col("kind")), "sha": F.when(m.isin(2, 3), "x").otherwise(F.col("sha")), "mode": F.when(m == 4, 493).otherwise(F.col("mode"))})
    return dv.state_diff(o.filter(m != 1), have)


@register("ambiguous_keys", "SELECT l_suppkey AS native_key, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1")
def ambiguous_keys(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("native_key"), F.col("l_partkey").alias("component"))
    return dv.ambiguous(i)


@register("index_lookup", "SELECT o_custkey AS native_key, c_nationkey AS component FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0")
def index_lookup(spark, d):
    index = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("native_key"), F.col("c_nationkey").alias("component"))
    return dv.resolved(index, table(spark, d, "orders").select(F.col("o_custkey").alias("native_key")))


_PLACE = """t AS (SELECT doc_id AS id, doc_id AS ident, sha256(text) AS sha, sha256(list_aggregate(list_sort(string_split(text, ' ')), 'string_agg', ' ')) AS signature FROM documents WHERE doc_id % 2 = 1 OR doc_id % 10 = 0), s AS (SELECT doc_id AS id, doc_id AS ident, sha256(text) AS sha, sha256(list_aggregate(list_sort(string_split(text, ' ')), 'string_agg', ' ')) AS signature FROM documents WHERE doc_id % 2 = 0)"""


@register("placement_ladder", px.sql(_PLACE, query="SELECT id, CASE WHEN a IS NOT NULL THEN 'identity' WHEN b IS NOT NULL THEN 'bytes' WHEN c IS NOT NULL THEN 'layout' ELSE 'raw' END AS how, coalesce(a, b, c) AS source FROM (SELECT t.id, (SELECT min(s.id) FROM s WHERE s.ident = t.ident) AS a, (SELECT min(s.id) FROM s WHERE s.sha = t.sha) AS b, (SELECT min(s.id) FROM s WHERE s.signature = t.signature) AS c FROM t)"))
def placement_ladder(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ident"), F.sha2("text", 256).alias("sha"), F.sha2(F.array_join(F.array_sort(F.split("text", " ")), " "), 256).alias("signature"))
    return dv.placed(x.filter("id % 2 = 1 OR id % 10 = 0"), x.filter("id % 2 = 0"))


@register("delta_bases")
def delta_bases(spark, d):
    """For every fiftieth document the similar one whose delta adds least, over the index's candidates."""
    docs = table(spark, d, "documents")
    p = cut(ct.feature_map(docs, "doc_id", "text"))  # read twice
    c = sim.candidates(p.filter("id % 50 = 0"), sim.newest(p), 4)
    bodies = docs.select("doc_id", "text")
    pairs = c.join(bodies.withColumnsRenamed({"doc_id": "query", "text": "body"}), "query").join(bodies.withColumnsRenamed({"doc_id": "id", "text": "base_body"}), "id")
    return dv.best_base(pairs.select(F.col("query").alias("doc_id"), F.col("id").alias("base"), "base_body", "body"), "doc_id")


@register("delta_chain_depth", "SELECT p_partkey AS id, (p_partkey % 6)::INT AS depth FROM part")
def delta_chain_depth(spark, d):
    n = F.col("p_partkey")
    return dv.chain_bases(table(spark, d, "part").select(n.alias("obj"), F.when(n % 6 != 0, n - 1).alias("base")), "obj")


_HOME = """h AS (SELECT sha, min(pack) AS pack FROM refs GROUP BY sha), st AS (SELECT h.sha, pack, logical AS bytes FROM h JOIN stored USING (sha)), nd AS (SELECT DISTINCT sha FROM refs WHERE version_id % 40 = 0),
p AS (SELECT pack, sum(bytes) AS bytes, coalesce(sum(bytes) FILTER (WHERE nd.sha IS NOT NULL), 0) AS live, count(nd.sha) AS live_n FROM st LEFT JOIN nd USING (sha) GROUP BY pack)"""


@register("union_totals", px.sql(px.REFS, px.STORED, _HOME, query="SELECT sum(bytes)::BIGINT AS now, sum(CASE WHEN live_n > 0 THEN bytes ELSE 0 END)::BIGINT AS after_gc, sum(CASE WHEN 2 * live > bytes THEN bytes ELSE live END)::BIGINT AS after_repack, sum(live)::BIGINT AS live, sum(36 * live_n)::BIGINT AS records FROM p"))
def union_totals(spark, d):
    r = px.refs(spark, d)
    stored = r.groupBy("sha").agg(F.min("pack").alias("pack")).join(px.stored(spark, d), "sha").select("sha", "pack", F.col("logical").alias("bytes"))
    return dv.union_totals(r.filter("version_id % 40 = 0"), stored)


@register("event_replay", px.sql(px.VERSIONS, """v AS (SELECT "key", date_diff('day', DATE '1992-01-01', ts::DATE) AS day, version_id AS seq, size AS bytes FROM versions)""", """x AS (SELECT *, lead(day, 3) OVER (PARTITION BY "key" ORDER BY day, seq) AS gone FROM v)""",
"""t AS (SELECT "key", unnest(range(min(day) + 7, max(day) + 8, 7)) AS tick, min(day) AS first FROM v GROUP BY 1)""", """n AS (SELECT *, CASE WHEN ((tick - first) // 7) % 2 = 0 THEN tick ELSE tick - 7 END AS swept FROM t)""",
query="""SELECT n."key", tick AS day, coalesce(sum(bytes) FILTER (WHERE day < tick AND (gone IS NULL OR gone >= tick)), 0)::BIGINT AS live, coalesce(sum(bytes) FILTER (WHERE gone < tick AND gone >= swept), 0)::BIGINT AS dead, coalesce(sum(bytes) FILTER (WHERE gone < swept), 0)::BIGINT AS collected FROM n JOIN x ON x."key" = n."key" GROUP BY n."key", tick"""))
def event_replay(spark, d):
    """Customers' orders as arrivals of a lineage, with ticks, retention of the last three and collection every second tick."""
    v = px.versions(spark, d)
    return dv.replayed(v.select("key", F.datediff("ts", F.lit("1992-01-01")).cast("long").alias("day"), F.col("version_id").alias("seq"), F.col("size").alias("bytes")))


@register("replay_arrivals", px.sql(px.VERSIONS, query="""SELECT "key", sum(size)::BIGINT AS arrived, (sum(size) FILTER (WHERE rank <= 3))::BIGINT AS live FROM (SELECT *, row_number() OVER (PARTITION BY "key" ORDER BY ts::DATE DESC, version_id DESC) AS rank FROM versions) GROUP BY 1"""))
def replay_arrivals(spark, d):
    """What the replay must end with: bytes arrived, and those of the last three, from its own last tick."""
    r = event_replay(spark, d)
    # numbers apart, not a struct: those are aggregated by hash, without a sort of all ticks
    end = r.groupBy("key").agg(*[F.max_by(c, "day").alias(c) for c in ("live", "dead", "collected")])
    return end.select("key", (F.col("live") + F.col("dead") + F.col("collected")).alias("arrived"), "live")


@register("posting_compaction", "SELECT feature, id FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY id DESC) AS rn FROM (SELECT DISTINCT l_partkey AS feature, l_orderkey AS id FROM lineitem WHERE l_orderkey % 9 <> 0)) WHERE rn <= 8")
def posting_compaction(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_linenumber") % 3).alias("run"), F.col("l_partkey").alias("feature"), F.col("l_orderkey").alias("id"))
    return dv.compacted(x, x.filter("id % 9 = 0").select("id").distinct(), 8)


@register("pruned_discovery", """WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1), c(node) AS (SELECT p_partkey FROM part WHERE p_partkey % 50 = 7 AND p_partkey % 5 <> 0 UNION SELECT dst FROM c JOIN e ON src = node WHERE dst % 5 <> 0) SELECT node FROM c""")
def pruned_discovery(spark, d):
    n = F.col("p_partkey")
    p = table(spark, d, "part")
    edges = p.filter("p_partkey > 1").select(n.alias("src"), F.floor(n / 2).alias("dst"))
    return dv.pruned_discovery(edges, p.filter("p_partkey % 50 = 7").select(n.alias("node")), p.filter("p_partkey % 5 = 0").select(n.alias("node")))


@register("local_identity", "SELECT l_orderkey, sha256(string_agg(l_partkey::VARCHAR || ':' || l_quantity::BIGINT::VARCHAR, '|' ORDER BY l_partkey, l_quantity)) AS ident FROM lineitem GROUP BY 1")
def local_identity(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_quantity"))).alias("p"))
    return x.select("l_orderkey", F.sha2(F.array_join(F.transform("p", lambda v: F.concat_ws(":", v["l_partkey"].cast("string"), v["l_quantity"].cast("long").cast("string"))), "|"), 256).alias("ident"))


@register("family_glob", "SELECT page_id, CASE WHEN url LIKE '%/en/%.html%' THEN 'en-html' WHEN url LIKE '%/en/%' THEN 'en' WHEN regexp_matches(url, '/(de|fr|es)/[0-9]+') THEN 'other' ELSE 'none' END AS family FROM pages")
def family_glob(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.when(u.like("%/en/%.html%"), "en-html").when(u.like("%/en/%"), "en").when(u.rlike("/(de|fr|es)/[0-9]+"), "other").otherwise("none").alias("family"))


@register("bounded_admission", "SELECT doc_id, CASE WHEN n_chars > 20000 THEN 'too long' WHEN n_chars < 50 THEN 'too short' WHEN lang NOT IN ('en', 'de') THEN 'language' ELSE 'ok' END AS reason FROM documents")
def bounded_admission(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", F.when(n > 20000, "too long").when(n < 50, "too short").when(~F.col("lang").isin("en", "de"), "language").otherwise("ok").alias("reason"))


@register("cost_by_role", px.sql(px.REFS, px.PACKS, query="SELECT now AS role, count(*) AS n, sum(length)::BIGINT AS bytes, count(DISTINCT pack) AS packs FROM refs JOIN packs USING (pack) GROUP BY now"))
def cost_by_role(spark, d):
    return px.refs(spark, d).join(px.packs(spark, d), "pack").groupBy(F.col("now").alias("role")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.count_distinct("pack").alias("packs"))


@register("read_cost", px.sql(px.REFS, query="SELECT version_id, count(*) AS chunks, count(DISTINCT pack) AS opens, sum(length)::BIGINT AS bytes, (1 + coalesce(sum((pack <> prev)::INT), 0))::BIGINT AS seeks FROM (SELECT *, lag(pack) OVER (PARTITION BY version_id ORDER BY ord) AS prev FROM refs) GROUP BY 1"))
def read_cost(spark, d):
    """What a whole read touches: chunks, packs opened, bytes, changes of pack on the way."""
    from pyspark.sql import Window

    r = px.refs(spark, d).withColumn("prev", F.lag("pack").over(Window.partitionBy("version_id").orderBy("ord")))
    return r.groupBy("version_id").agg(F.count("*").alias("chunks"), F.count_distinct("pack").alias("opens"), F.sum("length").alias("bytes"), (1 + F.coalesce(F.sum((F.col("pack") != F.col("prev")).cast("long")), F.lit(0))).alias("seeks"))


@register("compact_order", px.sql(px.REFS, query="SELECT sha, row_number() OVER (ORDER BY version_id, ord) AS place FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY version_id, ord) AS rn FROM refs) WHERE rn = 1"))
def compact_order(spark, d):
    """Places of chunks in locality order: sorted ranges are numbered apart and shifted by the counts before them."""
    first = ck.first_reference_order(px.refs(spark, d), ["version_id", "ord"]).select("sha", "first.*")
    laid = cut(first.repartitionByRange(4, "version_id", "ord").sortWithinPartitions("version_id", "ord").withColumn("part", F.spark_partition_id()))
    from pyspark.sql import Window

    n = laid.groupBy("part").agg(F.count("*").alias("n"))
    before = n.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    ranked = laid.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("version_id", "ord")))
    return ranked.join(before, "part").select("sha", (F.col("r") + F.col("before")).alias("place"))


@register("mean_over_seeds", "SELECT l_suppkey % 5 AS policy, round(avg(s), 6) AS mean FROM (SELECT l_suppkey, l_linenumber, avg(l_quantity) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def mean_over_seeds(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_quantity").alias("s"))
    return per.groupBy((F.col("l_suppkey") % 5).alias("policy")).agg(F.round(F.avg("s"), 6).alias("mean"))


@register("layout_entropy", """WITH b AS (SELECT source, unnest(string_split(lang, '')) AS ch FROM documents) SELECT source, round(sum(-c * log2(c / n)) / 8, 6) AS entropy, max(n)::BIGINT AS n FROM (SELECT source, ch, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY source)::DOUBLE AS n FROM b GROUP BY 1, 2) GROUP BY 1""")
def layout_entropy(spark, d):
    x = table(spark, d, "documents").select("source", F.explode(F.split("lang", "")).alias("ch")).filter("ch <> ''")
    return st.entropy_bytes(x, ["source"], F.col("ch")).select("source", F.round("entropy", 6).alias("entropy"), "n")


@register("move_to_front", """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), p AS (SELECT *, coalesce(lag(i) OVER (PARTITION BY user_id, event_type ORDER BY i), 0) AS prev FROM e)
SELECT p.user_id, p.event_id, count(DISTINCT q.event_type)::INT AS code FROM p LEFT JOIN p q ON q.user_id = p.user_id AND q.i < p.i AND q.i > p.prev GROUP BY 1, 2""")
def move_to_front(spark, d):
    x = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return dv.move_to_front(x, "user_id", "event_id", "event_type")


@register("ordered_listing", """SELECT "key", row_number() OVER (ORDER BY "key") AS rn FROM (SELECT DISTINCT lower(r_name) || '/é' AS "key" FROM region UNION SELECT DISTINCT lower(r_name) || '/z' FROM region)""")
def ordered_listing(spark, d):
    """Byte order: z before é."""
    from pyspark.sql import Window

    r = table(spark, d, "region")
    k = r.select(F.concat(F.lower("r_name"), F.lit("/é")).alias("key")).union(r.select(F.concat(F.lower("r_name"), F.lit("/z")))).distinct()
    return k.select("key", F.row_number().over(Window.orderBy("key")).cast("long").alias("rn"))


@register("span_restore", "SELECT doc_id AS id, CASE WHEN doc_id % 30 <> 0 THEN sha256(substr(text, 11, 40) || substr(text, 1, 10)) END AS sha FROM documents WHERE length(text) >= 50")
def span_restore(spark, d):
    """Two spans of each text put together; one text in thirty has a span beyond its chunk."""
    docs = table(spark, d, "documents").filter("length(text) >= 50")
    backing = docs.select(F.col("doc_id").alias("sha"), F.col("text").alias("payload"))
    far = F.when(F.col("doc_id") % 30 == 0, F.char_length("text")).otherwise(10)
    spans = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("ord"), far.alias("offset"), F.lit(40).alias("length")), F.struct(F.lit(1).alias("ord"), F.lit(0).alias("offset"), F.lit(10).alias("length")))).alias("s"))
    return dv.restored(spans.select("id", "sha", "s.*"), backing).select("id", F.sha2("body", 256).alias("sha"))


@register("prior_calibration", """WITH s AS (SELECT o_custkey AS lineage, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS t, floor(o_totalprice) AS p, (o_orderkey % 10) / 10.0 AS r FROM orders), n AS (SELECT lineage, count(*) AS n FROM s GROUP BY 1)
SELECT round(exp(avg(ln(0.5 + r)) FILTER (WHERE p > 0)), 6) AS ratio, round((avg(r) FILTER (WHERE t > 0))::DOUBLE, 6) AS rho_rep, round((avg(1 - r) FILTER (WHERE t > 0))::DOUBLE, 6) AS rho_plain, round(least(greatest((SELECT sum(n - 1) / sum(n) FROM n), 0.05), 0.95), 6) AS q, (SELECT count(*) FROM n) AS n FROM s""")
def prior_calibration(spark, d):
    from pyspark.sql import Window

    from granary.operators import planner as pl

    o = table(spark, d, "orders")
    t = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    s = o.select(F.col("o_custkey").alias("lineage"), t.alias("t"), F.floor("o_totalprice").cast("double").alias("p"), ((F.col("o_orderkey") % 10) / 10).alias("r"))
    plain = s.select("lineage", "t", F.lit(pl.PLAIN).alias("scheme"), F.col("p").alias("own"), F.when(F.col("t") > 0, 1 - F.col("r")).alias("overlap"))
    rep = s.select("lineage", "t", F.lit("rep").alias("scheme"), (F.col("p") * (0.5 + F.col("r"))).alias("own"), F.when(F.col("t") > 0, F.col("r")).alias("overlap"))
    return pl.priors(plain.unionByName(rep)).select(*[F.round(c, 6).alias(c) for c in ("ratio", "rho_rep", "rho_plain", "q")], "n")


@register("generated_chains", """WITH r AS (SELECT l AS lineage, c AS record, v AS revision, v = 0 OR ('0x' || substr(md5(concat_ws(':', '7', l, c, v)), 1, 8))::BIGINT % 10 = 0 AS new FROM range(20) x(l), range(50) y(c), range(6) z(v)),
m AS (SELECT *, max(CASE WHEN new THEN revision END) OVER (PARTITION BY lineage, record ORDER BY revision) AS made FROM r) SELECT lineage, revision, record, md5(concat_ws(':', '8', lineage, record, made)) AS body FROM m""")
def generated_chains(spark, d):
    from granary.sources import generated

    return generated.chains(spark, 20, 6, 50, seed=7)


@register("delta_envelopes", "SELECT doc_id, true AS exact, true AS bounded FROM documents WHERE text IS NOT NULL")
def delta_envelopes(spark, d):
    """Each document as an envelope over its source's first one, decoded again; its size lies within what the estimate says."""
    from granary.functions import content, envelope

    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    base = docs.groupBy("source").agg(F.min_by("text", "doc_id").alias("base"))

    @F.pandas_udf("exact boolean, bounded boolean")
    def proved(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for b, t in zip(x, y, strict=True):
            b, t = (b or "").encode(), t.encode()
            ops = [(0, o, n, lit) for o, n, lit in content.delta(b, t)]
            held = envelope.encode([b], ops, t)
            least, most = envelope.bounds(ops, len(t))
            rows.append((envelope.decode(held, lambda _, b=b: b) == t, least <= len(held) <= most))
        return pd.DataFrame(rows, columns=["exact", "bounded"])

    kept = docs.join(base, docs["source"].eqNullSafe(base["source"])).select("doc_id", proved("base", "text").alias("p"))
    return kept.select("doc_id", "p.exact", "p.bounded")


@register("parquet_page_walk", """SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS "column", count(*) AS n FROM nation""")
def parquet_page_walk(spark, d):
    """Values in the data pages of a table's files, by column."""
    from granary.sources import readers

    pages = readers.read(spark, "parquet_pages", f"{d}/nation.parquet")
    return pages.filter("kind LIKE 'data%' AND column IN ('n_nationkey', 'n_name', 'n_regionkey')").groupBy("column").agg(F.sum("n").alias("n"))


@register("derivation_steps", "SELECT vec_id, true AS exact FROM embeddings WHERE embedding IS NOT NULL")
def derivation_steps(spark, d):
    """Vectors as bytes through steps and back: swapped twice, turned and turned back, and each once by a step that undoes the other."""
    from granary.functions import derivations

    e = table(spark, d, "embeddings").filter("embedding IS NOT NULL")

    def packed(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            rows = [np.array(x, "<f4").tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[r, r[:8]] for r in rows], pa.list_(pa.binary())), pa.array(rows, pa.binary())], names=["vec_id", "inputs", "want"])

    held = e.select("vec_id", "embedding").mapInArrow(packed, f"vec_id {e.schema['vec_id'].dataType.simpleString()}, inputs array<binary>, want binary")
    n = F.octet_length("want")
    sizes = [r.n for r in held.select(n.alias("n")).distinct().limit(2).collect()]
    width = sizes[0] // 4
    steps = [{"kind": "concat"}, {"kind": "slice", "offset": 0, "length": sizes[0]}, {"kind": "bswap", "width": 4}, {"kind": "perm", "width": 4, "dims": [2, width // 2], "axes": [1, 0]},
             {"kind": "perm", "width": 4, "dims": [width // 2, 2], "axes": [1, 0]}, {"kind": "gather", "width": 4, "index": list(range(width))[::-1]}, {"kind": "gather", "width": 4, "index": list(range(width))[::-1]}, {"kind": "bswap", "width": 4}]
    made = derivations.derived(held, steps, "vec_id")
    return made.join(held.select("vec_id", "want"), "vec_id").select("vec_id", (F.col("body") == F.col("want")).alias("exact"))
