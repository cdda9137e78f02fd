"""Graphs over the driver tables: customers, orders, parts and suppliers as nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import graph as gr
from granary.operators import liveness as lv
from granary.plans import proxies as px
from granary.plans.registry import register, table


def _chain(spark, d):
    """Edges of part to part: n -> n // 2 and n -> n // 3, as a dependency graph without cycles."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("n")).filter("n > 1")
    half = p.select(F.col("n").alias("src"), F.floor(F.col("n") / 2).alias("dst"))
    third = p.select(F.col("n").alias("src"), F.floor(F.col("n") / 3).alias("dst")).filter("dst > 0")
    return half.union(third)


_EDGES = """e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2)"""


@register("dependency_closure", "WITH RECURSIVE " + _EDGES + ", c(node, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey % 97 = 0 UNION SELECT dst, depth + 1 FROM c JOIN e ON src = node) SELECT node, min(depth)::INT AS depth FROM c GROUP BY node")
def dependency_closure(spark, d):
    start = table(spark, d, "part").filter("p_partkey % 97 = 0").select(F.col("p_partkey").alias("node"))
    return lv.closure(_chain(spark, d), start)


@register("recursive_reach", "WITH RECURSIVE " + _EDGES + ", c(node, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey % 197 = 0 UNION SELECT dst, depth + 1 FROM c JOIN e ON src = node) SELECT node, min(depth)::INT AS depth FROM c GROUP BY node")
def recursive_reach(spark, d):
    """The recursive query's closure. Spark's own recursion keeps each path apart, and paths are far more than nodes."""
    start = table(spark, d, "part").filter("p_partkey % 197 = 0").select(F.col("p_partkey").alias("node"))
    return lv.closure(_chain(spark, d), start)


@register("blast_radius", "WITH RECURSIVE " + _EDGES + ", c(root, node) AS (SELECT p_partkey, p_partkey FROM part WHERE p_partkey <= 20 UNION SELECT root, src FROM c JOIN e ON dst = node) SELECT root, count(*) - 1 AS dependents FROM c GROUP BY root")
def blast_radius(spark, d):
    """How many nodes depend on each of the first twenty, over edges turned round; each root is closed apart."""
    back = _chain(spark, d).select(F.col("dst").alias("s"), F.col("src").alias("t"))
    roots = table(spark, d, "part").filter("p_partkey <= 20").select(F.col("p_partkey").alias("r"))
    pair = roots.select(F.struct(F.col("r").alias("root"), F.col("r").alias("n")).alias("node"))
    known = pair.select("node.root", F.col("node.n").alias("node"))
    front = known
    from granary.operators.storage import cut

    while True:
        step = front.join(back, front["node"] == back["s"]).select("root", F.col("t").alias("node")).distinct()
        front = cut(step.join(known, ["root", "node"], "left_anti"))
        if front.isEmpty():
            return known.groupBy("root").agg((F.count("*") - 1).alias("dependents"))
        known = known.unionByName(front)  # of tables that are cut already


@register("chain_depth", "WITH RECURSIVE c(node, up, depth) AS (SELECT p_partkey, p_partkey // 2, CASE WHEN p_partkey > 1 THEN 1 ELSE 0 END FROM part UNION ALL SELECT node, up // 2, depth + 1 FROM c WHERE up > 1) SELECT node, max(depth)::INT AS depth, false AS cyclic FROM c GROUP BY node")
def chain_depth(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent"))
    return gr.chain_depths(p)


@register("cycle_check", "SELECT p_partkey AS node, true AS cyclic FROM part WHERE p_partkey BETWEEN 1 AND 9")
def cycle_check(spark, d):
    """Nine nodes in three rings: every chain without an end is reported."""
    n = F.col("p_partkey")
    ring = table(spark, d, "part").filter("p_partkey BETWEEN 1 AND 9").select(n.alias("node"), F.when(n % 3 == 0, n - 2).otherwise(n + 1).alias("parent"))
    return gr.chain_depths(ring).filter("cyclic").select("node", "cyclic")


@register("duplicate_families", """SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY sha256(text)) AS root FROM documents QUALIFY count(*) OVER (PARTITION BY sha256(text)) > 1""")
def duplicate_families(spark, d):
    """Equal documents chained by neighbour, closed again to families."""
    from pyspark.sql import Window

    o = px.objects(spark, d)
    e = o.withColumn("dst", F.lag("version_id").over(Window.partitionBy("sha").orderBy("version_id"))).filter("dst IS NOT NULL")
    return gr.families(e.select(F.col("version_id").alias("src"), "dst"))


@register("strong_components", "SELECT n_nationkey AS node, CASE WHEN n_nationkey < 20 THEN (n_nationkey // 5) * 5 + 4 ELSE n_nationkey END AS component FROM nation WHERE n_nationkey < 25")
def strong_components(spark, d):
    """Four rings of five nations, bridged one way, and a tail without return."""
    n = F.col("n_nationkey")
    t = table(spark, d, "nation")
    ring = t.filter("n_nationkey < 20").select(n.alias("src"), F.when(n % 5 == 4, n - 4).otherwise(n + 1).alias("dst"))
    bridge = t.filter("n_nationkey < 24").filter("n_nationkey % 5 = 4 OR n_nationkey >= 20").select(n.alias("src"), (n + 1).alias("dst"))
    return gr.strong_components(ring.union(bridge))


def _leaves(spark, d, changed: bool):
    v = F.col("version_id")
    h = F.when((v % 50 == 3) & F.lit(changed), F.sha2(F.concat("sha", F.lit("x")), 256)).otherwise(F.col("sha"))
    o = px.objects(spark, d)
    o = o.filter("version_id % 50 <> 7") if changed else o.filter("version_id % 50 <> 9")
    return o.select(v.alias("slot"), h.alias("hash"))


@register("merkle_diff", "SELECT doc_id AS slot, CASE doc_id % 50 WHEN 3 THEN 'changed' WHEN 7 THEN 'removed' ELSE 'added' END AS change FROM documents WHERE doc_id % 50 IN (3, 7, 9)")
def merkle_diff(spark, d):
    return gr.merkle_diff(gr.merkle_levels(_leaves(spark, d, False)), gr.merkle_levels(_leaves(spark, d, True)))


@register("merkle_root", "WITH l AS (SELECT doc_id AS slot, sha256(text) AS hash FROM documents), a AS (SELECT slot // 16 AS slot, sha256(string_agg(hash, '' ORDER BY slot)) AS hash FROM l GROUP BY 1), b AS (SELECT slot // 16 AS slot, sha256(string_agg(hash, '' ORDER BY slot)) AS hash FROM a GROUP BY 1) SELECT slot, hash FROM b")
def merkle_root(spark, d):
    """Two levels of a tree with sixteen children a node."""
    level = px.objects(spark, d).select(F.col("version_id").alias("slot"), F.col("sha").alias("hash"))
    for _ in range(2):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "hash"))), lambda x: x["hash"]), "")
        level = level.groupBy(F.floor(F.col("slot") / 16).alias("slot")).agg(F.sha2(joined, 256).alias("hash"))
    return level


@register("refinement_classes", """WITH c0 AS (SELECT p_partkey AS id, sha256('local|' || p_brand) AS cls FROM part),
e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst, 0 AS pos FROM part WHERE p_partkey > 1),
c1 AS (SELECT c.id, sha256(concat_ws('|', c.cls, x.t)) AS cls FROM c0 c LEFT JOIN (SELECT src, pos::VARCHAR || ':' || cls AS t FROM e JOIN c0 ON id = dst) x ON x.src = c.id),
c2 AS (SELECT c.id, sha256(concat_ws('|', c.cls, x.t)) AS cls FROM c1 c LEFT JOIN (SELECT src, pos::VARCHAR || ':' || cls AS t FROM e JOIN c1 ON id = dst) x ON x.src = c.id)
SELECT id, cls FROM c2""")
def refinement_classes(spark, d):
    """Two rounds of refinement; ``refined`` runs until the number of classes is stable."""
    n = F.col("p_partkey")
    p = table(spark, d, "part")
    e = p.filter("p_partkey > 1").select(n.alias("src"), F.floor(n / 2).alias("dst"))
    c = p.select(n.alias("id"), F.sha2(F.concat(F.lit("local|"), "p_brand"), 256).alias("cls"))
    for _ in range(2):
        below = e.join(c, e["dst"] == c["id"]).select("src", F.concat(F.lit("0:"), "cls").alias("t"))
        c = c.join(below, c["id"] == below["src"], "left").select("id", F.sha2(F.concat_ws("|", "cls", "t"), 256).alias("cls"))
    return c


@register("refinement_stable")
def refinement_stable(spark, d):
    n = F.col("p_partkey")
    p = table(spark, d, "part")
    return gr.refined(p.select(n.alias("id"), F.col("p_brand").alias("label")), p.filter("p_partkey > 1").select(n.alias("src"), F.floor(n / 2).alias("dst"), F.lit(0).alias("pos")))


@register("mutual_match", """SELECT s_suppkey AS a, s_suppkey AS b, 'unique' AS how FROM supplier""")
def mutual_match(spark, d):
    """Suppliers against themselves: every name is its own only partner."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("ident"), F.array(F.col("s_nationkey").cast("string")).alias("context"))
    return gr.unique_then_mutual(s, s)


@register("context_match", """WITH x AS (SELECT s_suppkey AS id, s_nationkey AS ident, list_distinct(string_split(substr(md5(s_name), 1, 12), '')) AS context FROM supplier),
p AS (SELECT a.id AS a, b.id AS b, a.ident, len(list_intersect(a.context, b.context)) AS score FROM x a JOIN x b ON a.ident = b.ident WHERE a.id % 2 = 1 AND b.id % 2 = 0),
n AS (SELECT *, count(DISTINCT a) OVER (PARTITION BY ident) * count(DISTINCT b) OVER (PARTITION BY ident) AS ways FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS rb FROM n)
SELECT a, b, CASE WHEN ways = 1 THEN 'unique' ELSE 'context' END AS how FROM r WHERE ra = 1 AND rb = 1""")
def context_match(spark, d):
    """Suppliers of odd and even numbers within a nation, by characters that their names' digests share."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("ident"), F.array_distinct(F.split(F.substring(F.md5("s_name"), 1, 12), "")).alias("context"))
    return gr.unique_then_mutual(s.filter("id % 2 = 1"), s.filter("id % 2 = 0"))


_STEPS = """e AS (SELECT p_partkey AS src, (p_partkey // 20) * 20 + (p_partkey * 3 + 1) % 20 AS dst FROM part UNION SELECT p_partkey, (p_partkey // 20) * 20 + (p_partkey * 7 + p_partkey // 20) % 20 FROM part WHERE p_partkey % 3 = 0)"""


@register("strong_components_of_parts", f"""WITH RECURSIVE {_STEPS}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT node, greatest(node, coalesce((SELECT max(x.b) FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a = node), node)) AS component FROM n""")
def strong_components_of_parts(spark, d):
    p = F.col("p_partkey")
    block, k = F.floor(p / 20) * 20, F.floor(p / 20)
    part = table(spark, d, "part")
    edges = part.select(p.alias("src"), (block + (p * 3 + 1) % 20).alias("dst")).union(part.filter(p % 3 == 0).select(p, block + (p * 7 + k) % 20))
    return gr.strong_components(edges)
