"""Representation choice over the driver tables: a supplier's lines as objects, return flags as schemes, parts as components."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import selection as sel
from granary.plans.registry import register, table


def _candidates(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("inst"), F.col("l_linenumber").alias("obj"), F.col("l_returnflag").alias("scheme"), F.col("l_quantity").cast("long").alias("read"), (F.col("l_partkey") % 8).alias("c"))
    part = F.struct(F.col("c").cast("string").alias("id"), (10 + 5 * F.col("c")).cast("long").alias("size"))
    return x.groupBy("inst", "obj", "scheme").agg(F.min("read").alias("read"), F.slice(F.array_sort(F.collect_set(part)), 1, 3).alias("components"))


@register("dag_plans")
def dag_plans(spark, d):
    """Plans of every supplier by all policies."""
    return sel.planned(_candidates(spark, d))


@register("dag_plan_order", "SELECT DISTINCT l_suppkey::VARCHAR AS inst, true AS ordered FROM lineitem")
def dag_plan_order(spark, d):
    """Each better policy costs no more: exact, refined, marginal."""
    p = sel.planned(_candidates(spark, d)).groupBy("inst").pivot("policy", list(sel.POLICIES)).agg(F.max("cost"))
    return p.select("inst", ((F.col("exact") <= F.col("beam")) & (F.col("beam") <= F.col("refine")) & (F.col("refine") <= F.col("marginal")) & (F.col("exact") <= F.col("independent"))).alias("ordered"))


@register("dag_independent_cost", """SELECT inst, sum(w)::BIGINT AS alone FROM (SELECT inst, obj, min(read + s) AS w FROM (SELECT inst, obj, scheme, min(read) AS read, list_sum(list_transform(list_slice(list_sort(list_distinct(list(c))), 1, 3), lambda x: 10 + 5 * x)) AS s FROM (SELECT l_suppkey::VARCHAR AS inst, l_linenumber AS obj, l_returnflag AS scheme, l_quantity::BIGINT AS read, l_partkey % 8 AS c FROM lineitem) GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""")
def dag_independent_cost(spark, d):
    """What objects cost apart, before any sharing."""
    c = _candidates(spark, d).withColumn("w", F.col("read") + F.aggregate("components", F.lit(0).cast("long"), lambda a, x: a + x["size"]))
    return c.groupBy("inst", "obj").agg(F.min("w").alias("w")).groupBy("inst").agg(F.sum("w").alias("alone"))


_STEPS = ["m0 AS (SELECT DISTINCT inst, 0 AS mask, 0::BIGINT AS read FROM cand)"]
for _k in range(1, 8):
    _STEPS.append(f"m{_k} AS (SELECT m.inst, m.mask | coalesce(c.mask, 0) AS mask, min(m.read + coalesce(c.read, 0)) AS read FROM m{_k - 1} m LEFT JOIN cand c ON c.inst = m.inst AND c.obj = {_k} GROUP BY 1, 2)")


@register(
    "dag_exact_cost",
    """WITH cand AS (SELECT inst, obj, scheme, read, list_reduce(list_prepend(0, list_transform(list_slice(list_sort(list_distinct(cs)), 1, 3), lambda x: 1 << x)), lambda a, b: a | b)::INT AS mask
FROM (SELECT l_suppkey::VARCHAR AS inst, l_linenumber AS obj, l_returnflag AS scheme, min(l_quantity::BIGINT) AS read, list((l_partkey % 8)::INT) AS cs FROM lineitem GROUP BY 1, 2, 3)),
"""
    + ",\n".join(_STEPS)
    + "\nSELECT inst, min(read + list_sum(list_transform(range(0, 8), lambda i: CASE WHEN (mask >> i::INT) & 1 = 1 THEN 10 + 5 * i ELSE 0 END)))::BIGINT AS cost FROM m7 GROUP BY 1",
)
def dag_exact_cost(spark, d):
    """The least cost of a supplier's lines over all choices of schemes."""
    return sel.planned(_candidates(spark, d), ("exact",)).select("inst", "cost")


@register("group_plans", "SELECT DISTINCT l_suppkey::VARCHAR AS inst, true AS ordered FROM lineitem")
def group_plans(spark, d):
    """By exact cost: the best pure plan is no dearer than the best of two, and the exact plan than any."""
    p = sel.planned(_candidates(spark, d), ("exact", *sel.GROUP_POLICIES)).groupBy("inst").pivot("policy", ["exact", *sel.GROUP_POLICIES]).agg(F.max("cost"))
    return p.select("inst", ((F.col("exact") <= F.col("pure")) & (F.col("pure") <= F.col("best_of_two")) & (F.col("exact") <= F.col("exclusive"))).alias("ordered"))
