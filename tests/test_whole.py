"""Whole jobs: nothing of a table or a chain is left out."""

from __future__ import annotations

from granary.operators import graph
from granary.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_admission_has_every_stage(spark):
    got = catalogue.QUERIES["admission_policies"](spark, SF).groupBy("case", "policy").count().collect()
    orders = spark.read.parquet(f"{SF}/orders.parquet").join(spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_orderkey AS o_orderkey"), "o_orderkey", "left_semi")
    want = {str(r.o_custkey): r["count"] for r in orders.groupBy("o_custkey").count().collect()}
    assert max(want.values()) > 6 and {r.case for r in got} == set(want) and all(r["count"] == want[r.case] for r in got)


def test_long_chains_are_not_cycles(spark):
    rows = [(n, n - 1 if n else None) for n in range(201)] + [(1000, 1001), (1001, 1000), (1002, 1001)]
    got = {r.node: (r.depth, r.cyclic) for r in graph.chain_depths(spark.createDataFrame(rows, "node long, parent long")).collect()}
    assert got == {**{n: (n, False) for n in range(201)}, **{n: (None, True) for n in (1000, 1001, 1002)}}


def test_exact_plan_of_many_stages():
    """Forty stages of which each shares an object with the next alone: within the limit of states."""
    from granary.operators import planner

    stages = [[(planner.PLAIN, {f"p{j}": 150}, []), ("shared", {f"o{j}": 100, f"o{j + 1}": 100}, [])] for j in range(40)]
    assert len(planner.Case(stages, False).best()) == 40
