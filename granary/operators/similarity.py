"""Similarity search over an inverted index of features. Postings are (feature, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Newest postings that a feature keeps, and features and answers of a query: fixed values of the index.
NEWEST, MOST_FEATURES, MOST_ANSWERS = 64, 64, 64


def newest(postings: DataFrame, n: int = NEWEST) -> DataFrame:
    """Each feature's ``n`` newest (largest) ids: the cap is the index's own rule, so a common feature can't dominate."""
    w = Window.partitionBy("feature").orderBy(F.desc("id"))
    return postings.distinct().withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def alive(postings: DataFrame, dead: DataFrame) -> DataFrame:
    return postings.join(dead.select("id"), "id", "left_anti")


def candidates(queries: DataFrame, postings: DataFrame, k: int = MOST_ANSWERS) -> DataFrame:
    """(query, id, hits, rank): ids that share most features with each query, then the newest; a query isn't its own answer.

    A feature has at most ``NEWEST`` postings, so the join is linear in the queries' features.
    """
    j = queries.select(F.col("id").alias("query"), "feature").join(postings, "feature").filter("query <> id")
    hits = j.groupBy("query", "id").agg(F.count("*").alias("hits"))
    w = Window.partitionBy("query").orderBy(F.desc("hits"), F.desc("id"))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def overlap(a: Column, b: Column) -> Column:
    """Share of the elements of ``b``, repeats counted, that are in ``a``; 0 if either is empty."""
    hits = F.size(F.filter(b, lambda x: F.array_contains(a, x)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(hits / F.size(b))


def bottom_k(features: Column, k: int = MOST_FEATURES) -> Column:
    """The ``k`` least distinct features in ascending order."""
    return F.slice(F.array_sort(F.array_distinct(features)), 1, k)


def signature_distance(l1: Column, l2: Column, m1: Column, m2: Column) -> Column:
    """Relative distance of two signatures: |x - y| / max(|x|, |y|), 0 if both are 0, summed over L1 and L2."""
    rel = lambda x, y: F.coalesce(F.try_divide(F.abs(x - y), F.greatest(F.abs(x), F.abs(y))), F.lit(0.0))
    return rel(l1, m1) + rel(l2, m2)
