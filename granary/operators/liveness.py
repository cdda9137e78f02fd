"""Roots, reachability, verification, garbage, packs and tiers.

Nothing here is approximate: what isn't proved dead is live, and destructive plans are empty unless verification is clean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roots(scopes: dict[str, DataFrame]) -> DataFrame:
    """(scope, version_id) of current, historical, multipart and snapshot roots."""
    held = [df.select(F.lit(scope).alias("scope"), "version_id") for scope, df in scopes.items()]
    return reduce(DataFrame.unionByName, held)


def reachability(root_rows: DataFrame, refs: DataFrame) -> DataFrame:
    """(sha, n_roots, scopes): how many roots of which scopes reach a chunk."""
    j = root_rows.distinct().join(refs.select("version_id", "sha").distinct(), "version_id")
    return j.groupBy("sha").agg(F.count("*").alias("n_roots"), F.array_join(F.array_sort(F.collect_set("scope")), ",").alias("scopes"))


def closure(edges: DataFrame, start: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, depth) reachable from ``start`` (node) over edges (src, dst), each once at its least depth; cycles end by themselves.

    Breadth-first: each round joins the frontier only, and what is known is anti-joined away. Rounds are written tables.
    """
    from granary.operators.storage import cut

    known = cut(start.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = known
    for depth in range(1, most_rounds + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)  # of tables that are cut already
    raise ValueError(f"no end after {most_rounds} rounds")


def garbage(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored chunks that no root reaches."""
    return stored.join(live.select("sha"), "sha", "left_anti")


def missing(live: DataFrame, stored: DataFrame) -> DataFrame:
    return live.join(stored.select("sha"), "sha", "left_anti")


def manifest_issues(manifests: DataFrame) -> DataFrame:
    """(version_id, issue) of (version_id, sha, size, chunks array<struct<sha, length>>): bad digests, negative lengths, a wrong total."""
    total = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + c["length"])
    issue = (
        F.when(~F.col("sha").rlike("^[0-9a-f]{64}$"), "digest")
        .when(F.exists("chunks", lambda c: ~c["sha"].rlike("^[0-9a-f]{64}$")), "chunk digest")
        .when(F.exists("chunks", lambda c: c["length"] < 0), "length")
        .when(total != F.col("size"), "total")
    )
    return manifests.select("version_id", issue.alias("issue")).filter("issue IS NOT NULL")


def verify(refs: DataFrame, stored: DataFrame, deep: bool = False) -> DataFrame:
    """(kind, sha): missing chunks, and those whose length (deep: or digest) isn't the one referenced. Empty means OK."""
    want = refs.groupBy("sha").agg(F.min("length").alias("least"), F.max("length").alias("most"))
    j = want.join(stored, "sha", "left")
    kind = F.when(F.col("logical").isNull(), "missing").when((F.col("least") != F.col("logical")) | (F.col("most") != F.col("logical")), "invalid")
    if deep:
        kind = F.coalesce(kind, F.when(F.sha2("payload", 256) != F.col("sha"), "corrupt"))
    return j.select(kind.alias("kind"), "sha").filter("kind IS NOT NULL")


def collectable(stored: DataFrame, live: DataFrame, issues: DataFrame) -> DataFrame:
    """Garbage, or nothing at all while any issue is open."""
    gate = issues.limit(1).agg((F.count("*") == 0).alias("ok"))
    return garbage(stored, live).filter(gate.select("ok").scalar())


def pack_utilisation(records: DataFrame, live: DataFrame) -> DataFrame:
    """By pack: live and dead counts and bytes, live share, fully and partly dead, of records (pack, sha, stored)."""
    j = records.join(live.select("sha", F.lit(True).alias("live")), "sha", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    out = j.groupBy("pack").agg(
        F.count(F.when(F.col("live"), 1)).alias("live_n"),
        F.count(F.when(~F.col("live"), 1)).alias("dead_n"),
        F.coalesce(F.sum(F.when(F.col("live"), F.col("stored"))), F.lit(0)).alias("live_bytes"),
        F.coalesce(F.sum(F.when(~F.col("live"), F.col("stored"))), F.lit(0)).alias("dead_bytes"),
    )
    return out.withColumns({"fully_dead": F.col("live_n") == 0, "partly_dead": (F.col("live_n") > 0) & (F.col("dead_n") > 0)})


def repack(utilisation: DataFrame, least_live_percent: int = 50) -> DataFrame:
    """Packs with less live than that, but some: fully dead ones are dropped, not rewritten."""
    total = F.col("live_bytes") + F.col("dead_bytes")
    return utilisation.filter((F.col("live_n") > 0) & (100 * F.col("live_bytes") < least_live_percent * total))


def target_tiers(root_tiers: DataFrame, refs: DataFrame) -> DataFrame:
    """(sha, rank, shared): the hottest (least) tier rank of a chunk's roots, and whether sharing promotes it."""
    j = root_tiers.join(refs.select("version_id", "sha").distinct(), "version_id")
    return j.groupBy("sha").agg(F.min("rank").alias("rank"), (F.min("rank") < F.max("rank")).alias("promoted"))


def rebalance(targets: DataFrame, placed: DataFrame) -> DataFrame:
    """(pack, n, misplaced, misplaced_bytes, action) of chunks placed (sha, pack, rank as now, stored)."""
    j = placed.join(targets.select("sha", F.col("rank").alias("target"), "promoted"), "sha")
    wrong = F.col("target") != F.col("now")
    out = j.groupBy("pack").agg(
        F.count("*").alias("n"),
        F.count(F.when(wrong, 1)).alias("misplaced"),
        F.coalesce(F.sum(F.when(wrong, F.col("stored"))), F.lit(0)).alias("misplaced_bytes"),
        F.count_distinct("target").alias("targets"),
    )
    action = F.when(F.col("misplaced") == 0, "compliant").when((F.col("misplaced") == F.col("n")) & (F.col("targets") == 1), "move").otherwise("rewrite")
    return out.withColumn("action", action).drop("targets")


def group_reclaimable(refs: DataFrame, members: DataFrame) -> DataFrame:
    """(grp, bytes): chunks all of whose references lie in one group, of refs (owner, sha, length) and members (owner, grp)."""
    j = refs.join(members, "owner", "left")
    own = j.groupBy("sha").agg(F.max("length").alias("length"), F.min("grp").alias("grp"), (F.bool_and(F.col("grp").isNotNull()) & (F.min("grp") == F.max("grp"))).alias("inside"))
    return own.filter("inside").groupBy("grp").agg(F.sum("length").alias("bytes"), F.count("*").alias("chunks"))


def exclusive_bytes(refs: DataFrame) -> DataFrame:
    """(owner, bytes): chunks with a single owner."""
    one = refs.groupBy("sha").agg(F.max("length").alias("length"), F.min("owner").alias("owner"), F.max("owner").alias("other")).filter("owner = other")
    return one.groupBy("owner").agg(F.sum("length").alias("bytes"), F.count("*").alias("chunks"))


def shared_bytes(refs: DataFrame, owners: DataFrame) -> DataFrame:
    """One row: chunks and bytes of these owners, and how many also others reference."""
    inside = refs.join(owners.select("owner").distinct(), "owner", "left_semi").groupBy("sha").agg(F.max("length").alias("length"))
    outside = refs.join(owners.select("owner").distinct(), "owner", "left_anti").select("sha").distinct().withColumn("out", F.lit(True))
    j = inside.join(outside, "sha", "left")
    return j.agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes"), F.count("out").alias("shared_chunks"), F.coalesce(F.sum(F.when(F.col("out"), F.col("length"))), F.lit(0)).alias("shared_bytes"))


def preferred_copy(copies: DataFrame) -> DataFrame:
    """The valid copy of each digest of the least priority rank, then pack: copies (sha, rank, pack, valid)."""
    return copies.filter("valid").groupBy("sha").agg(F.min(F.struct("rank", "pack")).alias("c")).select("sha", "c.*")
