"""Merkle trees, refinement, components and paths, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.storage import cut, dropped


def merkle_levels(leaves: DataFrame, fanout: int = 16) -> list[DataFrame]:
    """Levels (slot, hash) from leaves (slot, hash) to one root: a node hashes its children's hashes in slot order.

    Slots count from 0; a null or negative one is an error, as it has no place in the tree. No leaves have one empty level.
    """
    place = F.when(F.col("slot") >= 0, F.col("slot")).otherwise(F.raise_error(F.lit("slots of a Merkle tree are numbers from 0")).cast(leaves.schema["slot"].dataType))
    levels = [leaves.select(place.alias("slot"), "hash")]
    while levels[-1].limit(2).count() > 1:
        up = levels[-1].groupBy(F.floor(F.col("slot") / fanout).alias("slot"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "hash"))), lambda x: x["hash"]), "")
        levels.append(cut(up.agg(F.sha2(joined, 256).alias("hash"))))
    return levels


def merkle_diff(a: list[DataFrame], b: list[DataFrame], fanout: int = 16) -> DataFrame:
    """(slot, change) of leaves: descends from the roots, only below nodes that differ."""
    front = None
    for level in range(min(len(a), len(b)) - 1, -1, -1):
        left, right = a[level].withColumnRenamed("hash", "l"), b[level].withColumnRenamed("hash", "r")
        if front is not None:
            up = front.select(F.col("slot").alias("__up"))
            left = left.join(up, F.floor(F.col("slot") / fanout) == F.col("__up"), "left_semi")
            right = right.join(up, F.floor(F.col("slot") / fanout) == F.col("__up"), "left_semi")
        front = cut(left.join(right, "slot", "full_outer").filter(~F.col("l").eqNullSafe(F.col("r"))))
    change = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").otherwise("changed")
    return front.select("slot", change.alias("change"))


def refined(nodes: DataFrame, edges: DataFrame, most_rounds: int = 32) -> DataFrame:
    """(id, cls): colours of one-dimensional refinement over ordered out-edges (src, dst, pos), until their number is stable."""
    colours = cut(nodes.select("id", F.sha2(F.concat_ws("|", F.lit("local"), F.col("label")), 256).alias("cls")))
    n = colours.select("cls").distinct().count()
    for _ in range(most_rounds):
        below = edges.join(colours, edges["dst"] == colours["id"], "left").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("cls", F.lit("dangling")).alias("c")))).alias("below"))
        text = F.concat_ws("|", F.col("cls"), F.array_join(F.transform("below", lambda x: F.concat_ws(":", x["pos"].cast("string"), x["c"])), ","))
        last, colours = colours, cut(colours.join(below, colours["id"] == below["src"], "left").select("id", F.sha2(text, 256).alias("cls")))
        dropped(last)
        m = colours.select("cls").distinct().count()
        if m == n:
            break
        n = m
    return colours


def families(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of undirected edges (src, dst), the least node as root; pointer jumping halves chains each round."""
    both = cut(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("root").alias("m"))
        low = labels.join(near, labels["node"] == near["src"]).select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        hop = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        new = cut(low.join(hop, low["root"] == hop["via"], "left").select("node", "was", F.least("root", F.coalesce("far", "root")).alias("root")))
        dropped(labels)
        labels = new
        if new.filter("root <> was").isEmpty():
            dropped(both)
            return labels.select("node", "root")


def strong_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, component) of directed edges: colours run forward by the greatest node, and back along equal colours from each colour's own node."""
    left = cut(edges.select("src", "dst").distinct())
    nodes = cut(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct())
    done = None
    for _ in range(most_rounds):
        if nodes.isEmpty():
            return done
        colour = cut(nodes.withColumn("colour", F.col("node")))
        while True:
            seen = left.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("c"))
            new = cut(colour.join(seen, "node", "left").select("node", F.col("colour").alias("was"), F.greatest("colour", F.coalesce("c", "colour")).alias("colour")))
            colour = new.select("node", "colour")
            if new.filter("colour <> was").isEmpty():
                break
        found = cut(colour.filter("node = colour"))
        front = found
        inner = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("colour"))
        inner = cut(inner)
        while True:
            back = front.select(F.col("node").alias("dst"), "colour").join(inner, ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            front = cut(back.join(found, ["node", "colour"], "left_anti"))
            if front.isEmpty():
                break
            found = cut(found.unionByName(front))
        part = found.select("node", F.col("colour").alias("component"))
        done = part if done is None else cut(done.unionByName(part))
        nodes = cut(nodes.join(part, "node", "left_anti"))
        left = cut(left.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi"))
    raise ValueError(f"no end after {most_rounds} rounds")


def chain_depths(parents: DataFrame) -> DataFrame:
    """(node, depth, cyclic) of a forest (node, parent): walks up all at once, doubling; what has no end after as many steps as there are nodes is cyclic."""
    state = cut(parents.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")))
    span, nodes = 1, state.count()
    while span <= nodes and not state.filter("up IS NOT NULL").isEmpty():
        nxt = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        last, state = state, cut(state.join(nxt, "up", "left").select("node", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth")))
        dropped(last)
        span *= 2
    return state.select("node", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"), F.col("up").isNotNull().alias("cyclic"))


def unique_then_mutual(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, how): nodes (id, ident, context array) paired first by identities unique on both sides, then by mutual best context overlap within an identity.

    Identities that either side repeats are compared within their group; a group is as large as its repeats.
    """
    counts = lambda d: d.groupBy("ident").agg(F.count("*").alias("n"))
    both = counts(a).withColumnRenamed("n", "na").join(counts(b).withColumnRenamed("n", "nb"), "ident")
    left = a.select(F.col("id").alias("a"), "ident", F.col("context").alias("ca")).join(both, "ident")
    right = b.select(F.col("id").alias("b"), "ident", F.col("context").alias("cb"))
    pairs = left.join(right, "ident").withColumn("score", F.size(F.array_intersect("ca", "cb")))
    exact = pairs.filter("na = 1 AND nb = 1").select("a", "b", F.lit("unique").alias("how"))
    rest = pairs.filter("na > 1 OR nb > 1")
    best_a = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    best_b = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("score"), "a"))
    mutual = rest.withColumns({"ra": best_a, "rb": best_b}).filter("ra = 1 AND rb = 1").select("a", "b", F.lit("context").alias("how"))
    return exact.unionByName(mutual)
