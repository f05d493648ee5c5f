"""Bounded walks over redirect and ownership edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.stages import Stages


def follow_redirects(starts: DataFrame, edges: DataFrame, most_hops: int = 16) -> DataFrame:
    """(node, target, hops, status): where each node ends up.

    ``edges`` (old, new). status is ok, fork (two targets), cycle or too_deep. Each
    hop is one equi-join, in which walks that have ended match nothing.
    """
    step = edges.groupBy("old").agg(F.min("new").alias("new"), F.count_distinct("new").alias("n"))
    walk = starts.select(F.col("node"), F.col("node").alias("at"), F.array("node").alias("path"), F.lit("open").alias("status"))
    for _ in range(most_hops + 1):
        moved = walk.join(step, (walk["at"] == step["old"]) & (walk["status"] == "open"), "left")
        seen = F.when(F.col("old").isNull(), "ok").when(F.col("n") > 1, "fork").when(F.array_contains("path", F.col("new")), "cycle").otherwise("open")
        status = F.when(F.col("status") == "open", seen).otherwise(F.col("status"))
        goes = F.col("old").isNotNull() & (status == "open")
        walk = moved.select(
            "node", F.when(goes, F.col("new")).otherwise(F.col("at")).alias("at"), F.when(goes, F.array_append("path", F.col("new"))).otherwise(F.col("path")).alias("path"), status.alias("status")
        )
    final = F.when(F.col("status") == "open", "too_deep").otherwise(F.col("status"))
    return walk.select("node", F.col("at").alias("target"), (F.size("path") - 1).alias("hops"), final.alias("status"))


PLACES = 12  # of a product of confidences: beyond, two ways are equally confident


def _best_edges(edges: DataFrame) -> DataFrame:
    """(child, parent, confidence): the most confident edge of each pair, between 0 and 1; a null confidence counts as 1."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0))))
    return edges.where("child <> parent").groupBy("child", "parent").agg(F.max(held).alias("confidence"))


def parent_exposure(edges: DataFrame, most_levels: int = 4) -> DataFrame:
    """(origin, parent, confidence, depth): the best path of up to ``most_levels`` edges to each parent; confidences multiply.

    ``edges`` (child, parent, confidence), null as 1. The most confident path counts, of equal ones the shortest. A
    path never gains by visiting a node twice, as confidences are 1 at most, so paths aren't written down: each level
    keeps a row for each origin and node, and only if it is more confident than all shorter ways. That
    is enough, since a longer and weaker way can't become part of a best one. An origin isn't a parent of its own.
    """
    stages = Stages(edges.sparkSession, "exposure")
    up = stages.keep(_best_edges(edges))
    step = up.select(F.col("child").alias("__c"), F.col("parent").alias("__p"), F.col("confidence").alias("__f"))
    level = stages.keep(up.select(F.col("child").alias("origin"), "parent", "confidence"))
    best = level.withColumn("depth", F.lit(1))
    for depth in range(2, most_levels + 1):
        reached = level.join(step, F.col("parent") == F.col("__c")).where("__p <> origin")
        reached = reached.groupBy("origin", F.col("__p").alias("parent")).agg(F.max(F.round(F.col("confidence") * F.col("__f"), PLACES)).alias("confidence"))
        known = best.select("origin", "parent", F.col("confidence").alias("held"), F.col("depth").alias("held_depth"))
        level = stages.keep(reached.join(known, ["origin", "parent"], "left").where("held is null or confidence > held").select("origin", "parent", "confidence"))
        both = best.unionByName(level.withColumn("depth", F.lit(depth)))
        best = stages.keep(both.groupBy("origin", "parent").agg(F.max_by("depth", F.struct("confidence", -F.col("depth"))).alias("depth"), F.max("confidence").alias("confidence")).select("origin", "parent", "confidence", "depth"))
    return best.select("origin", "parent", "confidence", "depth")


def ownership_cycles(edges: DataFrame, most_levels: int = 4) -> DataFrame:
    """(node, length): the nodes on a cycle of up to ``most_levels`` edges, and the length of the shortest; an edge to itself is one of length 1."""
    stages = Stages(edges.sparkSession, "cycles")
    pairs = stages.keep(edges.select("child", "parent").dropna().distinct())
    step = pairs.where("child <> parent").select(F.col("child").alias("__c"), F.col("parent").alias("__p"))
    loops = pairs.where("child = parent").select(F.col("child").alias("node"), F.lit(1).alias("length"))
    level = pairs.where("child <> parent").select(F.col("child").alias("origin"), "parent")
    seen = level
    for length in range(2, most_levels + 1):
        reached = stages.keep(level.join(step, F.col("parent") == F.col("__c")).select("origin", F.col("__p").alias("parent")).distinct())
        loops = loops.unionByName(reached.where("origin = parent").select(F.col("origin").alias("node"), F.lit(length).alias("length")))
        level = stages.keep(reached.where("origin <> parent").join(seen, ["origin", "parent"], "left_anti"))
        seen = seen.unionByName(level)
    return loops.groupBy("node").agg(F.min("length").alias("length"))


def related(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, other, direction, confidence): the parents and children one edge away from each node."""
    best = _best_edges(edges)
    up = nodes.join(best, F.col("node") == F.col("child")).select("node", F.col("parent").alias("other"), F.lit("parent").alias("direction"), "confidence")
    return up.unionByName(nodes.join(best, F.col("node") == F.col("parent")).select("node", F.col("child").alias("other"), F.lit("child").alias("direction"), "confidence"))
