"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def component_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for each node of ``edges`` (u, v): label is the component's least node.

    Alternates large-star and small-star steps, which need O(log^2 n) rounds. Each
    round is checkpointed, so neither the lineage nor a lost executor grows the work.
    Nodes without an edge have no row: they are their own component.
    """
    # The edges are cut first: each step reads its input twice.
    current, before = cut(_small_star(cut(edges))), None
    for _ in range(max_rounds):
        state = current.agg(F.count(F.lit(1)), F.expr("coalesce(sum(cast(xxhash64(u, v) as decimal(38, 0))), 0)")).first()
        if tuple(state) == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        before = tuple(state)
        current = cut(_small_star(_large_star(current)))
    raise RuntimeError("components did not settle")
