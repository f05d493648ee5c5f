"""Queries of ownership graphs: each customer is owned by richer ones of its nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.operators import graphs
from lumenfold.plans.registry import query, table

_EDGES = """
    c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS nth, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
    e AS (SELECT a.c_custkey AS child, b.c_custkey AS parent, max(CASE WHEN a.c_custkey % 6 = 0 THEN 1.0::DOUBLE ELSE round((a.c_acctbal + 12000) / 22000, 2) END) AS confidence
      FROM c a JOIN c b ON a.c_nationkey = b.c_nationkey AND (b.nth = (a.nth + 0) % a.n + 1 OR b.nth = (a.nth + 2) % a.n + 1) GROUP BY ALL)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next and the third next by balance own a customer; behind the richest the poorest follow, so there are cycles."""
    nation = W.partitionBy("c_nationkey")
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal", F.row_number().over(nation.orderBy("c_acctbal", "c_custkey")).alias("nth"), F.count(F.lit(1)).over(nation).alias("n"))
    held = F.when(F.col("c_custkey") % 6 != 0, F.round((F.col("c_acctbal") + 12000) / 22000, 2))
    ways = c.select("c_nationkey", F.col("c_custkey").alias("child"), held.alias("confidence"), F.explode(F.array(F.col("nth") % F.col("n") + 1, (F.col("nth") + 2) % F.col("n") + 1)).alias("nth"))
    return ways.join(c.select("c_nationkey", "nth", F.col("c_custkey").alias("parent")), ["c_nationkey", "nth"]).select("child", "parent", "confidence")


@query(
    f"""WITH RECURSIVE {_EDGES},
    w(origin, parent, confidence, depth, path) AS (SELECT child, parent, confidence, 1, [child, parent] FROM e WHERE child <> parent
      UNION ALL SELECT w.origin, e.parent, w.confidence * e.confidence, w.depth + 1, list_append(w.path, e.parent) FROM w JOIN e ON e.child = w.parent WHERE w.depth < 4 AND NOT list_contains(w.path, e.parent))
    SELECT origin, parent, round(confidence, 8) AS confidence, depth FROM w QUALIFY row_number() OVER (PARTITION BY origin, parent ORDER BY round(w.confidence, 12) DESC, depth) = 1"""
)
def ownership_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-217: the most confident way of up to four levels from each origin to each parent."""
    return graphs.parent_exposure(_edges(spark, sf_dir)).withColumn("confidence", F.round("confidence", 8))


@query(
    f"""WITH RECURSIVE {_EDGES},
    w(origin, here, depth) AS (SELECT child, parent, 1 FROM e UNION SELECT w.origin, e.parent, w.depth + 1 FROM w JOIN e ON e.child = w.here WHERE w.depth < 4)
    SELECT origin AS node, CAST(min(depth) AS INTEGER) AS length FROM w WHERE origin = here GROUP BY 1"""
)
def ownership_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-220: nodes that own themselves over up to four levels."""
    return graphs.ownership_cycles(_edges(spark, sf_dir))


@query(
    f"""WITH {_EDGES}, n AS (SELECT c_custkey AS node FROM customer WHERE c_mktsegment = 'MACHINERY'), o AS (SELECT * FROM e WHERE child <> parent)
    SELECT node, parent AS other, 'parent' AS direction, round(confidence, 6) AS confidence FROM n JOIN o ON child = node UNION ALL SELECT node, child, 'child', round(confidence, 6) FROM n JOIN o ON parent = node"""
)
def related_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-124, O-218: what stands one edge above or below each customer of a segment."""
    nodes = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("node"))
    return graphs.related(nodes, _edges(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))
