"""Queries of clustering: labels with link counts, and the events that clusters make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import moments, score
from lumenfold.operators import clusters
from lumenfold.plans.registry import query, table

#: The given vectors are nearly random: at the default of 0.80 no two of them are alike.
THRESHOLD = 0.4

_LABELS = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
walk AS (SELECT vec_id AS node, vec_id AS here FROM v UNION SELECT w.node, p.b FROM walk w JOIN pairs p ON p.a = w.here),
marks AS (SELECT node, min(here) AS cluster_id FROM walk GROUP BY 1),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY 1),
found AS (SELECT node AS item_id, cluster_id, coalesce(n, 0) AS n_links, count(*) OVER (PARTITION BY cluster_id) AS size FROM marks LEFT JOIN links ON a = node)
"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


@query(_LABELS + "SELECT item_id, cluster_id, n_links, size FROM found")
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-134, O-208, O-211: single-link clusters of all vectors; the least id is the label."""
    return clusters.single_link(_items(spark, sf_dir), THRESHOLD)


@query(
    _LABELS
    + """,
articles AS (
  SELECT f.cluster_id, d.doc_id, d.source, e.ts, q.authority, d.text FROM found f JOIN documents d ON d.doc_id = f.item_id JOIN events e ON e.event_id = d.doc_id
  LEFT JOIN (SELECT source, avg(quality) AS authority FROM documents JOIN labels USING (doc_id) GROUP BY 1) q ON q.source = d.source
),
g AS (SELECT cluster_id, count(*) AS articles, count(DISTINCT source) AS sources, min(ts) AS first_at, max(ts) AS last_at, avg(authority) AS authority, min(doc_id) AS lead_id FROM articles GROUP BY 1),
s AS (SELECT *, greatest(1.0, (epoch_us(last_at) - epoch_us(first_at)) / 3.6e9) AS span, least(1.0, 0.3 + 0.2 * sources) AS base FROM g)
SELECT cluster_id, articles, sources, first_at, last_at, lead_id,
  round(100 * (0.6 * tanh(articles / 5.0) + 0.4 * tanh(sources / 3.0)), 2) AS severity,
  round(100 * (0.30 * tanh(articles / 8.0) + 0.25 * tanh(articles / span / 3.0) + 0.20 * tanh(sources / 4.0) + 0.15 * coalesce(authority, 0.5) + 0.10 * 0.5), 2) AS hotness,
  round(sources / articles, 4) AS diversity, round(authority, 4) AS mean_authority,
  round(CASE WHEN authority IS NULL THEN base ELSE least(1.0, 0.5 * base + 0.5 * authority) END, 4) AS confidence
FROM s"""
)
def cluster_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-063, O-145, O-212: an event for each cluster of articles, with its features; the first article leads.

    A source's authority is the mean quality label of its documents. Novelty isn't measured, so hotness takes the midpoint.
    """
    docs = table(spark, sf_dir, "documents")
    found = clusters.single_link(_items(spark, sf_dir), THRESHOLD)
    authority = docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("authority"))
    articles = found.join(docs.select("doc_id", "source"), F.col("item_id") == F.col("doc_id")).join(table(spark, sf_dir, "events").select("event_id", "ts"), F.col("event_id") == F.col("doc_id")).join(authority, "source", "left")
    g = articles.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("articles"), F.count_distinct("source").alias("sources"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.avg("authority").alias("authority"), F.min("doc_id").alias("lead_id")
    )
    n, s, a = F.col("articles"), F.col("sources"), F.col("authority")
    return g.select(
        "cluster_id", "articles", "sources", "first_at", "last_at", "lead_id",
        score.event_severity(n, s).alias("severity"),
        score.event_hotness(n, s, moments.span_hours(F.col("first_at"), F.col("last_at")), a).alias("hotness"),
        score.source_diversity(n, s).alias("diversity"),
        F.round(a, 4).alias("mean_authority"),
        score.event_confidence(s, a).alias("confidence"),
    )
