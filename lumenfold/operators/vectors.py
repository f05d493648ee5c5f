"""Cosine similarity and nearest neighbours on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def nearest(queries: DataFrame, items: DataFrame, k: int, least: float) -> DataFrame:
    """The k most similar items of each query, and of those the ones at ``least`` or more.

    The threshold comes after the limit. ``queries`` (query_id, vector, label) is a
    stated set and is compared with the items of its label (the hard
    filter), which is an equi-join. A vector's norm is worked out once, not once a pair.
    """
    normed = lambda df: df.withColumns({"vector": F.transform("vector", lambda x: x.cast("double")), "norm": F.sqrt(dot(F.col("vector"), F.col("vector")))})
    queries, items = normed(queries), normed(items)
    pairs = queries.alias("q").join(items.alias("i"), F.col("q.label") == F.col("i.label")).where("q.query_id <> i.item_id")
    norms = F.col("q.norm") * F.col("i.norm")
    similarity = F.when(norms > 0, dot(F.col("q.vector"), F.col("i.vector")) / norms).otherwise(0.0)
    scored = pairs.select("q.query_id", "i.item_id", F.round(similarity, 6).alias("similarity"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "item_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).where(F.col("similarity") >= least)
