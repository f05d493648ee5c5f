"""DataFrame operators: latest rows, as-of values, top-n, sampling, streaks, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the first by ``order``, which has to be total."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def as_of(df: DataFrame, keys: Sequence[str], moment: str, value: str, cutoff: Column) -> DataFrame:
    """The value at the latest moment up to ``cutoff`` for each key; one shuffle with map-side reduction."""
    return df.where(F.col(moment) <= cutoff).groupBy(*keys).agg(
        F.max(F.struct(moment, value)).alias("__last")
    ).select(*keys, F.col(f"__last.{moment}").alias(moment), F.col(f"__last.{value}").alias(value))


def round_robin(df: DataFrame, source: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows when one row of each source is taken in turn."""
    turn = F.row_number().over(W.partitionBy(source).orderBy(*order))
    return df.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", source).limit(n)


def seeded_sample(df: DataFrame, groups: Sequence[str], key: str, seed: str, n: int) -> DataFrame:
    """n rows a group in the order of a salted hash: the same rows on every run."""
    mix = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    return top_n(df.withColumn("draw", mix), groups, [F.col("draw"), F.col(key)], n)


def streaks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], good: Column) -> DataFrame:
    """Adds streak: how many rows up to this one, in a row, fulfil ``good``."""
    w = W.partitionBy(*keys).orderBy(*order)
    held = F.coalesce(good, F.lit(False))
    run = df.withColumn("__good", held).withColumn("__run", F.sum((~held).cast("int")).over(w))
    inside = W.partitionBy(*keys, "__run").orderBy(*order)
    return run.withColumn("streak", F.sum(F.col("__good").cast("int")).over(inside)).drop("__good", "__run")


def merge_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Upsert of plain files: the row of the highest version stays, the new side wins ties."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest_per_key(both, keys, [F.col(version).desc_nulls_last(), F.col("__new").desc()]).drop("__new")


def reconcile(wanted: DataFrame, held: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, action): inserted, updated, removed or kept, to make ``held`` equal ``wanted``."""
    a = wanted.select(*keys, F.col(value).alias("__a"), F.lit(True).alias("__in_a"))
    b = held.select(*keys, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    action = F.when(F.col("__in_b").isNull(), "inserted").when(F.col("__in_a").isNull(), "removed").when(F.col("__a").eqNullSafe(F.col("__b")), "kept").otherwise("updated")
    return a.join(b, list(keys), "full").select(*keys, action.alias("action"))


def confusion(df: DataFrame, groups: Sequence[str], predicted: Column, actual: Column) -> DataFrame:
    """Counts and rates; a rate without a denominator is null."""
    cell = lambda p, a: F.count_if(predicted.eqNullSafe(F.lit(p)) & actual.eqNullSafe(F.lit(a)))
    out = df.groupBy(*groups).agg(cell(True, True).alias("tp"), cell(True, False).alias("fp"), cell(False, False).alias("tn"), cell(False, True).alias("fn"))
    rate = lambda top, bottom: F.round(F.try_divide(F.col(top), F.expr(bottom)), 6)
    return out.withColumns({"precision": rate("tp", "tp + fp"), "recall": rate("tp", "tp + fn"), "specificity": rate("tn", "tn + fp")})


def prefix_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cost: str, budget: int) -> DataFrame:
    """Rows in order until the first that would exceed the budget."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("spent", F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, 0))).where(F.col("spent") <= budget)
