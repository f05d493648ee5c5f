"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    A local session without one (a test) gets a temporary folder; a cluster's has to name it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lumenfold-"))
    return context.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under :func:`shared_root` for a table that a job writes."""
    return f"{shared_root(spark)}/lumenfold/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the lineage ends in files that survive a lost executor."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one job in a folder of their own, deleted as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.nth = spark, shared_path(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` as Parquet and reads it back."""
        self.nth += 1
        at = f"{self.path}/{self.nth}"
        df.write.option("compression", "lz4").parquet(at)
        kept = self.spark.read.schema(df.schema).parquet(at)
        kept.kept_at = at
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            delete(self.spark, table.kept_at)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a finished table by the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


HOT_ROWS = 1_000  # rows of a key from which it is hot, in a table of fewer than 100 million rows
MOST_HOT = 100_000  # hot keys at most: they are broadcast


def join_hot_apart(many: DataFrame, one: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has each key once and its number of rows in ``many``.

    A key with very many rows would fill one task. There are at most MOST_HOT keys
    with over total / MOST_HOT rows each, so those of ``one`` are broadcast, and the
    others are joined by a shuffle. ``many`` is read twice and has to be a written table.
    """
    least = max(HOT_ROWS, total // MOST_HOT)
    hot, rest = F.broadcast(one.where(F.col(rows) > least)), one.where(F.col(rows) <= least)
    names = F.broadcast(one.where(F.col(rows) > least).select(key))
    return many.join(hot, key).unionByName(many.join(names, key, "left_anti").join(rest, key))


def row_key(doc_id: str, text: str) -> list[Column]:
    """(doc_id, h): what tells documents apart; ids may repeat or be null."""
    return [F.col(doc_id).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("h")]


def without(docs: DataFrame, dropped: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` without the rows whose (doc_id, h) is in ``dropped``; a null doc_id is a value like others."""
    gone = dropped.select(F.col("doc_id").alias("__dropped"), F.col("h").alias("__h")).distinct()
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["__dropped"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == gone["__h"]), "left_anti")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; ``lower`` would change other letters too."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def require(df: DataFrame, *names: str) -> None:
    """Fails early when a column that an operator reads is missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
