"""Idempotent sinks over Parquet folders; a rerun with the same rows changes nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.relational import merge_latest


def insert_ignore(new: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """O-016, O-021: the rows to append: one of each key that ``held`` doesn't have.

    Keys with a null always count as new, as in a unique constraint.
    """
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    known = new.where(whole).dropDuplicates(list(keys)).join(held.select(*keys).distinct(), list(keys), "left_anti")
    return known.unionByName(new.where(~whole))


def upsert(new: DataFrame, held: DataFrame, keys: Sequence[str], version: str, path: str) -> None:
    """O-017 to O-020: writes the merged table to ``path``, a folder that ``held`` isn't read from."""
    merge_latest(held, new, keys, version).write.mode("overwrite").parquet(path)


def markdown_lines(df: DataFrame, key: str, title: str, body: str) -> DataFrame:
    """O-023: (key, line): one escaped Markdown section a row."""
    safe = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"([\\`*_{}\[\]()#+!|<>-])", r"\\$1")
    return df.select(key, F.concat(F.lit("## "), safe(title), F.lit("\n\n"), safe(body), F.lit("\n")).alias("line"))
