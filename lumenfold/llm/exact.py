"""Exact deduplication against a persistent digest index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import Scratch, delete, join_hot_apart, require, row_key, shared_path, text_or_empty, without


BUCKET_ROWS = 2_000_000  # digests (about 50 bytes each) that a new index plans for in a bucket


class DigestIndex:
    """A table of text digests, bucketed and sorted by digest.

    Columns: digest (binary SHA-256), keep_id (the document that stays), batch.
    New batches are reduced to one row a digest, compared by a sort-merge anti-join
    that shuffles the new side alone, and what is left is appended. A digest that
    the index holds already keeps its document. Whether a row stays is read from
    the index (its keep_id is the row's id), so a batch that is added again after a
    failure gives the same result and appends nothing.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None) -> None:
        """``path`` is where a new table's files go; an index that exists is opened by its name alone."""
        self.spark, self.name, self.buckets, self.path = spark, name, buckets, path

    def create(self, groups: DataFrame, rows: int) -> None:
        """Creates the empty table; its buckets are planned for ``rows`` documents unless they are given."""
        if not self.exists():
            self.buckets = self.buckets or max(8, -(-rows // BUCKET_ROWS))
            empty = groups.select("digest", "keep_id", F.lit("").alias("batch")).limit(0)
            writer = empty.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            (writer.option("path", self.path) if self.path else writer).saveAsTable(self.name)

    def bucket_count(self) -> int:
        if self.buckets is None:  # opened by name
            described = self.spark.sql(f"describe extended {self.name}").where("col_name = 'Num Buckets'").first()
            self.buckets = int(described["data_type"])
        return self.buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, groups: DataFrame, batch: str) -> None:
        """``groups`` (digest, keep_id) has a digest once; those that the index lacks are appended."""
        n = self.bucket_count()
        fresh = groups.select("digest", "keep_id", F.lit(batch).alias("batch"))
        fresh = fresh.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        writer = fresh.repartition(n, "digest").write.format("parquet").bucketBy(n, "digest").sortBy("digest")
        writer.mode("append").saveAsTable(self.name)

    def drop(self) -> None:
        """Drops the table and its files."""
        self.spark.sql(f"drop table if exists {self.name}")
        if self.path:
            delete(self.spark, self.path)


def digest(text: str) -> Column:
    """SHA-256 of the text's UTF-8 bytes; null counts as empty."""
    return F.unhex(F.sha2(text_or_empty(text), 256))


def exact_groups(docs: DataFrame, index: DigestIndex, batch: str = "first", doc_id: str = "doc_id", text: str = "text", parts: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, h, digest, keep_id, group_size, kept.

    Texts are equal when identical; null counts as empty. Of equal texts the row with
    the largest doc_id stays, unless the index knows the text from an earlier call:
    then none of these stays. group_size counts the rows of ``docs``. Rows that repeat a
    doc_id and a text are the same document and share its fate; rows of one doc_id
    with different texts are judged apart. Rows with a null doc_id are dropped where
    a row with an id has their text; a text without any doc_id has a null keep_id and
    all its rows stay. Other columns are not read. An empty table gives an empty table.

    ``parts`` > 1 adds the rows in ranges of descending (numeric) doc_id, each by its own
    anti-join and append, so one addition never sorts all digests at once; a later
    range finds the texts of the earlier ones in the index, and the result is the same.
    """
    require(docs, doc_id, text)
    # Digests are small: the texts are read once and never shuffled.
    scratch = Scratch(docs.sparkSession, "digests")
    known = scratch.keep(docs.select(*row_key(doc_id, text), digest(text).alias("digest")))
    groups = scratch.keep(known.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id")))
    total = known.count()
    index.create(groups, total)
    if parts == 1:
        index.add(groups, batch)
    else:
        shares = [1 - k / parts for k in range(1, parts)]
        cuts = known.agg(F.percentile_approx("doc_id", shares, 10_000).alias("at")).first()["at"] or []
        for nth, (low, high) in enumerate(zip([*cuts, None], [None, *cuts], strict=True)):
            here = F.lit(True) if high is None else F.col("doc_id").isNull() | (F.col("doc_id") < high)
            here = here if low is None else here & (F.col("doc_id") >= low)
            index.add(known.where(here).groupBy("digest").agg(F.max("doc_id").alias("keep_id")), f"{batch}.{nth}")
    held = scratch.keep(groups.select("digest", "group_size").join(index.table().select("digest", "keep_id"), "digest"))
    scratch.drop(groups)
    found = join_hot_apart(known, held, "digest", "group_size", total)
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return found.select("doc_id", "h", "digest", "keep_id", "group_size", kept.alias("kept"))


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str = "first", doc_id: str = "doc_id", text: str = "text", parts: int = 1) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` calls kept, with all their columns."""
    found = exact_groups(docs, index, batch, doc_id, text, parts)
    return without(docs, found.where(~F.col("kept")), doc_id, text)


def new_index(spark: SparkSession, name: str, buckets: int | None = None) -> DigestIndex:
    """An index under a name that no other run uses, with its files in the shared folder."""
    import uuid

    return DigestIndex(spark, f"{name}_{uuid.uuid4().hex[:12]}", buckets, shared_path(spark, name))
