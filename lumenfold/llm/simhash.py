"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import cut, join_hot_apart, require, row_key, without
from lumenfold.llm.components import component_labels

SHINGLE = 4
RADIUS = 4
SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text; 0 when it has no word.

    A-Z are lower-cased, words lie between ASCII white space, shingles count as
    often as they occur. A bit is set if it is set in over half the shingle hashes.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hashed(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    spans = list(zip([0, *ends], ends[shingle - 1 :], strict=False))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(spans), CHUNK):
        block = np.array([hashed(joined[s : e - 1], SEED) for s, e in spans[i : i + CHUNK]], dtype="<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(spans), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long, by an Arrow-batched function."""

    @F.pandas_udf(T.LongType())
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(x, shingle) for x in texts], dtype=np.uint64).view(np.int64))

    return simhash(text)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _masks(bits: int, shift: int, radius: int) -> list[tuple[int, int]]:
    """(bits flipped, mask as a signed long) for all flips of up to ``radius`` of ``bits`` bits."""
    flips = [(r, sum(1 << b for b in c) << shift) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return [(r, m - (1 << 64) if m >= 1 << 63 else m) for r, m in flips]


def _mask_array(masks: list[tuple[int, int]]) -> Column:
    return F.expr("array(" + ", ".join(f"struct({r} as flips, cast('{m}' as bigint) as mask)" for r, m in masks) + ")")


def ball_variants(fps: DataFrame) -> DataFrame:
    """(variant, fp): every variant within 2 bits of each fp, but those that can't meet another's.

    Two fingerprints at 4 bits or fewer have a variant in common that is within 2
    bits of both. They also have a 32-bit half with 2 differing bits or fewer, and
    such a variant can be chosen with at most one flip in that half on either side.
    So each fingerprint first deals out the 33 variants of each half; a half
    variant that a single fingerprint reaches leads to no pair. The others are
    completed in the other half to all variants within 2 bits in sum.
    Dealing out all 2,081 variants at once gives the same pairs with 30 times the
    shuffle (``prefilter=False`` in :func:`near_links`).
    """
    out = []
    for low, high in ((0, 32), (32, 0)):
        half = F.col("fp").bitwiseAND(F.expr(f"cast('{(0xFFFFFFFF << low) - (1 << 64) if low else 0xFFFFFFFF}' as bigint)"))
        dealt = fps.select("fp", half.alias("half"), F.explode(_mask_array(_masks(32, low, 1))).alias("f")).select(
            "fp", F.col("f.flips").alias("flips"), F.col("f.mask").alias("mask"), F.col("half").bitwiseXOR(F.col("f.mask")).alias("meet")
        )
        shared = dealt.withColumn("n", F.expr("count(1) over (partition by meet)")).where("n > 1")
        rest = F.explode(F.when(F.col("flips") == 0, _mask_array(_masks(32, high, 2))).otherwise(_mask_array(_masks(32, high, 1))))
        out.append(
            shared.select("fp", "mask", rest.alias("g")).select(
                F.col("fp").bitwiseXOR(F.col("mask")).bitwiseXOR(F.col("g.mask")).alias("variant"), "fp"
            )
        )
    return out[0].union(out[1]).distinct()


def all_variants(fps: DataFrame) -> DataFrame:
    """(variant, fp): all 2,081 variants within 2 bits of each fp."""
    dealt = fps.select("fp", F.explode(_mask_array(_masks(64, 0, 2))).alias("f"))
    return dealt.select(F.col("fp").bitwiseXOR(F.col("f.mask")).alias("variant"), "fp")


def near_links(fps: DataFrame, prefilter: bool = True) -> DataFrame:
    """Edges (u, v) that connect fingerprints at 4 differing bits or fewer.

    ``fps`` has distinct longs in ``fp``. All fingerprints that share a variant lie
    within 4 bits of each other, so a star around the least one keeps them
    connected with one edge a member instead of one a pair. Each edge is verified.
    """
    variants = ball_variants(fps) if prefilter else all_variants(fps)
    least = F.min("fp").over(W.partitionBy("variant"))
    edges = variants.select(F.col("fp").alias("u"), least.alias("v")).where("u <> v").distinct()
    return edges.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, h, fp (signed long), component_id.

    component_id is the least doc_id that is reachable by links, itself included.
    Null and empty texts and texts without words have fingerprint 0 and link like
    others. Rows that repeat a doc_id count as that document. A null doc_id stays
    null and never is a component_id unless its group has no other. Other columns
    of ``docs`` are not read. An empty table gives an empty table.
    """
    require(docs, doc_id, text)
    # Only ids and fingerprints are kept: texts are read once.
    known = cut(docs.select(*row_key(doc_id, text), fingerprint_column(F.col(text)).alias("fp")))
    firsts = cut(known.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    labels = component_labels(near_links(firsts.select("fp")))
    named = firsts.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = cut(named)
    least = named.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    least, total = cut(least), known.count()
    of_fp = cut(join_hot_apart(named, least, "label", "members", total).select("fp", "n", "component_id"))
    return join_hot_apart(known, of_fp, "fp", "n", total).select("doc_id", "h", "fp", "component_id")


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one of the least doc_id.

    All columns stay as they are. Of the component's rows, those with that doc_id
    stay, repeated ones too; rows of one doc_id whose texts are in different
    components are judged apart; rows with a null doc_id stay.
    """
    found = simhash_components(docs, doc_id, text)
    return without(docs, found.where("doc_id <> component_id"), doc_id, text)
