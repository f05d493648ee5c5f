"""Jump consistent hashing of stable keys to shards, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm.common import cut, require

#: Fixed value: the multiplier of the generator in the published algorithm.
MULTIPLIER = 2862933555777941757


def _next_state(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64 in 16-bit limbs, which no overflow check stops."""
    a = [F.shiftrightunsigned(key, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(4)]
    b = [F.lit((MULTIPLIER >> (16 * i)) & 0xFFFF).cast("long") for i in range(4)]
    carry, out = F.lit(1).cast("long"), None
    for i in range(4):
        total = carry
        for j in range(i + 1):
            total = total + a[j] * b[i - j]
        limb = F.shiftleft(total.bitwiseAND(F.lit(0xFFFF).cast("long")), 16 * i)
        out = limb if out is None else out.bitwiseOR(limb)
        carry = F.shiftrightunsigned(total, 16)
    return out


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a long key, after Lamping and Veach.

    The shard of a key changes only to the new shard when one is appended. Each
    jump moves to a higher shard, so ``shards`` steps are always enough; the first
    64 suffice but for a vanishing share of keys, which get all steps. A null key
    counts as 0.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    start = F.struct(F.coalesce(key.cast("long"), F.lit(0).cast("long")).alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        k = _next_state(s["k"])
        r = F.lit(float(1 << 31)) / (F.shiftrightunsigned(k, 33) + F.lit(1)).cast("double")
        moved = F.struct(k.alias("k"), s["j"].alias("b"), F.floor((s["j"] + F.lit(1)).cast("double") * r).cast("long").alias("j"))
        return F.when(s["j"] < F.lit(shards), moved).otherwise(s)

    def walk(state: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)

    state = walk(start, min(shards, 64))
    if shards > 64:
        state = F.when(state["j"] >= F.lit(shards), state).otherwise(walk(state, shards - 64))
    return state["b"].cast("int")


def shard_rows(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot, grown_shard.

    shard is the jump hash of doc_id and nothing else, so equal ids share a shard
    and an appended shard only takes rows into itself (grown_shard: the shard with
    one more). Ids that aren't whole numbers are hashed to a long first. size is the
    text's UTF-8 bytes plus 1 (null: 1, CRC of no bytes). slot counts a shard's rows from 0
    without gaps: rows are numbered within each input partition, and the
    partitions of a shard follow one another. So no shard is sorted as a whole, and
    a key that holds a third of the rows is spread like others.
    """
    require(docs, doc_id, text)
    key = F.col(doc_id) if docs.schema[doc_id].dataType.typeName() in ("long", "integer", "short", "byte") else F.xxhash64(doc_id)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
        F.monotonically_increasing_id().alias("place"),
    )
    # The places are fixed by the checkpoint: a later rerun of the scan can't change them.
    rows = cut(rows.withColumn("part", F.shiftright("place", 33)))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = rows.withColumn("nth", F.row_number().over(W.partitionBy("shard", "part").orderBy("place")))
    found = numbered.join(starts, ["shard", "part"])
    slot = (F.col("start") + F.col("nth") - 1).cast("long")
    return found.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"), "grown_shard")
