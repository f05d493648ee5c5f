"""Near-duplicates: SimHash fingerprints by ball hashing, a prefix-filtered join of word shingles for what they miss, and an exact check of each pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import Scratch, join_hot_apart, require, row_key, text_or_empty, without
from lumenfold.llm.components import component_labels
from lumenfold.llm.simhash import fingerprint_column, near_links

SHINGLE = 5  # words; texts are alike from a Jaccard similarity of 4/5 on
SEED = 42
SAMPLED = 4_000  # documents of a task, or
COUNTED = 2_000_000  # shingles, that are counted together before the common ones are looked for
COMMON = 3  # documents that make a shingle common
MOST_COMMON = 1_000_000  # common shingles sent to the workers
CROWDED = 8  # prefixes, of all texts, that make a shingle common, too
RECUTS = 2  # times that prefixes are cut anew once more shingles are known to be common
MOST_BROADCAST = 1_000_000  # documents to be checked, up to which their keys are broadcast
HEADS = 2  # holders of a shingle that all others are checked against before components are first known
MOST_HELD = 2_000_000  # shared shingles (8 bytes each) up to which they are broadcast
BITS = 512  # of a text's bitmap: it tells apart texts of up to 2 * BITS shingles
WIDEST = 16_384  # bits of the second bitmap that longer texts have: half their shingles, as a power of two, up to this
SPLIT = 256  # pairs of one text that are checked together


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of all runs of SHINGLE words; a shorter text is one run.

    Words are those of the SimHash fingerprint: A-Z lower-cased, cut at ASCII white space.
    """
    words = (text or "").encode().lower().split()
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([hashed(joined, SEED)], dtype=np.uint64).view(np.int64)
    ends = list(accumulate(len(w) + 1 for w in words))
    spans = zip([0, *ends], ends[SHINGLE - 1 :], strict=False)
    return np.unique(np.array([hashed(joined[s : e - 1], SEED) for s, e in spans], dtype=np.uint64).view(np.int64))


def _prefix(tokens: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first tokens in an order that is the same for all texts: the most common ones last, then by hash.

    Texts alike by 4/5 share at least 4/5 of either's tokens, so any prefixes of n - ceil(4n/5) + 1 meet.
    """
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        tokens = tokens[np.argsort(np.where(common[at] == tokens, times[at], 0), kind="stable")]
    return tokens[: len(tokens) // 5 + 1]


def _bitmap(tokens: np.ndarray, size: int = BITS) -> np.ndarray:
    """``size`` bits as int64 words, each the parity of the tokens that fall on it.

    A token that only one of two sets has changes one bit, so bitmaps differ in no more
    bits than the sets differ in tokens.
    """
    odd = np.bincount(tokens & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _wide(tokens: np.ndarray) -> np.ndarray:
    """The bitmap of a text of over 2 * BITS shingles, as wide as the text is long; none for a shorter one."""
    if len(tokens) <= 2 * BITS:
        return np.array([], dtype=np.int64)
    return _bitmap(tokens, min(WIDEST, 1 << (len(tokens) // 2 - 1).bit_length()))


def _wide_differ(a: Column, b: Column) -> Column:
    """Bits in which two wide bitmaps differ, 0 if a text has none.

    Sizes of alike texts differ by a quarter at most, so one bitmap is as wide as the
    other or twice that: the exclusive or of its halves is the bitmap of half the width.
    """
    least = F.least(F.size(a), F.size(b))

    def narrowed(x: Column) -> Column:
        halves = F.zip_with(F.slice(x, F.lit(1), least), F.slice(x, least + 1, least), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) == 2 * least, halves).otherwise(x)

    each = F.zip_with(narrowed(a), narrowed(b), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.when(least == 0, 0).otherwise(F.aggregate(each, F.lit(0), lambda so_far, x: so_far + x))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.array([], dtype=np.int64)))


def _mapped(rows: DataFrame, keep: list[str], pick: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The columns of ``keep``, sid (a hash of the text's shingle set), n (its size), its bitmaps and what ``pick`` takes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingles(t) for t in part.column("text").to_pylist()]
                sids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
                made = [pa.array(sids), pa.array([len(s) for s in sets], pa.int32()), *(_lists([of(s) for s in sets]) for of in (_bitmap, _wide, pick))]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *made], names=[*keep, "sid", "n", "bits", "wide", "tokens"])

    longs = T.ArrayType(T.LongType())
    fields = [*(rows.schema[k] for k in keep), T.StructField("sid", T.LongType()), T.StructField("n", T.IntegerType()), *(T.StructField(k, longs) for k in ("bits", "wide", "tokens"))]
    return rows.select(*keep, "text").mapInArrow(run, T.StructType(fields))


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in several documents, and in how many, counted over all texts.

    Tasks count runs of their texts; what stands once in each run is left to the counts of all
    prefixes. Which shingles are known as common changes the work, not the result.
    """
    most, longest = SAMPLED, COUNTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, n = [], 0

        def counted() -> pa.RecordBatch:
            t, k = np.unique(np.concatenate(sets), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(t[k > 1]), pa.array(k[k > 1])], names=["t", "k"])

        for batch in batches:
            for text in batch.column("text"):
                sets.append(shingles(text.as_py()))
                n += len(sets[-1])
                if len(sets) >= most or n >= longest:
                    yield counted()
                    sets, n = [], 0
        if sets:
            yield counted()

    counts = rows.select("text").mapInArrow(run, "t long, k long").groupBy("t").agg(F.sum("k").alias("k")).where(F.col("k") >= COMMON)
    found = counts.orderBy(F.desc("k"), "t").limit(MOST_COMMON).collect()
    return _by_shingle(np.array([r["t"] for r in found], dtype=np.int64), np.array([r["k"] for r in found], dtype=np.int64))


def _by_shingle(common: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by shingle; of one that stands there twice the larger count, and the MOST_COMMON of the largest counts."""
    order = np.lexsort((-times, common))
    common, times = common[order], times[order]
    first = np.concatenate(([True], common[1:] != common[:-1])) if len(common) else np.array([], dtype=bool)
    common, times = common[first], times[first]
    if len(common) > MOST_COMMON:
        kept = np.sort(np.argsort(-times, kind="stable")[:MOST_COMMON])
        common, times = common[kept], times[kept]
    return common, times


def _prefixes(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(known, held): the rows with their prefixes, and the shingles that several prefixes hold, with how many.

    A shingle that no task has found to be common may still stand in the prefixes of
    many texts, which would all meet each other. So the prefixes are counted over all
    texts, the crowded shingles join the common ones, and the prefixes are cut again:
    what a text holds alone comes first, at any size of the corpus. Any order that is the same for all texts is exact.
    """
    common, times = _common(rows)
    for nth in range(RECUTS + 1):
        order = (common, times)
        known = scratch.keep(_mapped(rows, ["doc_id", "h"], lambda s, order=order: _prefix(s, *order)))
        held = scratch.keep(known.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
        crowded = held.where(F.col("k") > CROWDED).orderBy(F.desc("k"), "t").limit(MOST_COMMON)
        found = crowded.collect() if nth < RECUTS else []
        more = np.array([r["t"] for r in found], dtype=np.int64)
        if not np.setdiff1d(more, common).size:
            break
        common, times = _by_shingle(np.concatenate((common, more)), np.concatenate((times, np.array([r["k"] for r in found], dtype=np.int64))))
        scratch.drop(known, held)
    return known, held


def _fingerprint_pairs(rows: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, u): the sids that the links of the texts' SimHash fingerprints connect, found by ball hashing; not yet checked.

    A fingerprint stands for the least sid that has it; others that have it, too, are linked to that one.
    """
    marked = rows.select("doc_id", "h", fingerprint_column(F.col("text")).alias("fp")).dropDuplicates(["doc_id", "h"])
    fps = scratch.keep(marked.join(ids.distinct(), ["doc_id", "h"]).select("fp", "sid").distinct())
    one = scratch.keep(fps.groupBy("fp").agg(F.min("sid").alias("first"), F.count(F.lit(1)).alias("k")))
    links = scratch.keep(near_links(one.select("fp")))
    total, named = links.count(), links
    for side in "vu":
        firsts = links.groupBy(side).agg(F.count(F.lit(1)).alias("m")).join(one.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_sid")), side)
        named = scratch.keep(join_hot_apart(named, scratch.keep(firsts), side, "m", total).drop("m"))
    same = join_hot_apart(fps, one, "fp", "k", fps.count()).select(F.col("first").alias("v_sid"), F.col("sid").alias("u_sid"))
    found = named.select("v_sid", "u_sid").unionByName(same).where("v_sid <> u_sid")
    return scratch.keep(found.select(F.least("u_sid", "v_sid").alias("v"), F.greatest("u_sid", "v_sid").alias("u")).distinct())


def _alike(pairs: DataFrame, rows: DataFrame, once: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (v, u) whose whole shingle sets are alike; ``once`` has a row of each sid.

    The sets of a text that is in very many pairs are dealt out to several tasks.
    """
    sids = pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct()
    keys = scratch.keep(once.join(sids, "sid", "left_semi").select("doc_id", "h"))
    texts = rows.join(F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys, ["doc_id", "h"], "left_semi")
    sets = scratch.keep(_mapped(texts, [], lambda s: s).dropDuplicates(["sid"]).select("sid", "tokens"))
    total, dealt = pairs.count(), pairs
    copies = {}
    for side in "vu":
        counts = scratch.keep(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("in_pairs")))
        parts = F.ceil(F.col("in_pairs") / SPLIT)
        dealt = scratch.keep(join_hot_apart(dealt, counts, side, "in_pairs", total).withColumn(f"{side}_part", F.pmod(F.xxhash64("u", "v"), parts)).drop("in_pairs"))
        each = counts.join(sets.select(F.col("sid").alias(side), F.col("tokens").alias(f"of_{side}")), side)
        copies[side] = each.select(side, f"of_{side}", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias(f"{side}_part"))
    # Pairs are small until the first set joins them: one set a pair is shuffled.
    met = dealt.join(copies["v"], ["v", "v_part"]).join(copies["u"], ["u", "u_part"])
    both = F.size(F.array_intersect("of_v", "of_u"))
    checked = scratch.keep(met.where(9 * both >= 4 * (F.size("of_v") + F.size("of_u"))).select("v", "u"))
    scratch.drop(keys, sets)
    return checked


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, keep_id) of the rows with a doc_id: keep_id is the least doc_id of the row's group.

    Texts are alike if the Jaccard similarity of their sets of 5-word shingles is 0.8
    or more; groups are connected by such pairs. No pair that connects is missed, and
    each was checked on the whole sets. Null texts count as empty, texts without words are alike.

    1. Texts whose SimHash fingerprints, those of op1, lie within 4 bits are found by its ball search and checked. At a
       similarity of 0.8 fingerprints differ in about ten bits, so this finds the closest copies; steps 2 to 4 find what is left.
    2. Prefixes of the sets are joined on their shingles: texts alike share one.
    3. Each text is checked against up to HEADS holders of its shingles, if they share half of
       a prefix: a large group of near copies takes a few pairs a member, not one a pair of members.
    4. Of each shingle's holders, those outside of its largest group so far meet all holders
       of other groups, if both places in the prefixes and the bitmaps of the whole sets
       still allow 0.8: all meetings of an alike pair do. Pairs within a group aren't looked at. Behind the last shared
       shingle of two prefixes, texts can't share more than what is left of the shorter
       one: pairs that can't be alike any more are left out before their sets are read.
    """
    require(docs, doc_id, text)
    scratch = Scratch(docs.sparkSession, "near")
    rows = docs.where(F.col(doc_id).isNotNull()).select(*row_key(doc_id, text), text_or_empty(text).alias("text"))
    known, held = _prefixes(rows, scratch)
    ids = scratch.keep(known.select("doc_id", "h", "sid"))
    once = scratch.keep(ids.groupBy("sid").agg(F.min(F.struct("doc_id", "h")).alias("rep")).select("sid", "rep.*"))
    dealt = known.select("sid", "n", F.posexplode("tokens").alias("at", "t"))
    n_held, total = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("k"), F.lit(0))).first()
    if n_held <= MOST_HELD:
        places = dealt.join(F.broadcast(held.select("t")), "t", "left_semi")
    else:
        places = join_hot_apart(dealt, held, "t", "k", total).drop("k")
    # Documents of equal sets have equal lists.
    places = scratch.keep(places.distinct())
    bitmaps = scratch.keep(known.select("sid", "bits", "wide").dropDuplicates(["sid"]))
    scratch.drop(known)

    fits: Column = 5 * F.least("v_n", "u_n") >= 4 * F.greatest("v_n", "u_n")
    pairs = _fingerprint_pairs(rows, ids, scratch)
    # The text that most copies were made of shares the most with others; it is the first head.
    central = held.join(places, "t").groupBy("sid").agg(F.sum("k").alias("weight"))
    weighed = scratch.keep(places.join(central, "sid"))
    for nth in range(HEADS):
        by = F.col("weight") if nth == 0 else F.xxhash64(F.lit(nth), "sid")
        first = F.max(F.struct(by.alias("by"), F.col("sid").alias("u"), F.col("n").alias("u_n"))).alias("head")
        one = scratch.keep(weighed.groupBy("t").agg(first, F.count(F.lit(1)).alias("k")).where("k > 1").select("t", "head.u", "head.u_n", "k"))
        met = join_hot_apart(places.select("t", F.col("sid").alias("v"), F.col("n").alias("v_n")), one, "t", "k", total).where((F.col("u") != F.col("v")) & fits)
        each = met.groupBy("v", "u", "v_n", "u_n").agg(F.count(F.lit(1)).alias("shared")).where(10 * F.col("shared") >= F.least("v_n", "u_n"))
        each = each.groupBy("v").agg(F.max_by("u", F.struct("shared", "u")).alias("u"))
        pairs = pairs.unionByName(each.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")))
    pairs = scratch.keep(pairs.distinct())
    scratch.drop(weighed)
    edges = _alike(pairs, rows, once, scratch)

    labels = component_labels(edges).groupBy("node").agg(F.min("label").alias("label")).withColumnRenamed("node", "sid")
    before = F.row_number().over(Window.partitionBy("sid").orderBy("at")) - 1  # shared shingles that stand before this one
    placed = places.withColumn("before", before).join(labels, "sid", "left")
    placed = scratch.keep(placed.select("t", F.struct("sid", "n", "at", "before").alias("o"), F.coalesce("label", "sid").alias("label")))
    scratch.drop(places)
    groups = placed.groupBy("t", "label").agg(F.count(F.lit(1)).alias("m"))
    groups = groups.groupBy("t").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.count(F.lit(1)).alias("n_groups"), F.sum("m").alias("k"))
    split = scratch.keep(groups.where("n_groups > 1").select("t", "main", "k"))
    apart = join_hot_apart(placed, split, "t", "k", total)
    apart = scratch.keep(apart.join(bitmaps.withColumnRenamed("sid", "of"), F.col("o.sid") == F.col("of")).drop("of"))
    scratch.drop(placed, split, bitmaps)
    crossing = (F.col("a.label") != F.col("b.label")) & ((F.col("b.label") == F.col("b.main")) | (F.col("a.o.sid") < F.col("b.o.sid")))
    # Each shingle that two texts share is met once, so they can be counted a pair.
    both = apart.where("label <> main").alias("a").join(apart.alias("b"), F.col("a.t") == F.col("b.t")).where(crossing)
    differ = sum((F.bit_count(F.col("a.bits")[i].bitwiseXOR(F.col("b.bits")[i])) for i in range(BITS // 64)), F.lit(0))
    # Alike sets differ in a ninth of their sizes' sum at most.
    both = both.where((9 * differ <= F.col("a.o.n") + F.col("b.o.n")) & (9 * _wide_differ(F.col("a.wide"), F.col("b.wide")) <= F.col("a.o.n") + F.col("b.o.n")))
    both = both.select(F.least("a.o", "b.o").alias("v"), F.greatest("a.o", "b.o").alias("u")).select(*[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "vu" for c in ("sid", "n", "at", "before")])
    # Two texts share no more than the shared shingles that both have before this one, and what is left from it on.
    most = F.least("v_before", "u_before") + F.least(F.col("v_n") - F.col("v_at"), F.col("u_n") - F.col("u_at"))
    both = both.where(fits & (9 * most >= 4 * (F.col("v_n") + F.col("u_n"))))
    left = F.least(F.col("v_n") - F.max("v_at"), F.col("u_n") - F.max("u_at")) - 1
    met = both.groupBy(F.col("v_sid").alias("v"), F.col("u_sid").alias("u"), "v_n", "u_n").agg((F.count(F.lit(1)) + left).alias("most"))
    more = met.where(9 * F.col("most") >= 4 * (F.col("v_n") + F.col("u_n"))).select("v", "u")
    more = scratch.keep(more.join(pairs, ["v", "u"], "left_anti"))
    scratch.drop(apart)
    edges = edges.unionByName(_alike(more, rows, once, scratch))

    labels = component_labels(edges).groupBy("node").agg(F.min("label").alias("label")).withColumnRenamed("node", "sid")
    named = scratch.keep(ids.join(labels, "sid", "left").select("doc_id", "h", F.coalesce("label", "sid").alias("group")))
    keep = scratch.keep(named.groupBy("group").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("members")))
    out = scratch.keep(join_hot_apart(named, keep, "group", "members", named.count()).select("doc_id", "h", "keep_id"))
    scratch.drop(ids, once, held, pairs, more, named, keep)
    return out


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of :func:`near_groups`: the one of the least doc_id.

    All columns stay as they are. Rows that repeat a doc_id are one document and don't
    drop each other (they stay apart by their texts, though); rows with a null doc_id
    stay. An empty table gives an empty table.
    """
    found = near_groups(docs, doc_id, text)
    return without(docs, found.where("doc_id > keep_id"), doc_id, text)
