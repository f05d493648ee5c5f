"""Benchmark decontamination by a prefix-filtered join on shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm.common import Scratch, ascii_lower, cut, require, row_key, text_or_empty, without

WINDOW = 10
SHINGLE = 3
#: Windows of the benchmark up to which it is broadcast (about 150 MB); beyond, both sides are shuffled.
MOST_BROADCAST = 500_000
MOST_DOCS = 1_000_000  # documents with a candidate window up to which their keys are broadcast


#: ASCII characters that no word has, one by one: Java looks such a class up in a table, ranges are tried in turn.
_GAPS = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isdigit() and not chr(c).islower())


def words(text: Column) -> Column:
    """Runs of digits, a-z and characters beyond ASCII, after lower-casing A-Z."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"[^{_GAPS}]++"), F.lit(0))


def _shingles(ws: Column, n: int) -> Column:
    """Hashes of all runs of n words; none if there are fewer."""
    at = F.sequence(F.lit(0), F.size(ws) - F.lit(n))
    runs = F.transform(at, lambda i: F.xxhash64(*[F.get(ws, i + F.lit(k)) for k in range(n)]))
    return F.when(F.size(ws) >= n, runs).otherwise(F.array().cast("array<long>"))


def _once(ws: Column, **more) -> Column:
    """Rows (ws and the columns of ``more``, functions of it) for a select.

    The words are an argument here: a plain column would be put into each use of
    it, and so be cut out of the text again for every word.
    """
    return F.inline(F.transform(F.array(ws), lambda w: F.struct(w.alias("ws"), *[f(w).alias(n) for n, f in more.items()])))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, words, n, shingle_n): the distinct windows of each item.

    A window has ``window`` consecutive words; an item of fewer, but not none, is
    one window. shingle_n is the shingle size that the window is looked up by.
    """
    require(benchmark, item_id, text)
    def cuts(ws: Column) -> Column:
        last = F.greatest(F.size(ws) - F.lit(window - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.slice(ws, i, F.lit(window)))

    items = benchmark.select(F.col(item_id).alias("item_id"), _once(words(text_or_empty(text)), cuts=cuts)).where(F.size("ws") > 0)
    return items.select("item_id", F.explode("cuts").alias("words")).distinct().select("item_id", "words", F.size("words").alias("n"), F.least(F.size("words"), F.lit(SHINGLE)).alias("shingle_n"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, item_ids, contaminated.

    A word is hit if it lies inside an occurrence of a benchmark window. item_ids
    holds the items with an occurring window, sorted as strings. Rows with the same
    doc_id and text share their result; null texts and ids are allowed (no words).

    1. Documents are cut into words once. Their shingles (3 words; fewer in shorter
       windows) that a window has are written with their places, next to one row a document.
    2. Counts of these in all documents order a window's shingles by rarity. A window must
       be contained whole, so its prefix is its rarest shingle alone: documents are joined
       on it, not on all of them.
    3. Bounds: the shingle's place in the window fixes where the window would start;
       it has to start in the document and end in it.
    4. Verification compares all words of the window there, in the documents that are left.

    A benchmark of over ``most_broadcast`` windows isn't broadcast: shingles are shuffled
    then, and documents are cut once more for their word counts.
    """
    require(docs, doc_id, text)
    none = F.array().cast("array<string>")
    rows = docs.select(F.struct(*row_key(doc_id, text)).alias("key"), text_or_empty(text).alias("text"))
    windows = cut(benchmark_windows(benchmark, window))
    sized = windows.groupBy("shingle_n").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a shingle size
    sizes, total = sorted(r["shingle_n"] for r in sized), sum(r["n"] for r in sized)
    n_words = F.size("ws").cast("long").alias("n_words")
    if not sizes:
        counted = rows.select("key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
        return counted.select("key.doc_id", "key.h", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("item_ids"), F.lit(False).alias("contaminated"))
    small = total <= most_broadcast
    side = F.broadcast if small else (lambda df: df)

    # Places of the shingles in each window: (item_id, words, n, shingle_n, place, h).
    hashed = None
    for n in sizes:
        part = windows.where(F.col("shingle_n") == n)
        part = part.select("*", F.posexplode(_shingles(F.col("words"), n)).alias("place", "h"))
        hashed = part if hashed is None else hashed.union(part)
    scratch = Scratch(docs.sparkSession, "shingles")
    lookup = hashed.select("h").distinct()
    first = F.array(F.lit(0).cast("long"))  # stands for the document itself
    cut_up = rows.select("key", _once(words(F.col("text")), hashes=lambda ws: F.concat(first, *[_shingles(ws, n) for n in sizes])))
    dealt = cut_up.select("key", n_words, F.posexplode("hashes").alias("pos", "h"))
    if small:
        known = lookup.union(docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("h"))).distinct()
        seen = dealt.join(F.broadcast(known), "h").where("h <> 0 or pos = 0")
    else:
        seen = dealt.where("pos > 0").join(lookup, "h").unionByName(dealt.where("pos = 0"))
    seen = scratch.keep(seen.select("key", "n_words", "pos", "h"))
    matches = seen.where("pos > 0")
    df = matches.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    # A window with a shingle that no document has can't occur: it has fewer counted shingles than places.
    by = W.partitionBy("item_id", "words")
    prefix = hashed.join(df, "h").withColumns({"found": F.count(F.lit(1)).over(by), "nth": F.row_number().over(by.orderBy("df", "place"))})
    prefix = prefix.where((F.col("nth") == 1) & (F.col("found") == F.col("n") - F.col("shingle_n") + 1))
    prefix = cut(prefix.select("item_id", "words", "n", "shingle_n", "place", "h"))

    # A position counts the document's own row first, then the shingles of each size in turn.
    skipped, begin = F.lit(1), F.lit(1)
    for n in sizes:
        begin = F.when(F.col("shingle_n") == n, skipped).otherwise(begin)
        skipped = skipped + F.greatest(F.col("n_words") - F.lit(n - 1), F.lit(0))
    start = (F.col("pos") - begin - F.col("place")).cast("int").alias("start")
    met = matches.join(side(prefix), "h").select("key", "n_words", start, "n", "words", "item_id")
    met = met.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
    met = met.groupBy("key").agg(F.collect_set(F.struct("start", "n", "words", F.col("item_id").cast("string").alias("item"))).alias("met"))
    met, holders = scratch.keep(met), rows.dropDuplicates(["key"])
    if met.count() <= MOST_DOCS:
        holders = rows.join(F.broadcast(met.select("key")), "key", "left_semi").dropDuplicates(["key"])

    def checked(ws: Column) -> Column:
        hits = F.filter("met", lambda m: F.slice(ws, m["start"] + 1, m["n"]) == m["words"])
        return F.array_sort(F.transform(hits, lambda m: F.struct(m["start"].alias("start"), m["n"].alias("n"), m["item"].alias("item"))))

    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("upto"))

    def cover(s: Column, x: Column) -> Column:
        end = x["start"] + x["n"]
        new = F.greatest(end - F.greatest(s["upto"], x["start"]), F.lit(0)).cast("long")
        return F.struct((s["hit"] + new).alias("hit"), F.greatest(s["upto"], end).alias("upto"))

    per_doc = holders.join(met, "key").select("key", _once(words(F.col("text")), hits=checked)).where(F.size("hits") > 0)
    items = F.sort_array(F.array_distinct(F.transform("hits", lambda m: m["item"])))
    per_doc = scratch.keep(per_doc.select("key", F.aggregate("hits", zero, cover)["hit"].alias("n_hit"), items.alias("item_ids")))
    scratch.drop(met)
    found = seen.where("pos = 0").select("key", "n_words").join(per_doc, "key", "left")
    return found.select(
        "key.doc_id",
        "key.h",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that contain a benchmark window; all columns stay.

    Rows are judged by doc_id and text together: of rows that repeat a doc_id only
    the contaminated ones go, and a row with a null doc_id goes like any other.
    """
    found = contamination(docs, benchmark, window, doc_id, text)
    return without(docs, found.where("contaminated"), doc_id, text)
