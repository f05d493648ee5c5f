"""Copied passages: longest common runs of words, and quotes that are too long or lack their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.operators.stages import Stages

# The bounds of copying and quoting, and what counts as a quote.
MOST_COPIED = 15
MOST_QUOTED = 25
QUOTE = r'"[^"]*"|“[^”]*”'

SPLIT = 10_000  # places of one window that are compared together


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _windows(df: DataFrame, size: int, names: list[str]) -> DataFrame:
    """(names, at, key, before, after): each run of ``size`` words, hashed with its scope, and the words next to it."""
    around = lambda i: F.when(F.get("words", i).isNotNull(), F.xxhash64(F.get("words", i)))
    one = lambda i: F.struct(i.alias("at"), F.xxhash64(F.col("scope"), F.slice("words", i + 1, F.lit(size))).alias("key"), around(i - 1).alias("before"), around(i + size).alias("after"))
    whole = df.where(F.size("words") >= size)
    return whole.select(*names, F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - size), one)).alias("w")).select(*names, "w.*")


def longest_runs(prose: DataFrame, sources: DataFrame, least: int = MOST_COPIED + 1) -> DataFrame:
    """(scope, prose_id, source_id, length, start, source_start): the longest run of words that two texts of a scope share.

    ``prose`` (scope, prose_id, words) and ``sources`` (scope, source_id, words); runs
    of under ``least`` words aren't looked for, a null scope or words match nothing. Of equal runs the first in
    the prose counts, and the first in the source of those. Repeated rows count once.

    Texts meet by the windows of ``least`` words that both have. On a diagonal (a
    window's place in the source less that in the prose) the windows of one run follow each other without a gap,
    so a run is known by its first and its last window: those where the words before, or after, differ. Only these
    leave the join. A window of very many places is dealt out to several tasks.
    """
    stages = Stages(prose.sparkSession, "runs")
    a = _windows(prose.where("scope is not null").dropDuplicates(["scope", "prose_id"]), least, ["scope", "prose_id"])
    b = stages.keep(_windows(sources.where("scope is not null").dropDuplicates(["scope", "source_id"]), least, ["scope", "source_id"]))
    a = stages.keep(a.join(b.select("key").distinct(), "key", "left_semi"))
    parts = a.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SPLIT).alias("parts"))
    dealt = a.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("prose_id", "at"), F.col("parts"))).drop("parts")
    copies = b.join(parts, "key").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    x, y = dealt.alias("x"), copies.alias("y")
    differ = lambda side: ~F.coalesce(F.col(f"x.{side}") == F.col(f"y.{side}"), F.lit(False))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.scope") == F.col("y.scope")) & (differ("before") | differ("after")))
    ends = met.select("x.scope", "prose_id", "source_id", F.col("x.at").alias("start"), (F.col("y.at") - F.col("x.at")).alias("diagonal"), differ("before").alias("first"), differ("after").alias("last"))
    along = W.partitionBy("scope", "prose_id", "source_id", "diagonal").orderBy("start")
    runs = ends.withColumn("until", F.when(F.col("last"), F.col("start")).otherwise(F.lead("start").over(along))).where("first")
    length = F.col("until") - F.col("start") + least
    best = runs.groupBy("scope", "prose_id", "source_id").agg(F.max(F.struct(length.alias("length"), (-F.col("start")).alias("s"), (-F.col("diagonal")).alias("d"))).alias("b"))
    return best.select("scope", "prose_id", "source_id", "b.length", (-F.col("b.s")).alias("start"), (-F.col("b.s") - F.col("b.d")).alias("source_start"))


def _padded(tokens: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def quote_findings(blocks: DataFrame, snippets: DataFrame) -> DataFrame:
    """(block_id, place, violation, word_count, source_id): what is wrong with the quotes of each block.

    ``blocks`` (block_id, text) has a block once; ``snippets`` (block_id, nth, source_id, text, publisher, url) are the
    sources that a block may quote, in the order of nth. place is the quote's number
    from 0. A quote of over MOST_QUOTED words is too long. Its source is a snippet that
    holds its words one after another: without one it is unattributable; if none of them has a URL that is missing; and
    one of those with a URL must have its publisher named in the block. source_id is the first snippet that fits.
    Quotes without words, and unbalanced marks, aren't quotes. Null texts count as empty.
    """
    body = F.coalesce("text", F.lit(""))
    quotes = blocks.select("block_id", F.lower(body).alias("block"), F.posexplode(F.regexp_extract_all(body, F.lit(QUOTE), F.lit(0))).alias("place", "quote")).withColumn("tokens", words(F.col("quote"))).where(F.size("tokens") > 0)
    around = snippets.select(F.col("block_id").alias("of"), "nth", "source_id", "publisher", "url", _padded(words(F.col("text"))).alias("snippet"))
    met = quotes.join(around, F.col("block_id") == F.col("of"), "left")
    fits = F.coalesce(F.contains("snippet", _padded(F.col("tokens"))), F.lit(False))
    linked = fits & (F.coalesce("url", F.lit("")) != "")
    named = linked & (F.coalesce("publisher", F.lit("")) != "") & F.contains("block", F.lower("publisher"))
    source = F.struct("nth", "source_id")
    each = met.groupBy("block_id", "place", F.size("tokens").alias("word_count")).agg(
        F.min(F.when(fits, source)).alias("matched"), F.min(F.when(linked, source)).alias("linked"), F.coalesce(F.bool_or(named), F.lit(False)).alias("named")
    )
    missing = F.when(F.col("matched").isNull(), "unattributable").when(F.col("linked").isNull(), "missing_url").when(~F.col("named"), "unattributed")
    first = F.col("matched.source_id")
    found = F.array(
        F.when(F.col("word_count") > MOST_QUOTED, F.struct(F.lit("too_long").alias("violation"), first.alias("source_id"))),
        F.when(missing.isNotNull(), F.struct(missing.alias("violation"), F.when(missing == "unattributed", F.col("linked.source_id")).otherwise(first).alias("source_id"))),
    )
    return each.select("block_id", "place", "word_count", F.explode(F.array_compact(found)).alias("f")).select("block_id", "place", "f.violation", "word_count", "f.source_id")


def copy_findings(blocks: DataFrame, snippets: DataFrame) -> DataFrame:
    """:func:`quote_findings`, and for each block the longest run of over MOST_COPIED words that its prose outside of quotes copies.

    A copying's place is the number of the segment between quotes; of equal runs the first segment counts, then the first snippet.
    """
    segments = blocks.select(F.col("block_id").alias("scope"), F.posexplode(F.split(F.coalesce("text", F.lit("")), QUOTE, -1)).alias("prose_id", "text"))
    prose = segments.select("scope", "prose_id", words(F.col("text")).alias("words"))
    sources = snippets.select(F.col("block_id").alias("scope"), F.struct("nth", "source_id").alias("source_id"), words(F.col("text")).alias("words"))
    runs = longest_runs(prose, sources)
    worst = runs.groupBy("scope").agg(F.min(F.struct((-F.col("length")).alias("length"), "prose_id", "source_id")).alias("w"))
    copied = worst.select(F.col("scope").alias("block_id"), F.col("w.prose_id").alias("place"), F.lit("excessive_copying").alias("violation"), (-F.col("w.length")).cast("int").alias("word_count"), F.col("w.source_id.source_id").alias("source_id"))
    return quote_findings(blocks, snippets).unionByName(copied)
