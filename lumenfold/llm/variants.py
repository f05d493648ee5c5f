"""Spelling variants: words one edit apart, found by partition-and-enumerate signatures of letter multisets."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import Scratch, ascii_lower, require, text_or_empty

RUN = r"[A-Za-zÀ-ÿ]+"
SLIP_EVERY = 97  # one run in so many loses a letter
MOST_HOPS = 64  # a form has twice the count of its word, so no path of forms is longer


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): all words of the texts, each run of letters lower-cased (A-Z alone), some with a letter less.

    h is the CRC-32 of ``<doc_id>:<run>``; where 97 divides it, the run loses its
    code point h modulo its length. A null text has no words, a null doc_id is written
    as nothing, and a run of one letter may become the empty word. Counts are summed
    within each task before the shuffle, so a frequent word is a row a task.
    """
    require(docs, doc_id, text)
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("__id"), F.explode(F.regexp_extract_all(text_or_empty(text), F.lit(RUN), F.lit(0))).alias("__run")
    ).select("__id", ascii_lower(F.col("__run")).alias("__run"))
    h = F.crc32(F.concat_ws(":", "__id", "__run").cast("binary"))
    at = (F.col("__h") % F.length("__run")).cast("int")
    slipped = F.concat(F.substring("__run", F.lit(1), at), F.substring("__run", at + 2, F.length("__run")))
    word = F.when(F.col("__h") % SLIP_EVERY == 0, slipped).otherwise(F.col("__run"))
    return runs.withColumn("__h", h).select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _part(parts: int, part: int) -> Column:
    """The multiset's elements of one part of the dimensions, as text in a fixed order.

    A multiset is a binary vector with a dimension for each (letter, nth occurrence);
    ``__letters`` is the sorted array of its letters. Dimensions are dealt to parts by the letter's hash and the occurrence.
    """
    nth = lambda x, i: i - F.array_position(F.col("__letters"), x) + 1
    return F.array_join(F.filter("__letters", lambda x, i: F.pmod(F.crc32(x.cast("binary")) + nth(x, i), F.lit(parts)) == part), "")


def signatures(words: DataFrame, far: int, parts: int, tag: Column) -> DataFrame:
    """(sig, ``words``' columns): equal signatures for any two words of one tag whose vectors differ in ``far`` dimensions or fewer.

    The dimensions are dealt into ``parts`` parts; ``far`` differences touch at most
    ``far`` of them, so two such words agree on all others: each choice of parts - far
    parts gives a signature. A word's first half, or its last, joins each signature:
    one edit leaves one of the two halves as it was, so no pair is lost, and words
    that only share their letters don't meet.
    """
    half = F.floor(F.col("__len") / 2).cast("int")
    sides = F.array(F.concat(F.lit("<"), F.substring("word", F.lit(1), half)), F.concat(F.lit(">"), F.expr("right(word, __len - floor(__len / 2))")))
    chosen = F.array(*[F.concat_ws("|", F.lit(",".join(map(str, c))), *[F.col("__parts")[i] for i in c]) for c in combinations(range(parts), parts - far)])
    ready = words.withColumn("__len", tag).withColumn("__parts", F.array(*[_part(parts, i) for i in range(parts)]))
    ready = ready.withColumn("__side", F.explode(sides)).withColumn("__chosen", F.explode(chosen))
    return ready.select(F.xxhash64(F.lit(far), "__len", "__side", "__chosen").alias("sig"), "word", "n")


def near_words(words: DataFrame, parts: int = 4) -> DataFrame:
    """(word, n, other, other_n): each ordered pair of words that one inserted, deleted or replaced code point tells apart, once.

    ``words`` (word, n) has each word once and should be a written table. A replaced
    letter changes two dimensions of the multiset, an inserted or deleted one changes
    one, so words of equal length meet by signatures for two differences and words of
    neighbouring lengths by those for one. A meeting is only a candidate: the edit
    distance of each is verified. Candidates that several signatures name are one pair.
    """
    held = words.withColumn("__letters", F.array_sort(F.split("word", ""))).withColumn("__letters", F.filter("__letters", lambda x: x != ""))
    length = F.length("word")
    twins = signatures(held, 2, parts, length)
    short, long = signatures(held, 1, parts - 1, length), signatures(held, 1, parts - 1, length - 1)
    one, two = ["sig", F.col("word").alias("a"), F.col("n").alias("a_n")], ["sig", F.col("word").alias("b"), F.col("n").alias("b_n")]
    # Merged, not broadcast: Spark sizes signatures by the file of the words, before they are multiplied.
    same = twins.select(*one).hint("merge").join(twins.select(*two), "sig").where("a < b")
    off = short.select(*one).hint("merge").join(long.select(*two), "sig")
    pairs = same.unionByName(off).where(F.expr("levenshtein(a, b, 1)") == 1).select("a", "a_n", "b", "b_n").distinct()
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))).alias("p")).select("p.*")


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for each word that has a form: the end of its path of forms, by pointer doubling."""
    state = scratch.keep(forms.select("word", F.col("form").alias("root")))
    hops = 1
    while hops < MOST_HOPS:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = scratch.keep(state.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(state)
        state, hops = moved, 2 * hops
        if state.where("moved").isEmpty():
            break
    return state.select("word", "root")


def variant_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each distinct word of ``least_chars`` code points and ``least_count`` occurrences or more.

    n_near counts the words one edit away. A word's form is the one of them with the
    largest n (ties: the least in code-point order), if that n is twice the word's or
    more, else null; root is where the path of forms ends, the word itself without
    one. Repeated rows count as often as they stand there; an empty table or empty and
    null texts give no words; other columns are ignored, whatever their names. A word
    of any length is held whole. Tables between the steps are in the shared folder;
    those that the result doesn't read are deleted. No table is broadcast: all of them grow with the words.
    """
    scratch = Scratch(docs.sparkSession, "variants")
    counted = word_counts(docs, doc_id, text)
    words = scratch.keep(counted.where((F.col("n") >= least_count) & (F.length("word") >= least_chars)))
    # Least of (-n, word): the largest count first, then the code-point order, which is that of UTF-8 bytes.
    best = near_words(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), "other")).alias("best"))
    linked = scratch.keep(best.select("word", "n_near", F.when(-F.col("best.rank") >= 2 * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.rank")).alias("form_n"))).alias("chosen")))
    roots = _roots(linked.where("chosen is not null").select("word", "chosen.form"), scratch)
    found = words.join(linked.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("chosen.form").alias("form"), F.col("chosen.form_n").alias("form_n"), F.coalesce("root", "word").alias("root"))
