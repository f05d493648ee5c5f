"""Repeated lines across documents, dropped by log templates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import Scratch, join_hot_apart, require, row_key, text_or_empty

WILD = "<*>"
LEADING = 3  # leading tokens in a leaf's path, below the token count
LEAST_DOCS = 3  # documents that a template has to recur in
LONG_TOKENS = 10  # tokens of a line from which LONG_DOCS documents are enough: it hardly recurs by chance
LONG_DOCS = 2
CONSTANT_DOCS = 2  # documents of the leaf that must share a token at its place, or it is a variable
LEAST_CONSTANT = 0.6  # share of a template's tokens that have to be constant
WHOLE_LINE = 200  # characters; longer lines are cut at the ends of their sentences
MOST_BROADCAST = 2_000_000  # shared leaves (8 bytes each) up to which they are broadcast
MARK = "\u0001"  # put where texts are cut; texts that hold it are cut by look-behind instead


def _sentences(line: Column) -> Column:
    for end in (". ", "! ", "? "):
        line = F.replace(line, F.lit(end), F.lit(end + MARK))
    return F.split(line, MARK, -1)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the value, which is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def units(text: Column, of_line: Callable[[Column], Column] = lambda x: x, of_sentence: Callable[[Column], Column] = lambda x: x) -> Column:
    """The lines of a text, and the sentences of lines of over WHOLE_LINE characters, mapped by the two functions.

    Joined they are the text again: each keeps the line feed or blank that ends it.
    """

    def cut(line: Column, marked: Column) -> Column:
        parts = F.when(marked, F.split(line, r"(?<=[.!?]\x20)", -1)).otherwise(_sentences(line))
        return F.when(F.length(line) <= WHOLE_LINE, F.array(of_line(line))).otherwise(F.transform(parts, of_sentence))

    def whole(marked: Column) -> Column:
        lines = F.when(marked, F.split(text, r"(?<=\n)", -1)).otherwise(F.split(F.replace(text, F.lit("\n"), F.lit("\n" + MARK)), MARK, -1))
        return F.flatten(F.transform(lines, lambda line: cut(line, marked)))

    return _let(F.contains(text, F.lit(MARK)), whole)


def _odd(text: Column) -> Column:
    """Whether blanks don't just stand one by one between the words of a line."""
    out = F.contains(text, F.lit("  "))
    for white in "\t\u000b\f\r" + MARK:
        out = out | F.contains(text, F.lit(white))
    return out


def masked(unit: Column, least: int, odd: Column, digits: Column) -> Column:
    """Single blanks between the tokens, tokens with a digit are <*>; empty if there are under ``least`` tokens.

    ``odd`` and ``digits`` say whether the text has something to replace at all.
    """
    plain = F.when(odd, F.regexp_replace(unit, f"[{MARK}\t-\r ]++", " ")).otherwise(F.replace(unit, F.lit("\n"), F.lit("")))

    def sized(line: Column) -> Column:
        wild = F.when(digits & line.rlike("[0-9]"), F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", WILD)).otherwise(line)
        return F.when(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) >= least - 1, wild).otherwise("")

    return _let(F.trim(plain), sized)


def _parsed(docs: DataFrame, doc_id: str, text: str, least_tokens: int) -> DataFrame:
    """(doc_id, h, line_no, leaf, line): the masked units that can be a template.

    They are masked as arrays, before they are dealt out: later steps read a finished column.
    """

    def of_text(t: Column) -> Column:
        return units(t["text"], lambda x: masked(x, least_tokens, t["odd"], t["digits"]), lambda x: masked(x, LONG_TOKENS, t["odd"], t["digits"]))

    body = text_or_empty(text)
    whole = _let(F.struct(body.alias("text"), _odd(body).alias("odd"), body.rlike("[0-9]").alias("digits")), of_text)
    lines = docs.select(*row_key(doc_id, text), F.posexplode(whole).alias("line_no", "line")).where(F.col("line") != "")
    tokens = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return lines.select("doc_id", "h", "line_no", F.xxhash64(tokens, F.substring_index("line", " ", LEADING)).alias("leaf"), "line")


def _least(tokens: Column) -> Column:
    return F.when(tokens >= LONG_TOKENS, LONG_DOCS).otherwise(LEAST_DOCS)


def line_templates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_tokens: int = 3, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, h, line_no, template, n_docs) of the lines whose template recurs; template is its hash.

    Lines of over WHOLE_LINE characters are parsed sentence by sentence, so a passage
    inside a longer line meets its other places; sentences of under LONG_TOKENS tokens
    and lines of under ``least_tokens`` never match.

    A fixed-depth tree parses lines: the first level is the token count, the next
    ones the first LEADING tokens, where tokens with a digit are variable. Below a
    leaf, a token is constant if CONSTANT_DOCS documents of the leaf have it at its
    place; other places are generalised to <*>. Lines with the same count and the
    same tokens after that share a template. It recurs if LEAST_DOCS distinct
    documents have it (LONG_DOCS if it has LONG_TOKENS tokens or more) and
    LEAST_CONSTANT of its tokens are constant. Copies of a whole text count as one
    document: they are for the exact deduplication to remove.

    Texts are masked and cut once; their lines are written with their leaf. No template
    reaches over leaves, so those of a single document, which hold most of the text,
    are left out at once: the others' hashes are broadcast up to ``most_broadcast`` of
    them; beyond, lines are shuffled by leaf. A line that two documents have as it is
    is its own template; only the tokens of the others are looked up. Frequent
    tokens, lines and templates are split off the joins on them.
    """
    require(docs, doc_id, text)
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.keep(_parsed(docs, doc_id, text, least_tokens))
    leaves = lines.groupBy("leaf").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("leaf")
    leaves = scratch.keep(leaves)
    side = F.broadcast(leaves) if leaves.count() <= most_broadcast else leaves
    shared = scratch.keep(lines.join(side, "leaf", "left_semi").withColumn("lid", F.xxhash64("line")))
    scratch.drop(lines, leaves)
    # Alike lines are counted once before their tokens are.
    alike = scratch.keep(shared.groupBy("leaf", "lid").agg(F.first("line").alias("line"), F.min("h").alias("a"), F.max("h").alias("b"), F.count(F.lit(1)).alias("n")))
    places, total = scratch.keep(shared.select("doc_id", "h", "line_no", "lid")), shared.count()
    scratch.drop(shared)

    words = F.split("line", " ", -1)
    spots = alike.select("lid", "leaf", "a", "b", F.posexplode(words).alias("at", "token")).where(F.col("token") != WILD)
    spots = spots.select("lid", "at", "a", "b", F.xxhash64("leaf", "at", "token").alias("spot"))
    constant = spots.groupBy("spot").agg(F.min("a").alias("least"), F.max("b").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most").select("spot", "n")
    constant, n_spots = scratch.keep(constant), spots.count()
    fixed = join_hot_apart(spots.where("a = b").select("lid", "at", "spot"), constant, "spot", "n", n_spots).groupBy("lid").agg(F.collect_set("at").alias("fixed"))
    single = alike.where("a = b").join(fixed, "lid").select("lid", "line", "n", "fixed")
    general = F.array_join(F.transform(words, lambda t, i: F.when(F.array_contains("fixed", i), t).otherwise(F.lit(WILD))), " ")
    single = single.select("lid", "n", F.size(words).alias("tokens"), F.size("fixed").alias("constants"), F.xxhash64(general).alias("template"))
    same = alike.where("a <> b").select("lid", "n", F.size(words).alias("tokens"), F.size(F.filter(words, lambda t: t != WILD)).alias("constants"), F.col("lid").alias("template"))
    made = single.unionByName(same).where(F.col("constants") >= F.lit(LEAST_CONSTANT) * F.col("tokens")).select("lid", "n", "tokens", "template")
    made = scratch.keep(made)
    scratch.drop(alike, constant)
    found = scratch.keep(join_hot_apart(places, made, "lid", "n", total).select("doc_id", "h", "line_no", "template", "tokens"))
    scratch.drop(places, made)
    holders = found.groupBy("template", "tokens", "h").agg(F.count(F.lit(1)).alias("rows")).groupBy("template", "tokens").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("n_docs"))
    recurring = scratch.keep(holders.where(F.col("n_docs") >= _least(F.col("tokens"))).select("template", "rows", "n_docs"))
    return join_hot_apart(found, recurring, "template", "rows", found.count()).select("doc_id", "h", "line_no", "template", "n_docs")


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_tokens: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, text without recurring lines, n_lines, n_dropped.

    Recurring lines (sentences, of long lines) are those of :func:`line_templates`; all
    their occurrences go, the others stay as they are, in their order. Where the last
    line goes, the text ends with the line before. Null texts count as empty (one empty
    line). Rows with the same doc_id and text are one document and share the result;
    null ids are allowed. Other columns aren't read. An empty table gives an empty table.
    """
    key = F.struct("doc_id", "h").alias("key")
    repeated = line_templates(docs, doc_id, text, least_tokens).groupBy(key).agg(F.collect_set("line_no").alias("drop"))
    body = text_or_empty(text)
    found = docs.select(F.struct(*row_key(doc_id, text)).alias("key"), body.alias("text")).join(repeated, "key", "left")

    def cleaned(parts: Column) -> Column:
        left = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("drop", i)), "")
        left = F.when(F.array_contains("drop", F.size(parts) - 1), F.rtrim(left, F.lit("\n "))).otherwise(left)
        return F.struct(left.alias("text"), F.size(parts).cast("long").alias("n"))

    # The units are an argument: a plain column would be cut out of the text for each use.
    made = F.when(F.col("drop").isNotNull(), F.transform(F.array(units(F.col("text"))), cleaned)[0])
    found = found.select("key.doc_id", "text", "drop", made.alias("made"))
    return found.select(
        "doc_id",
        F.coalesce("made.text", "text").alias("text"),
        F.coalesce("made.n", F.size(units(F.col("text"))).cast("long")).alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
