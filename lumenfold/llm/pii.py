"""Personal data: base patterns plus identifiers found by bootstrapped contexts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import Scratch, join_hot_apart, require, row_key, text_or_empty

KINDS = ("email", "ip", "card", "phone")

#: The patterns of the four kinds. They match what the plain forms
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and so on match, but possessively and only
#: from the start of a run (or from the end of the match before), so long runs take linear time and no deep recursion.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A string that each text with a match of the kind holds.
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_PART = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"

#: Candidates for unseen identifiers: up to 8 tokens with a digit with single blanks between them, or
#: a token without one that has @, . or _ between letters. (The bound keeps the regex from deep recursion.)
TOKEN = r"(?<!\S)(?:(?=\S*[0-9])\S++(?:\x20(?=\S*[0-9])\S++){0,7}+|(?=\S*[\p{L}\p{N}][@._]\p{L})\S++)"
MAY_HOLD = r"[0-9@_]|\.\p{L}"  # what a text with a candidate holds
MASK = "\uffff"  # stands for the characters of base matches where candidates are looked for
LEAST_CHARS = 6  # of a candidate, by default
LEAST_SEEDS = 5  # distinct accepted instances that a pattern needs
CONFIDENT = 0.75  # share of a pattern's distinct instances that have to be accepted
BLOCK = 256  # matches whose lengths are summed up together
_SPANS = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the value, which is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _starts(lengths: Column) -> Column:
    """Sums of all lengths before each, by blocks: a text may have very many matches."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    at = F.sequence(F.lit(0), F.size(lengths) - 1)
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))

    def of_blocks(sums: Column) -> Column:
        offsets = F.transform(blocks, lambda b: total(F.slice(sums, F.lit(1), b)))

        def one(i: Column, offs: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            return F.get(offs, block) + total(F.slice(lengths, block * BLOCK + 1, i - block * BLOCK))

        return _let(offsets, lambda offs: F.transform(at, lambda i: one(i, offs)))

    return F.when(F.size(lengths) > 0, _let(F.transform(blocks, lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))), of_blocks)).otherwise(F.array().cast("array<int>"))


def _spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, left, right) of the pattern's matches, in code points, with the words beside them.

    The words are looked for between one match and the next, so a text takes linear time.
    """
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def rows(x: Column) -> Column:
        n = F.size(x["values"])
        sizes = F.zip_with(F.slice(x["gaps"], F.lit(1), n), x["values"], lambda g, v: F.length(g) + F.length(v))
        before = F.transform(F.slice(x["gaps"], F.lit(1), n), lambda g: F.struct(F.length(g).alias("gap"), _last_word(g).alias("left")))
        after = F.transform(F.slice(x["gaps"], F.lit(2), n), _first_word)
        zipped = F.arrays_zip(_let(sizes, _starts).alias("at"), before.alias("b"), x["values"].alias("v"), after.alias("r"))

        def row(z: Column) -> Column:
            start = z["at"] + z["b"]["gap"]
            return F.struct(start.alias("start"), (start + F.length(z["v"])).alias("end"), z["v"].alias("value"), z["b"]["left"].alias("left"), z["r"].alias("right"))

        return F.when(n > 0, F.transform(zipped, row)).otherwise(F.array().cast(_SPANS))

    return _let(F.struct(gaps.alias("gaps"), values.alias("values")), rows)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    backwards = F.split(F.reverse(digits), "")

    def worth(d: Column, i: Column) -> Column:
        twice = d.cast("int") * (F.lit(1) + i % 2)
        return twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.filter(backwards, lambda d: d != ""), worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    n = F.length(_digits(value))
    if kind == "phone":
        return n.between(10, 15)
    return F.when(n.between(14, 19), luhn(_digits(value))).otherwise(False)


_BASE = "array<struct<start:int,rank:int,kind:string,end:int,value:string,left:string,right:string>>"


def _kind_spans(text: Column, kind: str, rank: int) -> Column:
    may = F.contains(text, F.lit(NEEDED[kind])) if NEEDED[kind] else text.rlike(r"[0-9][\x20-]?[0-9]")
    found = F.filter(_spans(text, PATTERNS[kind]), lambda s: _passes(kind, s["value"]))

    def named(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), *[s[c].alias(c) for c in ("end", "value", "left", "right")])

    return F.when(may, F.transform(found, named)).otherwise(F.array().cast(_BASE))


def base_spans(text: Column) -> Column:
    """Array of (start, rank, kind, end, value, left, right), by start and then kind as listed."""
    return F.array_sort(F.concat(*[_kind_spans(text, kind, rank) for rank, kind in enumerate(KINDS)]))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _blanked(text: Column) -> Column:
    return F.translate(text, "\t\n\u000b\f\r", "     ")


def _last_word(text: Column) -> Column:
    """The word before an instance; opening brackets and quotes at the instance aren't part of it."""
    return F.lower(F.substring_index(F.rtrim(F.regexp_replace(_blanked(text), r"[(\[<\x22']++$", "")), " ", -1))


def _first_word(text: Column) -> Column:
    """The word after an instance; punctuation at the instance isn't part of it."""
    return F.lower(F.substring_index(F.ltrim(F.regexp_replace(_blanked(text), r"^[^\p{L}\p{N}\x20]++", "")), " ", 1))


def _mask_kind(text: Column, base: Column, kind: str) -> Column:
    def covered(x: Column) -> Column:
        parts = F.zip_with(x["gaps"], x["values"], lambda g, v: F.concat(g, F.when(v.isNull(), "").when(_passes(kind, v), F.repeat(F.lit(MASK), F.length(v))).otherwise(v)))
        return F.array_join(parts, "")

    def one(t: Column) -> Column:
        halves = F.struct(F.split(t, PATTERNS[kind], -1).alias("gaps"), F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0)).alias("values"))
        return F.when(F.exists(base, lambda b: b["kind"] == kind), _let(halves, covered)).otherwise(t)

    return _let(text, one)


def _masked(text: Column, base: Column) -> Column:
    """The text with MASK for each character of a base match."""
    for kind in KINDS:
        text = _mask_kind(text, base, kind)
    return text


def _tokens(text: Column, least_chars: int = LEAST_CHARS) -> Column:
    """Array of (start, end, value, left, right): candidates and the words beside them. Trailing punctuation isn't part of the value."""

    def row(s: Column) -> Column:
        core = F.regexp_replace(s["value"], r"[^\p{L}\p{N}]+$", "")
        return F.struct(s["start"].alias("start"), (s["start"] + F.length(core)).alias("end"), core.alias("value"), s["left"].alias("left"), s["right"].alias("right"))

    found = F.filter(F.transform(_spans(text, TOKEN), row), lambda t: (F.length(t["value"]) >= least_chars) & ~F.contains(t["value"], F.lit(MASK)))
    return F.when(text.rlike(MAY_HOLD), found).otherwise(F.array().cast(_SPANS))


def accepted_instances(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The values that bootstrapping accepts. ``edges`` (pattern, value, seed) has each pair once and is a written table.

    A pattern's score is the accepted share of its distinct instances; it counts from
    LEAST_SEEDS accepted ones on. An instance's score is the best of its patterns'; at
    CONFIDENT it is accepted, and then supports its other patterns in the next round.
    Rounds go on until nothing is accepted any more: accepted instances only get more, so they end.
    A round reads the edges of values that are still open, and counts what it accepts: work shrinks with each.
    """
    accepted = [scratch.keep(edges.where("seed").select("value").distinct())]
    counts = scratch.keep(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count_if("seed").alias("n_accepted")))
    state = scratch.keep(edges.where(~F.col("seed")).join(accepted[0], "value", "left_anti").select("pattern", "value"))
    total = edges.count()
    # A value that is a seed beside one word counts as accepted beside its other words, too.
    late = edges.where(~F.col("seed")).join(accepted[0], "value").groupBy("pattern").agg(F.count(F.lit(1)).alias("more"))
    while True:
        counted = counts.join(late, "pattern", "left").select("pattern", "n", (F.col("n_accepted") + F.coalesce("more", F.lit(0))).alias("n_accepted"))
        counted = scratch.keep(counted)
        good = scratch.keep(counted.where((F.col("n_accepted") >= LEAST_SEEDS) & (F.col("n_accepted") >= CONFIDENT * F.col("n"))).select("pattern", "n"))
        # A frequent word's edges are split off the join; a value has two edges for each pair of words beside it.
        new = scratch.keep(join_hot_apart(state, good, "pattern", "n", total).select("value").distinct())
        if new.isEmpty():
            break
        accepted.append(new)
        moved = scratch.keep(state.join(new, "value").groupBy("pattern").agg(F.count(F.lit(1)).alias("more")))
        # Patterns that were good have nothing open any more.
        left = scratch.keep(state.join(new, "value", "left_anti"))
        scratch.drop(state, counts, good)
        counts, state, late = counted, left, moved
    found = accepted[0]
    for new in accepted[1:]:
        found = found.unionByName(new)
    return found


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and added (arrays of spans).

    base holds the matches of the four patterns that pass their check, leftmost
    and non-overlapping per kind; a failing match is dropped without a retry.

    added holds spans of kind "id" that bootstrapping finds. Each base match is, as a
    whole, a seed instance, of whatever kind. The other instances are candidates
    outside of base matches: groups of tokens with a digit, and tokens without one
    that have @, . or _ inside, of ``least_chars`` characters or more. A group of over
    eight tokens is cut after each eighth. A lexical pattern is the word on the left or on
    the right of an instance, in lower case. The graph of patterns and distinct
    instances is scored in rounds, see :func:`accepted_instances`; all occurrences of
    accepted instances are identifiers, where they overlap no base match.

    Null texts count as empty and have no spans; rows with the same doc_id and text
    share theirs; a null doc_id is allowed. Other columns aren't read. An empty table
    gives an empty table.
    """
    require(docs, doc_id, text)
    scratch = Scratch(docs.sparkSession, "pii")
    body = text_or_empty(text)
    made = F.transform(F.array(base_spans(body)), lambda b: F.struct(b.alias("base"), _let(_masked(body, b), lambda t: _tokens(t, least_chars)).alias("tokens")))
    # Texts are read once: only spans and instances, a small share of the text, are kept.
    found = scratch.keep(docs.select(*row_key(doc_id, text), made[0].alias("made")).select("doc_id", "h", "made.*"))
    row = F.struct("doc_id", "h").alias("key")
    tokens = found.select(row, F.explode("tokens").alias("t")).select("key", "t.*")
    seeds = found.select(F.explode("base").alias("t")).select("t.value", "t.left", "t.right", F.lit(True).alias("seed"))
    both = seeds.unionByName(tokens.select("value", "left", "right", F.lit(False).alias("seed")))
    sides = F.explode(F.array(F.concat(F.lit("L "), "left"), F.concat(F.lit("R "), "right"))).alias("pattern")
    edges = both.select("value", "seed", sides).where((F.length("pattern") > 2) & ~F.contains("pattern", F.lit(MASK)))
    edges = scratch.keep(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    accepted = accepted_instances(edges, scratch)
    counts = tokens.groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
    new = scratch.keep(counts.join(accepted, "value"))
    hit = join_hot_apart(tokens, new, "value", "rows", tokens.count())
    span = F.struct(F.col("start"), F.lit(len(KINDS)).alias("rank"), F.lit("id").alias("kind"), F.col("end"), F.col("value"))
    added = hit.groupBy("key").agg(F.array_sort(F.collect_set(span)).alias("added"))
    base = F.transform("base", lambda b: F.struct(*[b[c].alias(c) for c in ("start", "rank", "kind", "end", "value")]))
    whole = found.select(row, base.alias("base")).join(added, "key", "left")
    # Only where base matches overlap each other can a rest of one be a candidate.
    ends = F.slice(F.transform("base", lambda b: b["end"]), F.lit(1), F.size("base") - 1)
    mixed = F.when(F.size("base") > 1, F.exists(F.zip_with(ends, F.slice("base", F.lit(2), F.size("base") - 1), lambda e, b: e > b["start"]), lambda x: x)).otherwise(False)
    apart = F.filter("added", lambda a: ~F.exists("base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    apart = F.when(F.col("added").isNotNull() & mixed, apart).otherwise(F.col("added"))
    return whole.select("key.doc_id", "base", F.coalesce(apart, F.slice("base", F.lit(1), F.lit(0))).alias("added"))


def pii_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    found = find_pii(docs, doc_id, text)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
