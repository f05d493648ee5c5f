"""Sentences with their places in a text, and the factual claims among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Abbreviations, the words that make or unmake a claim, and its bounds.
ABBREVIATIONS = ("dr", "mr", "mrs", "ms", "prof", "sr", "jr", "st", "vs", "etc", "e.g", "i.e")
PREDICATES = (
    "announced", "announces", "reported", "reports", "said", "confirmed", "confirms", "approved", "approves", "raised", "raises", "lowered", "lowers",
    "increased", "increases", "decreased", "decreases", "launched", "launches", "signed", "signs", "filed", "files", "acquired", "acquires",
    "released", "releases", "recorded", "records", "reached", "reaches", "fell", "rose", "closed", "opened", "voted", "votes", "won", "lost",
)
HEDGES = ("could", "may", "might", "would", "should", "expect", "expected", "expects", "forecast", "forecasts", "forecasted", "predict", "predicts", "predicted", "opinion", "imagine", "likely", "possibly", "potential", "potentially")
DEPENDENT = ("this", "that", "these", "those", "it", "they", "he", "she", "which", "who", "while", "although", "because")
COUNTS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
LISTED = ("reasons", "ways", "things")
LEAST_CHARS, MOST_CHARS = 20, 200
MOST_CLAIMS = 3

#: What a full stop belongs to rather than end a sentence with: an abbreviation, one capital, or initials of up to ten
#: letters; the word begins behind anything but a letter or a full stop, and one line feed may follow it. What stands before is
#: looked at for full stops alone, not for each character.
_BEFORE = r"(?:^|[^A-Za-z.])\.{0,9}"
_SHORT = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
_STOP = rf"(?=\.)(?<!{_BEFORE}(?i:{_SHORT})\n?)(?<!{_BEFORE}[A-Z]\n?)(?<!{_BEFORE}(?:[A-Za-z]\.){{1,9}}[A-Za-z]\n?)\."
_WHITE = r"\p{IsWhite_Space}\x1C-\x1F"
SENTENCE = rf"(?s)\G.*?(?:[!?]|{_STOP})[\"'”’]?(?=[{_WHITE}]|\z)"


def sentence_texts(text: Column) -> Column:
    """The complete sentences one after another, each with the white space before it; what follows the last end isn't one.

    A sentence ends at . ! or ? and a closing quote, before white space or the end.
    Full stops in decimals, of abbreviations and of initials don't end it.
    """
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{_WHITE}]+|[{_WHITE}]+\z", "")


def _any(words: tuple[str, ...]) -> str:
    return rf"(?iU)\b(?:{'|'.join(words)})\b"


def is_claim(text: Column) -> Column:
    """Whether a complete sentence reports a fact: 20 to 200 characters, no markup, question, hedge, dependent or listicle start, and a factual verb behind a subject."""
    body = strip(text)
    # Empty without such a verb.
    subject = F.regexp_extract(body, rf"(?siU)^(.*?)\b(?:{'|'.join(PREDICATES)})\b", 1)
    starts = rf"(?iU)^\s*(?:(?:{'|'.join(DEPENDENT)})\b|(?:top\s+)?(?:\d+|{'|'.join(COUNTS)})\s+(?:{'|'.join(LISTED)})\b)"
    return (
        F.length(body).between(LEAST_CHARS, MOST_CHARS)
        & ~F.rlike(body, F.lit("[<>]"))
        & ~F.rlike(body, F.lit(r"\?[\"'”’]*\z"))
        & ~F.rlike(body, F.lit(starts))
        & ~F.rlike(body, F.lit(_any(HEDGES)))
        & F.rlike(subject, F.lit(r"[\p{L}\p{N}]"))
    )


def sentence_spans(articles: DataFrame, article_id: str = "article_id", text: str = "text") -> DataFrame:
    """(article_id, nth, start, end, sentence): the sentences of each text without the white space around them, by characters, end exclusive.

    nth counts from 0. Null and empty texts have none. Places are sums over an article's sentences, in its own window.
    """
    rows = articles.select(F.col(article_id).alias("article_id"), sentence_texts(F.col(text)).alias("all")).withColumn("row", F.monotonically_increasing_id())
    each = rows.select("article_id", "row", F.posexplode("all").alias("nth", "raw"))
    before = F.coalesce(F.sum(F.length("raw")).over(W.partitionBy("row").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    leading = F.length("raw") - F.length(F.regexp_replace("raw", rf"^[{_WHITE}]+", ""))
    made = each.select("article_id", "nth", (before + leading).cast("int").alias("start"), strip(F.col("raw")).alias("sentence"))
    return made.select("article_id", "nth", "start", (F.col("start") + F.length("sentence")).alias("end"), "sentence")


def extract_claims(articles: DataFrame) -> DataFrame:
    """(article_id, rank, field, start, end, claim): at most three claims of each article: its title's, then its summary's in order.

    ``articles`` (article_id, title, summary, truncated) has an article once. A title counts if it doesn't end in : ; , or …;
    a truncated article has no claims. Spans are characters of the field that they stand in.
    """
    whole = articles.where(~F.coalesce("truncated", F.lit(False)))
    title = F.coalesce("title", F.lit(""))
    ended = F.rlike(strip(title), F.lit(r"[^:;,…]\z"))
    lead = F.length(title) - F.length(F.regexp_replace(title, rf"^[{_WHITE}]+", ""))
    titles = whole.where(ended & is_claim(title)).select("article_id", F.lit(0).alias("part"), F.lit(0).alias("nth"), F.lit("title").alias("field"), lead.alias("start"), (lead + F.length(strip(title))).alias("end"), strip(title).alias("claim"))
    found = sentence_spans(whole, "article_id", "summary").where(is_claim(F.col("sentence")))
    both = titles.unionByName(found.select("article_id", F.lit(1).alias("part"), "nth", F.lit("summary").alias("field"), "start", "end", F.col("sentence").alias("claim")))
    rank = F.row_number().over(W.partitionBy("article_id").orderBy("part", "nth"))
    return both.withColumn("rank", rank).where(F.col("rank") <= MOST_CLAIMS).select("article_id", "rank", "field", "start", "end", "claim")
