"""Queries of sentences and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import claims
from lumenfold.plans.registry import query, table


@query()
def sentence_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-050: every sentence of every document. Look-behinds have no counterpart in the other engine: a test compares with a plain version."""
    return claims.sentence_spans(table(spark, sf_dir, "documents"), "doc_id", "text")


#: Two words before a full stop that is no farther than 60 characters. Letters can't be the blank or the full stop behind
#: them, so possessive runs from the first letter of a word find what backtracking would.
_TWO_WORDS = r"(?<!\p{L})(\p{L}++) (\p{L}++)(?=[^.]{0,60}+\.)"

#: Verbs and hedges that are put into the invented prose, by the length of the document.
_TAIL = ("announced", "reports that", "might have", "said", "closed at 3.5 points for Dr.", "launches?")


@query()
def reported_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-051, O-052: claims of articles: titles are the first words of documents, and summaries have a verb put into each sentence."""
    d = table(spark, sf_dir, "documents")
    words = F.array(*[F.lit(t) for t in _TAIL])
    verb = F.element_at(words, (F.col("n_chars") % len(_TAIL) + 1).cast("int"))
    title = F.concat_ws(" ", F.substring_index(F.coalesce("text", F.lit("")), " ", 4), verb, F.col("source"))
    summary = F.regexp_replace(F.coalesce("text", F.lit("")), _TWO_WORDS, F.concat(F.lit("$1 "), verb, F.lit(" $2")))
    return claims.extract_claims(d.select(F.col("doc_id").alias("article_id"), title.alias("title"), summary.alias("summary"), (F.col("n_chars") % 11 == 0).alias("truncated")))
