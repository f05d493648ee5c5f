"""Queries of copied passages and of quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import copying
from lumenfold.plans.registry import query, table

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def _runs_sql(prose: str, sources: str, least: int) -> str:
    """The longest runs of (scope, prose_id, ws) and (scope, source_id, ws), by islands of equal windows on diagonals."""

    def cut(name: str, key: str) -> str:
        return f"SELECT scope, {key}, i, array_to_string(ws[i:i + {least - 1}], ' ') AS win FROM (SELECT scope, {key}, ws, unnest(range(1, len(ws) - {least} + 2)) AS i FROM {name} WHERE len(ws) >= {least})"

    return f"""
    wa AS ({cut(prose, "prose_id")}), wb AS ({cut(sources, "source_id")}),
    met AS (SELECT scope, prose_id, source_id, wa.i AS i, wb.i - wa.i AS d FROM wa JOIN wb USING (scope, win)),
    islands AS (SELECT *, i - row_number() OVER (PARTITION BY scope, prose_id, source_id, d ORDER BY i) AS island FROM met),
    runs AS (SELECT scope, prose_id, source_id, d, min(i) - 1 AS start, count(*) + {least - 1} AS length FROM islands GROUP BY scope, prose_id, source_id, d, island),
    best AS (SELECT scope, prose_id, source_id, length, start, start + d AS source_start FROM runs
      QUALIFY row_number() OVER (PARTITION BY scope, prose_id, source_id ORDER BY length DESC, start, d) = 1)"""


#: Words that make a passage of the benchmark count as copied; an item has about 40.
LEAST = 8


@query(
    f"""
    WITH p AS (SELECT 0 AS scope, doc_id AS prose_id, {_WORDS} AS ws FROM documents), s AS (SELECT 0 AS scope, item_id AS source_id, {_WORDS} AS ws FROM benchmark),
    {_runs_sql("p", "s", LEAST)}
    SELECT prose_id AS doc_id, source_id AS item_id, CAST(length AS INTEGER) AS length, CAST(start AS INTEGER) AS start, CAST(source_start AS INTEGER) AS source_start FROM best"""
)
def copied_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-048: the longest run of words that a document shares with each benchmark item."""
    named = lambda t, key, to: table(spark, sf_dir, t).select(F.lit(0).alias("scope"), F.col(key).alias(to), copying.words(F.col("text")).alias("words"))
    found = copying.longest_runs(named("documents", "doc_id", "prose_id"), named("benchmark", "item_id", "source_id"), LEAST)
    return found.select(F.col("prose_id").alias("doc_id"), F.col("source_id").alias("item_id"), "length", "start", "source_start")


_BLOCKS = f"""
    d AS (SELECT doc_id, source, lang, n_chars, {_WORDS} AS ws FROM documents),
    blocks AS (SELECT doc_id AS block_id, (CASE WHEN n_chars % 2 = 0 THEN source ELSE 'someone' END) || ' wrote: "' || array_to_string(ws[4:9 + n_chars % 40], ' ') || '" and then ' || array_to_string(ws[40:41 + n_chars % 30], ' ') AS text FROM d),
    snippets AS (SELECT doc_id AS block_id, 0 AS nth, 'head' AS source_id, array_to_string(ws[1:30], ' ') AS text, source AS publisher, CASE WHEN lang = 'en' THEN 'https://example.com/' || doc_id END AS url FROM d
      UNION ALL SELECT doc_id, 1, 'rest', array_to_string(ws[25:65], ' '), 'someone', 'https://example.org/' || doc_id FROM d)"""


@query(
    rf"""
    WITH {_BLOCKS},
    q AS (SELECT block_id, lower(text) AS block, unnest(regexp_extract_all(text, '"[^"]*"|“[^”]*”')) AS quote, generate_subscripts(regexp_extract_all(text, '"[^"]*"|“[^”]*”'), 1) - 1 AS place FROM blocks),
    t AS (SELECT block_id, block, place, regexp_extract_all(quote, '[\p{{L}}\p{{N}}]+') AS ws FROM q),
    m AS (SELECT t.block_id, place, len(ws) AS n, s.nth, s.source_id, s.url IS NOT NULL AS linked, contains(block, lower(publisher)) AS named, contains(' ' || array_to_string({_WORDS}, ' ') || ' ', ' ' || array_to_string(ws, ' ') || ' ') AS fits
      FROM t JOIN snippets s USING (block_id) WHERE len(ws) > 0),
    g AS (SELECT block_id, place, n, min(nth) FILTER (WHERE fits) AS fit, min(nth) FILTER (WHERE fits AND linked) AS link, coalesce(bool_or(fits AND linked AND named), false) AS named FROM m GROUP BY ALL),
    x AS (SELECT scope AS block_id, prose_id, source_id, length FROM (SELECT * FROM best)),
    f AS (SELECT block_id, place, 'too_long' AS violation, n AS word_count, fit AS nth FROM g WHERE n > 25
      UNION ALL SELECT block_id, place, CASE WHEN fit IS NULL THEN 'unattributable' WHEN link IS NULL THEN 'missing_url' ELSE 'unattributed' END, n, CASE WHEN link IS NULL THEN fit ELSE link END FROM g WHERE fit IS NULL OR link IS NULL OR NOT named
      UNION ALL SELECT * EXCLUDE k FROM (SELECT block_id, prose_id, 'excessive_copying', length, source_id, row_number() OVER (PARTITION BY block_id ORDER BY length DESC, prose_id, source_id) AS k FROM x) WHERE k = 1)
    SELECT block_id, CAST(place AS INTEGER) AS place, violation, CAST(word_count AS INTEGER) AS word_count, CASE nth WHEN 0 THEN 'head' WHEN 1 THEN 'rest' END AS source_id FROM f""".replace(
        "    x AS (SELECT scope",
        """    segments AS (SELECT block_id, string_split_regex(text, '"[^"]*"|“[^”]*”') AS parts FROM blocks),
    p AS (SELECT block_id AS scope, prose_id, """
        + _WORDS
        + """ AS ws FROM (SELECT block_id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS prose_id FROM segments)),
    s AS (SELECT block_id AS scope, nth AS source_id, """
        + _WORDS
        + " AS ws FROM snippets),"
        + _runs_sql("p", "s", copying.MOST_COPIED + 1)
        + ",\n    x AS (SELECT scope",
    )
)
def copy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-047, O-049: blocks that quote and paraphrase each document, held against two snippets of it."""
    ws = F.col("ws")
    joined = lambda first, n: F.array_join(F.slice(ws, F.lit(first), n), " ")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", copying.words(F.col("text")).alias("ws"), (F.col("n_chars") % 40).cast("int").alias("q"), (F.col("n_chars") % 30).cast("int").alias("p"), (F.col("n_chars") % 2 == 0).alias("even"))
    blocks = d.select(F.col("doc_id").alias("block_id"), F.concat(F.when(F.col("even"), F.col("source")).otherwise("someone"), F.lit(' wrote: "'), joined(4, F.col("q") + 6), F.lit('" and then '), joined(40, F.col("p") + 2)).alias("text"))
    head = d.select(F.col("doc_id").alias("block_id"), F.lit(0).alias("nth"), F.lit("head").alias("source_id"), joined(1, F.lit(30)).alias("text"), F.col("source").alias("publisher"), F.when(F.col("lang") == "en", F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string"))).alias("url"))
    rest = d.select(F.col("doc_id").alias("block_id"), F.lit(1).alias("nth"), F.lit("rest").alias("source_id"), joined(25, F.lit(41)).alias("text"), F.lit("someone").alias("publisher"), F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"))
    return copying.copy_findings(blocks, head.unionByName(rest))
