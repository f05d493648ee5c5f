"""Queries of the scalar functions: text, URLs, scores, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import moments, score, text
from lumenfold.plans.registry import query, table

_SUFFIXES = "|".join(text.LEGAL_SUFFIXES)


@query(
    r"""
    WITH p AS (SELECT page_id, trim(url) || CASE page_id % 3 WHEN 0 THEN '' ELSE CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'b=%7e%20x&UTM_a=1&b&a=2&a=10&a%3D=q*+' || page_id || '&cmpid=3#top' END AS u FROM pages),
    q AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
      lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
      regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
      [{'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(x, '^[^=]*=(.*)$', 1), '+', ' '))} FOR x IN string_split(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*\?([^#]*)', 1), '&') IF x <> ''] AS pairs FROM p),
    k AS (SELECT *, list_sort([x FOR x IN pairs IF NOT regexp_matches(lower(x.k), '^utm_|^(gclid|fbclid|mc_cid|mc_eid|ref|cmpid|igshid)$')]) AS kept FROM q),
    r AS (SELECT page_id, scheme || '://' || CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') WHEN scheme = 'https' THEN regexp_replace(host, ':443$', '') ELSE host END
      || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string([replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+') FOR x IN kept], '&') END AS url FROM k)
    SELECT page_id, url, sha256(url) AS url_hash FROM r"""
)
def url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-026, O-027: canonical URL and its hash; two of three pages get parameters to be sorted, re-encoded and left out."""
    more = F.concat(F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("b=%7e%20x&UTM_a=1&b&a=2&a=10&a%3D=q*+"), F.col("page_id").cast("string"), F.lit("&cmpid=3#top"))
    url = F.concat(F.trim("url"), F.when(F.col("page_id") % 3 == 0, "").otherwise(more))
    return table(spark, sf_dir, "pages").select("page_id", text.normalize_url(url).alias("url"), text.url_hash(url).alias("url_hash"))


@query(
    rf"""
    SELECT s_suppkey, regexp_replace(w, '(\S)( ({_SUFFIXES}))+$', '\1') AS alias, trim(regexp_replace(lower(s_name), '\s+', ' ', 'g')) AS name,
      lpad(regexp_replace(s_name, '\D', '', 'g'), 10, '0') AS cik,
      regexp_replace(regexp_replace(lower(s_name), '[^\pL\pN]+', '-', 'g'), '^-|-$', '', 'g') AS industry_id
    FROM (SELECT *, trim(regexp_replace(regexp_replace(translate(lower(s_name || ', Inc. Ltd.'), '.''’`´', ''), '[^\pL\pN\s]', ' ', 'g'), '\s+', ' ', 'g')) AS w FROM supplier)"""
)
def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-030 to O-032, O-034: names, aliases and ids as keys."""
    name = F.col("s_name")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        text.normalize_alias(F.concat(name, F.lit(", Inc. Ltd."))).alias("alias"),
        text.normalize_name(name).alias("name"),
        text.normalize_cik(name).alias("cik"),
        text.normalize_industry_id(name).alias("industry_id"),
    )


@query(
    r"""
    WITH d AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents)
    SELECT doc_id, CAST(ceil(length(c) / 4.0) AS BIGINT) AS tokens, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS words,
      CASE WHEN length(c) <= 256 THEN c ELSE rtrim(regexp_replace(substr(c, 1, 256), '\s\S*$', '')) END AS head,
      sha256(trim(substr(text, 1, 80)) || chr(10) || trim(text)) AS content_hash, substr(text, 1, 200) AS excerpt, length(text) > 200 AS truncated
    FROM d"""
)
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-028, O-035 to O-037, O-044, O-045: hashes, budgets, excerpts."""
    t = F.col("text")
    cut = text.excerpt(F.lit(None).cast("string"), t)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.estimate_tokens(t).alias("tokens"),
        text.word_count(t).cast("long").alias("words"),
        text.truncate_to_tokens(t, 64).alias("head"),
        text.content_hash(F.substring(t, 1, 80), F.lit(None).cast("string"), t).alias("content_hash"),
        cut["text"].alias("excerpt"),
        cut["truncated"].alias("truncated"),
    )


@query(
    r"""
    WITH t AS (SELECT conv_id, turn, trim(regexp_replace(lower(translate(text, '‘’“”', '''''""')), '\s+', ' ', 'g')) AS s FROM conversations)
    SELECT conv_id, turn, CASE WHEN regexp_matches(s, '\b(denied|denies|refuted|dismissed|rejected claims of|not in talks)\b') THEN 'denied'
      WHEN regexp_matches(s, '\b(reportedly|rumored|rumors|speculation|considering|exploring|in talks|weighing|may|sources say)\b') THEN 'speculative' ELSE 'asserted' END AS status
    FROM t"""
)
def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-053: denied, speculative or asserted."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.assertion_status(F.col("text")).alias("status"))


@query(
    r"""
    WITH p AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\pL\pN]+'), ' ') || ' ' AS w FROM documents)
    SELECT doc_id, contains(w, ' of the ') AS included, contains(w, ' in the ') AS excluded, contains(w, ' of the ') AND NOT contains(w, ' in the ') AS matches FROM p"""
)
def phrase_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-040, O-041, O-109: include and exclude phrases; exclude wins."""
    inc, exc = (text.has_phrase(F.col("text"), F.lit(p)) for p in ("of the", "in the"))
    return table(spark, sf_dir, "documents").select("doc_id", inc.alias("included"), exc.alias("excluded"), (inc & ~exc).alias("matches"))


@query(
    """
    WITH e AS (SELECT event_id, least(100.0, value) AS s, value FROM events)
    SELECT event_id, CASE WHEN s <= 30 THEN 'low' WHEN s <= 55 THEN 'medium' WHEN s <= 75 THEN 'high' ELSE 'critical' END AS level,
      round(1 / (1 + exp(-(s - 45) / 14)), 6) AS probability,
      round(0.35 * s + 0.30 * least(100.0, value / 2) + 0.15 * least(100.0, value / 3) + 0.10 * 50 + 0.10 * 80, 6) AS risk_score
    FROM e"""
)
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-060, O-066, O-068: bands, plain logistic baseline, weighted components."""
    v = F.col("value")
    s = score.clamp(v, 0.0, 100.0)
    parts = {"probability_score": s, "impact_score": score.clamp(v / 2, 0.0, 100.0), "urgency_score": score.clamp(v / 3, 0.0, 100.0), "evidence_strength": F.lit(50.0), "model_consensus": F.lit(80.0)}
    return table(spark, sf_dir, "events").select("event_id", score.risk_level(s).alias("level"), F.round(score.sigmoid((s - 45) / 14), 6).alias("probability"), score.weighted_score(parts, digits=6).alias("risk_score"))


@query(
    """
    WITH e AS (SELECT event_id, ts, timezone('America/New_York', timezone('UTC', ts)) AS l FROM events),
    b AS (SELECT event_id, ts, l, CASE WHEN l <= CAST(l AS DATE) + INTERVAL '5 hours 30 minutes' THEN CAST(l AS DATE) ELSE CAST(CAST(l AS DATE) + INTERVAL 1 DAY AS DATE) END AS brief FROM e)
    SELECT event_id, brief AS brief_date, CAST(timezone('Asia/Tokyo', timezone('UTC', ts)) AS DATE) AS tokyo_date,
      CAST(date_trunc('month', ts) AS DATE) AS month_start, CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS DATE) AS next_month FROM b"""
)
def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-086, O-087, O-089, O-090, O-092: brief windows, zone dates, month bounds."""
    ts = F.col("ts")
    month = F.to_date(F.date_trunc("month", ts))
    return table(spark, sf_dir, "events").select("event_id", moments.brief_date(ts).alias("brief_date"), moments.local_date(ts, "Asia/Tokyo").alias("tokyo_date"), month.alias("month_start"), F.add_months(month, 1).alias("next_month"))


@query(
    r"""
    SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages"""
)
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-054: the plain text of filings and pages."""
    return table(spark, sf_dir, "pages").select("page_id", text.plain_text(F.col("html")).alias("body"))
