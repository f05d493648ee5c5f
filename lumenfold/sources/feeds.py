"""Scans of provider payloads: one payload a row in, one record a row out.

Each function takes a DataFrame with a string column ``payload`` (read by
``spark.read.text(..., wholetext=True)`` or from a raw table). Payloads that can't be
parsed give no rows; missing fields are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TITLE, SUMMARY = 512, 2000  # characters that a feed item keeps


def rss_items(payloads: DataFrame, most: int = 500) -> DataFrame:
    """O-001, O-002: items of RSS 2.0 documents, the first ``most`` of each (the bound is the feature).

    Other roots give no rows. ``cut`` names the fields that were longer than an item keeps.
    """
    item = "struct<guid: string, title: string, link: string, pubDate: string, description: string>"
    feeds = payloads.where(F.col("payload").rlike(r"(?s)^\s*(<\?xml.*?\?>)?\s*<rss[\s>]"))
    items = feeds.select(F.from_xml("payload", f"channel struct<item: array<{item}>>").getField("channel").getField("item").alias("items"))
    rows = items.select(F.explode(F.slice("items", 1, most)).alias("i")).select("i.*")
    longer = lambda c, n: F.when(F.length(c) > n, F.lit(c))
    return rows.select(
        F.coalesce("guid", "link").alias("guid"), F.col("link").alias("url"), F.substring("title", 1, TITLE).alias("title"), F.substring("description", 1, SUMMARY).alias("summary"),
        F.col("pubDate").alias("published"), F.array_compact(F.array(longer("title", TITLE), longer("description", SUMMARY))).alias("cut"),
    )


def series_observations(payloads: DataFrame) -> DataFrame:
    """O-004: ``{"series_id", "observations": [{"date", "value"}]}``; "." is a missing value."""
    parsed = F.from_json("payload", "series_id string, observations array<struct<date: string, value: string>>")
    rows = payloads.select(parsed.alias("p")).select("p.series_id", F.explode("p.observations").alias("o"))
    return rows.select("series_id", F.expr("try_cast(o.date as date)").alias("date"), F.expr("try_cast(nullif(o.value, '.') as double)").alias("value"))


def filings(payloads: DataFrame) -> DataFrame:
    """O-005, O-223: columnar arrays of one company, zipped to one row a filing."""
    parsed = F.from_json("payload", "cik string, recent struct<accession: array<string>, form: array<string>, filed: array<string>>")
    rows = payloads.select(parsed.alias("p")).select("p.cik", F.explode(F.arrays_zip("p.recent.accession", "p.recent.form", "p.recent.filed")).alias("f"))
    return rows.select("cik", "f.accession", "f.form", F.expr("try_cast(f.filed as date)").alias("filed"))


def yearly_indicators(payloads: DataFrame) -> DataFrame:
    """O-009: ``[meta, rows]`` with yearly periods; rows without a year are left out."""
    body = F.from_json(F.get_json_object("payload", "$[1]"), "array<struct<country: string, indicator: string, date: string, value: double>>")
    rows = payloads.select(F.explode(body).alias("r"))
    return rows.select("r.country", "r.indicator", F.make_date(F.expr("try_cast(r.date as int)"), F.lit(1), F.lit(1)).alias("observed_at"), "r.value").where("observed_at is not null")


def geo_incidents(payloads: DataFrame) -> DataFrame:
    """O-011: features of a collection; times are epoch milliseconds."""
    feature = "struct<id: string, properties: struct<mag: double, place: string, time: bigint>, geometry: struct<coordinates: array<double>>>"
    rows = payloads.select(F.explode(F.from_json("payload", f"features array<{feature}>").getField("features")).alias("f"))
    at = lambda i: F.get(F.col("f.geometry.coordinates"), F.lit(i))
    return rows.select("f.id", F.timestamp_millis("f.properties.time").alias("occurred_at"), F.col("f.properties.mag").alias("magnitude"), F.col("f.properties.place").alias("place"), at(0).alias("longitude"), at(1).alias("latitude"))


def mixed_periods(period: str) -> Column:
    """O-013: the first day of a period written as a day, month, quarter or year."""
    p = F.col(period)
    quarter = F.make_date(F.expr(f"try_cast(substring({period}, 1, 4) as int)"), F.expr(f"try_cast(substring({period}, 7, 1) as int) * 3 - 2"), F.lit(1))
    whole = lambda form, tail: F.when(p.rlike(form), F.expr(f"try_cast(concat({period}, '{tail}') as date)"))
    return F.coalesce(whole(r"^\d{4}-\d{2}-\d{2}$", ""), whole(r"^\d{4}-\d{2}$", "-01"), F.when(p.rlike(r"^\d{4}-Q[1-4]$"), quarter), whole(r"^\d{4}$", "-01-01"))
