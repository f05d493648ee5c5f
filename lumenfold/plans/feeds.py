"""Queries of sources, sinks and streams; payloads are built from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.plans.registry import query, table
from lumenfold.session import with_workers
from lumenfold.sources import feeds, sinks
from lumenfold.streaming import velocity


@query("SELECT CAST(event_id AS VARCHAR) AS id, date_trunc('millisecond', ts) AS occurred_at, value AS magnitude, event_type AS place, CAST(user_id % 360 - 180 AS DOUBLE) AS longitude, CAST(user_id % 180 - 90 AS DOUBLE) AS latitude FROM events")
def geo_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-011: incidents of GeoJSON payloads, one payload an event."""
    e = table(spark, sf_dir, "events")
    feature = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.struct(F.col("value").alias("mag"), F.col("event_type").alias("place"), F.unix_millis("ts").alias("time")).alias("properties"),
        F.struct(F.array(F.expr("user_id % 360 - 180D"), F.expr("user_id % 180 - 90D")).alias("coordinates")).alias("geometry"),
    )
    return feeds.geo_incidents(e.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("payload")))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS series_id, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS value FROM lineitem")
def series_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-004: observations of series payloads, missing values written as a full stop."""
    value = F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("string")).otherwise(".")
    row = F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), value.alias("value"))
    by = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("series_id")).agg(F.collect_list(row).alias("observations"))
    return feeds.series_observations(by.select(F.to_json(F.struct("series_id", "observations")).alias("payload")))


@query("SELECT CAST(o_custkey AS VARCHAR) AS cik, CAST(o_orderkey AS VARCHAR) AS accession, o_orderstatus AS form, CAST(o_orderdate AS DATE) AS filed FROM orders")
def filings_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-005, O-223: filings of columnar payloads."""
    row = F.struct(F.col("o_orderkey").cast("string").alias("accession"), F.col("o_orderstatus").alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"))
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("cik")).agg(F.collect_list(row).alias("r"))
    recent = F.struct(F.col("r.accession").alias("accession"), F.col("r.form").alias("form"), F.col("r.filed").alias("filed"))
    return feeds.filings(by.select(F.to_json(F.struct("cik", recent.alias("recent"))).alias("payload")))


@query("SELECT n.n_name AS country, o_orderpriority AS indicator, make_date(CAST(year(o_orderdate) AS BIGINT), 1, 1) AS observed_at, o_totalprice AS value FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation n ON n_nationkey = c_nationkey")
def indicator_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-009: yearly indicators of two-element payloads."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    row = F.struct(F.col("n_name").alias("country"), F.col("o_orderpriority").alias("indicator"), F.year("o_orderdate").cast("string").alias("date"), F.col("o_totalprice").alias("value"))
    return feeds.yearly_indicators(o.select(F.concat(F.lit('[{"page":1},'), F.to_json(F.array(row)), F.lit("]")).alias("payload")))


@query("SELECT DISTINCT o_custkey, o_orderpriority FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders h WHERE h.o_orderstatus = 'F' AND h.o_custkey = o.o_custkey AND h.o_orderpriority = o.o_orderpriority)")
def insert_ignore_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-016, O-021: keys that an insert adds to those of finished orders."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    return sinks.insert_ignore(o, o.where("o_orderstatus = 'F'"), ["o_custkey", "o_orderpriority"]).select("o_custkey", "o_orderpriority")


@query("SELECT event_type, date_trunc('day', ts) AS window_start, count(*) AS events, max(value) AS peak FROM events GROUP BY ALL")
def stream_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-294 to O-296: daily counts of a stream with a watermark, run to the end of its files."""
    stream = velocity.velocity(velocity.event_stream(with_workers(spark), f"{sf_dir}/events.parquet"))
    return velocity.run_to_end(stream, ["event_type", "window_start"], velocity.run_folder(spark))
