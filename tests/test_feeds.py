import datetime

from pyspark.sql import functions as F

from lumenfold.sources import feeds, sinks


def payloads(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "payload string")


def test_rss(spark):
    item = "<item><guid>{0}</guid><title>{1}</title><link>http://a/{0}</link><pubDate>Mon</pubDate></item>"
    feed = "<?xml version='1.0'?><rss version='2.0'><channel><title>c</title>" + item.format(1, "x" * 600) + item.format(2, "y") + item.format(3, "z") + "</channel></rss>"
    rows = feeds.rss_items(payloads(spark, feed, "<feed><item/></feed>", "", None), most=2).orderBy("guid").collect()
    assert [(r.guid, len(r.title), r.cut) for r in rows] == [("1", 512, ["title"]), ("2", 1, [])]


def test_broken_payloads_give_no_rows(spark):
    bad = payloads(spark, "{", "", None, "[]", "{}")
    for scan in (feeds.series_observations, feeds.filings, feeds.yearly_indicators, feeds.geo_incidents):
        assert scan(bad).count() == 0


def test_missing_values(spark):
    text = '{"series_id":"s","observations":[{"date":"2024-01-31","value":"."},{"date":"2024-02-30","value":"1.5"}]}'
    assert [tuple(r) for r in feeds.series_observations(payloads(spark, text)).collect()] == [("s", datetime.date(2024, 1, 31), None), ("s", None, 1.5)]


def test_mixed_periods(spark):
    df = spark.createDataFrame([("2024-03-05",), ("2024-03",), ("2024-Q3",), ("2024",), ("soon",), (None,)], "p string")
    d = datetime.date
    assert [r[0] for r in df.select(feeds.mixed_periods("p")).collect()] == [d(2024, 3, 5), d(2024, 3, 1), d(2024, 7, 1), d(2024, 1, 1), None, None]


def test_insert_ignore_and_upsert(spark, tmp_path):
    held = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, v int, t string")
    new = spark.createDataFrame([(1, 2, "c"), (3, 1, "d"), (3, 1, "d"), (None, 1, "e")], "k int, v int, t string")
    assert sorted(str(r.k) for r in sinks.insert_ignore(new, held, ["k"]).collect()) == ["3", "None"]
    sinks.upsert(new.where("k is not null"), held, ["k"], "v", f"{tmp_path}/t")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]


def test_markdown(spark):
    df = spark.createDataFrame([(1, "a*b", None)], "k int, t string, b string")
    assert sinks.markdown_lines(df, "k", "t", "b").select(F.col("line")).first()[0] == "## a\\*b\n\n\n"
