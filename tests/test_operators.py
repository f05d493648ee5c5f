from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumenfold.functions import moments, score, text
from lumenfold.operators import graphs, relational, vectors
from lumenfold.operators.lifecycle import AlertState, fold, next_level


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_urls_and_aliases(spark):
    url = text.normalize_url(F.col("u"))
    assert one(spark, url, u="HTTPS://Example.com:443/news/1/?utm_source=x&id=7#frag") == "https://example.com/news/1?id=7"
    assert one(spark, url, u="http://a.com") == "http://a.com/"
    alias = text.normalize_alias(F.col("a"))
    assert one(spark, alias, a="Coca-Cola Co., Inc.") == "coca cola"
    assert one(spark, alias, a="Group") == "group"
    assert one(spark, alias, a="Macy's") == "macys"


def test_assertions(spark):
    status = text.assertion_status(F.col("s"))
    assert one(spark, status, s="It denied reports that it may merge") == "denied"
    assert one(spark, status, s="The firm may merge") == "speculative"
    assert one(spark, status, s="The firm merged") == "asserted"


def test_scores(spark):
    df = spark.createDataFrame([(30.0,), (30.5,), (55.0,), (75.0,), (75.1,), (None,)], "s double")
    assert [r[0] for r in df.select(score.risk_level(F.col("s"))).collect()] == ["low", "medium", "medium", "high", "critical", None]
    assert one(spark, score.clamp(F.lit(None).cast("double")), x=1) is None
    p = spark.range(1).select(score.horizon_probabilities(F.lit(70.0), F.lit(50.0)).alias("p")).select("p.*").first()
    assert abs(p.p_0_6 + p.p_6_12 + p.p_12_18 - p.p_18) < 1e-9


def test_brief_windows_cover_all_instants_once(spark):
    df = spark.sql("select * from values (timestamp '2026-03-08 09:30:00'), (timestamp '2026-03-08 09:30:01'), (timestamp '2026-11-01 10:30:00'), (timestamp '2026-11-01 10:30:01') t(m)")
    days = [str(r[0]) for r in df.select(moments.brief_date(F.col("m"))).collect()]
    assert days == ["2026-03-08", "2026-03-09", "2026-11-01", "2026-11-02"]


def test_redirects(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4), (6, 1), (6, 2)], ["old", "new"])
    starts = spark.createDataFrame([(1,), (3,), (4,), (6,)], ["node"])
    got = {r.node: (r.target, r.status) for r in graphs.follow_redirects(starts, edges).collect()}
    assert got == {1: (3, "ok"), 3: (3, "ok"), 4: (5, "cycle"), 6: (6, "fork")}


def test_parent_exposure(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.5), (1, 3, 0.4), (3, 1, 1.0)], ["child", "parent", "confidence"])
    got = {(r.origin, r.parent): (round(r.confidence, 3), r.depth) for r in graphs.parent_exposure(edges).collect()}
    assert got[(1, 3)] == (0.45, 2) and got[(1, 2)] == (0.9, 1) and (1, 1) not in got


def test_merge_and_streak(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], ["k", "v", "x"])
    new = spark.createDataFrame([(1, 2, "c"), (2, 5, "d"), (3, 1, "e")], ["k", "v", "x"])
    assert {r.k: r.x for r in relational.merge_latest(old, new, ["k"], "v").collect()} == {1: "c", 2: "d", 3: "e"}
    df = spark.createDataFrame([(1, t, z) for t, z in enumerate([3.0, 3.0, None, 3.0, 1.0, 3.0])], "k int, t int, z double")
    out = relational.streaks(df, ["k"], [F.col("t")], F.col("z") > 2.5).orderBy("t").collect()
    assert [r.streak for r in out] == [1, 2, 0, 1, 0, 1]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [1.0, 0.0])], ["a", "b"])
    assert [round(r[0], 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.707107]


def test_lifecycle():
    assert [next_level(s, "low") for s in (36.9, 37, 62, 82)] == ["low", "medium", "high", "critical"]
    assert [next_level(s, "critical") for s in (71, 70, 50, 25)] == ["critical", "high", "medium", "low"]
    day = datetime(2024, 1, 1)
    scores = [(0, 90.0), (1, 20.0), (8, 20.0), (8.5, 90.0), (10, 90.0), (9, 1.0), (10, 1.0)]
    out = list(fold([(i, day + timedelta(days=d), s) for i, (d, s) in enumerate(scores)], AlertState()))
    assert [r[1] for r in out] == ["opened", "downgraded", "resolved", "cooldown", "opened", "late", "replay"]


def test_unknown_confidence_counts_as_one(spark):
    from lumenfold.operators.graphs import parent_exposure

    edges = spark.createDataFrame([("a", "b", None), ("b", "c", 0.5), ("a", "c", 0.4)], "child string, parent string, confidence double")
    assert {tuple(r) for r in parent_exposure(edges).collect()} == {("a", "b", 1.0, 1), ("b", "c", 0.5, 1), ("a", "c", 0.5, 2)}


def test_urls_as_the_standard_library_has_them(spark):
    from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

    def plain(url):
        parts = urlsplit(url.strip())
        scheme, host = (parts.scheme or "https").lower(), parts.netloc.lower()
        for name, port in (("http", ":80"), ("https", ":443")):
            host = host.removesuffix(port) if scheme == name else host
        kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in text.TRACKING_KEYS]
        return urlunsplit((scheme, host, parts.path.rstrip("/") or "/", urlencode(sorted(kept)), ""))

    urls = ["http://A.com:80", "https://a.com/x//?b=2&b=10&a", "a.com/x", "//a.com/x?ref=1", "http://a.com?q=a+b%20c%7E*~&REF=2&utm_x=1&source=3", "ftp://a:443/?=x&k==&é=ü", "https://a.com/?a%3D=1&a=2", "http://a.com:8080/#f?x=1", " HTTP://a.com/%7Ex/ "]
    for url in urls:
        assert one(spark, text.normalize_url(F.col("u")), u=url) == plain(url), url


def test_ciks_and_tokens(spark):
    cik = lambda x: one(spark, text.normalize_cik(F.col("u")), u=x)
    assert [cik(x) for x in ("CIK 320193", "12345678901", "none", "")] == ["0000320193", "12345678901", None, None]
    kinds = ("banking_stress", "supply_shock", "pandemic")
    found = lambda x: one(spark, text.canonical_type(F.col("u"), kinds), u=x)
    assert [found(x) for x in (" Bank-Run ", "supply.chain", "Pandemic", "sovereign/default", "x", "")] == ["banking_stress", "supply_shock", "pandemic", None, None, None]


def test_severities_by_name_and_magnitude(spark):
    rows = [("HIGH", 1.0), ("medium", None), ("Low", 9.0), (None, 6.1), ("odd", 9.0), ("odd", -1.0), (None, None)]
    df = spark.createDataFrame(rows, "name string, magnitude double")
    assert [r[0] for r in df.select(score.incident_severity(F.col("name"), F.col("magnitude"))).collect()] == [85.0, 55.0, 25.0, 76.25, 100.0, 0.0, 35.0]
