"""Queries of filters, lists, fallback joins, tallies, metrics and JSON access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions import score
from lumenfold.plans.registry import query, table


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the') OR source ILIKE '%\\_1%' ESCAPE '\\'")
def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    r"""O-042, O-043: case-insensitive search, where % and _ of the words sought mean themselves."""
    d = table(spark, sf_dir, "documents")
    return d.where(F.contains(F.lower("text"), F.lit("the")) | F.col("source").ilike(r"%\_1%")).select("doc_id", "lang")


@query(
    r"""
    SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS INTEGER) AS words, CAST(len(regexp_extract_all(text, '"[^"]*"|“[^”]*”')) AS INTEGER) AS quotes,
      length(regexp_replace(text, '"[^"]*"|“[^”]*”', '', 'g')) AS unquoted FROM documents"""
)
def quoted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-046, O-047: words of letters and digits, and quotes apart from prose."""
    quote = F.lit('"[^"]*"|“[^”]*”')
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    quotes = F.size(F.regexp_extract_all("text", quote, F.lit(0)))
    unquoted = F.length(F.regexp_replace("text", quote, F.lit(""))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("words"), quotes.alias("quotes"), unquoted.alias("unquoted"))


@query(
    r"""
    WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host FROM pages)
    SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS site, count(*) AS pages, count(DISTINCT host) AS hosts, count(*) FILTER (WHERE host = 'example.com' OR host LIKE '%.example.com') AS own FROM h GROUP BY 1"""
)
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-056: hosts by their last two labels, and those that belong to a site."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#:]+)", 1))
    h = table(spark, sf_dir, "pages").select(host.alias("host"))
    own = (F.col("host") == "example.com") | F.col("host").endswith(".example.com")
    return h.groupBy(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("site")).agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("host").alias("hosts"), F.count_if(own).alias("own"))


@query("""SELECT event_id, 'event:' || url_encode(event_type) || ':' || user_id AS dedupe_key, 'run:' || sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS job_key FROM events""")
def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-057, O-058: a readable key of encoded parts, and a hash of canonical JSON (keys in order)."""
    parts = F.concat_ws(":", F.lit("event"), F.url_encode("event_type"), F.col("user_id").cast("string"))
    job = F.concat(F.lit("run:"), F.sha2(F.to_json(F.struct("event_type", "user_id")), 256))
    return table(spark, sf_dir, "events").select("event_id", parts.alias("dedupe_key"), job.alias("job_key"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 1e6 THEN CAST(CAST(o_totalprice / 1e6 AS DECIMAL(18, 1)) AS VARCHAR) || 'M' WHEN o_totalprice >= 1e3 THEN CAST(CAST(o_totalprice / 1e3 AS DECIMAL(18, 1)) AS VARCHAR) || 'K' ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) END AS money FROM orders")
def money_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-059: amounts with a unit."""
    x = F.col("o_totalprice")
    part = lambda by, digits, unit: F.concat((x / F.lit(by)).cast(f"decimal(18,{digits})").cast("string"), F.lit(unit))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(x >= 1e6, part(1e6, 1, "M")).when(x >= 1e3, part(1e3, 1, "K")).otherwise(part(1.0, 2, "")).alias("money"))


@query(
    """
    WITH spec(l_returnflag, direction, scale) AS (VALUES ('A', 1, 50.0), ('N', -1, 30.0), ('R', 1, 40.0))
    SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(100.0, 50 + direction * (l_quantity - 25) / scale * 100)), 4) AS signal,
      CASE WHEN direction > 0 THEN least(0.94, l_discount * 10 + 0.02) ELSE greatest(0.65, l_discount * 10 - 0.05) END AS adjusted
    FROM lineitem JOIN spec USING (l_returnflag)"""
)
def signal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-065, O-075, O-078, O-083: directed values from a table of definitions (three fixed rows, broadcast)."""
    spec = spark.createDataFrame([("A", 1, 50.0), ("N", -1, 30.0), ("R", 1, 40.0)], "l_returnflag string, direction int, scale double")
    j = table(spark, sf_dir, "lineitem").join(F.broadcast(spec), "l_returnflag")
    signal = F.round(score.clamp(50 + F.col("direction") * (F.col("l_quantity") - 25) / F.col("scale") * 100, 0.0, 100.0), 4)
    near = F.col("l_discount") * 10
    adjusted = F.when(F.col("direction") > 0, F.least(F.lit(0.94), near + 0.02)).otherwise(F.greatest(F.lit(0.65), near - 0.05))
    return j.select("l_orderkey", "l_linenumber", signal.alias("signal"), adjusted.alias("adjusted"))


@query(
    """
    WITH p AS (SELECT l_returnflag, l_linestatus, l_quantity AS w, ln((l_discount + 0.01) / (0.99 - l_discount)) AS l FROM lineitem)
    SELECT l_returnflag, l_linestatus, round(1 / (1 + exp(-sum(w * l) / sum(w))), 6) AS pooled, round(avg(1 / (1 + exp(-(0.2 + 0.9 * l)))), 6) AS platt FROM p GROUP BY ALL"""
)
def pooled_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-069: the weighted mean of logits, and a sigmoid calibration."""
    p = F.col("l_discount") + 0.01
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("w"), F.ln(p / (1 - p)).alias("l"))
    pooled = score.sigmoid(F.sum(F.col("w") * F.col("l")) / F.sum("w"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(pooled, 6).alias("pooled"), F.round(F.avg(score.sigmoid(0.2 + 0.9 * F.col("l"))), 6).alias("platt"))


@query(
    """
    WITH g AS (SELECT *, user_id * 37 % 360 - 180.0 AS lon, user_id * 17 % 180 - 90.0 AS lat FROM events),
    k AS (SELECT user_id, event_type, count(*) AS n FROM g GROUP BY ALL),
    top AS (SELECT user_id, event_type AS dominant FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1),
    m AS (SELECT user_id, round((lon + 180) / 360, 6) AS x, round((90 - lat) / 180, 6) AS y, count(DISTINCT event_id) AS events, max(value) AS risk FROM g WHERE lon BETWEEN -120 AND 60 AND lat BETWEEN -45 AND 70 GROUP BY ALL)
    SELECT m.*, dominant FROM m JOIN top USING (user_id)"""
)
def map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-084, O-155: points inside a box, their place on the map and dominant kind (ties by name)."""
    lon, lat = F.expr("user_id * 37 % 360 - 180D"), F.expr("user_id * 17 % 180 - 90D")
    g = table(spark, sf_dir, "events").withColumns({"lon": lon, "lat": lat}).where("lon between -120 and 60 and lat between -45 and 70")
    by = g.groupBy("user_id", "lon", "lat", "event_type").agg(F.count_distinct("event_id").alias("n"), F.max("value").alias("v"))
    best = F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("dominant")
    x, y = F.round((F.col("lon") + 180) / 360, 6), F.round((90 - F.col("lat")) / 180, 6)
    return by.groupBy("user_id", x.alias("x"), y.alias("y")).agg(F.sum("n").alias("events"), F.max("v").alias("risk"), best)


@query(
    """
    SELECT a.o_orderkey, count(b.o_orderkey) AS inside, coalesce(round(sum(b.o_totalprice), 2), 0) AS amount FROM orders a LEFT JOIN orders b ON b.o_custkey = a.o_custkey
      AND b.o_orderdate >= a.o_orderdate AND b.o_orderdate <= a.o_orderdate + INTERVAL 180 DAY AND b.o_orderkey <> a.o_orderkey GROUP BY 1"""
)
def validity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-097, O-131, O-144: orders within the 180 days of another one of the customer, both ends included.

    A range window per customer instead of a self join: the work grows with the rows,
    not with their pairs. The row itself is taken out again.
    """
    day = F.unix_micros("o_orderdate")
    w = W.partitionBy("o_custkey").orderBy("t").rangeBetween(0, 180 * 86_400 * 1_000_000)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), day.alias("t"))
    amount = (F.sum("price").over(w) - F.col("price")).cast("double")
    return o.select("o_orderkey", (F.count(F.lit(1)).over(w) - 1).alias("inside"), amount.alias("amount"))


@query(
    """
    SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'label' WHEN e.vec_id IS NOT NULL THEN 'embedding' END AS method, coalesce(l.quality, e.label) AS value
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""
)
def fallback_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-116, O-132, O-133, O-228: the first source that knows a key wins; without one the value is null."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    first = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("a"), F.lit("label").alias("m"))
    second = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("b"), F.lit("embedding").alias("n"))
    return d.join(first, "doc_id", "left").join(second, "doc_id", "left").select("doc_id", F.coalesce("m", "n").alias("method"), F.coalesce("a", "b").alias("value"))


@query(
    """
    WITH j AS (SELECT d.source, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)),
    n AS (SELECT source, count(*) AS total FROM j GROUP BY 1),
    t AS (SELECT source, lang AS tag FROM j UNION ALL SELECT source, 'good' FROM j WHERE quality = 1 UNION ALL SELECT source, 'toxic' FROM j WHERE toxic = 1)
    SELECT source, tag, count(*) AS hits, any_value(total) AS total, round(count(*) / any_value(total), 6) AS rate FROM t JOIN n USING (source) GROUP BY ALL"""
)
def outcome_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-151, O-154, O-224: distinct tags of each match against a fixed denominator, which is counted in the same pass."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    tags = F.array_distinct(F.array_compact(F.array("lang", F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.lit(""))))
    by = j.select("source", F.explode(tags).alias("tag")).groupBy("source", "tag").agg(F.count(F.lit(1)).alias("hits"))
    total = F.max(F.when(F.col("tag") == "", F.col("hits"))).over(W.partitionBy("source"))
    return by.withColumn("total", total).where("tag != ''").withColumn("rate", F.round(F.col("hits") / F.col("total"), 6))


@query(
    """
    WITH r AS (SELECT user_id, event_type, value < 400 AS relevant, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rank FROM events),
    f AS (SELECT user_id, event_type, min(rank) FILTER (WHERE relevant) AS first FROM r GROUP BY ALL)
    SELECT event_type, count(*) AS queries, round(avg(CASE WHEN first <= 1 THEN 1 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN first <= 3 THEN 1 ELSE 0 END), 6) AS hit_3,
      round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, count(*) FILTER (WHERE first IS NULL) AS none FROM f GROUP BY 1"""
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-159: hit rates and the mean reciprocal rank; a query without a relevant row counts as zero."""
    w = W.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")
    r = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.row_number().over(w).alias("rank"))
    f = r.groupBy("user_id", "event_type").agg(F.min(F.when(F.col("value") < 400, F.col("rank"))).alias("first"))
    hit = lambda k: F.round(F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))), 6)
    return f.groupBy("event_type").agg(F.count(F.lit(1)).alias("queries"), hit(1).alias("hit_1"), hit(3).alias("hit_3"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.count_if(F.col("first").isNull()).alias("none"))


@query(
    """
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, coalesce(sum(CAST(o_totalprice AS DECIMAL(18, 2))) FILTER (WHERE o_orderstatus = 'F'), 0) AS finalized,
      coalesce(sum(CAST(o_totalprice AS DECIMAL(18, 2))) FILTER (WHERE o_orderstatus = 'O'), 0) AS reserved, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS unresolved FROM orders GROUP BY 1"""
)
def spending_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-163: exact sums of each month by status."""
    price, status = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderstatus")
    total = lambda s: F.coalesce(F.sum(F.when(status == s, price)), F.lit(0).cast("decimal(18,2)"))
    by = table(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"))
    return by.agg(total("F").alias("finalized"), total("O").alias("reserved"), F.count_if(~status.isin("F", "O")).alias("unresolved"))


@query(
    """
    WITH s AS (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1)
    SELECT l_suppkey, v[CAST(floor((len(v) - 1) * 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor((len(v) - 1) * 0.95) AS BIGINT) + 1] AS p95 FROM s"""
)
def nearest_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-160, O-167: nearest-rank percentiles; equal values are counted first, and no group is collected."""
    by = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_extendedprice").agg(F.count(F.lit(1)).alias("n"))
    part = W.partitionBy("l_suppkey")
    ranked = by.withColumns({"upto": F.sum("n").over(part.orderBy("l_extendedprice").rowsBetween(W.unboundedPreceding, 0)), "all": F.sum("n").over(part)})
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * p), F.col("l_extendedprice")))
    return ranked.groupBy("l_suppkey").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query(
    """
    WITH v AS (SELECT l_orderkey, count(*) AS lines, count(DISTINCT l_linenumber) AS numbers FROM lineitem GROUP BY 1 HAVING count(*) >= 3 AND count(*) = count(DISTINCT l_linenumber))
    SELECT o_custkey, o_orderkey, lines FROM orders JOIN v ON l_orderkey = o_orderkey QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""
)
def newest_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-125, O-176, O-182: the newest complete set of each key."""
    v = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("l_linenumber").alias("numbers")).where("lines >= 3 and lines = numbers")
    j = table(spark, sf_dir, "orders").join(v, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "lines")).alias("r")).select("o_custkey", "r.o_orderkey", "r.lines")


@query(
    """
    SELECT sha256(text) AS content_hash, count(DISTINCT source) AS sources, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1"""
)
def leaked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-122, O-179, O-209: texts that lie in several groups, with the row seen first."""
    by = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash"))
    return by.agg(F.count_distinct("source").alias("sources"), F.min("doc_id").alias("first_doc")).where("sources > 1")


@query("(SELECT doc_id, 'both' AS side FROM (SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings)) UNION ALL (SELECT doc_id, 'labels' FROM (SELECT doc_id FROM labels EXCEPT SELECT vec_id FROM embeddings)) UNION ALL (SELECT vec_id, 'embeddings' FROM (SELECT vec_id FROM embeddings EXCEPT SELECT doc_id FROM labels))")
def key_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-203, O-205, O-206, O-210: which side knows a key; one shuffle gives intersection and both differences."""
    keys = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("s")).union(table(spark, sf_dir, "embeddings").select("vec_id", F.lit(2)))
    both = keys.groupBy("doc_id").agg(F.bit_or("s").alias("s"))
    return both.select("doc_id", F.when(F.col("s") == 3, "both").when(F.col("s") == 1, "labels").otherwise("embeddings").alias("side"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(len(json_keys(props)) AS INTEGER) AS fields, user_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-106, O-188, O-225, O-226, O-229: numbers out of JSON text, and a lookup that ignores the case of keys."""
    props = F.from_json("props", "map<string,string>")
    found = F.get(F.map_values(F.map_filter(props, lambda k, _: F.lower(k) == "k")), F.lit(0))
    e = table(spark, sf_dir, "events").where(F.expr("try_cast(get_json_object(props, '$.k') as double) >= 50"))
    return e.select("event_id", found.cast("double").alias("k"), F.size(props).alias("fields"), "user_id")


@query(
    """
    WITH b AS (SELECT event_id, ts, user_id, value, CASE WHEN value >= 400 THEN 'high' WHEN value >= 250 THEN 'medium' ELSE 'low' END AS level FROM events WHERE upper(event_type) IN ('CLICK', 'VIEW', 'PURCHASE') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20')
    SELECT event_id, level, count(*) OVER () AS total FROM b WHERE level <> 'low' ORDER BY value DESC NULLS LAST, event_id LIMIT 50"""
)
def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-099 to O-102, O-107, O-232, O-237: filters, a derived level, the count of all and a page (the feature)."""
    level = F.when(F.col("value") >= 400, "high").when(F.col("value") >= 250, "medium").otherwise("low")
    e = table(spark, sf_dir, "events").where("ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20'").where(F.upper("event_type").isin("CLICK", "VIEW", "PURCHASE"))
    b = e.select("event_id", "value", level.alias("level")).where("level != 'low'")
    page = b.orderBy(F.col("value").desc_nulls_last(), "event_id").limit(50)
    return page.select("event_id", "level").withColumn("total", b.agg(F.count(F.lit(1))).scalar())


@query(
    """
    SELECT d.lang, count(*) AS observed, count(l.doc_id) AS admitted, count(e.vec_id) AS grouped, count(*) FILTER (WHERE l.doc_id IS NOT NULL AND e.vec_id IS NOT NULL) AS completed, count(*) FILTER (WHERE l.doc_id IS NULL) AS pending
    FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY 1"""
)
def collection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-166: how far the documents of each language have come."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    a = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("a"))
    g = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("g"))
    j = d.join(a, "doc_id", "left").join(g, "doc_id", "left")
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("observed"), F.count("a").alias("admitted"), F.count("g").alias("grouped"), F.count_if(F.col("a") & F.col("g")).alias("completed"), F.count_if(F.col("a").isNull()).alias("pending"))
