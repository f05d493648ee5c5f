"""Queries of the relational operators: joins, latest rows, windows, paging, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions import moments, score
from lumenfold.operators import graphs, relational, vectors
from lumenfold.plans.registry import query, table


@query(
    """
    WITH g AS (SELECT e.label, d.lang, count(*) AS articles, count(DISTINCT d.source) AS sources, min(v.ts) AS first_at, max(v.ts) AS last_at
      FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id JOIN events v ON v.event_id = d.doc_id GROUP BY ALL),
    s AS (SELECT *, greatest(1.0, (epoch_us(last_at) - epoch_us(first_at)) / 3.6e9) AS span FROM g),
    r AS (SELECT label, lang, articles, sources, round(span, 4) AS span_hours, round(100 * (0.6 * tanh(articles / 5.0) + 0.4 * tanh(sources / 3.0)), 2) AS severity,
      round(100 * (0.30 * tanh(articles / 8.0) + 0.25 * tanh(articles / span / 3.0) + 0.20 * tanh(sources / 4.0) + 0.15 * 0.5 + 0.10 * 0.5), 2) AS hotness FROM s)
    SELECT *, CAST(row_number() OVER (ORDER BY hotness DESC, articles DESC, label, lang) AS INTEGER) AS rank FROM r"""
)
def hot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-061, O-062, O-094, O-185: features of clusters, ranked. A cluster is one row, so the rank's window is small."""
    joined = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents"), F.col("doc_id") == F.col("vec_id")).join(table(spark, sf_dir, "events"), F.col("event_id") == F.col("doc_id"))
    groups = joined.groupBy("label", "lang").agg(F.count(F.lit(1)).alias("articles"), F.count_distinct("source").alias("sources"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    span = moments.span_hours(F.col("first_at"), F.col("last_at"))
    a, s = F.col("articles"), F.col("sources")
    made = groups.select("label", "lang", "articles", "sources", F.round(span, 4).alias("span_hours"), score.event_severity(a, s).alias("severity"), score.event_hotness(a, s, span).alias("hotness"))
    return made.withColumn("rank", F.row_number().over(W.orderBy(F.desc("hotness"), F.desc("articles"), "label", "lang")))


@query("SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-120, O-143, O-169, O-170, O-180, O-196: the latest row of each key."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("r"))
    return last.select("user_id", "event_type", "r.event_id", "r.ts", "r.value")


@query(
    """
    WITH a AS (SELECT user_id, max((ts, event_id, value)) AS r FROM (SELECT user_id, ts, event_id, value FROM events WHERE ts <= TIMESTAMP '2024-01-20') GROUP BY user_id),
    b AS (SELECT user_id, max_by(value, (ts, event_id)) AS v FROM events WHERE ts <= TIMESTAMP '2024-01-13' GROUP BY user_id),
    c AS (SELECT user_id, max_by(value, (ts, event_id)) AS v FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY user_id)
    SELECT c.user_id, c.v AS current, b.v AS previous, round(c.v - b.v, 4) AS delta FROM c LEFT JOIN b USING (user_id)"""
)
def risk_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-127 to O-129, O-234: as-of values at two cutoffs in one pass."""
    e = table(spark, sf_dir, "events").where("ts <= timestamp '2024-01-20'")
    at = F.struct("ts", "event_id", "value")
    two = e.groupBy("user_id").agg(F.max(at).alias("c"), F.max(F.when(F.col("ts") <= F.expr("timestamp '2024-01-13'"), at)).alias("p"))
    return two.select("user_id", F.col("c.value").alias("current"), F.col("p.value").alias("previous"), F.round(F.col("c.value") - F.col("p.value"), 4).alias("delta"))


@query(
    """
    SELECT user_id, event_type, event_id, CAST(row_number() OVER w AS INTEGER) AS rank FROM events
    WINDOW w AS (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) QUALIFY row_number() OVER w <= 3"""
)
def top_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-171 to O-173: the top three of each group in a total order."""
    return relational.top_n(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_type", "event_id", "rank")


@query(
    """
    WITH f AS (SELECT *, coalesce(value > 250, false) AS good FROM events),
    g AS (SELECT *, sum(CASE WHEN good THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f)
    SELECT event_id, CAST(sum(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS BIGINT) AS streak FROM g"""
)
def velocity_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-175, O-286: consecutive readings above the threshold."""
    return relational.streaks(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("value") > 250).select("event_id", "streak")


@query(
    """
    WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents)
    SELECT doc_id, source, CAST(turn AS INTEGER) AS turn FROM r ORDER BY turn, source LIMIT 100"""
)
def admission_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-177, O-267: up to 100 documents, one of each source in turn (the quota is the feature)."""
    return relational.round_robin(table(spark, sf_dir, "documents"), "source", [F.col("doc_id")], 100).select("doc_id", "source", "turn")


@query(
    """
    WITH d AS (SELECT doc_id, lang, sha256('trial:' || CAST(doc_id AS VARCHAR)) AS draw FROM documents)
    SELECT doc_id, lang FROM d QUALIFY row_number() OVER (PARTITION BY lang ORDER BY draw, doc_id) <= 20"""
)
def trial_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-178: a seeded sample of each group (the sample is the feature)."""
    return relational.seeded_sample(table(spark, sf_dir, "documents"), ["lang"], "doc_id", "trial", 20).select("doc_id", "lang")


@query(
    """
    SELECT doc_id, content_hash, lead, copies, doc_id <> lead AS duplicate FROM (SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, min(doc_id) OVER w AS lead, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY coalesce(text, '')))"""
)
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-146, O-200: each document with the first one of its text, new or duplicate: hashes are counted before they are joined back."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    g = d.groupBy("content_hash").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("copies"))
    return d.join(g, "content_hash").select("doc_id", "content_hash", "lead", "copies", (F.col("doc_id") != F.col("lead")).alias("duplicate"))


@query(
    """
    SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
      AND EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)"""
)
def unlabelled_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-117 to O-119, O-293: what is left to do, as semi and anti joins."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").join(e, "doc_id", "left_semi")


@query(
    """
    SELECT n.n_name, r.r_name, count(*) AS orders, count(DISTINCT c.c_custkey) AS customers, round(sum(o.o_totalprice), 2) AS total, round(avg(o.o_totalprice), 2) AS mean
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
    GROUP BY ALL"""
)
def exposure_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-115, O-141, O-142: a chain of equi-joins and grouped totals."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = o.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("c_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@query(
    """
    SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
    ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 25"""
)
def order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-140, O-183, O-184: a page in a total order with the count of all (the page is the feature)."""
    base = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01'").select("o_orderkey", "o_totalprice")
    page = base.orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").offset(25).limit(25)
    return page.withColumn("total", base.agg(F.count(F.lit(1))).scalar())


@query(
    """
    WITH m AS (SELECT l_suppkey, date_trunc('month', l_shipdate) AS month, sum(l_extendedprice) AS revenue, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL),
    p AS (SELECT *, lag(revenue) OVER w AS before, lag(quantity) OVER w AS quantity_before FROM m WINDOW w AS (PARTITION BY l_suppkey ORDER BY month))
    SELECT l_suppkey, CAST(month AS DATE) AS month, round(revenue, 2) AS revenue, round((revenue - before) / before, 6) AS change,
      CASE WHEN before IS NOT NULL THEN round(least(100.0, abs((revenue - before) / before) / 0.25 * 100), 4) END AS price_shock,
      CASE WHEN before IS NOT NULL THEN round(least(100.0, greatest(0.0, (quantity_before - quantity) / quantity_before) / 0.20 * 100), 4) END AS stock_draw FROM p"""
)
def supply_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-077, O-128, O-241: each period against the one before."""
    m = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.to_date(F.date_trunc("month", "l_shipdate")).alias("month")).agg(F.sum("l_extendedprice").alias("r"), F.sum("l_quantity").alias("q"))
    w = W.partitionBy("l_suppkey").orderBy("month")
    p = m.withColumns({"rb": F.lag("r").over(w), "qb": F.lag("q").over(w)})
    change = (F.col("r") - F.col("rb")) / F.col("rb")
    draw = (F.col("qb") - F.col("q")) / F.col("qb")
    return p.select("l_suppkey", "month", F.round("r", 2).alias("revenue"), F.round(change, 6).alias("change"), F.round(score.clamp(F.abs(change) / 0.25 * 100, 0.0, 100.0), 4).alias("price_shock"), F.round(score.clamp(draw / 0.20 * 100, 0.0, 100.0), 4).alias("stock_draw"))


@query(
    """
    WITH x AS (SELECT event_type, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-21' AND ts <= TIMESTAMP '2024-01-28') AS recent,
      count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-14' AND ts <= TIMESTAMP '2024-01-21') AS before FROM events GROUP BY 1)
    SELECT event_type, recent, before, round((recent - before) / nullif(before, 0), 6) AS velocity FROM x"""
)
def window_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-174, O-296: a window (start, end] against the one before."""
    inside = lambda a, b: F.count_if(F.expr(f"ts > timestamp '2024-01-{a}' and ts <= timestamp '2024-01-{b}'"))
    x = table(spark, sf_dir, "events").groupBy("event_type").agg(inside(21, 28).alias("recent"), inside(14, 21).alias("before"))
    return x.withColumn("velocity", F.round(F.try_divide(F.col("recent") - F.col("before"), F.col("before")), 6))


@query(
    """
    WITH x AS (SELECT d.lang, (length(regexp_replace(text, '[^!%&$#*|]', '', 'g')) * 100.0 / greatest(length(text), 1)) < 2 AS p, quality = 1 AS a FROM documents d JOIN labels USING (doc_id)),
    c AS (SELECT lang, count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE p AND NOT a) AS fp, count(*) FILTER (WHERE NOT p AND NOT a) AS tn, count(*) FILTER (WHERE NOT p AND a) AS fn FROM x GROUP BY 1)
    SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity FROM c"""
)
def rule_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-157, O-158: confusion counts and rates of a rule against the labels."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    share = F.length(F.regexp_replace("text", "[^!%&$#*|]", "")) * 100.0 / F.greatest(F.length("text"), F.lit(1))
    return relational.confusion(d.select("lang", (share < 2).alias("p"), (F.col("quality") == 1).alias("a")), ["lang"], F.col("p"), F.col("a"))


@query(
    """
    WITH s AS (SELECT l.doc_id, l.toxic AS y, (d.n_chars % 1000) / 1000.0 AS p FROM labels l JOIN documents d USING (doc_id)), g AS (SELECT unnest(range(0, 51)) / 50.0 AS threshold),
    m AS (SELECT threshold, count(*) FILTER (WHERE p >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE p >= threshold AND y = 0) AS fp, count(*) FILTER (WHERE p < threshold AND y = 1) AS fn FROM s, g GROUP BY 1)
    SELECT CAST(threshold AS DOUBLE) AS threshold, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM m"""
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """51 thresholds over scored rows, by cumulative counts instead of a product of rows and thresholds."""
    s = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("toxic", ((F.col("n_chars") % 1000) / 1000.0).alias("p"))
    # A row counts as positive for the thresholds up to its score: one bucket a row, then sums from above.
    bucket = F.floor(F.col("p") * 50 + 1e-9).cast("int")
    counts = s.groupBy(F.least(bucket, F.lit(50)).alias("b")).agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg"))
    grid = spark.range(51).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0)
    above, every = W.orderBy(F.desc("b")), W.partitionBy()  # 51 rows
    m = grid.select((F.col("b") / 50).alias("threshold"), F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(every).alias("n"))
    m = m.withColumn("fn", F.col("n") - F.col("tp"))
    rate = lambda bottom: F.round(F.try_divide(F.col("tp"), F.expr(bottom)), 6)
    return m.select("threshold", "tp", "fp", "fn", rate("tp + fp").alias("precision"), rate("tp + fn").alias("recall"))


@query(
    """
    SELECT p_brand, p_type, count(*) AS parts, round(median(p_retailprice), 4) AS median_price, round(stddev_pop(p_retailprice), 4) AS spread, CAST(min(p_size) AS INTEGER) AS least, CAST(max(p_size) AS INTEGER) AS most
    FROM part GROUP BY ALL HAVING count(*) >= 2"""
)
def peer_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-150, O-160, O-263: peers of at least two with medians and spread."""
    g = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("parts"), F.round(F.median("p_retailprice"), 4).alias("median_price"), F.round(F.stddev_pop("p_retailprice"), 4).alias("spread"), F.min("p_size").alias("least"), F.max("p_size").alias("most"))
    return g.where("parts >= 2")


@query(
    """
    WITH j AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
    SELECT user_id, count(*) AS n, round(sum(k), 4) AS total, round(max(k), 4) AS most FROM j WHERE k >= 1 GROUP BY 1"""
)
def json_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-106, O-188, O-226: JSON fields as numbers."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select("user_id", k.alias("k")).where("k >= 1").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("k"), 4).alias("total"), F.round(F.max("k"), 4).alias("most"))


@query(
    """
    SELECT 'orders' AS bucket, count(*) AS n, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'
    UNION ALL SELECT 'lineitem', count(*), min(l_shipdate), max(l_shipdate) FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'
    UNION ALL SELECT 'events', count(*), min(ts), max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-10'"""
)
def retention_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-025, O-199: what is older than the limit, by bucket."""
    def bucket(name: str, column: str, limit: str) -> DataFrame:
        old = table(spark, sf_dir, name).where(F.col(column) < F.expr(f"timestamp '{limit}'"))
        return old.agg(F.lit(name).alias("bucket"), F.count(F.lit(1)).alias("n"), F.min(column).alias("first_at"), F.max(column).alias("last_at"))

    return bucket("orders", "o_orderdate", "1996-01-01").unionByName(bucket("lineitem", "l_shipdate", "1996-01-01")).unionByName(bucket("events", "ts", "2024-01-10"))


@query(
    """
    WITH w AS (SELECT o_orderkey, o_custkey, CAST(round(o_totalprice) AS BIGINT) AS v FROM orders WHERE o_orderkey % 3 <> 0),
    h AS (SELECT o_orderkey, o_custkey, CAST(round(o_totalprice) AS BIGINT) + (o_orderkey % 5 = 0)::INT AS v FROM orders WHERE o_orderkey % 4 <> 0)
    SELECT coalesce(w.o_orderkey, h.o_orderkey) AS o_orderkey, CASE WHEN h.o_orderkey IS NULL THEN 'inserted' WHEN w.o_orderkey IS NULL THEN 'removed' WHEN w.v = h.v THEN 'kept' ELSE 'updated' END AS action
    FROM w FULL JOIN h ON w.o_orderkey = h.o_orderkey"""
)
def reconcile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-022: which rows to insert, update and remove so that a held set equals a wanted one."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("v"))
    held = o.where("o_orderkey % 4 <> 0").withColumn("v", F.col("v") + (F.col("o_orderkey") % 5 == 0).cast("int"))
    return relational.reconcile(o.where("o_orderkey % 3 <> 0"), held, ["o_orderkey"], "v")


@query(
    """
    WITH p AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS similarity
      FROM embeddings q JOIN embeddings i ON q.label = i.label AND q.vec_id <> i.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM p)
    SELECT query_id, item_id, similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5 AND similarity >= 0.2"""
)
def similar_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-064, O-135, O-193, O-214: top five by cosine among items of the label, then the threshold."""
    e = table(spark, sf_dir, "embeddings")
    items = e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")
    queries = items.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    return vectors.nearest(queries, items, 5, 0.2)


@query(
    """
    WITH RECURSIVE e AS (SELECT DISTINCT ps AS old, pn AS new FROM (SELECT l_suppkey AS ps, max(l_suppkey) FILTER (WHERE l_quantity > 25) OVER (PARTITION BY l_orderkey) AS pn FROM lineitem) WHERE pn > ps AND ps % 7 <> 0),
    s AS (SELECT old, min(new) AS new, count(*) AS n FROM e GROUP BY 1),
    w(node, here, hops, status) AS (SELECT s_suppkey, s_suppkey, 0, 'open' FROM supplier UNION ALL
      SELECT node, CASE WHEN s.n = 1 THEN s.new ELSE here END, CASE WHEN s.n = 1 THEN hops + 1 ELSE hops END, CASE WHEN s.old IS NULL THEN 'ok' WHEN s.n > 1 THEN 'fork' ELSE 'open' END
      FROM w LEFT JOIN s ON s.old = w.here WHERE w.status = 'open')
    SELECT node, here AS target, CAST(hops AS INTEGER) AS hops, status FROM w WHERE status <> 'open'"""
)
def redirect_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-130, O-216: where redirects lead, with forks, cycles and overlong chains told apart."""
    big = F.max(F.when(F.col("l_quantity") > 25, F.col("l_suppkey"))).over(W.partitionBy("l_orderkey"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("old"), big.alias("new")).where("new > old and old % 7 <> 0").distinct()
    return graphs.follow_redirects(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node")), edges)


@query(
    """
    WITH x AS (SELECT o_custkey, o_orderkey, o_orderdate, ceil(o_totalprice) AS cost, sum(ceil(o_totalprice)) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS spent FROM orders)
    SELECT o_custkey, o_orderkey, CAST(spent AS BIGINT) AS spent FROM x WHERE spent <= 500000"""
)
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-194, O-279: rows in order until the budget is used up."""
    o = table(spark, sf_dir, "orders").withColumn("cost", F.ceil("o_totalprice"))
    return relational.prefix_within(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], "cost", 500_000).select("o_custkey", "o_orderkey", "spent")


@query(
    """
    WITH s AS (SELECT user_id, event_type, least(100.0, max(value)) AS s FROM events GROUP BY ALL),
    w AS (SELECT *, CASE event_type WHEN 'purchase' THEN 2.0 WHEN 'click' THEN 1.0 ELSE 0.5 END AS w FROM s)
    SELECT user_id, round(sum(w * s) / sum(w), 4) AS score, count(*) AS available, round(count(*) / 5.0, 4) AS coverage FROM w GROUP BY 1"""
)
def signal_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-147, O-148, O-152, O-153, O-242, O-243: weighted mean of the signals that exist, with coverage."""
    s = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(score.clamp(F.max("value"), 0.0, 100.0).alias("s"))
    w = F.when(F.col("event_type") == "purchase", 2.0).when(F.col("event_type") == "click", 1.0).otherwise(0.5)
    return s.withColumn("w", w).groupBy("user_id").agg(F.round(F.sum(F.col("w") * F.col("s")) / F.sum("w"), 4).alias("score"), F.count(F.lit(1)).alias("available"), F.round(F.count(F.lit(1)) / 5.0, 4).alias("coverage"))


@query(
    """
    WITH f AS (SELECT user_id, count(*) AS n, max(value) AS m, sum(value * greatest(0.25, 1 - date_diff('day', ts::DATE, DATE '2024-01-31') / 45.0)) AS t FROM events WHERE ts < TIMESTAMP '2024-02-01' GROUP BY 1)
    SELECT user_id, n, round(least(100.0, 0.55 * least(100.0, m) + 0.18 * t), 4) AS shock FROM f"""
)
def event_shock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-071, O-149, O-245: decayed intensities blended into one shock."""
    e = table(spark, sf_dir, "events").where("ts < timestamp '2024-02-01'")
    age = F.datediff(F.expr("date '2024-01-31'"), F.to_date("ts"))
    f = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("m"), F.sum(F.col("value") * score.recency_weight(age)).alias("t"))
    return f.select("user_id", "n", F.round(score.clamp(0.55 * score.clamp(F.col("m"), 0.0, 100.0) + 0.18 * F.col("t"), 0.0, 100.0), 4).alias("shock"))


@query(
    """
    SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 4) AS mean_chars, CAST(max(turn) AS BIGINT) AS last_turn FROM conversations GROUP BY ROLLUP (role)"""
)
def role_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-168: counts by category with the total row."""
    return table(spark, sf_dir, "conversations").rollup("role").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.max("turn").alias("last_turn"))
