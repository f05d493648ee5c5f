"""Queries of predictions, gates, calibration, horizons and event-to-event comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions import score, text
from lumenfold.plans.registry import query, table

# Named signals, comparisons and limits of the gate.
GATE = (("click", "gte", 50.0), ("error", "lt", 160.0), ("purchase", "gt", 60.0), ("view", "lte", 150.0))


@query(
    """
    WITH s AS (SELECT user_id, event_type AS signal, avg(value) AS x FROM events GROUP BY 1, 2),
    p(signal, op, lim) AS (VALUES ('click', 'gte', 50.0), ('error', 'lt', 160.0), ('purchase', 'gt', 60.0), ('view', 'lte', 150.0)),
    j AS (SELECT user_id, CASE op WHEN 'gte' THEN x >= lim WHEN 'gt' THEN x > lim WHEN 'lt' THEN x < lim ELSE x <= lim END AS met FROM s JOIN p USING (signal))
    SELECT u.user_id, count(met) AS evaluable, count(*) FILTER (WHERE met) AS met, count(met) = 4 AND coalesce(bool_and(met), false) AS passed
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN j USING (user_id) GROUP BY 1"""
)
def reduction_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-110, O-111: comparisons of named signals; a missing signal can't be evaluated, and all have to be met."""
    means = table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.avg(F.when(F.col("event_type") == s, F.col("value"))).alias(s) for s, _, _ in GATE])
    ops = {"gte": lambda x, y: x >= y, "gt": lambda x, y: x > y, "lt": lambda x, y: x < y, "lte": lambda x, y: x <= y}
    tests = F.array(*[ops[op](F.col(s), F.lit(limit)) for s, op, limit in GATE])
    known = F.filter(tests, lambda t: t.isNotNull())
    met = F.size(F.filter(known, lambda t: t))
    return means.select("user_id", F.size(known).cast("long").alias("evaluable"), met.cast("long").alias("met"), (met == len(GATE)).alias("passed"))


@query(
    """
    WITH s AS (SELECT user_id, least(100.0, avg(value)) AS score, 100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*) AS fast FROM events GROUP BY 1),
    a AS (SELECT *, round(least(0.95, greatest(0.0, 0.65 / (1 + exp(-(score - 45.0) / 14.0)))), 4) AS p18 FROM s),
    b AS (SELECT *, round(p18 * (0.25 + 0.30 * fast / 100.0), 4) AS p6 FROM a),
    c AS (SELECT *, greatest(round(p18 * least(0.88, 0.62 + 0.20 * fast / 100.0), 4), p6) AS p12 FROM b)
    SELECT user_id, p6 AS p_0_6, round(p12 - p6, 4) AS p_6_12, round(p18 - p12, 4) AS p_12_18, p18 AS p_18 FROM c"""
)
def baseline_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-067: a panel's score and fast stress give cumulative probabilities by horizon, front-loaded by the stress."""
    of_user = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.least(F.lit(100.0), F.avg("value")).alias("score"), (100.0 * F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("fast")
    )
    return of_user.select("user_id", score.horizon_probabilities(F.col("score"), F.col("fast")).alias("p")).select("user_id", "p.*")


@query(
    """
    WITH o AS (SELECT o_orderkey, o_orderpriority, least(0.99, greatest(0.01, o_totalprice / 500000)) AS p, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders),
    c AS (SELECT *, 1 / (1 + exp(-(-0.2 + 0.8 * ln(p / (1 - p))))) AS q FROM o)
    SELECT o_orderpriority, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg((q - y) * (q - y)), 6) AS brier_calibrated,
      round(avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss FROM c GROUP BY 1"""
)
def calibration_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-073 (no lead time): Brier score before and after a sigmoid calibration, and log loss."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", score.clamp(F.col("o_totalprice") / 500000, 0.01, 0.99).alias("p"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    q = score.sigmoid(F.lit(-0.2) + 0.8 * score.logit(F.col("p")))
    return o.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(score.brier(F.col("p"), F.col("y"))), 6).alias("brier"),
        F.round(F.avg(score.brier(q, F.col("y"))), 6).alias("brier_calibrated"),
        F.round(F.avg(score.log_loss(F.col("p"), F.col("y"))), 6).alias("log_loss"),
    )


@query(
    """
    SELECT o_orderkey, h AS horizon, CAST(o_orderdate + to_months(lo) AS DATE) AS lower, inc AS lower_inclusive, CAST(o_orderdate + to_months(hi) AS DATE) AS upper,
      CASE WHEN inc THEN CAST(o_orderdate + to_months(lo) AS DATE) <= day ELSE CAST(o_orderdate + to_months(lo) AS DATE) < day END AND day <= CAST(o_orderdate + to_months(hi) AS DATE) AS holds
    FROM (SELECT o_orderkey, o_orderdate, CAST(o_orderdate + to_months(CAST(o_orderkey % 20 AS INTEGER)) AS DATE) AS day FROM orders), (VALUES ('0_6m', 0, 6, true), ('6_12m', 6, 12, false), ('12_18m', 12, 18, false), ('within_18m', 0, 18, true)) b(h, lo, hi, inc)"""
)
def horizon_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-093: the bounds of the four horizons of a day, clamped to the month's end, and whether each holds another day."""
    day, other = F.to_date("o_orderdate"), F.add_months(F.to_date("o_orderdate"), (F.col("o_orderkey") % 20).cast("int"))
    bounds = F.explode(F.array(*[score.horizon(day, h) for h in score.HORIZONS])).alias("b")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", other.alias("day"), bounds).select("o_orderkey", "day", "b.*")
    after = F.when(F.col("lower_inclusive"), F.col("lower") <= F.col("day")).otherwise(F.col("lower") < F.col("day"))
    return rows.withColumn("holds", after & (F.col("day") <= F.col("upper"))).drop("day")


@query(
    """
    SELECT event_id, CASE WHEN name IN ('critical', 'severe', 'high') THEN 85.0 WHEN name IN ('moderate', 'medium') THEN 55.0 WHEN name IN ('minor', 'low') THEN 25.0
      WHEN magnitude IS NOT NULL THEN round(least(100.0, greatest(0.0, magnitude / 8 * 100)), 2) ELSE 35.0 END AS severity
    FROM (SELECT event_id, value / 7.3 - 0.2 AS magnitude, lower(CASE event_type WHEN 'error' THEN 'Severe' WHEN 'purchase' THEN 'medium' WHEN 'view' THEN 'LOW' END) AS name FROM events)"""
)
def incident_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-076: a band by name, else the magnitude as a share of eight, else 35."""
    name = F.when(F.col("event_type") == "error", "Severe").when(F.col("event_type") == "purchase", "medium").when(F.col("event_type") == "view", "LOW")
    return table(spark, sf_dir, "events").select("event_id", score.incident_severity(name, F.col("value") / 7.3 - 0.2).alias("severity"))


@query(
    """
    SELECT l_orderkey, list_sort(list_distinct(list(lower(l_returnflag)))) AS tags, bool_or(lower(l_returnflag) IN ('a', 'r')) AS hit,
      bool_and(l_returnflag IN ('A', 'N')) AS in_vocabulary FROM lineitem GROUP BY 1"""
)
def tag_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-103, O-104: tags that meet a list in any case, and tags that a vocabulary holds all of."""
    tags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("own"))
    low = F.sort_array(F.transform("own", F.lower))
    return tags.select("l_orderkey", low.alias("tags"), F.arrays_overlap(low, F.array(F.lit("a"), F.lit("r"))).alias("hit"), (F.size(F.array_except("own", F.array(F.lit("A"), F.lit("N")))) == 0).alias("in_vocabulary"))


@query(
    """
    WITH e AS (SELECT event_type, round(value / 10) * 10 AS t, props FROM events WHERE value IS NOT NULL),
    m AS (SELECT event_type, t, count(*) AS n, count(*) FILTER (WHERE CAST(json_extract(props, '$.k') AS INTEGER) >= 50) AS good FROM e GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(good / n, 6) DESC, n DESC, t) AS nth FROM m)
    SELECT event_type, t AS threshold, n, round(good / n, 6) AS precision FROM r WHERE nth = 1"""
)
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-195: the best candidate by precision, then support, then the least threshold."""
    e = table(spark, sf_dir, "events").where("value is not null").select("event_type", (F.round(F.col("value") / 10) * 10).alias("t"), (F.get_json_object("props", "$.k").cast("int") >= 50).alias("good"))
    m = e.groupBy("event_type", "t").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good")).withColumn("precision", F.round(F.col("good") / F.col("n"), 6))
    best = m.groupBy("event_type").agg(F.max(F.struct("precision", "n", (-F.col("t")).alias("low"))).alias("b"))
    return best.select("event_type", (-F.col("b.low")).alias("threshold"), "b.n", "b.precision")


@query(
    """
    WITH w AS (SELECT user_id, event_id, event_type, value, ts, lag(event_type) OVER u AS pt, lag(value) OVER u AS pv, lag(ts) OVER u AS pts FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, round((0.4e0 * CAST(event_type = pt AS INTEGER) + CASE WHEN value IS NULL OR pv IS NULL THEN 0 ELSE 0.35e0 * exp(-abs(value - pv) / 100) END
      + 0.25e0 * CAST(CAST(ts AS DATE) = CAST(pts AS DATE) AS INTEGER)) / (0.65e0 + CASE WHEN value IS NULL OR pv IS NULL THEN 0 ELSE 0.35e0 END) * CASE WHEN event_type = pt THEN 1 ELSE 0.55e0 END, 6) AS similarity
    FROM w WHERE pt IS NOT NULL"""
)
def field_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-074: weighted mean of the fields that both events have, times 0.55 if their types differ."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumns({f"p_{c}": F.lag(c).over(w) for c in ("event_type", "value", "ts")}).where("p_event_type is not null")
    both, same = F.col("value").isNotNull() & F.col("p_value").isNotNull(), F.col("event_type") == F.col("p_event_type")
    close = F.when(both, 0.35 * F.exp(-F.abs(F.col("value") - F.col("p_value")) / 100)).otherwise(0.0)
    got = 0.4 * same.cast("int") + close + 0.25 * (F.to_date("ts") == F.to_date("p_ts")).cast("int")
    return e.select("event_id", F.round(got / (0.65 + F.when(both, 0.35).otherwise(0.0)) * F.when(same, 1.0).otherwise(0.55), 6).alias("similarity"))


@query(
    """
    WITH w AS (SELECT user_id, event_id, round(value, -1) - lag(round(value, -1)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS move FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(move) DESC, event_id) AS nth FROM w WHERE abs(move) > 0)
    SELECT user_id, event_id, round(move, 6) AS move, CAST(row_number() OVER (ORDER BY abs(move) DESC, user_id) AS INTEGER) AS rank FROM r WHERE nth = 1"""
)
def largest_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-197: the largest change of each series in either direction, and its rank over all; a series that didn't move has none.

    A series is one row by then; its rank is a sort of these.
    """
    value = F.round("value", -1)
    move = value - F.lag(value).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    moves = table(spark, sf_dir, "events").select("user_id", "event_id", move.alias("move")).where(F.abs("move") > 0)
    best = moves.groupBy("user_id").agg(F.max(F.struct(F.abs("move").alias("size"), (-F.col("event_id")).alias("first"), "move")).alias("b"))
    rank = F.row_number().over(W.orderBy(F.desc("b.size"), "user_id"))
    return best.select("user_id", (-F.col("b.first")).alias("event_id"), F.round("b.move", 6).alias("move"), rank.alias("rank"))


@query(
    """
    WITH d AS (SELECT user_id, CAST(ts AS DATE) AS period, value, ts, event_id FROM events WHERE value IS NOT NULL),
    p AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY user_id, period ORDER BY ts DESC, event_id DESC) = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY period DESC) AS nth FROM p)
    SELECT user_id, count(*) AS points, string_agg(strftime(period, '%Y-%m-%d') || ' ' || printf('%.2f', value), '; ' ORDER BY period DESC) AS trend FROM r WHERE nth <= 5 GROUP BY 1 HAVING count(*) >= 2"""
)
def five_point_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-181: the newest value of each of the last five distinct days, the newest first; from two days on."""
    newest = F.max_by("value", F.struct("ts", "event_id")).alias("value")
    periods = table(spark, sf_dir, "events").where("value is not null").groupBy("user_id", F.to_date("ts").alias("period")).agg(newest)
    nth = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("period")))
    last = periods.withColumn("nth", nth).where("nth <= 5")
    points = F.array_sort(F.collect_list(F.struct("nth", F.concat(F.date_format("period", "yyyy-MM-dd"), F.lit(" "), F.format_string("%.2f", "value")).alias("text"))))
    return last.groupBy("user_id").agg(F.count(F.lit(1)).alias("points"), F.array_join(F.transform(points, lambda x: x["text"]), "; ").alias("trend")).where("points >= 2")


@query(
    """
    SELECT c_custkey, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS newest, coalesce((SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_custkey = c_custkey), 0) AS spent
    FROM customer"""
)
def customer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-121: correlated maximum and sum, as one aggregation and a left join."""
    of = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("newest"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(of, "c_custkey", "left").withColumn("spent", F.coalesce("spent", F.lit(0.0)))


@query(
    """
    SELECT DISTINCT l_orderkey, l_partkey, l_returnflag, l_linestatus FROM lineitem"""
)
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-202: one row of each order, part and kind of support."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus").dropDuplicates()


@query(
    """
    WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, ts DESC, event_id) AS nth FROM events)
    SELECT event_type, count(*) FILTER (WHERE nth <= 100) AS shown, count(*) > 100 AS truncated, round(min(value) FILTER (WHERE nth <= 100), 6) AS least_shown FROM r WHERE nth <= 101 GROUP BY 1"""
)
def bounded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-191: a bounded report that reads one row more than it shows, to say whether there are others."""
    nth = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc_nulls_last("value"), F.desc("ts"), "event_id"))
    r = table(spark, sf_dir, "events").withColumn("nth", nth).where("nth <= 101")
    shown = F.col("nth") <= 100
    return r.groupBy("event_type").agg(F.count_if(shown).alias("shown"), (F.count(F.lit(1)) > 100).alias("truncated"), F.round(F.min(F.when(shown, F.col("value"))), 6).alias("least_shown"))


_PHRASES = ", ".join(f"'{p}'" for p in text.HINDSIGHT_PHRASES)


@query(
    rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') || ' In ' || (2010 + n_chars % 20) || ', ' || upper([{_PHRASES}, 'nothing of it'][1 + n_chars % 23]) || ' in ' || (2010 + n_chars % 20) || ' and 1' || (500 + n_chars % 500) AS text FROM documents)
    SELECT doc_id, array_to_string(list_sort(list_distinct([CAST(y AS INTEGER) FOR y IN regexp_extract_all(text, '\b(1[6-9][0-9]{{2}}|20[0-9]{{2}})\b') IF CAST(y AS INTEGER) > 2015])), ',') AS late_years,
      array_to_string([p FOR p IN [{_PHRASES}] IF contains(lower(text), p)], ',') AS phrases FROM d"""
)
def hindsight_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-098: the distinct years after a limit, and the phrases that tell of what came later; a sentence with both is put behind each text."""
    words = F.array(*[F.lit(p) for p in (*text.HINDSIGHT_PHRASES, "nothing of it")])
    year = (F.col("n_chars") % 20 + 2010).cast("string")
    more = F.concat(F.lit(" In "), year, F.lit(", "), F.upper(F.element_at(words, (F.col("n_chars") % 23 + 1).cast("int"))), F.lit(" in "), year, F.lit(" and 1"), (F.col("n_chars") % 500 + 500).cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), more).alias("text"))
    return d.select("doc_id", F.array_join(text.future_years(F.col("text"), F.lit(2015)).cast("array<string>"), ",").alias("late_years"), F.array_join(text.hindsight_phrases(F.col("text")), ",").alias("phrases"))
