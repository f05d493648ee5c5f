"""Queries of calibrators, of the precision knee and of linking policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import score
from lumenfold.operators import calibration
from lumenfold.plans.registry import query, table


@query(
    """
    WITH o AS (SELECT o_orderpriority AS g, round(least(1.0, greatest(0.0, o_totalprice / 500000)), 2) AS x, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders),
    pts AS (SELECT g, x, sum(y) AS s, count(*) AS n FROM o GROUP BY ALL),
    cum AS (SELECT *, sum(s) OVER w AS cs, sum(n) OVER w AS cn, row_number() OVER w AS i FROM pts WINDOW w AS (PARTITION BY g ORDER BY x)),
    means AS (SELECT a.g, a.i AS j, b.i AS k, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM cum a JOIN cum b ON a.g = b.g AND b.i >= a.i),
    least_of AS (SELECT g, j, k AS i, min(m) OVER (PARTITION BY g, j ORDER BY k DESC) AS m FROM means),
    fit AS (SELECT g, i, max(m) AS y FROM least_of GROUP BY ALL)
    SELECT g AS o_orderpriority, x AS p, n, round(y, 6) AS calibrated FROM fit JOIN cum USING (g, i)"""
)
def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-072: a monotone fit of outcomes by priority, and its value at each probability of two places."""
    p = score.clamp(F.col("o_totalprice") / 500000, 0.0, 1.0)
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", score.round_product(p, 2).alias("p"), (F.col("o_orderstatus") == "F").alias("outcome"))
    points = calibration.fit_isotonic(rows.withColumn("outcome", F.col("outcome").cast("int")), "o_orderpriority", digits=2)
    seen = rows.groupBy("o_orderpriority", "p").agg(F.count(F.lit(1)).alias("n"))
    return calibration.apply_isotonic(seen, points, "o_orderpriority").withColumn("calibrated", score.round_product(F.col("calibrated"), 6))


@query(
    """
    WITH s AS (SELECT user_id, least(100.0, avg(value)) AS score, 100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*) AS fast FROM events GROUP BY 1),
    a AS (SELECT *, round(least(0.95, greatest(0.0, 0.65 / (1 + exp(-(score - 45.0) / 14.0)))), 4) AS p18 FROM s),
    b AS (SELECT *, round(p18 * (0.25 + 0.30 * fast / 100.0), 4) AS p6 FROM a),
    c AS (SELECT *, greatest(round(p18 * least(0.88, 0.62 + 0.20 * fast / 100.0), 4), p6) AS p12 FROM b),
    d AS (SELECT user_id, 1 / (1 + exp(-(0.4 + 0.7 * ln(q6 / (1 - q6))))) AS c6, least(1.0, greatest(0.0, p12)) AS c12, 1 / (1 + exp(-(-0.6 + 1.4 * ln(q18 / (1 - q18))))) AS c18
      FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, p6)) AS q6, greatest(1e-6, least(1 - 1e-6, p18)) AS q18 FROM c))
    SELECT user_id, round(c6, 6) AS p_0_6, round(greatest(c6, c12) - c6, 6) AS p_6_12, round(greatest(c6, c12, c18) - greatest(c6, c12), 6) AS p_12_18 FROM d"""
)
def calibrated_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-072: cumulative horizons through a sigmoid, nothing and another sigmoid, made monotone again."""
    of_user = table(spark, sf_dir, "events").groupBy("user_id").agg(F.least(F.lit(100.0), F.avg("value")).alias("score"), (100.0 * F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("fast"))
    h = of_user.select("user_id", score.horizon_probabilities(F.col("score"), F.col("fast")).alias("h"))
    p12 = F.round(F.col("h.p_0_6") + F.col("h.p_6_12"), 4)
    c = calibration.calibrated_buckets(calibration.platt(F.col("h.p_0_6"), 0.7, 0.4), calibration.identity(p12), calibration.platt(F.col("h.p_18"), 1.4, -0.6))
    return h.select("user_id", c.alias("c")).select("user_id", "c.*")


_PAIRS = "SELECT l_returnflag AS kind, round(0.62 + l_quantity / 160 + l_discount / 2, 3) AS similarity, l_quantity > 18 OR l_linestatus = 'F' AS same FROM lineitem"
_COUNTS = f"""
    WITH pairs AS ({_PAIRS}), g AS (SELECT CAST(round(0.7 + 0.005 * unnest(range(0, 51)), 3) AS DOUBLE) AS threshold),
    c AS (SELECT kind, threshold, count(*) FILTER (WHERE similarity >= threshold AND same) AS tp, count(*) FILTER (WHERE similarity >= threshold AND NOT same) AS fp,
      count(*) FILTER (WHERE similarity < threshold AND same) AS fn, count(*) FILTER (WHERE similarity < threshold AND NOT same) AS tn FROM pairs, g GROUP BY 1, 2),
    r AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.round(0.62 + F.col("l_quantity") / 160 + F.col("l_discount") / 2, 3).alias("similarity"), ((F.col("l_quantity") > 18) | (F.col("l_linestatus") == "F")).alias("same"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(_COUNTS + "SELECT kind, threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, coalesce(precision >= 0.9, false) AS feasible FROM r")
def pair_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-269: the 51 thresholds over labelled pairs, by one count of rows."""
    return _rounded(calibration.threshold_counts(_pairs(spark, sf_dir), "kind"), "precision", "recall", "f1")


@query(
    _COUNTS
    + """SELECT kind, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r WHERE precision >= 0.9
    QUALIFY row_number() OVER (PARTITION BY kind ORDER BY recall DESC, f1 DESC, abs(round((threshold - 0.8) * 1000)), threshold DESC) = 1"""
)
def pair_knees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-269: the knee of each kind at a precision of 0.90."""
    return _rounded(calibration.precision_knee(calibration.threshold_counts(_pairs(spark, sf_dir), "kind"), "kind"), "precision", "recall", "f1")


_MENTIONS = {
    "split": "CASE WHEN l_suppkey % 2 = 0 THEN 'train' ELSE 'development' END",
    "score": "CASE WHEN l_tax > 0.01 OR l_returnflag <> 'R' THEN round(l_quantity * (0.9 + l_discount) / 50, 4) END",
    "is_link": "l_returnflag <> 'R' OR l_quantity > 45",
    "top_hit": "l_quantity > 12",
    "candidate_hit": "l_quantity > 12 OR l_tax > 0.04",
    "gated": "l_linenumber = 7 OR l_discount > 0.09",
}
_METRICS = f"""
    WITH m AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _MENTIONS.items())} FROM lineitem),
    b AS (SELECT split, CASE WHEN score IS NULL THEN -1 ELSE least(200, CAST(floor(round(score * 10000) / 50) AS INTEGER)) END AS s, is_link, is_link AND coalesce(score IS NOT NULL AND top_hit, false) AS top, is_link AND coalesce(score IS NOT NULL AND candidate_hit, false) AS hit, gated, count(*) AS n FROM m GROUP BY ALL),
    p AS (SELECT a.i AS accept, d.i AS adjudicate FROM range(0, 201) a(i) JOIN range(0, 201) d(i) ON d.i < a.i),
    c AS (SELECT split, accept, adjudicate, sum(n) AS total, coalesce(sum(n) FILTER (WHERE is_link), 0) AS links, coalesce(sum(n) FILTER (WHERE NOT is_link), 0) AS nils, coalesce(sum(n) FILTER (WHERE hit), 0) AS candidate_hits, coalesce(sum(n) FILTER (WHERE top), 0) AS top_hits,
        coalesce(sum(n) FILTER (WHERE s >= accept AND NOT gated), 0) AS accepted_total, coalesce(sum(n) FILTER (WHERE s >= accept AND NOT gated AND top), 0) AS accepted_correct, coalesce(sum(n) FILTER (WHERE s >= accept AND NOT gated AND is_link AND NOT top), 0) AS accepted_wrong,
        coalesce(sum(n) FILTER (WHERE s >= accept AND NOT gated AND NOT is_link), 0) AS accepted_nil, coalesce(sum(n) FILTER (WHERE s >= adjudicate AND (s < accept OR gated)), 0) AS adjudications, coalesce(sum(n) FILTER (WHERE s < adjudicate), 0) AS nil_decisions,
        coalesce(sum(n) FILTER (WHERE s < adjudicate AND NOT is_link), 0) AS nil_recalled, coalesce(sum(n) FILTER (WHERE (s >= accept AND NOT gated AND top) OR (s >= adjudicate AND (s < accept OR gated) AND hit)), 0) AS routed_hits
      FROM b, p GROUP BY 1, 2, 3),
    r AS (SELECT *, accepted_correct / nullif(accepted_total, 0) AS precision, accepted_correct / nullif(links, 0) AS link_recall, routed_hits / nullif(links, 0) AS routed_recall, nil_recalled / nullif(nils, 0) AS nil_recall, adjudications / total AS adjudication_rate FROM c)"""
_COUNTED = ("total", "links", "nils", "candidate_hits", "top_hits", "accepted_total", "accepted_correct", "accepted_wrong", "accepted_nil", "adjudications", "nil_decisions", "nil_recalled", "routed_hits")
_RATES = ("precision", "link_recall", "routed_recall", "nil_recall", "adjudication_rate")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _MENTIONS.items()])
    # Without a candidate nothing can hit.
    return calibration.policy_metrics(m.withColumns({c: F.col(c) & F.col("score").isNotNull() for c in ("top_hit", "candidate_hit")}))


@query(_METRICS + f"SELECT split, CAST(accept AS INTEGER) AS accept, CAST(adjudicate AS INTEGER) AS adjudicate, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _COUNTED)}, {', '.join(f'round({c}, 6) AS {c}' for c in _RATES)} FROM r")
def policy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-136, O-158: all 20,100 policies of two thresholds on both splits, in steps of 0.005."""
    return _rounded(_metrics(spark, sf_dir), *_RATES)


@query(
    _METRICS
    + """, gate AS (SELECT accept, adjudicate FROM r WHERE split = 'train' AND accepted_total >= 1 AND precision >= 0.95 AND nil_recall >= 0.8),
    d AS (SELECT r.* FROM r JOIN gate USING (accept, adjudicate) WHERE split = 'development'),
    k AS (SELECT count(*) AS eligible, count(precision) AS defined FROM d),
    w AS (SELECT accept, adjudicate, precision FROM d ORDER BY coalesce(precision, '-inf'::DOUBLE) DESC, coalesce(link_recall, '-inf'::DOUBLE) DESC, coalesce(routed_recall, '-inf'::DOUBLE) DESC, coalesce(nil_recall, '-inf'::DOUBLE) DESC, adjudication_rate, abs(accept - 170) + abs(adjudicate - 100), accept DESC, adjudicate DESC LIMIT 1)
    SELECT CASE WHEN precision IS NULL THEN 'retained_insufficient_evidence' ELSE 'calibrated' END AS status, CASE WHEN precision IS NULL THEN 0.85e0 ELSE accept / 200 END AS accept, CASE WHEN precision IS NULL THEN 0.5e0 ELSE adjudicate / 200 END AS adjudicate, eligible, defined FROM k LEFT JOIN w ON true"""
)
def policy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-195, O-270: the best policy on development of those that train lets through."""
    return calibration.select_policy(_metrics(spark, sf_dir))
