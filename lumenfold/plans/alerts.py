"""Alert queries: the lifecycle as a batch fold and the global budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.lifecycle import AlertState, fold
from lumenfold.operators.relational import top_n
from lumenfold.plans.registry import query, table
from lumenfold.streaming.alerts import alert_moves
from lumenfold.streaming.velocity import event_stream, run_folder

FOLD_SCHEMA = "user_id long, event_type string, event_id long, transition string, state string, level string"


def fold_alerts(observations: DataFrame) -> DataFrame:
    """Lifecycle transitions of (user_id, event_type, event_id, ts, value).

    Rows are shuffled by key and sorted; a task then streams through its keys in
    Arrow batches and holds the state of the current key alone, so a key with very
    many rows never is in memory as a group. A rerun task gives the same rows.
    """
    ordered = observations.select("user_id", "event_type", "event_id", "ts", "value").repartition("user_id", "event_type").sortWithinPartitions("user_id", "event_type", "ts", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, AlertState()
        for batch in batches:
            rows = []
            for user, kind, event_id, ts, value in batch.itertuples(index=False):
                if (user, kind) != key:
                    key, state = (user, kind), AlertState()
                rows += [(user, kind, *r) for r in fold([(event_id, ts.to_pydatetime(), value)], state)]
            yield pd.DataFrame(rows, columns=["user_id", "event_type", "event_id", "transition", "state", "level"])

    return ordered.mapInPandas(run, FOLD_SCHEMA)


#: One step of each key at a time. Levels are 0 to 3; a level is reached at 37, 62 and 82, and left at 25, 50 and 70.
LIFECYCLE_SQL = """
    WITH RECURSIVE o AS (SELECT user_id, event_type, event_id, ts, least(100.0, greatest(0.0, value)) AS s, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
    w(user_id, event_type, n, event_id, transition, state, level, clear_since, resolved_at, peak, last_at) AS (
      SELECT DISTINCT user_id, event_type, 0::BIGINT, NULL::BIGINT, 'start', 'none', 0, NULL::TIMESTAMP, NULL::TIMESTAMP, 0, NULL::TIMESTAMP FROM o
      UNION ALL
      SELECT user_id, event_type, n, event_id, t,
        CASE t WHEN 'opened' THEN 'open' WHEN 'escalated' THEN 'escalated' WHEN 'resolved' THEN 'resolved' WHEN 'downgraded' THEN 'downgraded' ELSE state END,
        CASE WHEN t IN ('replay', 'quiet', 'cooldown') THEN level WHEN t = 'opened' THEN hi ELSE nl END,
        CASE WHEN t IN ('replay', 'quiet', 'cooldown') THEN clear_since WHEN t IN ('opened', 'escalated', 'rebounded') THEN NULL WHEN calm THEN since WHEN t = 'downgraded' THEN NULL ELSE clear_since END,
        CASE t WHEN 'opened' THEN NULL WHEN 'resolved' THEN ts ELSE resolved_at END,
        CASE WHEN t IN ('replay', 'quiet', 'cooldown') THEN peak WHEN t = 'opened' THEN hi ELSE greatest(peak, nl) END,
        CASE t WHEN 'replay' THEN last_at ELSE ts END
      FROM (SELECT *, CASE WHEN ts <= last_at THEN 'replay'
          WHEN idle THEN CASE WHEN hi = 0 THEN 'quiet' WHEN resolved_at IS NOT NULL AND ts - resolved_at < INTERVAL 24 HOUR AND hi <= peak THEN 'cooldown' ELSE 'opened' END
          WHEN nl > level THEN 'escalated' WHEN calm THEN CASE WHEN ts - since >= INTERVAL 7 DAY THEN 'resolved' WHEN since = ts THEN 'downgraded' ELSE 'unchanged_calm' END
          WHEN nl < level THEN 'downgraded' WHEN state = 'downgraded' AND clear_since IS NOT NULL THEN 'rebounded' ELSE 'unchanged' END AS t
        FROM (SELECT *, nl = 0 AND s <= 25 AND NOT idle AND nl <= level AS calm, CASE WHEN state = 'downgraded' AND clear_since IS NOT NULL THEN clear_since ELSE ts END AS since
          FROM (SELECT *, CASE WHEN hi > level THEN hi WHEN level = 3 AND s > 70 THEN 3 WHEN level >= 2 AND s > 50 THEN 2 WHEN level >= 1 AND s > 25 THEN 1 ELSE 0 END AS nl
            FROM (SELECT w.user_id, w.event_type, o.n, o.event_id, o.ts, o.s, w.state, w.level, w.clear_since, w.resolved_at, w.peak, w.last_at, w.state IN ('none', 'resolved') AS idle,
                CASE WHEN s >= 82 THEN 3 WHEN s >= 62 THEN 2 WHEN s >= 37 THEN 1 ELSE 0 END AS hi
              FROM w JOIN o ON o.user_id = w.user_id AND o.event_type = w.event_type AND o.n = w.n + 1)))))
    SELECT user_id, event_type, event_id, CASE transition WHEN 'unchanged_calm' THEN 'unchanged' ELSE transition END AS transition,
      CASE transition WHEN 'unchanged_calm' THEN 'downgraded' ELSE state END AS state, ['low', 'medium', 'high', 'critical'][level + 1] AS level FROM w WHERE n > 0"""


@query(LIFECYCLE_SQL)
def alert_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-284 to O-288: the state machine over each key's observations in order."""
    return fold_alerts(table(spark, sf_dir, "events"))


@query(LIFECYCLE_SQL)
def alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-284 to O-288, O-291, O-294: the same moves from a stream with states that expire; its checkpoint is the cursor."""
    folder = run_folder(spark)
    moves = alert_moves(event_stream(spark, f"{sf_dir}/events.parquet"))
    moves.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


ACTIVE = ("open", "escalated", "downgraded")


def supersede(alerts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts with the superseded ones marked, verdicts): narrower alerts give way to broader ones.

    ``alerts`` (alert_id, user_id, dedupe_key, state, superseded_by) has each once; ``requests`` (broader_id, narrower array) has
    a broader alert once. A request is carried out as a whole or not at all: reason is the first fault by narrower id,
    null if there is none. Faults: no narrower alert, itself, an unknown alert, one that isn't active, another owner's, one of the same
    key. Of several requests for one alert that of the least broader_id takes it. verdicts has (broader_id, reason, n).
    """
    known = alerts.select("alert_id", "user_id", "dedupe_key", F.col("state").isin(*ACTIVE).alias("active"))
    side = lambda p: known.select(*[F.col(c).alias(f"{p}_{c}") for c in known.columns])
    each = requests.select("broader_id", F.explode_outer(F.array_distinct("narrower")).alias("narrower_id"))
    met = each.join(side("b"), F.col("broader_id") == F.col("b_alert_id"), "left").join(side("n"), F.col("narrower_id") == F.col("n_alert_id"), "left")
    fault = (
        F.when(F.col("narrower_id").isNull(), "no_narrower_alert").when(F.col("broader_id") == F.col("narrower_id"), "itself")
        .when(F.col("b_alert_id").isNull() | F.col("n_alert_id").isNull(), "unknown_alert").when(~F.col("b_active") | ~F.col("n_active"), "not_active")
        .when(F.col("b_user_id") != F.col("n_user_id"), "other_owner").when(F.col("b_dedupe_key") == F.col("n_dedupe_key"), "same_key")
    )
    judged = met.withColumn("fault", fault)
    verdicts = judged.groupBy("broader_id").agg(F.min(F.when(F.col("fault").isNotNull(), F.struct("narrower_id", "fault")))["fault"].alias("reason"), F.count("narrower_id").alias("n"))
    good = judged.select("broader_id", "narrower_id").join(verdicts.where("reason is null").select("broader_id"), "broader_id")
    taken = good.groupBy(F.col("narrower_id").alias("alert_id")).agg(F.min("broader_id").alias("__by"))
    marked = alerts.join(taken, "alert_id", "left").withColumns({"state": F.when(F.col("__by").isNotNull(), "superseded").otherwise(F.col("state")), "superseded_by": F.coalesce("__by", "superseded_by")}).drop("__by")
    return marked, verdicts


_ALERTS = """
    a AS (SELECT c_custkey AS alert_id, c_nationkey AS user_id, c_mktsegment || c_custkey % 3 AS dedupe_key, CASE WHEN c_acctbal < 0 THEN 'resolved' WHEN c_acctbal < 3000 THEN 'downgraded' ELSE 'open' END AS state FROM customer),
    r AS (SELECT o_custkey AS broader_id, list_distinct(list(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2000 ELSE c_custkey END) FILTER (WHERE c_custkey IS NOT NULL OR o_orderkey % 3 = 0)) AS narrower
      FROM orders LEFT JOIN (SELECT s.c_custkey, s.c_nationkey, s.c_mktsegment, b.c_custkey AS own FROM customer s JOIN customer b ON s.c_nationkey = b.c_nationkey AND s.c_custkey = b.c_custkey + 25) ON own = o_custkey GROUP BY 1)"""


def _supersession(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    state = F.when(F.col("c_acctbal") < 0, "resolved").when(F.col("c_acctbal") < 3000, "downgraded").otherwise("open")
    alerts = c.select(F.col("c_custkey").alias("alert_id"), F.col("c_nationkey").alias("user_id"), F.concat("c_mktsegment", (F.col("c_custkey") % 3).cast("string")).alias("dedupe_key"), state.alias("state"), F.lit(None).cast("long").alias("superseded_by"))
    s, b = c.select("c_custkey", "c_nationkey"), c.select((F.col("c_custkey") + 25).alias("next"), F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("own"))
    fellows = s.join(b, (F.col("c_nationkey") == F.col("nation")) & (F.col("c_custkey") == F.col("next")))
    asked = table(spark, sf_dir, "orders").join(fellows, F.col("own") == F.col("o_custkey"), "left")
    one = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 2000).otherwise(F.col("c_custkey"))
    return supersede(alerts, asked.groupBy(F.col("o_custkey").alias("broader_id")).agg(F.collect_set(one).alias("narrower")))


_JUDGED = f"""WITH {_ALERTS},
    e AS (SELECT broader_id, unnest(CASE WHEN len(coalesce(narrower, [])) = 0 THEN [NULL] ELSE narrower END) AS narrower_id FROM r),
    m AS (SELECT e.*, CASE WHEN narrower_id IS NULL THEN 'no_narrower_alert' WHEN broader_id = narrower_id THEN 'itself' WHEN b.alert_id IS NULL OR n.alert_id IS NULL THEN 'unknown_alert' WHEN b.state = 'resolved' OR n.state = 'resolved' THEN 'not_active'
      WHEN b.user_id <> n.user_id THEN 'other_owner' WHEN b.dedupe_key = n.dedupe_key THEN 'same_key' END AS fault FROM e LEFT JOIN a b ON b.alert_id = broader_id LEFT JOIN a n ON n.alert_id = narrower_id),
    v AS (SELECT broader_id, arg_min(fault, narrower_id) FILTER (WHERE fault IS NOT NULL AND narrower_id IS NOT NULL) AS f, bool_or(narrower_id IS NULL) AS none, count(narrower_id) AS n FROM m GROUP BY 1),
    verdicts AS (SELECT broader_id, CASE WHEN none THEN 'no_narrower_alert' ELSE f END AS reason, n FROM v)"""


@query(_JUDGED + " SELECT broader_id, reason, n FROM verdicts")
def supersession_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-290: which requests to replace narrower alerts are carried out, and why others aren't."""
    return _supersession(spark, sf_dir)[1]


@query(
    _JUDGED
    + """, t AS (SELECT narrower_id, min(broader_id) AS taker FROM m JOIN verdicts USING (broader_id) WHERE reason IS NULL GROUP BY 1)
    SELECT alert_id, user_id, dedupe_key, CASE WHEN taker IS NULL THEN state ELSE 'superseded' END AS state, taker AS superseded_by FROM a LEFT JOIN t ON narrower_id = alert_id"""
)
def superseded_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-290: all alerts after the replacements; only the state and the successor change."""
    return _supersession(spark, sf_dir)[0]


@query(
    """
    WITH l AS (SELECT user_id, event_type, max_by(least(100.0, value), (ts, event_id)) AS score, max(ts) AS seen FROM events GROUP BY ALL),
    s AS (SELECT *, CASE WHEN score >= 82 THEN 'critical' WHEN score >= 62 THEN 'high' END AS level FROM l),
    r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, seen, user_id, event_type) AS rank FROM s WHERE level IS NOT NULL)
    SELECT user_id, event_type, level, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= CASE level WHEN 'critical' THEN 3 ELSE 10 END"""
)
def alert_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-192, O-289: at most 3 critical and 10 high alerts at once (the budget is the feature)."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("r"))
    score = F.least(F.lit(100.0), F.col("r.value"))
    s = last.select("user_id", "event_type", score.alias("score"), F.col("r.ts").alias("at")).withColumn("level", F.when(F.col("score") >= 82, "critical").when(F.col("score") >= 62, "high")).where("level is not null")
    top = top_n(s, ["level"], [F.desc("score"), F.col("at"), F.col("user_id"), F.col("event_type")], 10)
    return top.where("level = 'high' or rank <= 3").select("user_id", "event_type", "level", "rank")
