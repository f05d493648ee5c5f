"""The stream's alert moves equal the batch fold's, however it is cut into micro-batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenfold.operators.lifecycle import AlertState
from lumenfold.plans.alerts import fold_alerts
from lumenfold.streaming import alerts

SCHEMA = "user_id long, event_type string, event_id long, ts timestamp, value double"
START = datetime(2024, 1, 1)


def observations(n=240):
    rng = random.Random(11)
    return [(rng.randrange(3), rng.choice("ab"), i, START + timedelta(hours=7 * i), rng.choice([5.0, 20.0, 40.0, 60.0, 65.0, 90.0])) for i in range(n)]


def streamed(spark, folder, rows, cuts, ttl=alerts.TTL):
    """Moves of ``rows``, written as one file a micro-batch, in order."""
    for nth, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{nth:03}")
    import glob
    import os
    import shutil

    os.makedirs(f"{folder}/flat")
    for nth, f in enumerate(sorted(glob.glob(f"{folder}/in/*/part-*.parquet"))):
        shutil.copy(f, f"{folder}/flat/{nth:03}.parquet")
        os.utime(f"{folder}/flat/{nth:03}.parquet", (1_700_000_000 + nth, 1_700_000_000 + nth))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/flat")
    moves = alerts.alert_moves(stream, "1 hour", ttl)
    moves.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()))


@pytest.mark.parametrize("cuts", [[], [101, 170]])
def test_any_cut_gives_the_batch_folds_rows(spark, tmp_path, cuts):
    rows = observations()
    wanted = sorted(map(tuple, fold_alerts(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert streamed(spark, str(tmp_path), rows, cuts) == wanted and len({r[3] for r in wanted}) >= 6


def test_late_rows_are_reported_and_open_alerts_outlive_the_ttl(spark, tmp_path):
    hour = lambda h: START + timedelta(hours=h)
    rows = [(1, "a", 1, hour(0), 70.0), (2, "a", 2, hour(0), 5.0), (3, "a", 3, hour(100), 5.0), (3, "a", 4, hour(200), 5.0), (1, "a", 5, hour(201), 90.0), (2, "a", 6, hour(202), 70.0), (1, "a", 7, hour(201), 90.0)]
    got = streamed(spark, str(tmp_path), rows, [2, 3, 4, 6], ttl=timedelta(hours=50))
    assert {r[2]: r[3] for r in got} == {1: "opened", 2: "quiet", 3: "quiet", 4: "quiet", 5: "escalated", 6: "opened", 7: "replay"}


def test_what_holds_a_decision():
    later = START + timedelta(days=40)
    assert not alerts.holds_decision(AlertState(), later)
    assert alerts.holds_decision(AlertState(level="high", state="open", peak=2, last_at=START), later)
    assert alerts.holds_decision(AlertState(state="resolved", resolved_at=later - timedelta(hours=23)), later)
    assert not alerts.holds_decision(AlertState(state="resolved", resolved_at=later - timedelta(hours=24)), later)


def test_keys_share_calls_and_rows_of_state(spark, tmp_path, monkeypatch):
    rows = [(user, kind, 600 * at + 2 * user + (kind == "b"), START + timedelta(hours=30 * at), 5.0 + 29 * ((user + at) % 4)) for at in range(3) for user in range(300) for kind in "ab"]
    calls = spark.sparkContext.accumulator(0)
    step = alerts._advance

    def counted(ttl):
        def advance(*args):
            calls.add(1)
            yield from step(ttl)(*args)

        return advance

    monkeypatch.setattr(alerts, "_advance", counted)
    monkeypatch.setattr(alerts, "BUCKETS", 7)
    got = streamed(spark, str(tmp_path), rows, [600, 1200])
    assert got == sorted(map(tuple, fold_alerts(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert 0 < calls.value <= 7 * 5


def test_a_null_user_is_a_key_of_its_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(alerts, "BUCKETS", 1)
    big = (1 << 60) + 1  # not a float
    rows = [(None, "a", 1, START, 70.0), (big, "a", 2, START, 5.0), (None, "a", 3, START, 90.0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    moves = alerts.alert_moves(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
    moves.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("event_id").collect()
    assert [(r.event_id, r.user_id, r.transition) for r in got] == [(1, None, "opened"), (2, big, "quiet"), (3, None, "replay")]
