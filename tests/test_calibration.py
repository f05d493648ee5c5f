"""Calibrators against plain versions, and sweeps against the whole grid."""

import random

from compare import TABLES, both
from pyspark.sql import functions as F

from lumenfold.operators import calibration
from lumenfold.plans import calibration as plans
from lumenfold.plans.registry import SQL


def plain_isotonic(points):
    """Greatest of the least means: the value at i is the max over j <= i of the min over k >= i of the mean of j..k."""
    n = len(points)
    mean = lambda j, k: sum(s for _, s, _ in points[j : k + 1]) / sum(c for _, _, c in points[j : k + 1])
    return [max(min(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]


def interpolate(points, p):
    if p <= points[0][0]:
        return points[0][1]
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        if p <= x1:
            return y0 + (p - x0) / (x1 - x0) * (y1 - y0)
    return points[-1][1]


def test_isotonic_is_monotone_and_least_squares(spark):
    rng = random.Random(6)
    rows = [(g, round(rng.random(), 2), int(rng.random() < 0.3 + g * 0.1)) for g in range(4) for _ in range(150)] + [(0, None, 1), (1, 0.5, None), (2, 1.7, 1), (2, -3.0, 0)]
    df = spark.createDataFrame(rows, "g int, p double, outcome int")
    points = calibration.fit_isotonic(df, "g").collect()
    for g in range(4):
        own = sorted((r.x, r.y) for r in points if r.g == g)
        assert all(a[1] <= b[1] + 1e-12 for a, b in zip(own, own[1:], strict=False))
        data = {}
        for _, p, y in (r for r in rows if r[0] == g and None not in r):
            p = min(max(p, 0.0), 1.0)
            s, n = data.get(p, (0, 0))
            data[p] = (s + y, n + 1)
        wanted = plain_isotonic([(x, *data[x]) for x in sorted(data)])
        assert all(abs(interpolate(own, x) - y) < 1e-9 for x, y in zip(sorted(data), wanted, strict=True))
    asked = [(g, p) for g in (0, 1, 2, 3, 9) for p in (None, -1.0, 0.0, 0.0005, 0.1, 0.333, 0.5, 0.77777, 1.0, 2.0)]
    out = calibration.apply_isotonic(spark.createDataFrame(asked, "g int, p double").withColumn("x0", F.lit("z")), calibration.fit_isotonic(df, "g"), "g").collect()
    assert len(out) == len(asked)
    for r in out:
        own = sorted((q.x, q.y) for q in points if q.g == r.g)
        want = None if r.p is None else interpolate(own, min(max(r.p, 0.0), 1.0)) if own else min(max(r.p, 0.0), 1.0)
        assert (r.calibrated is None) == (want is None) and (want is None or abs(r.calibrated - want) < 1e-9)


def plain_policy(rows, accept, adjudicate):
    out = dict.fromkeys(("accepted_total", "accepted_correct", "accepted_wrong", "accepted_nil", "adjudications", "nil_decisions", "nil_recalled", "routed_hits"), 0)
    for _, s, link, top, hit, gated in rows:
        n = None if s is None else round(s * 10_000)
        if n is not None and n >= accept * 50 and not gated:
            out["accepted_total"] += 1
            out["accepted_correct" if link and top else "accepted_wrong" if link else "accepted_nil"] += 1
            out["routed_hits"] += link and top
        elif n is not None and n >= adjudicate * 50:
            out["adjudications"] += 1
            out["routed_hits"] += link and hit
        else:
            out["nil_decisions"] += 1
            out["nil_recalled"] += not link
    return out


def test_policies_equal_the_grid(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(80):
        s = rng.choice([None, 0.0, 1.0, 0.85, 0.5, 0.4999, round(rng.random(), 4)])
        hit = s is not None and rng.random() < 0.7
        rows.append((rng.choice(["train", "development"]), s, rng.random() < 0.7, hit and rng.random() < 0.8, hit, rng.random() < 0.2))
    df = spark.createDataFrame(rows, "split string, score double, is_link boolean, top_hit boolean, candidate_hit boolean, gated boolean")
    got = calibration.policy_metrics(df).collect()
    assert len(got) == 2 * 20_100
    for r in got[::7]:
        want = plain_policy([x for x in rows if x[0] == r.split], r.accept, r.adjudicate)
        assert {k: r[k] for k in want} == want


def test_gate_and_retained_policies(spark):
    schema = "split string, score double, is_link boolean, top_hit boolean, candidate_hit boolean, gated boolean"
    good = [(s, 0.9, True, True, True, False) for s in ("train", "development")] + [(s, 0.1, False, False, False, False) for s in ("train", "development")]
    pick = lambda rows: tuple(calibration.select_policy(calibration.policy_metrics(spark.createDataFrame(rows, schema))).first())
    status, accept, adjudicate, eligible, defined = pick(good)
    assert (status, accept, adjudicate) == ("calibrated", 0.85, 0.5) and eligible >= defined > 0
    assert pick([("train", 0.9, True, False, True, False), *good[1:]])[:3] == ("retained_insufficient_evidence", 0.85, 0.5)
    assert pick([*good[:1], ("train", 0.1, False, False, False, False), ("development", None, True, False, False, False)])[0] == "retained_insufficient_evidence"


def test_knee_prefers_recall_then_nearness(spark):
    rows = [("a", 0.93, True)] * 9 + [("a", 0.74, False)] * 2 + [("b", 0.9, False)] * 5 + [("c", None, True)]
    df = spark.createDataFrame(rows, "g string, similarity double, same boolean")
    knees = calibration.precision_knee(calibration.threshold_counts(df, "g"), "g").collect()
    assert [(r.g, r.threshold, r.recall) for r in knees] == [("a", 0.8, 1.0)]


def test_half_cents_are_rounded_as_in_sql(spark, tmp_path):
    """142500 / 500000 is 0.285, which is 0.28 by its product with 100; 3 of 64 outcomes end in a half at six places."""
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    (tmp_path / "orders.parquet").unlink()
    prices = [2500.0 * i for i in range(1, 200)] * 2 + [100_000.0] * 64
    rows = [(i, 1, "F" if i % 5 == 0 or i > 460 else "O", v, "A" if v != 100_000.0 else "B") for i, v in enumerate(prices)]
    frame = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").toPandas()
    frame.to_parquet(tmp_path / "orders.parquet")
    ours, wanted = both(spark, plans.isotonic_calibration, SQL["isotonic_calibration"], str(tmp_path))
    assert ours == wanted and len(ours) > 90
