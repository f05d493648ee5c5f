"""Hard negatives against a plain search over all pairs, and the parts of the index."""

import math
import random

import numpy as np
import pytest
from compare import both
from pyspark.sql import functions as F

from lumenfold.llm import negatives
from lumenfold.llm.queries import OP12_SQL, op12_negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, every=50, most=(5, 3)):
    held = {}
    for i, label, v in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[1], r[2])):
        if all(x is not None and math.isfinite(x) for x in v):
            held.setdefault(i, (label, [math.floor(256 * float(np.float32(x))) for x in v]))
    lengths = [len(v) for _, v in held.values()]
    dims = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    held = {i: x for i, x in held.items() if len(x[1]) == dims}
    out = []
    for a, (label, v) in held.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=True)) for i, (_, w) in held.items() if i != a}
        first = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in first if held[i][0] == label][: most[0]]:
            fits = [i for i in first if held[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(fits[: most[1]], 1)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def made(n, dims, rng, common=0.0):
    shared = [round(rng.gauss(0, 0.4), 1) for _ in range(dims)]
    return [(i, rng.randrange(4), list(shared) if rng.random() < common else [round(rng.gauss(0, 0.4), 1) for _ in range(dims)]) for i in range(n)]


def test_query_equals_its_sql(spark):
    ours, wanted = both(spark, op12_negatives, OP12_SQL)
    assert ours == wanted and ours


@pytest.mark.parametrize(("dims", "common", "block"), [(3, 0.0, 8), (6, 0.4, 16), (2, 0.9, 5), (16, 0.1, 32)])
def test_equals_all_pairs_with_ties_and_a_common_vector(spark, dims, common, block, monkeypatch):
    rows = made(600, dims, random.Random(dims), common)
    monkeypatch.setattr(negatives, "PART_ROWS", 150)
    monkeypatch.setattr(negatives, "ZONES", 7)
    got = found(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), block_rows=block))
    assert got == plain(rows) and got


def test_nulls_bad_components_repeats_lengths_and_clashing_names(spark):
    rng = random.Random(1)
    rows = made(200, 4, rng)
    rows += [(50, 9, [9.0] * 4), rows[100], (300, None, [1.0] * 4), (350, 1, None), (None, 1, [1.0] * 4), (400, 1, [1.0, None, 0.0, 0.0]), (450, 1, [float("nan")] * 4), (500, 1, [float("inf")] * 4), (550, 1, [1.0] * 3), (600, 1, [])]
    df = spark.createDataFrame(rows, SCHEMA)
    odd = df.select("*", *[F.lit("z").alias(c) for c in ("v", "rid", "slot", "block", "place", "ids", "rank")])
    got = found(negatives.hard_negatives(odd, block_rows=16))
    assert got == plain(rows) and got
    assert found(negatives.hard_negatives(df.limit(0))) == []
    assert found(negatives.hard_negatives(spark.createDataFrame([(0, 1, [1.0])], SCHEMA))) == []


def test_scores_beyond_exact_doubles_are_whole(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [float(np.float32(rng.uniform(1, 4) * 2**20)) for _ in range(3)]) for i in range(120)]
    assert found(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), block_rows=16)) == plain(rows) != []


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_each_cell_once_in_steps_of_one(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    place = negatives.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_zone_maps_leave_blocks_unread(spark):
    """Well separated groups: most blocks can't hold what a query looks for, so they aren't read."""
    rng = random.Random(2)
    rows = [(i, i % 8, [(2.0 if i % 8 == d else 0.0) + rng.gauss(0, 0.01) for d in range(8)]) for i in range(2000)]
    index = negatives.BlockIndex.build(negatives.participants(spark.createDataFrame(rows, SCHEMA), 256.0, "vec_id", "label", "embedding"), 50)
    zones = index.blocks.select(F.lit(0).alias("chunk"), "block", "low", "high", F.array_min("ids").alias("least"), F.array_distinct("labels").alias("labels"))
    queries = index.rows(50).select("rid", F.lit(0).alias("slot"), "label", "v", F.lit(-(2**63)).alias("low"), F.lit(2**63 - 1).alias("high"), F.lit(2.0e5).alias("least_score"), F.lit(2**63 - 1).alias("least_id"))
    one = queries.agg(F.collect_list(F.struct("*")).alias("queries")).withColumn("chunk", F.lit(0)).join(zones.groupBy("chunk").agg(F.collect_list(F.struct("block", "low", "high", "least", "labels")).alias("zones")), "chunk")
    read = one.mapInArrow(lambda b: negatives._needed(b, 8, True), "chunk long, block long, chosen array<int>")
    pairs, blocks = read.select(F.sum(F.size("chosen"))).first()[0], index.blocks.count()
    assert blocks >= 40 and pairs <= 0.25 * blocks * 40


def test_nothing_is_broadcast_and_the_product_is_not_shuffled(spark, monkeypatch):
    """Packed vectors were sized by their compressed files and broadcast, and went through a shuffle once a block and query."""
    plans, keep = [], negatives.Scratch.keep
    monkeypatch.setattr(negatives.Scratch, "keep", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(self, df))
    out = negatives.hard_negatives(spark.createDataFrame(made(300, 4, random.Random(3)), SCHEMA), block_rows=16)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "Broadcast" in p]
    products = [p[p.index("CartesianProduct") :] for p in plans if "CartesianProduct" in p]
    assert len(products) == 2 and not [p for p in products if "Exchange" in p]
