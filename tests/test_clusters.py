"""Single-link clusters against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import clusters
from lumenfold.plans import clusters as plans

SCHEMA = "item_id long, vector array<double>"


def plain(rows, t):
    def cos(a, b):
        if a == b:
            return 1.0 if any(a) else 0.0
        norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / norms if norms else 0.0

    alike = {i: [j for j, w in rows if j != i and cos(v, w) >= t] for i, v in rows}
    label = {}
    for i in sorted(alike):
        todo = [] if i in label else [i]
        while todo:
            at = todo.pop()
            if at not in label:
                label[at] = i
                todo += alike[at]
    return sorted((i, label[i], len(alike[i]), sum(x == label[i] for x in label.values())) for i in label)


def found(df):
    return sorted(map(tuple, df.select("item_id", "cluster_id", "n_links", "size").collect()))


def around(centres, n, spread, rng):
    return [(i * 3 + 1, [c + rng.gauss(0, spread) for c in centres[i % len(centres)]]) for i in range(n)]


@pytest.mark.parametrize("t", [0.0, 0.5, 0.8, 0.95])
def test_equals_all_pairs(spark, t, monkeypatch):
    monkeypatch.setattr(clusters, "PIVOT_ROWS", 20)
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 8)
    rng = random.Random(int(t * 100))
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(12)]
    rows = around(centres, 250, 0.35, rng)
    rows += [(2000 + i, rows[7][1]) for i in range(40)] + [(3000, [0.0] * 5), (3001, [0.0] * 5), (3002, [-0.0] * 5)]
    got = found(clusters.single_link(spark.createDataFrame(rows, SCHEMA), t))
    assert got == plain(rows, t) and len({r[1] for r in got}) > (0 if t == 0 else 3)


def test_a_chain_is_one_cluster(spark):
    rows = [(i, [math.cos(i * 0.05), math.sin(i * 0.05)]) for i in range(60)]
    got = found(clusters.single_link(spark.createDataFrame(rows, SCHEMA), math.cos(0.06)))
    assert got == plain(rows, math.cos(0.06)) and {r[1] for r in got} == {0}


def test_far_pairs_are_never_compared(spark, monkeypatch):
    """Well separated groups: of all pairs of vectors, few meet in a tile."""
    monkeypatch.setattr(clusters, "PIVOT_ROWS", 10)
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 16)
    rng, met = random.Random(1), []
    rows = around([[10.0 * (i == d) for d in range(20)] for i in range(20)], 1000, 0.05, rng)
    compared = clusters._compared
    monkeypatch.setattr(clusters, "_compared", lambda tiles, *a: (met.append(tiles.select(F.sum(F.size("a") * F.size("b"))).first()[0]), compared(tiles, *a))[1])
    got = found(clusters.single_link(spark.createDataFrame(rows, SCHEMA), 0.95))
    assert {r[2] for r in got} == {49} and met[0] < 0.35 * 1000 * 1000


def test_missing_vectors_thresholds_and_odd_tables_are_refused(spark):
    rows = [(i, None if i % 3 == 0 else [1.0, float(i)]) for i in range(25)]
    with pytest.raises(clusters.MissingVectors, match=r"9 item\(s\) have no vector: 0, 3, 6, 9, 12, ... \(\+4 more\)"):
        clusters.single_link(spark.createDataFrame(rows, SCHEMA))
    with pytest.raises(clusters.MissingVectors, match="1 item"):
        clusters.single_link(spark.createDataFrame([(1, [1.0, float("nan")])], SCHEMA))
    good = spark.createDataFrame([(1, [1.0]), (2, [1.0])], SCHEMA)
    for bad in (True, "0.8", float("nan"), float("inf"), -0.1, 1.1):
        with pytest.raises(ValueError, match="threshold"):
            clusters.single_link(good, bad)
    for twice in ([(1, [1.0]), (1, [2.0])], [(None, [1.0])], [(1, [1.0]), (2, [1.0, 2.0])]):
        with pytest.raises(ValueError, match="distinct"):
            clusters.single_link(spark.createDataFrame(twice, SCHEMA))
    assert found(clusters.single_link(good.limit(0))) == []
    odd = good.select("*", *[F.lit("z").alias(c) for c in ("id", "n", "key", "copy", "part", "cluster_id", "size")])
    assert found(clusters.single_link(odd)) == [(1, 1, 1, 2), (2, 1, 1, 2)]


def test_articles_without_an_embedding_stop_the_run(spark):
    """The given documents outnumber the vectors, so clustering them all has to be refused."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("item_id"))
    items = docs.join(plans._items(spark, "/root/testdata/sf0.01"), "item_id", "left")
    with pytest.raises(clusters.MissingVectors, match="500 item"):
        clusters.single_link(items)


def test_vectors_without_structure_are_not_copied_to_all_pivots(spark, monkeypatch):
    """At a low threshold random vectors were guests at nearly every pivot: 30 copies of each, and more with each further pivot."""
    monkeypatch.setattr(clusters, "PIVOT_ROWS", 20)
    monkeypatch.setattr(clusters, "SQUARE", 64)
    rng, copies = random.Random(3), []
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(600)]
    placed = clusters._placed
    monkeypatch.setattr(clusters, "_placed", lambda *a: (copies.append(placed(*a).count()), placed(*a))[1])
    got = found(clusters.single_link(spark.createDataFrame(rows, SCHEMA), 0.6))
    assert got == plain(rows, 0.6) and copies[0] <= 2 * len(rows)
