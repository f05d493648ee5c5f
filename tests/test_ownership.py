"""Exposure along ownership against all simple paths, and cycles."""

import random

import pytest

from lumenfold.operators import graphs

SCHEMA = "child int, parent int, confidence double"


def plain(edges, levels):
    best, loops = {}, {}

    def walk(path, confidence):
        for c, p, f in edges:
            if c != path[-1]:
                continue
            if p == path[0]:
                loops[p] = min(loops.get(p, 99), len(path))
            if p in path:
                continue
            now = confidence * (1.0 if f is None else min(max(f, 0.0), 1.0))
            rank = (-now, len(path))
            best[path[0], p] = min(best.get((path[0], p), (9, 9)), rank)
            if len(path) < levels:
                walk([*path, p], now)

    for c in {c for c, _, _ in edges}:
        walk([c], 1.0)
    return {k: (-a, d) for k, (a, d) in best.items()}, loops


@pytest.mark.parametrize("levels", [1, 3, 4])
def test_exposure_equals_all_simple_paths(spark, levels):
    rng = random.Random(levels)
    edges = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(45)})
    edges = [(c, p, rng.choice([None, 0.0, 0.5, 0.5, 0.9, 1.0, 1.5, -1.0])) for c, p in edges for _ in range(rng.choice((1, 1, 2)))]
    df = spark.createDataFrame(edges, SCHEMA)
    wanted, loops = plain(edges, levels)
    got = {(r.origin, r.parent): (r.confidence, r.depth) for r in graphs.parent_exposure(df, levels).collect()}
    assert got.keys() == wanted.keys() and all(abs(got[k][0] - wanted[k][0]) < 1e-12 and got[k][1] == wanted[k][1] for k in got)
    assert {r.node: r.length for r in graphs.ownership_cycles(df, levels).collect()} == loops


def test_empty_graphs(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert graphs.parent_exposure(none).collect() == [] == graphs.ownership_cycles(none).collect()
