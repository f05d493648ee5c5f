"""Longest common runs against the quadratic version, and the cases of quotes."""

import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import copying


def plain(a, b, least):
    """(length, start, source_start) by the table of all pairs of words."""
    best, before = (0, 0, 0), [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                row[j] = before[j - 1] + 1
                if row[j] > best[0]:
                    best = (row[j], i - row[j], j - row[j])
        before = row
    return best if best[0] >= least else None


@pytest.mark.parametrize(("least", "split"), [(2, 10_000), (3, 2), (5, 1)])
def test_runs_equal_the_quadratic_version(spark, least, split, monkeypatch):
    monkeypatch.setattr(copying, "SPLIT", split)
    rng = random.Random(least)
    shared = [[rng.choice("abcdef") for _ in range(12)] for _ in range(5)]

    def text():
        out = []
        for _ in range(rng.randrange(8)):
            out += rng.choice(shared)[rng.randrange(6) : rng.randrange(6, 13)] if rng.random() < 0.5 else [rng.choice("abcdefgh")] * rng.randrange(1, 6)
        return out

    prose, sources = [(i % 2, i, text()) for i in range(30)], [(i % 2, i, text()) for i in range(20)]
    a = spark.createDataFrame([*prose, (None, 99, shared[0]), (0, 98, None), prose[3]], "scope int, prose_id int, words array<string>")
    b = spark.createDataFrame([*sources, sources[2]], "scope int, source_id int, words array<string>")
    got = sorted(map(tuple, copying.longest_runs(a, b, least).collect()))
    wanted = sorted((s, i, j, *r) for s, i, x in prose for t, j, y in sources if s == t and (r := plain(x, y, least)))
    assert got == wanted and len(got) > 30
    assert copying.longest_runs(a.limit(0), b, least).collect() == []


def findings(spark, text, snippets):
    blocks = spark.createDataFrame([(1, text)], "block_id int, text string")
    rows = [(1, n, *s) for n, s in enumerate(snippets)]
    df = spark.createDataFrame(rows, "block_id int, nth int, source_id string, text string, publisher string, url string")
    return sorted((r.violation, r.word_count, r.source_id) for r in copying.copy_findings(blocks, df.withColumn("place", F.lit("z"))).collect())


def test_bounds_of_copying_and_quoting(spark):
    run = " ".join(f"w{i}" for i in range(40))
    cut = lambda n: " ".join(run.split()[:n])
    source = ("s", run, "Daily Post", "https://x")
    assert findings(spark, f"so {cut(15)} it is", [source]) == []
    assert findings(spark, f"so {cut(16).upper()} it is", [source]) == [("excessive_copying", 16, "s")]
    assert findings(spark, f'The daily post: "{cut(25)}"', [source]) == []
    assert findings(spark, f'The daily post: “{cut(26)}”', [source]) == [("too_long", 26, "s")]
    assert findings(spark, '"not in it"', [source]) == [("unattributable", 3, None)]
    assert findings(spark, f'"{cut(3)}" he said', [source]) == [("unattributed", 3, "s")]
    assert findings(spark, f'Daily Post: "{cut(3)}"', [("s", run, "Daily Post", None)]) == [("missing_url", 3, "s")]
    assert findings(spark, f'Other: "{cut(3)}"', [("s", run, "Daily Post", ""), ("t", run, "Other", "https://y")]) == []
    assert findings(spark, f'a lone " mark and {cut(16)}', [source]) == [("excessive_copying", 16, "s")]
    assert findings(spark, '"" and "..."', [source]) == [] == findings(spark, None, [source])
    two = [("t", cut(20), None, None), ("s", run, None, None)]
    assert findings(spark, f"{cut(18)} x {cut(22)}", two) == [("excessive_copying", 22, "s")]
    assert findings(spark, f"{cut(18)}", two) == [("excessive_copying", 18, "t")]
