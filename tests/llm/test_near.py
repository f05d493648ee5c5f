"""Near-duplicates of the pipeline against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenfold.llm import near


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """The least id of each group that pairs alike connect."""
    sets, label = {i: plain_set(t) for i, t in rows}, {}
    like = lambda a, b: 9 * len(a & b) >= 4 * (len(a) + len(b))
    for i in sorted(sets):
        if i not in label:
            todo, label[i] = [i], i
            while todo:
                x = todo.pop()
                for y in sets:
                    if y not in label and like(sets[x], sets[y]):
                        label[y] = i
                        todo.append(y)
    return set(label.values())


@pytest.mark.parametrize(("sampled", "held"), [(20_000, 2_000_000), (20, 0)])
def test_near_dedup_is_complete_and_checked(spark, monkeypatch, sampled, held):
    import corpus_pipeline as pipeline

    monkeypatch.setattr(near, "SAMPLED", sampled)
    monkeypatch.setattr(near, "MOST_HELD", held)
    rng, texts = random.Random(7), []
    word = lambda: f"w{rng.randrange(5000)}"
    line = " ".join(f"licence{i}" for i in range(30))
    for _ in range(40):  # copies on both sides of 0.8
        base = [word() for _ in range(rng.choice([5, 9, 30, 120]))]
        for changes in (0, 1, 2, 3, 4):
            some = list(base)
            for at in rng.sample(range(len(some)), min(changes, len(some))):
                some[at] = word()
            texts.append(" ".join(some))
    hot = [word() for _ in range(80)]
    for _ in range(150):  # one large group of near copies
        some = list(hot)
        for _ in range(rng.choice([1, 1, 2, 3])):
            some[rng.randrange(80)] = word()
        texts.append(" ".join(some))
    texts += [f"{line} {' '.join(word() for _ in range(rng.choice([1, 6, 60])))}" for _ in range(60)]
    texts += ["a b", "A  b", "", " ", "a b c d e", "a b c d e f"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit("clash"), "sid": F.lit(1)})
    got = pipeline.near_stage(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(plain_kept(rows))


def test_near_dedup_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, "A b c  d e f"), (1, "x"), (3, None), (4, ""), (3, "other words"), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in near.near_dedup(docs).collect() if r.text is not None)
    assert got == [(0, "a b c d e f"), (0, "a b c d e f"), (1, "a b c d e f"), (1, "x"), (3, "other words")]
    assert near.near_dedup(docs.limit(0)).count() == 0


def test_bitmaps_never_rule_out_an_alike_pair():
    rng = np.random.default_rng(5)
    for size in (1, 5, 40, 400, 4000):
        for _ in range(20):
            base = np.unique(rng.integers(-(2**63), 2**63 - 1, size))
            other = np.unique(np.concatenate([base[rng.random(len(base)) > 0.1], rng.integers(-(2**63), 2**63 - 1, size // 10)]))
            bits = near._bitmap(base) ^ near._bitmap(other)
            assert sum(int(w).bit_count() for w in bits.view(np.uint64)) <= len(np.setxor1d(base, other))


def test_wide_bitmaps_never_rule_out_an_alike_pair_and_tell_long_texts_apart(spark):
    rng, pairs = np.random.default_rng(6), []
    some = lambda n: np.unique(rng.integers(-(2**63), 2**63 - 1, n))
    for size in (900, 1100, 2030, 2100, 4090, 9000, 40_000):  # on both sides of powers of two
        for more in (0.0, 0.05, 0.2):
            base = some(size)
            pairs.append((base, np.unique(np.concatenate([base, some(int(size * more))]))))
        pairs.append((some(size), some(int(size * 1.2))))
    rows = [(i, near._wide(a).tolist(), near._wide(b).tolist()) for i, (a, b) in enumerate(pairs)]
    made = spark.createDataFrame(rows, "i int, a array<long>, b array<long>").select("i", near._wide_differ(F.col("a"), F.col("b")).alias("bits"))
    for r in made.collect():
        a, b = pairs[r.i]
        assert r.bits <= len(np.setxor1d(a, b))
        if r.i % 4 == 3 and 1100 <= len(a) < 20_000:  # unrelated
            assert 9 * r.bits > len(a) + len(b)


def test_near_dedup_of_long_texts(spark):
    rng, texts = random.Random(8), []
    passage = [f"p{i}" for i in range(300)]  # makes long texts meet that aren't alike
    for size in (900, 1500, 2300, 4500):
        base = [f"w{rng.randrange(50_000)}" for _ in range(size)]
        grown = [f"w{rng.randrange(50_000)}" for _ in range(size // 6)]
        other = [f"w{rng.randrange(50_000)}" for _ in range(size)]
        changed = list(base)
        for at in rng.sample(range(size), size // 100):
            changed[at] = "changed"
        texts += [" ".join(t) for t in (base, base + grown, passage + other, passage + base[: size // 2], changed)]
    rows = list(enumerate(texts))
    got = near.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(plain_kept(rows))


def starts(pairs):
    """The least member of each member's group."""
    label = {x: x for pair in pairs for x in pair}
    for _ in label:
        for pair in pairs:
            label |= dict.fromkeys(pair, min(label[x] for x in pair))
    return label


def test_near_stage_checks_the_links_of_simhash_fingerprints(spark, monkeypatch):
    import corpus_pipeline as pipeline
    from lumenfold.llm.simhash import RADIUS, fingerprint

    rng, rows = random.Random(9), []
    for at in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        for nth in range(4):  # all but the first have one changed word
            rows.append((4 * at + nth, " ".join(["changed" if nth and i == nth else w for i, w in enumerate(base)])))
    fps = {}
    for _, t in rows:
        sid = xxhash.xxh64_intdigest(near.shingles(t).tobytes(), near.SEED)
        fps[sid - (1 << 64) if sid >= 1 << 63 else sid] = fingerprint(t)
    close = {(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= RADIUS}
    checked, alike = [], near._alike
    monkeypatch.setattr(near, "_alike", lambda pairs, *rest: checked.append({(r.v, r.u) for r in pairs.select("v", "u").collect()}) or alike(pairs, *rest))
    monkeypatch.setattr(near, "HEADS", 0)  # nothing but fingerprints before the last pass
    got = pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(plain_kept(rows)) == list(range(0, 48, 4))
    assert checked[0] <= close and len(close) > 20 and starts(checked[0]) == starts(close)


def test_common_shingles_are_counted_over_all_texts(spark, monkeypatch):
    """They were counted in a sample: texts of any other h were left out."""
    monkeypatch.setattr(near, "SAMPLED", 20)
    rows = [(i, 1, " ".join([f"w{i}x{j}" for j in range(9)] + (["a", "b", "c", "d", "e"] if i % 7 == 0 else []))) for i in range(70)]
    common, times = near._common(spark.createDataFrame(rows, "doc_id long, h long, text string").coalesce(1))
    assert common.tolist() == near.shingles("a b c d e").tolist() and 3 <= times[0] <= 10
