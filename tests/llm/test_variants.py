"""Spelling variants against a plain version."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import variants
from lumenfold.llm.queries import op11_variants

SCHEMA = "doc_id long, text string"


def plain_words(docs):
    upper = {c: c + 32 for c in range(65, 91)}
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(upper)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return count


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(docs):
    n = {w: k for w, k in plain_words(docs).items() if len(w) >= 5 and k >= 3}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(rows)


def found(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def test_groups_equal_the_plain_version(spark):
    rng = random.Random(5)
    base = ["stone", "stones", "store", "score", "scores", "tones", "notes", "onset", "étude", "études", "Étude", "aaaaa", "aaaaaa", "aaaaaaa", "baaaaa"]
    docs = []
    for i in range(300):
        words = []
        for _ in range(rng.randrange(0, 60)):
            w = rng.choice(base)
            if rng.random() < 0.3:
                k = rng.randrange(len(w) + 1)
                w = rng.choice((w[:k] + rng.choice("aeostÿß") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("aeost") + w[k + 1 :]))
            words.append(rng.choice((w, w.upper(), w.title())))
        docs.append((i, rng.choice((" ", "-", "1")).join(words)))
    docs += [(None, "stone store"), (7, None), (8, ""), (docs[0][0], docs[0][1]), (10**12, "stone " * 5000 + "x" * 50_000)]
    wanted = plain_groups(docs)
    assert found(variants.variant_groups(spark.createDataFrame(docs, SCHEMA))) == wanted
    assert sum(r[3] is not None for r in wanted) > 50 and any(r[5] not in (r[0], r[3]) for r in wanted) and max(r[2] for r in wanted) > 5


def test_query_equals_the_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert found(op11_variants(spark, "/root/testdata/sf0.001")) == plain_groups([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("parts", [3, 4, 5])
def test_every_pair_meets_by_a_signature(spark, parts):
    rng = random.Random(parts)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(400)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    pairs = {(r.word, r.other) for r in variants.near_words(df, parts).collect()}
    assert pairs == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_empty_table_and_clashing_names(spark):
    assert found(variants.variant_groups(spark.createDataFrame([], SCHEMA))) == []
    docs = spark.createDataFrame([(1, "abcde abcde abcde abcdx abcdx abcdx")], SCHEMA)
    odd = docs.select("*", *[F.lit("z").alias(c) for c in ("word", "n", "form", "root", "sig", "a", "b", "__run", "__len")])
    assert found(variants.variant_groups(odd)) == found(variants.variant_groups(docs)) == plain_groups([tuple(r) for r in docs.collect()])


def test_a_long_path_of_forms_ends_at_one_root(spark):
    chain = [("aaaaa" + "b" * i, 3 ** (i + 1)) for i in range(1, 8)]
    docs = spark.createDataFrame([(10_000 + i, w) for w, n in chain for i in range(n)], SCHEMA)
    rows = found(variants.variant_groups(docs))
    assert rows == plain_groups([tuple(r) for r in docs.collect()])
    assert {r[5] for r in rows if r[0] in dict(chain)} == {chain[-1][0]}


def test_nothing_is_broadcast(spark, monkeypatch):
    """Signatures were sized by the file of the words, before they are multiplied, and broadcast."""
    plans, keep = [], variants.Scratch.keep
    monkeypatch.setattr(variants.Scratch, "keep", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(self, df))
    out = variants.variant_groups(spark.createDataFrame([(1, "abcde abcde abcde abcdx abcdx abcdx abcdex abcdex abcdex")], SCHEMA))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in plans) >= 3 and not [p for p in plans if "Broadcast" in p]
