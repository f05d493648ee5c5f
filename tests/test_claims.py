"""Sentences and claims against a plain version."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import claims
from lumenfold.plans import claims as plans
from lumenfold.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def plain_spans(text):
    """Ends are looked for one after another; a full stop is judged by the letters and stops right before it."""
    out, start, at = [], 0, 0
    while at < len(text):
        if text[at] not in ".!?":
            at += 1
            continue
        if text[at] == ".":
            run = re.search(r"[A-Za-z][A-Za-z.]*$", text[start:at])
            word = run.group() if run else ""
            if word.lower() in claims.ABBREVIATIONS or re.fullmatch(r"[A-Z]|(?:[A-Za-z]\.)+[A-Za-z]", word) or (text[at - 1 : at].isdigit() and text[at + 1 : at + 2].isdigit()):
                at += 1
                continue
        end = at + 1 + (text[at + 1 : at + 2] in tuple("\"'”’"))
        if end >= len(text) or text[end].isspace():
            piece = text[start:end]
            lead = len(piece) - len(piece.lstrip())
            out.append((start + lead, start + len(piece.rstrip())))
            start = end
        at = end
    return out


def plain_claim(text):
    any_of = lambda words: re.compile(r"\b(?:" + "|".join(words) + r")\b", re.I)
    verb = any_of(claims.PREDICATES).search(text)
    return bool(
        20 <= len(text) <= 200 and not set("<>") & set(text) and not text.rstrip("\"'”’").endswith("?") and not any_of(claims.DEPENDENT).match(text) and not any_of(claims.HEDGES).search(text)
        and not re.match(r"(?:top\s+)?(?:\d+|" + "|".join(claims.COUNTS) + r")\s+(?:reasons|ways|things)\b", text, re.I) and verb and re.search(r"[^\W_]", text[: verb.start()])
    )


def plain_claims(title, summary, truncated):
    if truncated:
        return []
    title, summary = title or "", summary or ""
    out = []
    if title.strip() and title.strip()[-1] not in ":;,…" and plain_claim(title.strip()):
        lead = len(title) - len(title.lstrip())
        out.append(("title", lead, lead + len(title.strip())))
    return (out + [("summary", a, b) for a, b in plain_spans(summary) if plain_claim(summary[a:b])])[:3]


@pytest.mark.parametrize(
    ("text", "ends"),
    [
        ("One. Two! Three? Rest", [4, 9, 16]), ("It rose 3.5 points. Then fell.", [19, 30]), ("Dr. No met Mr. Yes. So.", [19, 23]), ("See e.g. this. I.e. that.", [14, 25]), ("J. K. Smith won. U.S.A. lost.", [16, 29]),
        ('He said "no." Then left.', [13, 24]), ("What?! Yes.", [6, 11]), ("No.end here. x", [12]), ("", []), ("no end", []), ("...", [3]), (". a.", [1, 4]), ("wait.. go.", [6, 10]), ("Vs. you. ETC. me.", [8, 17]), ("a 5.", [4]),
    ],
)
def test_sentence_ends(spark, text, ends):
    got = claims.sentence_spans(spark.createDataFrame([(1, text)], "article_id int, text string")).orderBy("nth").collect()
    assert [r.end for r in got] == ends == [b for _, b in plain_spans(text)]
    assert all(text[r.start : r.end] == r.sentence for r in got)


def test_random_texts_equal_the_plain_version(spark):
    rng = random.Random(4)
    parts = ["a", "B", "Dr", "e.g", "i.e", "U.S", ".", ".", "!", "?", " ", " ", "\n", '"', "'", "”", "3", "1.5", "é", "etc", "xDr", "9st", " "]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(600)] + [(900, None)]
    got = {}
    for r in claims.sentence_spans(spark.createDataFrame(texts, "article_id int, text string").withColumn("nth", F.lit("z"))).orderBy("article_id", "nth").collect():
        got.setdefault(r.article_id, []).append((r.start, r.end))
    assert got == {i: s for i, t in texts if (s := plain_spans(t or ""))} and len(got) > 300


def test_queries_equal_the_plain_version(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = sorted((r.article_id, r.start, r.end) for r in QUERIES["sentence_places"](spark, DATA).collect())
    assert got == sorted((i, a, b) for i, t in docs.items() for a, b in plain_spans(t)) and len(got) > 1000
    caught = []
    extract = claims.extract_claims
    plans.claims.extract_claims = lambda df: (caught.append(df), extract(df))[1]
    try:
        rows = QUERIES["reported_claims"](spark, DATA).collect()
    finally:
        plans.claims.extract_claims = extract
    wanted = {(r.article_id, *c) for r in caught[0].collect() for c in plain_claims(r.title, r.summary, r.truncated)}
    assert {(r.article_id, r.field, r.start, r.end) for r in rows} == wanted and len(wanted) > 50


def test_three_claims_and_what_is_none(spark):
    fact = "Acme Corp reported higher earnings."
    rows = [(1, f" {fact} ", f"{fact} Nothing here. {fact} {fact} {fact}", False), (2, f"{fact[:-1]}:", None, None), (3, fact, fact, True), (4, None, "Reported 5 gains in the last quarter. They said it was good enough. Acme said it may rise soon. Five ways Acme launched a thing. <b>Acme</b> said that it won.", False), (5, "Has Acme reported its earnings?", 'Is "Acme Corp reported?" 12 reported in all of the cases.', False)]
    got = claims.extract_claims(spark.createDataFrame(rows, "article_id int, title string, summary string, truncated boolean")).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.article_id, []).append((r.field, r.start, r.end))
    assert found == {i: c for i, t, s, cut in rows if (c := plain_claims(t, s, cut))} and len(found[1]) == 3 and 4 not in found and found[5][0][0] == "summary"


def test_long_texts_take_little_time(spark):
    """What stands before a character was looked at for every character: a million took over six seconds."""
    text = "It rose by words of no end " * 40_000 + "and fell. "
    df = spark.createDataFrame([(1, text)], "article_id int, text string")
    claims.sentence_spans(df.limit(0)).collect()
    began = time.monotonic()
    assert [(r.start, r.end) for r in claims.sentence_spans(df).collect()] == [(0, len(text) - 1)]
    assert time.monotonic() - began < 4


def test_words_before_a_full_stop_are_those_of_backtracking(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text").union(spark.createDataFrame([("a bc def. é ß3 x y. aé1b cc  d e f.",), (f"{'long ' * 15}end. a b",)], "text string"))
    slow = F.regexp_replace("text", r"(\p{L}+) (\p{L}+)(?=[^.]{0,60}\.)", "$1 said $2")
    assert docs.where(~slow.eqNullSafe(F.regexp_replace("text", plans._TWO_WORDS, "$1 said $2"))).count() == 0
    # Words far from a full stop were tried from each of their letters, back to each letter of the next one.
    text = "abcdefghijklmnopqrstuvwxyz " * 3_000
    df = spark.createDataFrame([(text,)], "text string")
    began = time.monotonic()
    assert df.select(F.regexp_replace("text", plans._TWO_WORDS, "$1 said $2")).first()[0] == text
    assert time.monotonic() - began < 3
