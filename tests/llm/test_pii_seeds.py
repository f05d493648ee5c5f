"""Base matches of all shapes teach the contexts of unseen identifiers."""

import random

from lumenfold.llm import pii


def test_whole_matches_are_seeds(spark):
    letters = "abcdefghijklmnopqrst"
    mail = [(i, f"write mailbox {c}nn@host.org, please") for i, c in enumerate(letters)]
    card = [(100 + i, f"charge visacard 4111 1111 1111 1111 {c}") for i, c in enumerate("ab")]
    for i in range(20):  # cards of distinct digits that pass the Luhn check
        head = f"41111111111{1000 + i}"
        last = next(d for d in "0123456789" if sum(v - 9 * (v > 9) for v in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(head + d)))) % 10 == 0)
        n = head + last
        card.append((200 + i, f"charge visacard {n[:4]} {n[4:8]} {n[8:12]} {n[12:]} today"))
    new = [(50, "write mailbox jane.doe(at)host please"), (51, "charge visacard 9999 888 777 today"), (52, "some file.name in 12 34 56 78 rows")]
    docs = spark.createDataFrame(mail + card + new, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.pii_digests(docs).collect()}
    assert got[0] == "email:14:26" and got[200].startswith("card:16:35")
    assert (got[50], got[51], got[52]) == ("id:14:30", "id:16:28", "")


def test_found_identifiers_teach_new_patterns(spark):
    rows = [(i, f"call desk +1 (555) 100-{1000 + i} now") for i in range(60)]
    rows += [(100 + i, f"call desk 555-200-{7000 + i} ext") for i in range(10)] + [(200, "via 555-300-9999 ext"), (201, "in 2024/11/05 we met")]
    got = {r.doc_id: r.spans for r in pii.pii_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[103] == "id:10:22" and got[200] == "id:4:16" and got[201] == ""


def plain_accepted(edges):
    accepted = {v for _, v, seed in edges if seed}
    before = None
    while before != len(accepted):
        before, of = len(accepted), {}
        for p, v, _ in edges:
            of.setdefault(p, set()).add(v)
        good = {p for p, vs in of.items() if len(vs & accepted) >= pii.LEAST_SEEDS and len(vs & accepted) >= pii.CONFIDENT * len(vs)}
        accepted |= {v for p, v, _ in edges if p in good}
    return accepted


def test_accepted_like_plain(spark, monkeypatch):
    from lumenfold.llm import common

    rng = random.Random(5)
    edges = {(f"p{(n := rng.randrange(300)) // 12 + rng.choice([0, 0, 0, 1])}", f"v{n}") for _ in range(900)}
    seeds = {f"v{n}" for n in range(300) if rng.random() < (0.9 if n < 60 else 0.3)}
    edges = [(p, v, v in seeds) for p, v in sorted(edges)]
    wanted = plain_accepted(edges)
    assert len(seeds & {v for _, v, _ in edges}) < len(wanted) < 300
    frame = spark.createDataFrame(edges, "pattern string, value string, seed boolean")
    for hot in (1_000, 5):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        assert {r.value for r in pii.accepted_instances(frame, common.Scratch(spark, "test")).collect()} == wanted


def test_a_chain_of_seven_hops_is_followed_to_its_end(spark):
    from lumenfold.llm import common

    edges = [(f"p{i}.{j}", v) for i in range(7) for j in range(3) for v in [f"v{i}.{k}" for k in range(6)] + [f"v{i + 1}.{k}" for k in (2 * j, 2 * j + 1)]]
    frame = spark.createDataFrame([(p, v, v.startswith("v0.")) for p, v in edges], "pattern string, value string, seed boolean")
    got = {r.value for r in pii.accepted_instances(frame, common.Scratch(spark, "test")).collect()}
    assert got == {f"v{i}.{k}" for i in range(8) for k in range(6)} == plain_accepted([tuple(r) for r in frame.collect()])


def test_shorter_candidates_and_groups_of_over_eight(spark):
    docs = [(i, f"ring desk +1 (555) 100-{1000 + i} now") for i in range(30)] + [(50, "ring desk 12-34 now"), (51, "ring desk " + " ".join("12345678") + " 9 now")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {n: {r.doc_id: [(a.start, a.end) for a in r.added] for r in pii.find_pii(docs, least_chars=n).collect()} for n in (5, 6)}
    assert spans[5][50] == [(10, 15)] and spans[6][50] == []
    assert spans[6][51] == [(10, 25)]


def test_very_many_matches_in_one_text(spark):
    many = " ".join(f"n{i}@x{i % 7}.org {10_000_000 + i}" for i in range(50_000))
    got = pii.find_pii(spark.createDataFrame([(1, many)], "doc_id long, text string")).collect()[0]
    assert len(got.base) == 50_000 and all(many[b.start : b.end] == b.value for b in got.base[::997])
