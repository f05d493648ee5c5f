"""Line templates against a plain version."""

import random
import re

from lumenfold.llm import lines


def plain_units(text):
    for line in re.split(r"(?<=\n)", text):
        if len(line) <= lines.WHOLE_LINE:
            yield line, False
        else:
            yield from ((p, True) for p in re.split(r"(?<=[.!?] )", line))


def plain_dropped(docs, least_tokens):
    """{doc_id: numbers of its dropped units}."""
    parsed = []
    for i, text in docs:
        for no, (unit, part) in enumerate(plain_units(text)):
            words = [lines.WILD if re.search("[0-9]", w) else w for w in unit.replace("\u0001", " ").split()]
            if words and len(words) >= (lines.LONG_TOKENS if part else least_tokens):
                parsed.append((i, text, no, words))
    leaves, out = {}, {}
    for row in parsed:
        leaves.setdefault((len(row[3]), *row[3][:3]), []).append(row)
    for rows in leaves.values():
        made = {}
        for i, text, no, words in rows:
            constant = [w != lines.WILD and len({t for _, t, _, x in rows if x[k] == w}) >= 2 for k, w in enumerate(words)]
            if sum(constant) >= lines.LEAST_CONSTANT * len(words):
                made.setdefault(tuple(w if c else lines.WILD for w, c in zip(words, constant, strict=True)), []).append((i, text, no))
        for template, places in made.items():
            if len({t for _, t, _ in places}) >= (2 if len(template) >= lines.LONG_TOKENS else 3):
                for i, _, no in places:
                    out.setdefault(i, set()).add(no)
    return out


def test_same_as_plain(spark):
    rng = random.Random(3)
    word = lambda n=40: f"{rng.choice('abcde')}{rng.choice('xyz')}{'q' * rng.randrange(n // 20)}"
    passage = " ".join(" ".join(f"shared{k}{j}x".translate(str.maketrans("0123456789", "klmnopqrst")) for j in range(12)) + "." for k in range(5))
    docs = []
    for i in range(60):
        body = []
        for _ in range(rng.randrange(1, 8)):
            kind = rng.randrange(6)
            if kind == 0:
                body.append(f"Subscribe to letter {rng.randrange(99)} {word()} now please")
            elif kind == 1:
                body.append(" ".join(word() for _ in range(rng.randrange(1, 5))))
            elif kind == 2:
                body.append(" ".join(" ".join(word() for _ in range(rng.randrange(3, 14))) + rng.choice([".", "!", "?", ""]) for _ in range(9)))
            elif kind == 3:
                body.append(f"{' '.join(word(400) for _ in range(20))} end. {passage} {' '.join(word(400) for _ in range(20))}")
            elif kind == 4:
                body.append(f"\t order  {rng.randrange(9)}   from {word()} of the house has been sent on\u000b its way to {word()}")
            else:
                body.append("")
        docs.append((i, "\n".join(body)))
    docs += [(100, docs[0][1]), (101, ""), (102, "mark \u0001 inside.\nand a line of its own here"), (103, f"{'long ' * 20}\u0001 first. {passage} {'tail ' * 50}\nx")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for least, most in ((1, 2_000_000), (3, 0)):
        wanted = plain_dropped(docs, least)
        got = {}
        for r in lines.line_templates(frame, least_tokens=least, most_broadcast=most).collect():
            got.setdefault(r.doc_id, set()).add(r.line_no)
        assert got == wanted and 103 in wanted and len(wanted) > 20
    whole = {r.doc_id: r for r in lines.drop_repeated_lines(frame, least_tokens=3).collect()}
    for i, text in docs:
        left = [u for no, (u, _) in enumerate(plain_units(text)) if no not in wanted.get(i, set())]
        assert whole[i].text.rstrip("\n ") == "".join(left).rstrip("\n ") and whole[i].n_dropped == len(wanted.get(i, ()))
        assert whole[i].n_lines == len(list(plain_units(text))) and (i in wanted or whole[i].text == text)
