"""Long lines that recur in exactly two texts."""

from lumenfold.llm import lines


def test_long_lines_recur_from_two_texts_on(spark):
    long = "this notice of {} words stands in two of the texts and has to go from both"
    rows = [(1, f"one\n{long.format(11)}\nonly here a"), (2, f"{long.format(12)}\ntwo"), (3, "a short line twice"), (4, "a short line twice\nb"), (5, "this notice of 12 words but other ones after that so it has to stay here")]
    rows.append((6, rows[4][1]))  # copies of a whole text are one document
    got = {r.doc_id: r for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].text, got[2].text) == ("one\nonly here a", "two") and got[1].n_dropped == got[2].n_dropped == 1
    assert all(got[i].n_dropped == 0 for i in (3, 4, 5, 6))
