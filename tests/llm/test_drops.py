"""What stays when ids repeat or are null: the drops agree with the flags."""

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from compare import DATA  # noqa: E402

from lumenfold.llm import decontam, exact, queries, simhash  # noqa: E402


def frame(spark, rows):
    """Columns with the names that the operators use inside."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit("x"), "digest": F.lit(1), "key": F.lit(2.0), "__h": F.lit(3)})


def left(df):
    return sorted((r.doc_id or 0, r.text or "") for r in df.collect())


def test_exact_drops_by_id_and_text(spark):
    docs = frame(spark, [(1, "dup"), (5, "dup"), (1, "other"), (None, "dup"), (None, "dup"), (None, "alone"), (7, None), (6, "")])
    for parts in (1, 3):
        index = exact.new_index(spark, "drops")
        out = exact.exact_dedup(docs, index, parts=parts)
        assert left(out) == [(0, "alone"), (1, "other"), (5, "dup"), (7, "")] and out.columns == docs.columns
        index.drop()


def test_later_ranges_go_through_the_anti_join(spark):
    rows = [(i, f"t{i % 7}") for i in range(60)] + [(None, "t3")]
    index = exact.new_index(spark, "ranges", 4)
    got = exact.exact_groups(frame(spark, rows), index, parts=3).collect()
    held = {r.digest: (r.keep_id, r.batch) for r in index.table().collect()}
    assert len(held) == index.table().count() == 7 and {b for _, b in held.values()} == {"first.0"}
    assert all(r.keep_id == held[r.digest][0] == max(i for i, t in rows if i is not None and t == f"t{r.keep_id % 7}") for r in got)
    again = exact.DigestIndex(spark, index.name)
    assert exact.exact_dedup(frame(spark, [(900, "t3"), (901, "new")]), again, "later").collect()[0].doc_id == 901 and again.bucket_count() == 4
    index.drop()


def test_op5_anti_joins_and_leaves_no_table(spark):
    queries.op5_exact(spark, DATA).collect()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digests_")]


def test_the_index_lies_in_the_shared_folder_and_goes_with_its_files(spark):
    from pathlib import Path

    from lumenfold.llm.common import shared_root

    index = exact.new_index(spark, "placed", 2)
    exact.exact_groups(frame(spark, [(1, "a"), (2, "b")]), index).collect()
    at = Path(index.path.removeprefix("file:"))
    assert str(at).startswith(shared_root(spark).removeprefix("file:")) and list(at.glob("*.parquet"))
    index.drop()
    assert not at.exists() and not index.exists()


def test_simhash_drops_by_id_and_text(spark):
    docs = frame(spark, [(1, "a b c d e f"), (7, "a b c d e f"), (7, "quite another text of words"), (None, "a b c d e f"), (3, None), (4, " ")])
    assert left(simhash.simhash_dedup(docs)) == [(0, "a b c d e f"), (1, "a b c d e f"), (3, ""), (7, "quite another text of words")]
    assert simhash.simhash_dedup(docs.limit(0)).count() == 0


def test_simhash_of_odd_rows(spark):
    docs = frame(spark, [(9, None), (4, ""), (None, " \t"), (2, "word " * 20_000), (2, "word " * 20_000), (None, "only one without an id")])
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.simhash_components(docs).collect())
    assert got == [(0, 0), (0, 4), (2, 2), (2, 2), (4, 4), (9, 4)]


def test_decontaminate_drops_by_id_and_text(spark):
    bench = spark.createDataFrame([("q1", " ".join(f"w{i}" for i in range(10)))], "item_id string, text string")
    bad = "see " + " ".join(f"W{i}" for i in range(10))
    docs = frame(spark, [(None, bad), (2, bad), (2, "clean text"), (3, None), (None, "clean too")])
    for most in (500_000, 0):
        flags = {(r.doc_id, r.contaminated) for r in decontam.contamination(docs, bench, most_broadcast=most).collect()}
        assert flags == {(None, True), (2, True), (2, False), (3, False), (None, False)}
    assert left(decontam.decontaminate(docs, bench)) == [(0, "clean too"), (2, "clean text"), (3, "")]
