"""Each operator against a brute-force version, and the cases that data bring: nulls, empties, repeats, clashes."""

import hashlib
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from compare import DATA, both  # noqa: E402

from lumenfold.llm import chat, decontam, exact, lines, packing, pii, quality, queries, sharding, simhash, tokens  # noqa: E402

LONG = "word " * 30_000 + "end"
ODD = [None, "", " ", "a", "a b c d e f", "a b c d e f", "ÀB ça x\t\ty\n\n z", "a@b.co x +1 (555) 123-4567 1.2.3.4.5 4111 1111 1111 1111", LONG]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, repeats, very long texts, and columns whose names clash."""
    rows = [(i, t, 1.0, "k", "v") for i, t in enumerate(ODD)] + [(None, "a b c d e f", 2.0, "k", "v"), (1, "", 3.0, "k", "v")]
    return spark.createDataFrame(rows, "doc_id long, text string, fp double, key string, digest string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def texts(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    ours, wanted = both(spark, queries.queries()[name], queries.oracle_sql()[name])
    assert ours == wanted


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    prints = {i: plain_fingerprint(t) for i, t in texts(spark)}
    label = dict.fromkeys(prints)
    for i in sorted(prints):  # a plain walk over all pairs
        if label[i] is None:
            todo, label[i] = [i], i
            while todo:
                x = todo.pop()
                for y in prints:
                    if label[y] is None and (prints[x] ^ prints[y]).bit_count() <= 4:
                        label[y] = i
                        todo.append(y)
    got = queries.op1_simhash(spark, DATA).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (prints[i], label[i]) for i in prints}


def test_simhash_prefilter_loses_no_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 40)
    values = {int(b) for b in base}
    for b in base:
        for flips in range(1, 6):
            values.add(int(b) ^ sum(1 << int(k) for k in rng.choice(62, flips, replace=False)))
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    parts = []
    for fast in (True, False):
        label = {v: v for v in values}
        edges = [(r.u, r.v) for r in simhash.near_links(fps, fast).collect()]
        for _ in range(8):
            for u, v in edges:
                label[u] = label[v] = min(label[u], label[v])
        parts.append(label)
    assert parts[0] == parts[1] and len(set(parts[0].values())) < len(values)


def test_tokens(spark):
    from tokenizers import Tokenizer

    for name, end in (("byte_bpe_50k.json", 0), ("word_bpe_49k.json", 2)):
        path = queries.tokenizer_path(name)
        plain, ours = Tokenizer.from_file(path), tokens.PieceEncoder(path)
        some = [t for _, t in texts(spark)[:60]] + [t or "" for t in ODD] + ["  a\n b ", "don't we'll 1 234", "é́ ́x", "x\x1cy z", "İ ΣΑΣ", "<|endoftext|> a", "a<|ENDOFTEXT|>b <|startoftext|>\n<|endoftext|>", "<| a |>"]
        for t, ids in zip(some, ours.encode(some), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
    got = queries.op2_tokens(spark, DATA).orderBy("doc_id").collect()
    plain, start = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json")), 0
    for r, (i, t) in zip(got, sorted(texts(spark)), strict=True):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pieces_outlive_a_generation():
    made = []
    encode = lambda p: made.append(p) or p.encode()
    pieces = tokens._Pieces(encode, encode, 3)  # words and other pieces
    for n in range(20):
        pieces.age()
        assert [pieces[p] for p in ("often", f"a{n}", f"b{n}")] == [b"often", b"a%d" % n, b"b%d" % n]
    assert made.count("often") == 1 and len(pieces) + len(pieces.old) <= 4 * 3


def test_token_files(spark, odd, none, tmp_path):
    """Encodings, page indexes, a read of the metadata alone, and nulls, repeats and empty tables."""
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "odd")
    tokens.write_tokens(odd, queries.tokenizer_path("byte_bpe_50k.json"), path)
    groups = [pq.ParquetFile(f).metadata.row_group(0) for f in glob.glob(f"{path}/tokens/*.parquet") if pq.ParquetFile(f).metadata.num_rows]
    for group in groups:
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings and "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    counts = tokens.read_tokens(spark, path, ("doc_id", "n_tokens"))
    assert ",tokens" not in counts._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    rows = tokens.read_tokens(spark, path).orderBy("start").collect()
    assert len(rows) == len(ODD) + 2 and rows[0].doc_id is None and [r.start for r in rows] == list(np.cumsum([0, *(r.n_tokens for r in rows)])[:-1])
    assert [r.n_tokens for r in rows if r.doc_id == 1] == [1, 1] and all(len(r.tokens) == r.n_tokens and r.tokens[-1] == 0 for r in rows)
    tokens.write_tokens(none, queries.tokenizer_path("byte_bpe_50k.json"), str(tmp_path / "none"))
    assert tokens.read_tokens(spark, str(tmp_path / "none")).count() == 0
    assert packing.pack(none, queries.tokenizer_path("word_bpe_49k.json")).count() == 0


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(40)
    pieces = packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json")).collect()
    ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 2] for i, t in texts(spark)}
    at = dict.fromkeys(ids, 0)
    for p in sorted(pieces, key=lambda p: p.start):
        assert p.start == at[p.doc_id] and np.frombuffer(p.ids, "<u4").tolist() == ids[p.doc_id][p.start : p.start + p.length] and p.doc_tokens == len(ids[p.doc_id])
        at[p.doc_id] += p.length
    assert at == {i: len(x) for i, x in ids.items()}
    ends: dict[int, int] = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in ends.values())
    assert max(ends.values()) <= 4096 and padding <= 0.005 * sum(ends.values())
    assert packing.pack(odd, queries.tokenizer_path("word_bpe_49k.json")).agg(F.sum("length")).first()[0] > 30_000


def test_chat(spark):
    rows = [(1, 0, "user", "<|im_end|>\\<\\|"), (1, 1, "assistant", "a <\\\\|b\n"), (2, 0, "assistant", None), (2, 0, None, "x"), (None, 5, "r\\n\n<|", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit("clash"))
    got = {r.conv_id: r for r in chat.chat_digests(turns).collect()}

    def sha(t):
        return hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()

    assert got[1].turns_sha256 == sha([("user", "<|im_end|>\\<\\|"), ("assistant", "a <\\\\|b\n")]) and got[1].valid and got[1].loss_chars == 8
    assert got[2].turns_sha256 == sha([("", "x"), ("assistant", "")]) and not got[2].valid
    assert got[None].turns_sha256 == sha([("r\\n\n<|", "")]) and got[None].n_turns == 1
    assert chat.chat_digests(turns.limit(0)).count() == 0


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels)
    seen = quality.score(docs.join(labels, "doc_id").where(quality.held_out()), model).join(labels, "doc_id").toPandas()
    assert (seen.predicted == seen.quality).mean() > 0.95 and seen[seen.quality == 1].predicted.mean() > 0.98
    got = quality.score(odd, model).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(none, model).count() == 0 and quality.train(docs, labels.limit(0)) is None
    assert quality.keep_good(odd, labels.limit(0)).count() == odd.count()


def test_exact(spark, odd, none):
    index = exact.new_index(spark, "test_digests", 4)
    first = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(odd, index, "a").collect()}
    assert {(0, 1, 3, False), (1, 1, 3, True), (4, 5, 3, False), (5, 5, 3, True), (None, 5, 3, False)} <= first
    again = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(odd, index, "a").collect()}
    assert again == first and index.table().count() == len({t or "" for t in ODD})
    later = spark.createDataFrame([(99, "a", 1), (98, "new", 1)], "doc_id long, text string, x int")
    assert [r.doc_id for r in exact.exact_dedup(later, index, "b").collect()] == [98]
    assert exact.exact_dedup(none, exact.new_index(spark, "test_empty", 2)).count() == 0
    index.drop()


def plain_pii(text):
    def luhn(d):
        return sum(v - 9 * (v > 9) for v in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d)))) % 10 == 0

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m, d: 14 <= len(d) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 10 <= len(d) <= 15),
    }
    found = [(m.start(), r, k, m.end()) for r, (k, (p, ok)) in enumerate(rules.items()) for m in re.finditer(p, text) if ok(m.group(), re.sub("[^0-9]", "", m.group()))]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def test_pii(spark, odd, none):
    extra = ["a@b.c_x@d.e a@b a@b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1", "4111-1111-1111-1111 4111 1111 1111 1112", "🙂é +1 (555) 123-4567- x", "9" * 50_000, "x@" * 20_000 + "y.z"]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    wanted = {(i, hashlib.sha256(plain_pii(t or "").encode()).hexdigest()) for i, t in [*enumerate(ODD), *((100 + i, t) for i, t in enumerate(extra)), (None, "a b c d e f")]}
    assert {(r.doc_id, r.base_sha256) for r in pii.pii_digests(docs).collect()} == wanted
    assert pii.find_pii(none).count() == 0


def test_pii_finds_unseen_identifiers_by_context(spark):
    rows = [(i, f"call desk +1 (555) 100-{1000 + i} now") for i in range(60)] + [(60, "call desk 555-200-7777 now"), (61, "in 2024/11/05 we met")]
    got = {r.doc_id: r.spans for r in pii.pii_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[60] == "id:10:22" and got[61] == "" and got[0] == "phone:10:27"


def test_sharding(spark, odd, none):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = spark.createDataFrame([(k,) for k in (0, 1, 42, 256, -7, 2**62, 0xDEAD10CC)], "k long")
    for n in (1, 2, 8, 57, 100, 666):
        assert all(r.s == jump(r.k % 2**64, n) for r in keys.select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect())
    got = sharding.shard_rows(odd, 3).collect()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 3) for r in got) and sharding.shard_rows(none, 3).count() == 0


def test_lines(spark, odd, none):
    head = "Subscribe to our news letter number {} now please"
    rows = [(i, f"own {i} a{'b' * i} c d\n{head.format(i)}\ntwo words") for i in range(5)] + [(9, "only here we have this line")]
    got = {r.doc_id: r for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3].text == "own 3 abbb c d\ntwo words" and got[3].n_dropped == 1 and got[9].n_dropped == 0
    whole = lines.drop_repeated_lines(odd).collect()
    assert len(whole) == len(ODD) + 2 and all(r.n_dropped == 0 for r in whole) and lines.drop_repeated_lines(none).count() == 0


def test_decontam(spark, odd, none):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(14))), (2, "short one"), (3, ""), (4, None), (10, "W0 w1")], "item_id long, text string").withColumn("n", F.lit(1))
    docs = spark.createDataFrame([(1, "x " + " ".join(f"W{i}," for i in range(12))), (2, "a short one short one"), (3, "w0-w1 w2"), (4, "short"), (5, None), (1, "clean")], "doc_id long, text string")
    for limit in (500_000, 0):
        got = {(r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids)) for r in decontam.contamination(docs, bench, most_broadcast=limit).collect()}
        assert got == {(1, 13, 12, "1,10"), (2, 5, 4, "2"), (3, 3, 2, "10"), (4, 1, 0, ""), (5, 0, 0, ""), (1, 1, 0, "")}
    assert decontam.contamination(odd, bench.limit(0)).count() == odd.count()
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.decontaminate(odd, bench).columns == odd.columns


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        docs = out
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert len(set(kept.values())) == len(kept) > 100
