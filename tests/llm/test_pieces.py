"""SentencePiece encoding: ids and texts against the library, spans against the library's own offsets."""

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from lumenfold.llm import pieces
from lumenfold.llm.queries import op13_pieces, tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "a", " a", "a ", "  a  b ", "a\nb\t c", "Ａｂ ﬁ é é", "a▁b ▁", "<s> x <unk></s>", "\x00a", "　x  y", "日本語のテキスト 🙂🏽 x", "¼ ² ﷺ ™", "x" * 300, "ab " * 3000]


def random_texts(n=200):
    rng = random.Random(3)
    alphabet = "aaaabcdé ßﬁＡ  \n\t▁日🙂0189.,"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_texts_and_spans(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = random_texts()
    for text, (ids, begins, ends, size) in zip(texts, pieces.PieceCodec(PATH).encode(texts), strict=True):
        data = text.encode()
        assert ids.tolist() == library.encode(text) and size == len(data)
        assert [*ends[:-1]] == [*begins[1:]] and (not len(ids) or (begins[0], ends[-1]) == (0, len(data)))
        covered = b""
        for i, b, e in zip(ids.tolist(), begins, ends, strict=True):
            piece = library.id_to_piece(i)
            covered += bytes([int(piece[3:5], 16)]) if library.is_byte(i) else piece.encode()
            if not library.is_byte(i):
                assert data[b:e].decode().replace(" ", "▁") in (piece, piece.removeprefix("▁"))
        assert covered == b"" or covered == ("▁" + text.replace(" ", "▁")).encode()


def test_words_give_the_whole_encoding(monkeypatch):
    library, codec = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.PieceCodec(PATH)
    texts = [*random_texts(300), "the quick brown fox  jumps over a lazy dog " * 20, "w " * 100, "one\ntwo three", "a \nb", "a b ", "a▁ b", " a"]
    assert codec.separable and codec.cut("a  b c ") == ["a", " b", "c "]
    monkeypatch.setattr(pieces, "CACHED", 5)
    monkeypatch.setattr(pieces, "LONGEST", 3)
    for at in range(0, len(texts), 20):
        for text, got in zip(texts[at : at + 20], codec.encode(texts[at : at + 20]), strict=True):
            assert got[0].tolist() == library.encode(text), text
    codec.separable = False
    assert [x[0].tolist() for x in codec.encode(texts)] == library.encode(texts)


@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_compiled_character_maps(rule, squeeze):
    """The library's own rules: the same text and, at every byte, the source offset that it gives."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    ours = pieces.Normalizer(library.serialized_model_proto())
    assert (ours.map is None) == (rule == "identity")
    rng = random.Random(9)
    parts = ["a", "B", " ", "  ", "ﬁ", "Ａ", "¼", "é", "é", "ｶﾞ", "㍿", "ﷺ", "　", "\t", "\n", "​", "日本", "🙂", "İ", "ß", "™", "한", "한"]
    for text in [*ODD, *["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(300)]]:
        out, source = ours.normalize(text)
        wanted, places = library.normalize(text, with_offsets=True)
        assert out.decode() == wanted, text
        data, at, chars = text.encode(), 0, []
        for c in out.decode():
            chars.append(len(data[: source[at]].decode(errors="ignore")))
            at += len(c.encode())
        first = 1 if wanted else 0  # the blank put first: the library's place of it isn't compared
        assert chars[first:] == places[first:][: len(chars) - first], text


def test_unsupported_models_are_refused():
    with pytest.raises(ValueError, match="suffix"):
        pieces.Normalizer(b"\x12\x03\xc0\x01\x01")


def test_query_equals_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = []
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode(r.text or "")
        wanted.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len((r.text or "").encode())))
    assert sorted(map(tuple, op13_pieces(spark, "/root/testdata/sf0.001").collect())) == sorted(wanted)


def test_nulls_repeats_empty_tables_and_clashing_names(spark):
    schema = "doc_id string, text string"
    rows = [("a", None), (None, "x y"), ("a", ""), ("b", "word " * 40_000), ("b", "word " * 40_000)]
    odd = spark.createDataFrame(rows, schema).select("*", *[F.lit("z").alias(c) for c in ("ids", "begins", "ends", "n_bytes", "decoded")])
    got = pieces.decode_pieces(pieces.encode_pieces(odd, PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(i), t or "") for i, t in rows)
    assert {len(r.ids) for r in got if r.decoded == ""} == {0}
    assert pieces.encode_pieces(spark.createDataFrame([], schema), PATH).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in pieces.decode_pieces(nothing, PATH).collect()] == ["", ""]
