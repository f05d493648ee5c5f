"""SentencePiece encoding with byte spans, and decoding.

A model file holds its vocabulary and a compiled character map. Texts are normalised
here by the map's longest prefixes, with the source byte of each byte of the result,
so that every piece of the encoding can be told where in the text it comes from. The
merges themselves are the library's.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import require
from lumenfold.llm.tokens import small_batches

SPACE = "▁"  # U+2581 stands for a blank
CACHED = 300_000  # words (about 150 bytes each) from which a worker's cache starts anew
LONGEST = 48  # characters of a word that is worth holding
ID = np.dtype("<i4")
_CUTS = re.compile(f"(?s)(?<=[^ {SPACE}]) (?=.)")
ENCODED = "doc_id {doc_id}, ids array<int>, begins array<int>, ends array<int>, n_bytes long"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields: integers, or bytes for all other kinds."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 and the texts that replace its keys."""

    def __init__(self, compiled: bytes) -> None:
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.texts = compiled[4 + size :]
        self.begins: dict[str, bool] = {}

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes of the longest key at ``at``, its replacement), or None."""
        units, node, found = self.units, 0, None
        node ^= self._children(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            leaf = units[node] >> 8 & 1
            node ^= self._children(units[node])
            if leaf:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(0, found[1])]

    @staticmethod
    def _children(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def starts(self, text: str) -> list[str]:
        """The text's characters that some key begins with; each character is looked up once a worker."""
        for c in set(text) - self.begins.keys():
            node, data = self._children(self.units[0]), c.encode()
            for byte in data:
                node ^= byte
                if node >= len(self.units) or self.units[node] & 0x800000FF != byte:
                    break
                node ^= self._children(self.units[node])
            else:
                self.begins[c] = True
                continue
            self.begins[c] = False
        return [c for c in set(text) if self.begins[c]]


class Normalizer:
    """Normalises as the model says, and knows the source of each byte of the result."""

    def __init__(self, model: bytes) -> None:
        spec, trainer = b"", b""
        for number, value in _fields(model):
            spec, trainer = (value if number == 3 else spec), (value if number == 2 else trainer)
        given = dict(_fields(spec))
        compiled = given.get(2, b"")
        self.map = CharacterMap(compiled) if compiled else None
        self.prefix, self.squeeze, self.escape = (bool(given.get(n, 1)) for n in (3, 4, 5))
        if dict(_fields(trainer)).get(24, 0):
            raise ValueError("models that write white space as a suffix aren't supported")

    def _replaced(self, text: str, data: bytes) -> tuple[bytes, np.ndarray]:
        """The text after the map, and the first source byte of each of its bytes.

        A character that no key covers keeps its bytes one by one; all bytes of a replacement come from its key's first.
        """
        firsts = self.map.starts(text) if self.map else []
        if not firsts:
            return data, np.arange(len(data), dtype=np.int32)
        parts, sources, done = [], [], 0
        for m in re.compile(b"|".join(re.escape(c.encode()) for c in firsts)).finditer(data):
            if m.start() < done:
                continue  # inside the key before
            if key := self.map.longest(data, m.start()):
                parts += [data[done : m.start()], key[1]]
                sources += [np.arange(done, m.start(), dtype=np.int32), np.full(len(key[1]), m.start(), np.int32)]
                done = m.start() + key[0]
        return b"".join([*parts, data[done:]]), np.concatenate([*sources, np.arange(done, len(data), dtype=np.int32)])

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """(bytes, source): ``source`` has the source byte of each byte and, last, the source's length.

        The blank that the model puts first has no source: it begins and ends at the first byte of what follows.
        """
        data = text.encode()
        out, source = self._replaced(text, data)
        flat = np.frombuffer(out, np.uint8)
        if self.squeeze:
            blank = flat == 32
            inner = np.flatnonzero(~blank)
            if not len(inner):
                return b"", np.array([len(data)], np.int32)
            keep = ~(blank & np.concatenate(([True], blank[:-1])))
            keep[inner[-1] + 1 :] = False
            flat, source = flat[keep], source[keep]
        if not len(flat):
            return b"", np.array([len(data)], np.int32)
        if self.escape:
            blank = flat == 32
            wide = np.where(blank, 3, 1)
            at = np.repeat(np.where(blank, 0, flat), wide).astype(np.uint8)
            begins = np.flatnonzero(np.repeat(blank, wide))
            at[begins] = np.tile(np.frombuffer(SPACE.encode(), np.uint8), len(begins) // 3)
            flat, source = at, np.repeat(source, wide)
        if self.prefix:
            first = SPACE.encode() if self.escape else b" "
            flat = np.concatenate((np.frombuffer(first, np.uint8), flat))
            source = np.concatenate((np.full(len(first), source[0], np.int32), source))
        if self.squeeze and self.escape:  # the library also drops written marks of blanks at the end
            mark = SPACE.encode()
            trimmed = flat.tobytes()
            while trimmed.endswith(mark):
                trimmed = trimmed[: -len(mark)]
            flat, source = flat[: len(trimmed)], source[: len(trimmed)]
        return flat.tobytes(), np.append(source, np.int32(len(data)))


class PieceCodec:
    """Encodes to ids and source spans, and decodes; each distinct word goes to the library once.

    A text is cut at each blank that follows another character than a blank and isn't
    its last: the blank is what the library puts before the next word. That is exact as no piece has a
    blank behind another character, which is tested once; otherwise, or if the map
    changes blanks, texts go to the library as a whole. So a text of any length is encoded in bounded memory.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as file:
            model = file.read()
        self.library, self.normalizer = SentencePieceProcessor(model_proto=model), Normalizer(model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        single = [self.library.is_byte(i) for i in range(len(pieces))]
        self.size = np.array([1 if one else len(x.encode()) for one, x in zip(single, pieces, strict=True)], np.int32)
        self.known: dict[str, bytes] = {}
        self.separable = self._separable(pieces)

    def _separable(self, pieces: list[str]) -> bool:
        n = self.normalizer
        return n.prefix and n.escape and not n.squeeze and n.map is None and not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def cut(self, text: str) -> list[str]:
        """The words of a text, to be encoded one by one."""
        if not self.separable:
            return [text]
        if "  " not in text and SPACE not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ")
        return _CUTS.split(text)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(ids, begins, ends, bytes of the text) of each text; spans are in bytes of the text's UTF-8.

        Words that aren't held yet are encoded together; a full cache starts anew.
        """
        if len(self.known) > CACHED:
            self.known = {}
        cuts = [self.cut(text) for text in texts]
        fresh = list(set().union(*cuts) - self.known.keys())
        made = {w: array("i", ids).tobytes() for w, ids in zip(fresh, self.library.encode(fresh, num_threads=1), strict=True)}
        known = self.known
        known.update(made)
        for text, words in zip(texts, cuts, strict=True):
            ids = np.frombuffer(b"".join(map(known.__getitem__, words)), ID)
            out, source = self.normalizer.normalize(text)
            bounds = np.zeros(len(ids) + 1, np.int32)
            np.cumsum(self.size[ids], out=bounds[1:])
            if bounds[-1] != len(out):
                np.cumsum(self._unknown_sizes(text), out=bounds[1:])
            if bounds[-1] != len(out):
                raise ValueError("the pieces don't make up the normalised text")
            places = source[bounds]
            yield ids, places[:-1], places[1:], int(source[-1])
        for w in made:
            if len(w) > LONGEST:
                del known[w]

    def _unknown_sizes(self, text: str) -> np.ndarray:
        """An unknown piece is as long as what it stands for; vocabularies with a byte fallback have none."""
        return np.array([len(p.piece.encode()) for p in self.library.encode(text, out_type="immutable_proto").pieces], np.int32)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec a Python worker; ``path`` is a local file of each executor."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).astype(np.int32)))


def encode_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, begins, ends, n_bytes) of each row: its piece ids and the bytes of the text that each one covers.

    Piece i covers bytes begins[i] to ends[i] (exclusive) of the text's UTF-8. Spans
    follow each other without a gap where the model keeps all white space. A piece of
    the blank that the model puts first covers nothing; one inside a replacement
    covers nothing or the whole key, as its last part ends where the key does. A null
    text counts as empty and gives empty lists; repeated rows and null ids stay as they
    are; texts of any length are encoded whole, word by word. Other
    columns are dropped.
    """
    require(docs, doc_id, text)
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "ids", "begins", "ends", "n_bytes"]
        for batch in small_batches(batches, "text"):
            if batch.num_rows:
                ids, begins, ends, sizes = zip(*codec(path).encode(batch.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids), _lists(begins), _lists(ends), pa.array(sizes, pa.int64())], names)

    return chosen.mapInArrow(run, ENCODED.format(doc_id=chosen.schema["doc_id"].dataType.simpleString()))


def decode_pieces(encoded: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the text of each list of ids, by the library; null and empty lists give an empty text.

    Invalid byte sequences become U+FFFD, as the library has it. A column named ``to`` is replaced.
    """
    require(encoded, ids)
    rest = encoded.drop(to)
    names = rest.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, ids):
            lists = batch.column(ids)
            texts = [codec(path).decode([] if x.values is None else x.values.to_numpy().tolist()) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, to])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(to, T.StringType())]))


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes) of each row of ``docs``, from the encoded and decoded rows."""
    found = decode_pieces(encode_pieces(docs, path), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_bytes")
