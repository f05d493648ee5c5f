"""Token ids: exact encoding with a cache of pieces, and the token file format."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from os.path import commonprefix
from struct import Struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm.common import require, shared_path, text_or_empty

ID = np.dtype("<u4")
CACHED = 400_000  # pieces (about 200 bytes each) in a generation of a worker's main cache
LONGEST = 48  # characters of a piece that is worth holding
#: White space but blanks and line feeds. U+180E counts as white space in older Unicode tables.
_ODD = re.compile(r"[^\S \n]")
_ODD_PAIRS = ("  ", "\n\n", " \n", "\n ", "᠎")
_ODD_ASCII = (*_ODD_PAIRS[:4], *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
_SAFE = re.compile(r"(?<=[^\s᠎]) (?=[^\s᠎])")
#: Letters, which both vocabularies keep as one word in any Unicode version, and then
#: ASCII marks, which they keep as another; an apostrophe may begin a word of its own.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_PACKED = [Struct(f"<{n}I").pack for n in range(4 * LONGEST)]  # a character gives four ids at most


def _byte_alphabet() -> dict[int, int]:
    """Byte-level vocabularies write printable bytes as themselves, others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


_ALPHABET = _byte_alphabet()


class _Pieces(dict[str, bytes]):
    """The ids of the pieces seen of late; long ones aren't held.

    A full generation becomes the old one, and what is used of it moves on to the
    next, so frequent pieces stay and at most two generations are held.
    """

    def __init__(self, word: Callable[[str], bytes], whole: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.most, self.word, self.whole, self.old, self.marks = most, word, whole, dict[str, bytes](), dict[str, bytes]()

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is not None:
            self[piece] = ids
            return ids
        if len(piece) > LONGEST:
            return self.whole(piece)
        found = _PLAIN.fullmatch(piece)
        if found is None:
            ids = self[piece] = self.whole(piece)
            return ids
        body, tail = found.groups()
        if not tail:
            ids = self[body] = self.word(body)
            return ids
        # A word's first sight with marks holds the word alone, a later one the whole piece.
        known = self.get(body) or self.old.get(body)
        if known is None:
            known = self[body] = self.word(body)
            return known + self.marks[tail]
        ids = self[piece] = known + self.marks[tail]
        return ids

    def age(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class _Marks(dict[str, bytes]):
    """The ids of runs of marks that follow words."""

    def __init__(self, whole: Callable[[str], bytes]) -> None:
        super().__init__()
        self.whole = whole

    def __missing__(self, run: str) -> bytes:
        ids = self[run] = self.whole(run)
        return ids


class PieceEncoder:
    """Encodes texts like the tokenizer itself, but each distinct piece once.

    Both supported vocabularies cut a text into words before any merge, and no word
    reaches over the cuts made here, so joined pieces equal the whole encoding:

    - byte level: a blank between two other characters belongs to the following
      word; a line feed between two other characters is a word of its own. Texts
      with other white space are cut only at blanks between two other characters.
    - words: white space is dropped, so blanks and line feeds are cuts.

    Strings of special tokens inside a text are encoded as the library does by default.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.byte_level = isinstance(self.tokenizer.pre_tokenizer, ByteLevel)
        #: What all strings of special tokens begin with: a text that has it is left to the library as a whole.
        self.special = commonprefix([t.content for t in self.tokenizer.get_added_tokens_decoder().values()])
        self.merge = self.tokenizer.model.tokenize
        # At byte level only the first word of a line has no blank before it.
        self.bare = _Pieces(self._word, self._whole, CACHED // 8 if self.byte_level else CACHED)
        self.led = _Pieces(lambda w: self._word(w, "Ġ"), lambda p: self._whole(" " + p), CACHED)
        # Marks after a word never follow a blank, so both caches share them.
        self.bare.marks = self.led.marks = _Marks(self._whole)
        self.feed = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=ID).tobytes()

    def _word(self, word: str, mark: str = "") -> bytes:
        """A word of letters goes to the vocabulary's merges at once."""
        if not self.byte_level:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_ALPHABET)
        ids = [t.id for t in self.merge(mark + word)]
        return _PACKED[len(ids)](*ids)

    def _odd(self, text: str) -> bool:
        if text.isascii():
            return any(x in text for x in _ODD_ASCII)
        return any(x in text for x in _ODD_PAIRS) or _ODD.search(text) is not None

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for known in (self.bare, self.led):
            known.age()
        if len(self.led.marks) > CACHED:
            self.led.marks.clear()
        bare, led, out = self.bare.__getitem__, self.led.__getitem__, []
        for text in texts:
            if self.special and self.special in text:
                out.append(self._whole(text))
                continue
            if not self.byte_level:
                out.append(b"".join(map(bare, text.replace("\n", " ").split(" "))))
                continue
            lines = [_SAFE.split(text)] if self._odd(text) else [x.split(" ") for x in text.split("\n")]
            out.append(self.feed.join([bare(p[0]) + b"".join(map(led, p[1:])) for p in lines]))
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder a Python worker; ``path`` is a local file of each executor."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def small_batches(batches: Iterable[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that their texts hold about ``most`` bytes at once."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(1, batch.column(column).nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


TOKEN_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the token file format below ``path``; see :func:`read_tokens`.

    ``path/tokens`` is Parquet: doc_id, part (file order), part_start (ids before the
    document in its part), n_tokens (with the end id), tokens (list of int). Rows
    ascend by doc_id within and over the parts. The list is dictionary-encoded, the
    counters are delta-encoded (version 2 pages), row groups hold 32 MB and pages
    256 KB, and Parquet's page indexes let a range of doc_id or the metadata alone
    be read without the lists. ``path/parts`` holds part, docs, ids, start.

    Null texts count as empty: they hold the end id alone. Rows that repeat a
    doc_id are all written, one after another. Rows of a null doc_id come first.
    An empty table gives empty files. Rerun tasks write the same rows: a part's
    counters depend on its rows alone.
    """
    require(docs, doc_id, text)
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])
    end = np.array([end_id], dtype=ID).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, part, start = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        for batch in small_batches(batches, "text"):
            ids = encode_all(batch.column("text").to_pylist())
            counts = np.fromiter((len(x) // 4 + 1 for x in ids), dtype=np.int64, count=len(ids))
            ends = np.cumsum(counts)
            flat = np.frombuffer(end.join(ids) + end, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(start + ends - counts), pa.array(counts), lists], schema=schema)
            start += int(ends[-1]) if len(ends) else 0

    ordered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    spark = docs.sparkSession
    ordered.mapInArrow(encode, TOKEN_SCHEMA).write.options(
        **{"compression": "snappy", "parquet.writer.version": "v2", "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.enable.dictionary": "false", "parquet.enable.dictionary#tokens.list.element": "true"}
    ).parquet(f"{path}/tokens")
    parts = spark.read.schema(TOKEN_SCHEMA).parquet(f"{path}/tokens").groupBy("part").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("ids"))
    # One row a written file, so this window stays small.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts.select("part", "docs", "ids", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start")).coalesce(1).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "tokens")) -> DataFrame:
    """Rows of the token files; start counts the ids of all documents before.

    Columns that aren't asked for aren't read: metadata reads leave the lists alone.
    """
    rows = spark.read.schema(TOKEN_SCHEMA).parquet(f"{path}/tokens")
    if "start" in columns:
        # The manifest has one row a file and is broadcast.
        parts = spark.read.schema("part int, docs long, ids long, start long").parquet(f"{path}/parts").select("part", "start")
        rows = rows.join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("part_start"))
    return rows.select(*columns)


def with_crc32(rows: DataFrame, lists: str = "tokens") -> DataFrame:
    """Replaces the id list by ids_crc32 over little-endian unsigned 32-bit ids."""
    kept = [c for c in rows.columns if c != lists]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(lists)
            offsets = ids.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype(ID, copy=False))).cast("B")
            sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sums, pa.int64())], names=[*kept, "ids_crc32"])

    return rows.mapInArrow(digest, ", ".join(f"{c} {types[c]}" for c in kept) + ", ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes ``docs`` as token files in the shared folder and reads them back."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path, end_id)
    return read_tokens(docs.sparkSession, path)
