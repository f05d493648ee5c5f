"""Bounded-space online packing of token ids into fixed-length sequences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import require, shared_path, text_or_empty
from lumenfold.llm.tokens import ID, encoder, small_batches

#: ids: the piece's ids as little-endian unsigned 32-bit integers. open: its window wasn't full when the pass ended.
PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, open boolean, part long, ids binary"
_FIELDS = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "open", "part", "ids")
_ARROW = pa.schema([(n, {"open": pa.bool_(), "ids": pa.binary()}.get(n, pa.int64())) for n in _FIELDS])
FAN = 16  # parts whose leftovers one merging task takes


@dataclass
class _Window:
    pieces: list[tuple[int | None, int, int, bytes]] = field(default_factory=list)  # doc_id, start, doc_tokens, ids
    used: int = 0


class OpenWindows:
    """A fixed number of open windows; pieces that are dealt out close them one by one."""

    def __init__(self, first_id: int, part: int, most_open: int, length: int, least_piece: int) -> None:
        self.next_id, self.part, self.most_open, self.length, self.least = first_id, part, most_open, length, least_piece
        self.open: list[_Window] = []
        self.rows: list[tuple] = []

    def _close(self, window: _Window, still_open: bool = False) -> None:
        offset = 0
        for doc_id, start, total, ids in window.pieces:
            n = len(ids) // ID.itemsize
            self.rows.append((doc_id, start, n, total, self.next_id, offset, still_open, self.part, ids))
            offset += n
        self.next_id += 1

    def _put(self, window: _Window, piece: tuple[int | None, int, int, bytes]) -> None:
        window.pieces.append(piece)
        window.used += len(piece[3]) // ID.itemsize
        if window.used == self.length:
            self.open.remove(window)
            self._close(window)

    def add(self, doc_id: int | None, start: int, total: int, ids: bytes) -> None:
        """Places ids of a document from ``start`` on; ``total`` counts all its ids."""
        full = self.length * ID.itemsize
        while len(ids) >= full:
            self._close(_Window([(doc_id, start, total, ids[:full])]))
            start, ids = start + self.length, ids[full:]
        while ids:
            n = len(ids) // ID.itemsize
            fitting = [w for w in self.open if self.length - w.used >= n]
            if fitting:
                self._put(max(fitting, key=lambda w: w.used), (doc_id, start, total, ids))
                return
            if len(self.open) < self.most_open:
                self.open.append(_Window())
                continue
            # Nothing fits: the fullest goes, filled up with the document's head unless its gap is tiny.
            fullest = max(self.open, key=lambda w: w.used)
            gap = self.length - fullest.used
            if gap < self.least:
                self.open.remove(fullest)
                self._close(fullest)
            else:
                self._put(fullest, (doc_id, start, total, ids[: gap * ID.itemsize]))
                start, ids = start + gap, ids[gap * ID.itemsize :]

    def leave(self) -> None:
        """Hands over the windows that are still open."""
        for window in self.open:
            self._close(window, still_open=True)
        self.open = []

    def last(self) -> None:
        """Cuts the windows that are still open at powers of two, which need no padding."""
        for window in self.open:
            rest, pieces, size = window.used, list(window.pieces), self.length
            while rest:
                while size > rest:
                    size //= 2
                cut, room = _Window(), size
                while room:
                    doc_id, start, total, ids = pieces.pop(0)
                    n = min(room, len(ids) // ID.itemsize)
                    cut.pieces.append((doc_id, start, total, ids[: n * ID.itemsize]))
                    if tail := ids[n * ID.itemsize :]:
                        pieces.insert(0, (doc_id, start + n, total, tail))
                    room -= n
                self._close(cut)
                rest -= size
        self.open = []

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    length: int = 4096,
    most_open: int = 32,
    least_piece: int = 16,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Sequences of at most ``length`` ids (a power of two): one row a piece, see PIECE_SCHEMA.

    Each input partition is packed as it is read, without a shuffle: whole windows
    are cut off long documents; what is left goes to the open window it fits best;
    where none fits, the fullest is emitted, filled up with the document's head
    (gaps of under ``least_piece`` are padded instead). The ``most_open`` windows that
    a partition leaves are merged in rounds of 16 partitions a task, so a task
    never holds more than 16 x ``most_open`` windows; the very last window is cut at
    powers of two. Pieces are written to the shared folder after each round; a rerun
    task packs its partition alike.

    Null texts count as empty and hold the end id alone. Repeated rows are packed
    one by one. An empty table gives an empty table. Other columns aren't read.
    """
    require(docs, doc_id, text)
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "packed")
    end = end_id.to_bytes(ID.itemsize, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        windows = OpenWindows(part << 32, part, most_open, length, least_piece)
        for batch in small_batches(batches, "text"):
            texts = batch.column("text").to_pylist()
            for name, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                windows.add(name, 0, len(ids) // ID.itemsize + 1, ids + end)
            yield windows.batch()
        windows.leave()
        yield windows.batch()

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    source.mapInArrow(first, PIECE_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/round=0")
    rounds = [spark.read.schema(PIECE_SCHEMA).parquet(f"{path}/round=0")]
    while True:
        left = rounds[-1].where("open")
        last_part = left.agg(F.max("part")).first()[0]
        if last_part is None:
            break
        rounds.append(_merge(left, f"{path}/round={len(rounds)}", len(rounds), last_part < FAN, length, most_open, least_piece))
    done = rounds[0].where("not open")
    for r in rounds[1:]:
        done = done.union(r.where("not open"))
    return done.drop("open", "part")


def _merge(left: DataFrame, path: str, nth: int, final: bool, length: int, most_open: int, least_piece: int) -> DataFrame:
    """Packs the leftovers of FAN parts into one part; the final round leaves nothing."""

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        windows = OpenWindows((nth << 56) | (part << 32), part, 1, length, 1)
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        for row in table.select(["doc_id", "start", "doc_tokens", "ids"]).to_pylist():
            windows.add(row["doc_id"], row["start"], row["doc_tokens"], row["ids"])
        windows.last() if final else windows.leave()
        return pa.Table.from_batches([windows.batch()])

    grouped = left.withColumn("to_part", F.expr(f"part div {FAN}")).groupBy("to_part")
    grouped.applyInArrow(merge, PIECE_SCHEMA).write.option("compression", "zstd").parquet(path)
    return left.sparkSession.read.schema(PIECE_SCHEMA).parquet(path)
