"""Hard negatives by exact windowed searches over Hilbert-ordered blocks with zone maps.

Vectors lie in Parquet in the order of a Hilbert curve, some hundred to a block. Each
block has, for every dimension, the least and the largest value. From these interval
arithmetic bounds the score of any vector of the block with a query, and a query reads
only the blocks whose bounds meet its window of scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm.common import Scratch, require

BLOCK_ROWS = 256
CURVE_DIMS, CURVE_BITS = 12, 4  # the dimensions of most variance, and the cells of each
PACK = 1024  # rows along the curve whose queries are compared with a block at once
ZONES = 2048  # blocks and packs compared, after which a task passes on what it has found
PART_ROWS = 16_384  # rows that one task puts into blocks
EXACT = 2.0**53  # integers below are exact as doubles
INDEX = "block long, n int, ids array<long>, labels array<int>, vectors array<double>, low array<double>, high array<double>"
FOUND = "rid long, slot int, score long, vec_id long"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of ``cells`` (n x dims, integers of ``bits`` bits), as an unsigned integer.

    Turns axes into the curve's transposed form by undoing excess work from the highest bit down, then Gray-encodes.
    """
    x = cells.T.astype(np.int64).copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    place = np.zeros(cells.shape[0], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << np.uint64(1)) | ((x[i] >> b) & 1).astype(np.uint64)
    return place


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _lists(values: np.ndarray, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(values))


def participants(vectors: DataFrame, scale: float, vec_id: str, label: str, vector: str) -> DataFrame:
    """(vec_id, label, v): the rows that take part, each component floor(scale * x) as a double.

    Rows with a null id, label, vector or any null or non-finite component don't; an id
    that stands on several rows counts once (by the least label, then vector); vectors
    of another length than the commonest (ties: the longest) don't take part either,
    as no product with them is defined.
    """
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    whole = F.forall("v", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), x.alias("v")).dropna().where(whole)
    once = rows.withColumn("__nth", F.row_number().over(W.partitionBy("vec_id").orderBy("label", "v"))).where("__nth = 1")
    # floor() of a double is a long in Spark, so large values are left to the nearest double below by hand.
    scaled = F.transform("v", lambda v: F.when(F.abs(v * scale) < EXACT, F.floor(v * scale).cast("double")).otherwise(v * scale))
    return once.select("vec_id", "label", scaled.alias("v"))


class BlockIndex:
    """All rows in blocks along the curve, as a written table, with the number of dimensions."""

    def __init__(self, blocks: DataFrame, dims: int, scratch: Scratch) -> None:
        self.blocks, self.dims, self.scratch = blocks, dims, scratch

    @classmethod
    def build(cls, rows: DataFrame, block_rows: int = BLOCK_ROWS) -> BlockIndex:
        """Indexes every row (vec_id, label, v). The curve takes the dimensions of most variance, each cut into cells around its mean."""
        scratch = Scratch(rows.sparkSession, "vectors")
        kept = scratch.keep(rows)
        lengths = kept.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
        dims, total = (lengths["dims"], lengths["count"]) if lengths else (0, 0)
        kept_rows = kept.where(F.size("v") == dims)
        spread = kept_rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_pop("x"), F.lit(0.0)).alias("sd"))
        curve = [(r["i"], r["mean"], r["sd"] if np.isfinite(r["sd"]) else 0.0) for r in spread.orderBy(F.desc("sd"), "i").limit(CURVE_DIMS).collect()]
        cells = 1 << CURVE_BITS

        def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch.column("v"), dims) if batch.num_rows and dims else np.zeros((batch.num_rows, 0))
                at = [np.clip(((v[:, i] - mean) / (sd or 1.0) / 4 + 0.5) * cells, 0, cells - 1) for i, mean, sd in curve]
                place = hilbert(np.stack(at, 1).astype(np.int64), CURVE_BITS) if at else np.zeros(batch.num_rows, np.uint64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int64))], ["vec_id", "label", "v", "place"])

        def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            block, held, n = TaskContext.get().partitionId() << 32, [], 0

            def out(table: pa.Table) -> pa.RecordBatch:
                nonlocal block
                batch = table.combine_chunks().to_batches()[0]
                v = _matrix(batch.column("v"), dims) if dims else np.zeros((batch.num_rows, 0))
                one = [batch.num_rows]
                columns = [pa.array([block], pa.int64()), pa.array(one, pa.int32()), _lists(batch.column("vec_id").to_numpy(), one), _lists(batch.column("label").to_numpy(), one), _lists(v.ravel(), [v.size]), _lists(v.min(0), [dims]), _lists(v.max(0), [dims])]
                block += 1
                return pa.RecordBatch.from_arrays(columns, ["block", "n", "ids", "labels", "vectors", "low", "high"])

            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= block_rows:
                    table = pa.Table.from_batches(held)
                    while n >= block_rows:
                        yield out(table.slice(0, block_rows))
                        table, n = table.slice(block_rows), n - block_rows
                    held = table.to_batches()
            if n:
                yield out(pa.Table.from_batches(held))

        along = kept_rows.mapInArrow(placed, "vec_id long, label int, v array<double>, place long")
        ordered = along.repartitionByRange(max(1, -(-total // PART_ROWS)), "place", "vec_id").sortWithinPartitions("place", "vec_id")
        blocks = scratch.keep(ordered.mapInArrow(packed, INDEX))
        scratch.drop(kept)
        return cls(blocks, dims, scratch)

    def rows(self, every: int) -> DataFrame:
        """(rid, label, v, block) of the rows whose id is divisible by ``every``."""
        dims = self.dims

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, labels = batch.column("ids")[i].values.to_numpy(), batch.column("labels")[i].values.to_numpy()
                    v = batch.column("vectors")[i].values.to_numpy().reshape(len(ids), dims)
                    chosen = np.flatnonzero(ids % every == 0)
                    one = np.full(len(chosen), batch.column("block")[i].as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[chosen]), pa.array(labels[chosen]), _lists(v[chosen].ravel(), [dims] * len(chosen)), pa.array(one, pa.int64())], ["rid", "label", "v", "block"])

        return self.blocks.mapInArrow(run, "rid long, label int, v array<double>, block long")

    def search(self, queries: DataFrame, most: int, same: bool) -> DataFrame:
        """(rid, slot, score, vec_id): for each query the first ``most`` rows of its label (or of others) whose score is in its window.

        ``queries`` has (rid, slot, label, v, block, low, high): (rid, slot) names a query, rid also the row that it
        doesn't find, ``block`` where that row lies, [low, high] the window. Higher scores come first, then smaller ids.

        1. Each query reads its own block; the last of its first ``most`` rows there is a bound for all others.
        2. Each pack of rows with their queries meets each block in a product that moves nothing through a shuffle or the
           driver. Zone maps come first: a block is read for a query only if its scores can lie in the window and beat the
           bound (at equal scores by its least id).
        3. Bounds rise with what a task finds. It passes on the first rows of each query, and those of all tasks are merged.

        The result is exact. A row of the product holds a block and a pack, which has each vector once however many queries
        it is of. Nothing is broadcast: Spark would size packed rows by their compressed files and hold them whole in the driver.
        """
        dims, block = self.dims, ["ids", "labels", "vectors", "low", "high"]

        def packed(asked: DataFrame, *key: str) -> DataFrame:
            each = asked.groupBy("rid", *key).agg(F.first("label").alias("label"), F.first("v").alias("v"), F.collect_list(F.struct("slot", "low", "high", "least_score", "least_id")).alias("asks"))
            return each.groupBy(*key).agg(F.collect_list(F.struct("rid", "label", "v", "asks")).alias("queries"))

        fresh = self.scratch.keep(queries.withColumns({"least_score": F.col("low"), "least_id": F.lit(2**63 - 1)}))
        own = packed(fresh, "block").hint("merge").join(self.blocks.select("block", *block), "block")
        seeds = own.select("queries", *block, F.col("block").alias("pack")).mapInArrow(lambda batches: _read(batches, dims, most, same), FOUND)
        bound = seeds.groupBy("rid", "slot").agg(F.count(F.lit(1)).alias("__n"), F.max(F.struct((-F.col("score")).alias("score"), "vec_id")).alias("__last"))
        known = F.col("__n") >= most
        part = F.shiftright("block", 32)
        nth = F.dense_rank().over(W.partitionBy(part).orderBy("block", "rid")) - 1
        bounded = (
            fresh.drop("least_score", "least_id")
            .join(bound.hint("merge"), ["rid", "slot"], "left")
            .withColumns({"least_score": F.when(known, -F.col("__last.score")).otherwise(F.col("low")), "least_id": F.when(known, F.col("__last.vec_id")).otherwise(F.lit(2**63 - 1)), "pack": F.shiftleft(part, 32) + F.floor(nth / PACK)})
            .drop("__n", "__last")
        )
        packs = self.scratch.keep(packed(bounded, "pack"))
        tiles = self.blocks.select(*block).crossJoin(packs.hint("shuffle_replicate_nl"))
        found = tiles.select("queries", *block, "pack").mapInArrow(lambda batches: _read(batches, dims, most, same), FOUND)
        rank = F.row_number().over(W.partitionBy("rid", "slot").orderBy(F.desc("score"), "vec_id"))
        result = self.scratch.keep(found.withColumn("rank", rank).where(F.col("rank") <= most))
        self.scratch.drop(fresh, packs)
        return result


def _queries(column: pa.Array, i: int, dims: int) -> dict[str, np.ndarray]:
    """The queries of one row; ``of`` is the row of ``v`` that each is of."""
    values, names = column[i].values, ("slot", "low", "high", "least_score", "least_id")
    plain = lambda x: x.to_numpy(zero_copy_only=False)
    v, of, asks = _matrix(values.field("v"), dims) if dims else np.zeros((len(values), 0)), np.arange(len(values)), values
    if values.type.get_field_index("asks") >= 0:  # several of a vector
        lists = values.field("asks")
        of, asks = np.repeat(of, plain(lists.value_lengths())), lists.flatten()
    return {n: plain(asks.field(n)) for n in names} | {"v": v, "of": of, "rid": plain(values.field("rid"))[of], "label": plain(values.field("label"))[of]}


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; those beyond doubles' exact integers by Python's integers, clipped to longs."""
    reach = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if reach < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -(2**63), 2**63 - 1).astype(np.int64)


def _read(batches: Iterable[pa.RecordBatch], dims: int, most: int, same: bool) -> Iterator[pa.RecordBatch]:
    """The first ``most`` rows for each query, of all the blocks that one task reads for it."""
    best: dict[int, np.ndarray] = {}  # by pack
    reached: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # the bounds of its queries so far

    def out() -> Iterator[pa.RecordBatch]:
        for rows in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1].astype(np.int32)), pa.array(rows[2]), pa.array(rows[3])], ["rid", "slot", "score", "vec_id"])
        best.clear()

    compared = 0
    for batch in batches:
        for i in range(batch.num_rows):
            pack, q = batch.column("pack")[i].as_py(), _queries(batch.column("queries"), i, dims)
            q["least_score"], q["least_id"] = reached.get(pack, (q["least_score"], q["least_id"]))
            ids, labels, vectors, low, high = (batch.column(n)[i].values.to_numpy() for n in ("ids", "labels", "vectors", "low", "high"))
            asked = np.flatnonzero(_fits(q, low[None, :], high[None, :], ids.min(keepdims=True), [set(labels.tolist())], same)[:, 0])
            if not len(asked):
                continue
            of, at = np.unique(q["of"][asked], return_inverse=True)
            score = scores(q["v"][of], vectors.reshape(len(ids), dims))
            # Few rows reach the least bound of a vector's queries; those are held against each of them.
            least = np.full(len(of), 2**63 - 1)
            np.minimum.at(least, at, q["least_score"][asked])
            row, column = np.nonzero(score >= least[:, None])
            n_asked = np.bincount(at, minlength=len(of))
            n = n_asked[row]
            ask = asked[np.repeat((np.cumsum(n_asked) - n_asked)[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            score, column = np.repeat(score[row, column], n), np.repeat(column, n)
            fits = ((labels[column] == q["label"][ask]) == same) & (ids[column] != q["rid"][ask]) & (score >= q["low"][ask]) & (score <= q["high"][ask])
            fits &= (score > q["least_score"][ask]) | ((score == q["least_score"][ask]) & (ids[column] <= q["least_id"][ask]))
            if fits.any():
                ask, score, column = ask[fits], score[fits], column[fits]
                rows = np.stack((q["rid"][ask], q["slot"][ask].astype(np.int64), score, ids[column], ask))
                best[pack] = rows = _firsts(np.concatenate([best[pack], rows] if pack in best else [rows], 1), most)
                last = np.flatnonzero(np.append((rows[4, 1:] != rows[4, :-1]), True))
                full = last[np.diff(last, prepend=-1) >= most]
                reached[pack] = q["least_score"].copy(), q["least_id"].copy()
                reached[pack][0][rows[4, full]], reached[pack][1][rows[4, full]] = rows[2, full], rows[3, full]
        compared += batch.num_rows
        if compared >= ZONES:
            compared = 0
            yield from out()
    yield from out()


def _firsts(rows: np.ndarray, most: int) -> np.ndarray:
    """Of (rid, slot, score, id) columns the first ``most`` of each (rid, slot): by the higher score, then the smaller id."""
    rows = rows[:, np.lexsort((rows[3], ~rows[2], rows[1], rows[0]))]  # ~x turns the order of longs round without overflow
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
    begins = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)
    return rows[:, np.arange(len(new)) - begins < most]


def _fits(q: dict[str, np.ndarray], low: np.ndarray, high: np.ndarray, ids: np.ndarray, held: list[set[int]], same: bool) -> np.ndarray:
    """Which blocks (a row of ``low`` and ``high``, the least id and the labels of each) a query must read: queries x blocks."""
    up, down = np.maximum(q["v"], 0), np.minimum(q["v"], 0)
    # The largest and least of v * x for x in [low, high], summed over the dimensions.
    most, least = up @ high.T + down @ low.T, up @ low.T + down @ high.T
    slack = np.abs(q["v"]).max(initial=0) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * low.shape[1]
    if slack >= EXACT:  # bounds are rounded there
        most, least = most + slack * 1e-12, least - slack * 1e-12
    most, least = most[q["of"]], least[q["of"]]
    beat = (most > q["least_score"][:, None]) | ((most == q["least_score"][:, None]) & (ids[None, :] <= q["least_id"][:, None]))
    fits = beat & (most >= q["low"][:, None]) & (least <= q["high"][:, None])
    names, at = np.unique(q["label"], return_inverse=True)
    has = np.array([[(x in h) if same else bool(h - {x}) for h in held] for x in names.tolist()], bool).reshape(len(names), len(held))
    return fits & has[at]


def _needed(batches: Iterable[pa.RecordBatch], dims: int, same: bool) -> Iterator[pa.RecordBatch]:
    """(chunk, block, chosen): the blocks that a chunk of queries must read, and which of its queries each is for."""
    for batch in batches:
        for i in range(batch.num_rows):
            q, zones = _queries(batch.column("queries"), i, dims), batch.column("zones")[i].values
            low, high = (_matrix(zones.field(n), dims) if dims else np.zeros((len(zones), 0)) for n in ("low", "high"))
            fits = _fits(q, low, high, zones.field("least").to_numpy(), [set(x.as_py()) for x in zones.field("labels")], same)
            blocks, columns = zones.field("block").to_numpy(), np.flatnonzero(fits.any(0))
            if len(columns):
                chosen = [np.flatnonzero(fits[:, k]).astype(np.int32) for k in columns]
                n = len(columns)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column("chunk")[i].as_py()), pa.int64()), pa.array(blocks[columns]), _lists(np.concatenate(chosen), [len(c) for c in chosen])], ["chunk", "block", "chosen"])


def hard_negatives(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, scale: float = 256.0, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor: a row whose id is divisible by ``every``.

    A score is the integer inner product of two rows whose components are
    floor(``scale`` * x). An anchor's positives are its first ``positives`` other rows
    of its label; each takes the first ``negatives`` rows of other labels whose score is between 50 % and 95 % of
    its own. Higher scores come first, ties by the smaller id. Which rows take part says :func:`participants`. An
    anchor without positives, or a positive without such rows, gives no row; so does an empty table. Scores beyond a
    long are clipped to it. Other columns are ignored, whatever their names. A vector that very many rows share is no
    hot key: blocks are cut by place and id, and at equal scores a block is read only if its least id can still win.
    """
    require(vectors, vec_id, label, vector)
    index = BlockIndex.build(participants(vectors, scale, vec_id, label, vector), block_rows)
    anchors = index.scratch.keep(index.rows(every))
    whole = {"slot": F.lit(0), "low": F.lit(-(2**63)), "high": F.lit(2**63 - 1)}
    near = index.search(anchors.withColumns(whole), positives, same=True).where("score >= 0")
    # 50 * p <= 100 * n <= 95 * p in whole numbers; a negative p has no such n.
    window = near.select("rid", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.expr("score div 2 + score % 2").alias("low"), F.expr("score - (score div 20 + if(score % 20 > 0, 1, 0))").alias("high"))
    asked = anchors.hint("merge").join(window, "rid").where("low <= high")
    away = index.search(asked.drop("positive_id", "positive_score"), negatives, same=False)
    out = away.hint("merge").join(window.select("rid", "slot", "positive_id", "positive_score"), ["rid", "slot"])
    return out.select(F.col("rid").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
