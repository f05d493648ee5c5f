"""Single-link clusters of vectors: a complete search by pivots and angles, then connected components.

The angle between vectors is a metric, and a cosine of ``threshold`` or more is an
angle of ``reach`` = acos(threshold) or less. So each vector goes to its nearest pivot
(its home) and, as a guest, to every pivot that is no more than twice ``reach``
farther: any two alike vectors meet at the home of either. At a pivot they lie in bands
by their angle to it, and only bands within ``reach`` are compared, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.stages import Stages

DEFAULT_THRESHOLD = 0.80
PIVOT_ROWS = 5_000  # vectors a pivot stands for
MOST_PIVOTS = 1_024  # pivots (a vector each) that go to the workers
BANDS = 64  # of the angles to a pivot, from 0 to pi
BLOCK_ROWS = 8_192  # vectors of a block at most, about: a block is moved once a block that it is compared with
LEAST_BLOCKS = 16  # blocks that all vectors are cut into at least, if they have 512 vectors or more
SQUARE = 1_024  # vectors of each side of a tile compared at once
SLACK = 1e-6  # radians: bounds are wider by this than rounding can move them
PREVIEW = 5


class MissingVectors(RuntimeError):
    """At least one item has no vector in the space that is clustered."""


def checked_threshold(threshold: float) -> float:
    """A finite real number from 0 to 1; anything else is refused before any pair is scored."""
    if isinstance(threshold, bool) or not isinstance(threshold, int | float):
        raise ValueError(f"threshold must be a real number in [0, 1], got {threshold!r}")
    if not math.isfinite(threshold) or not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must be finite and in [0, 1], got {threshold!r}")
    return float(threshold)


def require_vectors(items: DataFrame, item_id: str = "item_id", vector: str = "vector") -> None:
    """Fails with a count and the first few ids if an item lacks its vector: a partial clustering would look like a whole one."""
    missing = items.where(F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (F.size(vector) == 0))
    if n := missing.count():
        first = [str(r[0]) for r in missing.select(item_id).orderBy(item_id).limit(PREVIEW).collect()]
        rest = f", ... (+{n - PREVIEW} more)" if n > PREVIEW else ""
        raise MissingVectors(f"{n} item(s) have no vector: {', '.join(first)}{rest}")


def _units(column: pa.Array, dims: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    norms = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, norms, out=np.zeros_like(v), where=norms > 0)


def _lists(values: np.ndarray, size: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, size), pa.int32()), pa.array(values.ravel()))


def _prunes(pivots: np.ndarray, reach: float) -> bool:
    """Whether a vector is a guest at half of the pivots or fewer, by the pivots themselves: each as if it weren't one.

    Otherwise all vectors would be copied to nearly all pivots, which are as many as the table is large, and nothing
    be left out: a single pivot compares no more than twice the pairs and copies none.
    """
    if len(pivots) < 3:
        return True
    angles = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    np.fill_diagonal(angles, np.inf)
    guests = (angles <= angles.min(1)[:, None] + 2 * reach + SLACK).sum(1).mean()
    return bool(2 * guests <= len(pivots) - 1)


def _placed(reps: DataFrame, pivots: np.ndarray, reach: float) -> DataFrame:
    """(part, home, band, id, n, v): each vector at its home, and as a guest wherever an alike one may be at home."""
    dims = pivots.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                v = _units(part.column("vector"), dims)
                angles = np.arccos(np.clip(v @ pivots.T, -1, 1))
                home = angles.argmin(1)
                rows, parts = np.nonzero(angles <= angles.min(1)[:, None] + 2 * reach + SLACK)
                if len(rows):
                    band = np.minimum((angles[rows, parts] / math.pi * BANDS).astype(np.int32), BANDS - 1)
                    taken = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(parts.astype(np.int32)), pa.array(home[rows] == parts), pa.array(band), taken.column("id"), taken.column("n"), _lists(v[rows], dims)], ["part", "home", "band", "id", "n", "v"]
                    )

    return reps.mapInArrow(run, "part int, home boolean, band int, id long, n long, v array<double>")


def _compared(tiles: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(id, links, root) of the vectors of a tile that are alike to some other of it.

    ``links`` counts rows alike to one at home, copies included; root is the least id that the tile's pairs connect: a
    star of each connected part stands for all its pairs.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = (_rows(batch.column(side)[i].values, dims) for side in ("a", "b"))
                for p, q in product(range(0, len(left[0]), SQUARE), range(0, len(right[0]), SQUARE)):
                    yield from square([x[p : p + SQUARE] for x in left], [x[q : q + SQUARE] for x in right])

    def square(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        (ids, _, a), (others, n, b) = left, right
        alike = (a @ b.T >= threshold) & (ids[:, None] != others[None, :])
        if not alike.any():
            return
        none = np.iinfo(np.int64).max
        root_a, root_b = np.where(alike.any(1), ids, none), np.where(alike.any(0), others, none)
        while True:
            new_a = np.minimum(root_a, np.where(alike, root_b[None, :], none).min(1))
            new_b = np.minimum(root_b, np.where(alike, new_a[:, None], none).min(0))
            if (new_a == root_a).all() and (new_b == root_b).all():
                break
            root_a, root_b = new_a, new_b
        links = alike @ n
        in_a, in_b = alike.any(1), alike.any(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((ids[in_a], others[in_b]))), pa.array(np.concatenate((links[in_a], np.zeros(in_b.sum(), np.int64)))), pa.array(np.concatenate((root_a[in_a], root_b[in_b])))], ["id", "links", "root"]
        )

    return tiles.mapInArrow(run, "id long, links long, root long")


def _rows(values: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = values.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return values.field("id").to_numpy(), values.field("n").to_numpy(), v


def component_roots(edges: DataFrame, stages: Stages) -> DataFrame:
    """(node, root): the least node that the edges (u, v) connect with each node of theirs.

    Each round a node takes the least root among its own and its neighbours', and then
    the root of that root, so long paths shrink by halves. Rounds are written tables.
    """
    both = stages.keep(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct())
    roots = stages.keep(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        least = roots.join(near, "node").select("node", F.col("root").alias("before"), F.least("root", "near").alias("root"))
        hop = roots.select(F.col("node").alias("root"), F.col("root").alias("onward"))
        moved = stages.keep(least.join(hop, "root", "left").select("node", F.least("root", F.coalesce("onward", "root")).alias("root"), "before"))
        stages.drop(roots)
        roots = moved.select("node", "root")
        roots.kept_at = moved.kept_at
        if moved.where("root <> before").isEmpty():
            stages.drop(both)
            return roots


def single_link(items: DataFrame, threshold: float = DEFAULT_THRESHOLD, item_id: str = "item_id", vector: str = "vector") -> DataFrame:
    """(item_id, cluster_id, n_links, size): clusters that pairs of a cosine of ``threshold`` or more connect.

    cluster_id is the least item_id (a long) of the cluster, n_links the number of other items
    alike to this one, size that of the cluster. Every pair at the threshold counts: the search is complete. An item
    without alike ones is a cluster of its own. Zero vectors have a cosine of 0 with all others; copies of a vector are
    always alike, but for zero vectors at a threshold above 0.

    Items without a vector are refused (:func:`require_vectors`), and so are thresholds
    outside of [0, 1], vectors of different lengths and repeated ids. An empty table gives an empty table. Copies are
    compared once, so a vector that very many items share costs one row; a crowded
    pivot is split into bands and blocks, so no task holds a pivot's vectors at once.
    """
    threshold = checked_threshold(threshold)
    require_vectors(items, item_id, vector)
    stages = Stages(items.sparkSession, "clusters")
    kept = stages.keep(items.select(F.col(item_id).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double") + F.lit(0.0)).alias("vector")))  # -0.0 becomes 0.0
    seen = kept.agg(F.count(F.lit(1)), F.count_distinct("id"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if not seen[0]:
        return kept.select(F.col("id").alias("item_id"), F.col("id").alias("cluster_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("size"))
    if seen[0] != seen[1] or seen[2] != seen[3]:
        raise ValueError("ids have to be distinct and not null, and vectors of one length")
    dims = seen[3]
    zero = F.forall("vector", lambda x: x == 0)
    # Zero vectors aren't alike to each other above a threshold of 0, so each stays for itself.
    copy = F.when(zero, F.col("id")).otherwise(F.lit(-1))
    named = stages.keep(kept.withColumn("key", F.xxhash64("vector", copy)))
    reps = stages.keep(named.groupBy("vector", copy.alias("copy")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    stages.drop(kept)
    total = reps.count()
    some = reps.orderBy(F.xxhash64("vector"), "id").limit(min(MOST_PIVOTS, -(-total // PIVOT_ROWS))).select("vector").collect()
    pivots = _units(pa.array([r["vector"] for r in some], pa.list_(pa.float64())), dims)
    reach = math.acos(threshold)
    if not _prunes(pivots, reach):
        pivots = pivots[:1]
    block_rows = min(BLOCK_ROWS, max(SQUARE // 2, total // LEAST_BLOCKS))
    placed = stages.keep(_placed(reps.select("id", "n", "vector"), pivots, reach))
    sizes = placed.groupBy("part", "band").agg(F.count(F.lit(1)).alias("rows"))
    # At most MOST_PIVOTS * BANDS rows, so they are broadcast.
    split = placed.join(F.broadcast(sizes), ["part", "band"]).withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / block_rows))).drop("rows")
    row = F.struct("id", "n", "v")
    blocks = stages.keep(split.groupBy("part", "band", "block").agg(F.collect_list(row).alias("b"), F.collect_list(F.when(F.col("home"), row)).alias("a")))
    step = math.ceil((reach + SLACK) / math.pi * BANDS)
    at = [F.col(c) for c in ("part", "band", "block")]
    # Bands within reach of each other, as an equality of (part, band).
    left = blocks.where(F.size("a") > 0).select(*[c.alias(f"a_{n}") for c, n in zip(at, ("part", "band", "block"), strict=True)])
    left = left.withColumn("band", F.explode(F.sequence(F.greatest(F.col("a_band") - step, F.lit(0)), F.least(F.col("a_band") + step, F.lit(BANDS - 1))))).withColumn("part", F.col("a_part"))
    tiles = left.join(blocks.select(*at), ["part", "band"])
    tiles = tiles.join(blocks.select(F.col("part").alias("a_part"), F.col("band").alias("a_band"), F.col("block").alias("a_block"), "a"), ["a_part", "a_band", "a_block"])
    tiles = tiles.join(blocks.select(*at, "b"), ["part", "band", "block"]).select("a", "b")
    found = stages.keep(_compared(tiles, dims, threshold))
    roots = component_roots(found.select(F.col("id").alias("u"), F.col("root").alias("v")), stages)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = reps.join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    per = stages.keep(joined.select(F.xxhash64("vector", F.when(zero, F.col("id")).otherwise(F.lit(-1))).alias("key"), F.coalesce("root", "id").alias("cluster_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "n"))
    sizes = per.groupBy("cluster_id").agg(F.sum("n").alias("size"))
    return named.join(per.drop("n"), "key").join(sizes, "cluster_id").select(F.col("id").alias("item_id"), "cluster_id", "n_links", "size")
