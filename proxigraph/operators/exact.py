"""Exact k-nearest-neighbour graphs: edges (src, dst, dist, rk), ties to the smaller dst, no point its own neighbour.

Every strategy gives the same graph (``norms`` up to rounding of the
distances). ``gemm``, the default, cuts the points into blocks whose size
does not depend on the table's, pairs blocks by an equi-join, computes each
pair of blocks as one matrix product, keeps every candidate that could be
among a point's k within the product's rounding error, and computes those
few again as exact left folds. At most k rows per point and block pair
leave a task; a window with a pre-shuffle limit merges them. Vectors of few components are cut into boxes, of which
only those meet that can hold one of a point's k. The other strategies
meet each unordered pair of blocks once. ``native`` scans a pair of blocks in
tiles, keeps each point's k so far, and folds all pairs that a product, within
its rounding error, does not put beyond them; the others fold every pair of
points, without a product.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from proxigraph.functions import distance as D
from proxigraph.sources.vectors import check_k, shape
from proxigraph.storage import through_files

BLOCK, LEAST_BLOCK = 2048, 512
#: Components of the vectors whose exact distances are computed at once.
COMPONENTS = 1 << 22
#: Components of a block that native scans in tiles, and of vectors whose pairs it folds at once.
SCANNED, FOLDED = 1 << 20, 1 << 18
#: Below, a product's rounding error may be lost in numbers that are too small for all their digits.
TINY = 1e-270
#: Vectors of so many components at most are cut into boxes, and so many of these by one task.
SLIM, CUT = 8, 64
#: Pairs that leave Python at once where all do, points that are folded with each other point in turn, the points in a list of distances, and the lists in a row. Spark's generated code holds all pairs of a row.
PAIRS, WIDE, LISTED, LISTS = 1 << 16, 256, 32, 32
EDGES = "src long, dst long, dist double"
#: src, dst and dist of edges.
Edges = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Both blocks with their ids, which ascend, and whether they are one block. Gives edges, or what a batch is made of.
Tile = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool], Iterator[tuple]]
#: Points, and for some others their distances to those from the first on. Declared without nulls, as looking for them would cost more than the numbers.
LIST = StructType([StructField("src", LongType(), False), StructField("first", IntegerType(), False), StructField("dists", ArrayType(DoubleType(), False), False)])
LISTS_OF_PAIRS = StructType([StructField("ids", ArrayType(LongType(), False), False), StructField("lists", ArrayType(LIST, False), False)])
STRATEGIES = ("gemm", "native", "norms", "tiled", "sort_slice")


def best(candidates: DataFrame, k: int) -> DataFrame:
    """The k smallest (dist, dst) of each src. k = 0 gives nothing."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return candidates.select("src", "dst", "dist", rank.alias("rk")).where(F.col("rk") <= k)


def all_pairs(vecs: DataFrame, metric: str | D.Metric = "l2", parallelism: int | None = None, block: int = BLOCK) -> DataFrame:
    """src, dst, dist of every ordered pair of different points. Quadratic by definition. Raises ValueError for vectors that shape() refuses.

    A pair is folded once and leaves Python once, as a number in a list; Spark adds the ids and makes both rows of it.
    A list's rows follow each other one way and then the other, so a file has ids as runs and a list's distances again
    as a copy of what it has just written. Blocks are as large as native's, so a point is sent few times.
    """
    n, d = shape(vecs)
    lists = _met(vecs, _sent(n, d, block, _cores(vecs, parallelism)), n, parallelism, _listed(D.metric(metric).distances), LISTS_OF_PAIRS, _lists)
    each = lists.select("ids", F.inline("lists").alias("a", "first", "dists"), F.lit(True).alias("there"), F.lit(False).alias("back"))
    ways = vecs.sparkSession.sql("SELECT ids, a, first, dists, way FROM {each} UNPIVOT INCLUDE NULLS (way FOR name IN (there, back))", each=each)
    pairs = ways.select("way", "ids", "a", "first", F.posexplode("dists").alias("at", "dist")).withColumn("b", F.get("ids", F.col("first") + F.col("at")))
    return pairs.select(F.when(F.col("way"), F.col("a")).otherwise(F.col("b")).alias("src"), F.when(F.col("way"), F.col("b")).otherwise(F.col("a")).alias("dst"), "dist")


def _sent(n: int, d: int, block: int, cores: int) -> int:
    """Points of a block that is met whole: of many tiles, so that there are some twelve pairs of blocks a core."""
    return max(gemm_block(n, block, cores), min(SCANNED // max(1, d), math.ceil(n / math.ceil(math.sqrt(24 * cores)))))


def _native(vecs: DataFrame, k: int, metric: D.Metric, parallelism: int | None, block: int, n: int, d: int) -> DataFrame:
    """The canonical scan: each point meets all others, and the distance of a pair that may be among a point's k is folded component by component.

    Blocks of many tiles make some twelve pairs of blocks a core, so a point is sent few times and few of its lists are merged.
    """
    cores = _cores(vecs, parallelism)
    return best(_met(vecs, _sent(n, d, block, cores), n, parallelism, _scan(k, metric, gemm_block(n, block, cores)), EDGES), k)


def _norms(vecs: DataFrame, k: int, metric: D.Metric, parallelism: int | None, block: int, n: int) -> DataFrame:
    """Distances by the norm identity: norms once a block, dot products as left folds."""
    if metric.name != "l2":
        raise ValueError("strategy norms is for l2")
    return best(_met(vecs, gemm_block(n, block, _cores(vecs, parallelism)), n, parallelism, _nearest(k, D.tile_l2_from_norms), EDGES), k)


def _sort_slice(vecs: DataFrame, k: int, metric: D.Metric, parallelism: int | None, block: int, n: int) -> DataFrame:
    """Sorts a point's distances to a block and slices them; its slices of all blocks are sorted and sliced again. No more than k distances a block are gathered."""
    slices = _met(vecs, gemm_block(n, block, _cores(vecs, parallelism)), n, parallelism, _nearest(k, metric.distances, _sort), EDGES)
    near = slices.groupBy("src").agg(F.slice(F.sort_array(F.collect_list(F.struct("dist", "dst"))), 1, k).alias("near"))
    return near.select("src", F.posexplode("near").alias("at", "e")).select("src", "e.dst", "e.dist", (F.col("at") + 1).alias("rk"))


def _block_of(n: int, block: int):
    return F.pmod(F.xxhash64("vec_id"), F.lit(max(1, math.ceil(n / block)))).cast("int")


def _paired(left: DataFrame, right: DataFrame, blocks: int) -> DataFrame:
    """Each block of the left with each of the right: an equi-join on the right's number."""
    return left.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(right, F.col("other") == F.col("blk_b"))


def _tiled(vecs: DataFrame, k: int, metric: D.Metric, parallelism: int | None, block: int, n: int) -> DataFrame:
    """Tiles of block times block points. As many as fill a block of gemm travel together, so a point isn't sent once for each tile."""
    sent = max(block, gemm_block(n, BLOCK, _cores(vecs, parallelism)) // block * block)
    return best(_met(vecs, sent, n, parallelism, _in_tiles(k, metric.distances, block), EDGES), k)


def _pack(rows: pa.Table) -> pa.Table:
    order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
    matrix = np.array(rows["v"].combine_chunks().flatten()).reshape(rows.num_rows, -1)[order]
    return pa.table({"blk": pa.array([rows["blk"][0].as_py()], pa.int32()), "n": pa.array([rows.num_rows], pa.int32()), "ids": [rows["vec_id"].to_numpy()[order].astype("<i8").tobytes()], "m": [matrix.astype("<f8").tobytes()]})


def _cores(vecs: DataFrame, parallelism: int | None) -> int:
    return parallelism or vecs.sparkSession.sparkContext.defaultParallelism


def _met(vecs: DataFrame, block: int, n: int, parallelism: int | None, tile: Tile, schema: str | StructType, batch: Callable[..., pa.RecordBatch] | None = None) -> DataFrame:
    """What tile gives for each unordered pair of blocks, a block with itself included.

    A metric is symmetric, so a pair of blocks serves both. Pairs are dealt by
    their own number, so that no task has all pairs of a block.
    """
    blocks, tasks = max(1, math.ceil(n / block)), parallelism or 4 * _cores(vecs, None)
    packed = vecs.withColumn("blk", _block_of(n, block)).groupBy("blk").applyInArrow(_pack, "blk int, n int, ids binary, m binary")
    a, b = (packed.select(*[F.col(c).alias(f"{c}_{side}") for c in packed.columns]) for side in "ab")
    a = a.withColumn("blk_b", F.explode(F.sequence("blk_a", F.lit(blocks - 1))))
    b = b.withColumn("blk_a", F.explode(F.sequence(F.lit(0), "blk_b")))
    sides = [side.repartition(tasks, "blk_a", "blk_b") for side in (a, b)]
    joined = sides[0].join(sides[1].hint("merge"), ["blk_a", "blk_b"])
    # The join is dealt to spark.sql.shuffle.partitions tasks where these are more.
    return (joined.coalesce(parallelism) if parallelism else joined).mapInArrow(_tiles(tile, batch or _edges), schema)


def _edges(src: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(dist, pa.float64())], ["src", "dst", "dist"])


def _tiles(tile: Tile, to_batch: Callable[..., pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                a, b = (np.frombuffer(r[m], "<f8").reshape(r[n], -1) for m, n in (("m_a", "n_a"), ("m_b", "n_b")))
                for found in tile(a, np.frombuffer(r["ids_a"], "<i8"), b, np.frombuffer(r["ids_b"], "<i8"), r["blk_a"] == r["blk_b"]):
                    yield to_batch(*found)

    return run


def _partition(dist: np.ndarray, kth: int) -> np.ndarray:
    return np.partition(dist, kth, axis=1)


def _sort(dist: np.ndarray, kth: int) -> np.ndarray:
    return np.sort(dist, axis=1)


def _nearest(k: int, distances: Callable[[np.ndarray, np.ndarray], np.ndarray], arrange: Callable[[np.ndarray, int], np.ndarray] = _partition) -> Tile:
    """The k nearest of each row of either block in the other one. distances are exact."""

    def tile(a: np.ndarray, a_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray, same: bool) -> Iterator[Edges]:
        dist = distances(a, b)
        if same:
            np.fill_diagonal(dist, np.inf)
        for ids, others, rows in ((a_ids, b_ids, dist), (b_ids, a_ids, np.ascontiguousarray(dist.T)))[: 1 if same else 2]:
            at, near = row_best(rows, k, same, arrange)
            yield ids[at], others[near], rows[at, near]

    return tile


def _listed(distances: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Tile:
    """All pairs of two blocks' points, each once: some ids of the second block, points of the first, and from which of those ids on a point's distances are given, one point's after the other's.

    In one block a point meets those after it.
    """

    def tile(a: np.ndarray, a_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray, same: bool) -> Iterator[tuple]:
        height = PAIRS // LISTED
        for j in range(0, len(b), WIDE):
            wide = b[j : j + WIDE]
            end = min(len(a), j + len(wide) - 1) if same else len(a)
            for i in range(0, end, height):
                folded = distances(a[i : min(i + height, end)], wide)
                for c in range(0, len(wide), LISTED):
                    ids = b_ids[j + c : j + min(c + LISTED, len(wide))]
                    stop = min(i + len(folded), j + c + len(ids) - 1) if same else i + len(folded)
                    if stop <= i:
                        continue
                    dist, first = folded[: stop - i, c : c + LISTED], np.zeros(stop - i, np.int32)
                    if same:
                        first = np.maximum(0, np.arange(i + 1, stop + 1, dtype=np.int32) - j - c)
                    yield ids, a_ids[i:stop], first, dist[np.arange(len(ids)) >= first[:, None]] if first.any() else dist.ravel()

    return tile


def _lists(ids: np.ndarray, src: np.ndarray, first: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    """_listed's numbers with the ids once for LISTS points."""

    def cut(lengths: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), values)

    rows = np.diff(np.append(np.arange(0, len(src), LISTS), len(src)))
    lists = pa.StructArray.from_arrays([pa.array(src, pa.int64()), pa.array(first, pa.int32()), cut(len(ids) - first, pa.array(dist, pa.float64()))], ["src", "first", "dists"])
    return pa.RecordBatch.from_arrays([cut(np.full(len(rows), len(ids)), pa.array(np.tile(ids, len(rows)), pa.int64())), cut(rows, lists)], ["ids", "lists"])


def _in_tiles(k: int, distances: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> Tile:
    """_nearest by tiles of size times size points, whose lists are merged to the k nearest in a whole block."""
    nearest = _nearest(k, distances)

    def tile(a: np.ndarray, a_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray, same: bool) -> Iterator[Edges]:
        cut = lambda x, i: x[i : i + size]
        lists = [e for i in range(0, len(a), size) for j in range(i if same else 0, len(b), size) for e in nearest(cut(a, i), cut(a_ids, i), cut(b, j), cut(b_ids, j), same and i == j)]
        src, dst, dist = (np.concatenate(x) for x in zip(*lists, strict=True))
        order = np.lexsort((dst, dist, src))
        src, dst, dist = src[order], dst[order], dist[order]
        first = np.arange(len(src)) - np.searchsorted(src, src, "left") < k
        yield src[first], dst[first], dist[first]

    return tile


class _Lists:
    """The k nearest so far of each of some points, in order of point, distance and id, and the distance that a further one must not exceed."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, k: int):
        self.points, self.columns, self.ids, self.k = points, np.ascontiguousarray(points.T), ids, k
        self.at, self.dst, self.dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.most = np.full(len(ids), np.inf)

    def offer(self, at: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> None:
        near = ~(dist > self.most[at])
        at, dst, dist = (np.concatenate(x) for x in ((self.at, at[near]), (self.dst, dst[near]), (self.dist, dist[near])))
        order = np.lexsort((dst, dist, at))
        at, dst, dist = at[order], dst[order], dist[order]
        place = np.arange(len(at)) - np.searchsorted(at, at, "left")
        self.most[at[place == self.k - 1]] = dist[place == self.k - 1]
        self.at, self.dst, self.dist = (x[place < self.k] for x in (at, dst, dist))


def _kth(fast: np.ndarray, k: int, axis: int) -> np.ndarray:
    """A number along axis that k or more don't exceed: the k-th of the least of groups. Infinite where there are fewer."""
    length, other = fast.shape[axis], fast.shape[1 - axis]
    if length < k:
        return np.full(other, np.inf)
    groups = min(length, max(64, 4 * k))
    size = length // groups
    least = fast[: groups * size].reshape(size, groups, other).min(0) if axis == 0 else fast[:, : groups * size].reshape(other, size, groups).min(1)
    return np.partition(least, k - 1, axis=axis).take(k - 1, axis)


def _folds(metric: D.Metric, a: _Lists, at: np.ndarray, b: _Lists, near: np.ndarray) -> np.ndarray:
    step = max(1, FOLDED // max(1, len(a.columns)))
    cut = [slice(i, i + step) for i in range(0, max(1, len(at)), step)]
    return np.concatenate([metric.rows(a.columns.take(at[c], 1).T, b.columns.take(near[c], 1).T) for c in cut])


def _meet(a: _Lists, b: _Lists, metric: D.Metric) -> None:
    """Offers each point of a those of b, and the other way round. Only pairs that are surely beyond the k nearest of both are not folded."""
    k, same = a.k, a is b
    error = 1e-12 * len(a.columns) * (np.abs(a.points).max(initial=0.0) + np.abs(b.points).max(initial=0.0)) ** 2
    if metric.block and TINY < error < 1 / TINY:
        fast = metric.block(a.points, b.points)
    else:
        fast, error = metric.distances(a.points, b.points), 0.0
    if same:
        np.fill_diagonal(fast, np.inf)
    far = fast > _limit(a, fast, k, 1, error)[:, None]
    if not same:
        far &= fast > _limit(b, fast, k, 0, error)
    pairs = np.flatnonzero(~far)
    at, near = np.divmod(pairs, len(b.ids))
    if same:
        at, near = at[at != near], near[at != near]
    dist = _folds(metric, a, at, b, near)
    a.offer(at, b.ids[near], dist)
    if not same:
        b.offer(near, a.ids[at], dist)


def _limit(lists: _Lists, fast: np.ndarray, k: int, axis: int, error: float) -> np.ndarray:
    """What a pair's fast distance must not exceed: the k-th so far is exact, the k-th of this tile is as far off as the pair's own."""
    limit = lists.most + error
    return limit if np.isfinite(limit).all() else np.fmin(limit, _kth(fast, k, axis) + 2 * error)


def _scan(k: int, metric: D.Metric, size: int) -> Tile:
    """The k nearest of each point of two blocks in the other one, by tiles of size times size points."""

    def tile(a: np.ndarray, a_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray, same: bool) -> Iterator[Edges]:
        left = [_Lists(a[i : i + size], a_ids[i : i + size], k) for i in range(0, len(a), size)]
        right = left if same else [_Lists(b[i : i + size], b_ids[i : i + size], k) for i in range(0, len(b), size)]
        for i, x in enumerate(left):
            for y in right[i if same else 0 :]:
                _meet(x, y, metric)
        for x in left if same else left + right:
            yield x.ids[x.at], x.dst, x.dist

    return tile


def row_best(dist: np.ndarray, k: int, same: bool, arrange: Callable[[np.ndarray, int], np.ndarray] = _partition) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k smallest of each row, of equal ones the first; same: without the diagonal. Not-a-number comes last. arrange puts the k-th of each row in its place."""
    if k < dist.shape[1]:
        at, near = np.nonzero(~(dist > arrange(dist, k - 1)[:, k - 1, None]))
    else:
        at, near = (x.ravel() for x in np.indices(dist.shape))
    if same:
        at, near = at[at != near], near[at != near]
    order = np.lexsort((near, dist[at, near], at))
    at, near = at[order], near[order]
    first = np.arange(len(at)) - np.searchsorted(at, at, "left") < k
    return at[first], near[first]


def block_best(a: np.ndarray, a_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray, k: int, metric: D.Metric) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """src, dst and exact dist of the k nearest in block b of each row of a. b_ids ascend."""
    own = a_ids[:, None] == b_ids
    if metric.block is None:
        at, near = np.nonzero(~own)
    else:
        fast = np.where(own, np.inf, metric.block(a, b))
        scale = 1e-12 * a.shape[1] * (np.abs(a).max(initial=0.0) + np.abs(b).max(initial=0.0)) ** 2
        cut = np.partition(fast, k - 1, axis=1)[:, k - 1, None] if k < len(b) else np.inf
        at, near = np.nonzero((fast <= cut + scale) & ~own)
    step = max(1, COMPONENTS // max(1, a.shape[1]))
    exact = np.concatenate([metric.rows(a[at[i : i + step]], b[near[i : i + step]]) for i in range(0, max(1, len(at)), step)])
    order = np.lexsort((near, exact, at))
    at, near, exact = at[order], near[order], exact[order]
    first = np.arange(len(at)) - np.searchsorted(at, at, "left") < k
    return a_ids[at[first]], b_ids[near[first]], exact[first]


def _products(k: int, metric: D.Metric):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                a, b = (np.frombuffer(r[m], "<f8").reshape(r[n], -1) for m, n in (("m_a", "n_a"), ("m_b", "n_b")))
                src, dst, dist = block_best(a, np.frombuffer(r["ids_a"], "<i8"), b, np.frombuffer(r["ids_b"], "<i8"), k, metric)
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(dist, pa.float64())], ["src", "dst", "dist"])

    return run


def gemm_block(n: int, block: int, cores: int) -> int:
    """A small table is cut finer, so that the pairs of blocks are about twice the cores; a block is sent once for each other, so none is small."""
    return min(block, max(LEAST_BLOCK, math.ceil(n / math.ceil(math.sqrt(2 * cores)))))


def _gemm(vecs: DataFrame, k: int, metric: D.Metric, parallelism: int | None, block: int, n: int) -> DataFrame:
    block = gemm_block(n, block, parallelism or vecs.sparkSession.sparkContext.defaultParallelism)
    packed = vecs.withColumn("blk", _block_of(n, block)).groupBy("blk").applyInArrow(_pack, "blk int, n int, ids binary, m binary")
    a, b = (packed.select(*[F.col(c).alias(f"{c}_{side}") for c in packed.columns]) for side in "ab")
    return best(_paired(a, b, math.ceil(n / block)).mapInArrow(_products(k, metric), "src long, dst long, dist double"), k)


def cells(m: np.ndarray, ids: np.ndarray, block: int) -> list[np.ndarray]:
    """Row numbers of cells of block rows at most, by ascending id: halves along the widest side, of equal values the smaller ids first."""
    todo, out = [np.arange(len(m))] if len(m) else [], []
    while todo:
        rows = todo.pop()
        if len(rows) <= block:
            out.append(rows[np.argsort(ids[rows])])
            continue
        x = m[rows]
        rows = rows[np.lexsort((ids[rows], x[:, np.argmax(np.ptp(x, axis=0))]))]
        todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    return out


def _cut(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not rows:
            return
        ids = np.concatenate([r["vec_id"].to_numpy() for r in rows])
        m = np.concatenate([r["v"].flatten().to_numpy().reshape(r.num_rows, -1) for r in rows])
        part = TaskContext.get().partitionId()
        for i, cell in enumerate(cells(m, ids, block)):
            x = m[cell]
            row = [(part << 32) + i, len(cell), ids[cell].astype("<i8").tobytes(), x.astype("<f8").tobytes(), x.min(0).astype("<f8").tobytes(), x.max(0).astype("<f8").tobytes(), ids[cell[0]]]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["blk", "n", "ids", "m", "lo", "hi", "first"])

    return run


class _Boxes:
    """All boxes: what leads a search and what a point can leave out."""

    def __init__(self, rows: list):
        self.blk, self.n, self.first = (np.array([r[c] for r in rows], np.int64) for c in ("blk", "n", "first"))
        self.lo, self.hi = (np.array([np.frombuffer(r[c], "<f8") for r in rows]) for c in ("lo", "hi"))

    def seeds(self, bound, at: int, k: int) -> np.ndarray:
        """The blocks that look nearest from the middle of a box, with more than k points in all."""
        middle = self.lo[at] + (self.hi[at] - self.lo[at]) / 2
        order = np.lexsort((np.arange(len(self.blk)) != at, bound(middle[None], self.lo, self.hi)[0]))
        return order[: np.searchsorted(np.cumsum(self.n[order]), k, "right") + 1]

    def near(self, apart, at: int, dist: np.ndarray) -> np.ndarray:
        """The boxes that are not beyond all of dist from a whole box; of them alone rows need be looked at."""
        if apart is None:
            return np.arange(len(self.blk))
        return np.flatnonzero(~(apart(self.lo[at], self.hi[at], self.lo, self.hi) > dist.max()))

    def open(self, bound, a: np.ndarray, dist: np.ndarray, dst: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether a box may hold something before (dist, dst), for each row of a and each of the boxes."""
        least = bound(a, self.lo[which], self.hi[which])
        return ~(least > dist[:, None]) & ((least != dist[:, None]) | (self.first[which] <= dst[:, None]))


def _block(r: dict, side: str = "") -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(r[f"m{side}"], "<f8").reshape(r[f"n{side}"], -1), np.frombuffer(r[f"ids{side}"], "<i8")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _boxed(vecs: DataFrame, k: int, metric: D.Metric, parallelism: int | None, block: int, n: int, d: int) -> DataFrame:
    """gemm for vectors of few components: a block is a box, and meets those that can hold one of the k nearest of a point of it.

    A point's k-th nearest in the blocks that look nearest bounds its search;
    blocks beyond the bound, or at it with larger ids alone, hold none of its
    k. The driver and tasks hold the boxes, a few numbers a block.
    """
    spark, tasks = vecs.sparkSession, parallelism or 4 * _cores(vecs, None)
    sides = vecs.agg(*[(F.max(F.get("v", F.lit(i))) - F.min(F.get("v", F.lit(i)))).alias(str(i)) for i in range(d)]).first()
    ranged = vecs.select("vec_id", "v").repartitionByRange(math.ceil(n / (CUT * block)), F.get("v", F.lit(int(np.argmax(sides)))), "vec_id")
    packed = through_files(ranged.mapInArrow(_cut(block), "blk long, n int, ids binary, m binary, lo binary, hi binary, first long"), "blocks")
    boxes = _Boxes(packed.select("blk", "n", "lo", "hi", "first").collect())
    number, bound = {int(b): i for i, b in enumerate(boxes.blk)}, metric.bound
    chunk = max(1, COMPONENTS // block)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            led = boxes.blk[boxes.seeds(bound, number[r["blk"]], k)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(led), r["blk"])), pa.array(led)], ["blk_a", "blk_b"])

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            a, a_ids = _block(r, "_a")
            found = [block_best(a, a_ids, *_block(s), k, metric) for s in r["led"]]
            src, dst, dist = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((dst, dist, src))
            src, dst, dist = src[order], dst[order], dist[order]
            kth = np.searchsorted(src, a_ids, "left") + k - 1  # each point has k, as its seeds have more than k points
            dst, dist = dst[kth], dist[kth]
            every = boxes.near(metric.apart, number[r["blk_a"]], dist)
            met = np.concatenate([every[i : i + chunk][boxes.open(bound, a, dist, dst, every[i : i + chunk]).any(0)] for i in range(0, len(every), chunk)])
            yield pa.RecordBatch.from_arrays([pa.array([r["blk_a"]], pa.int64()), pa.array([dist.tobytes()], pa.binary()), pa.array([dst.tobytes()], pa.binary()), pa.array([boxes.blk[met].tolist()], pa.list_(pa.int64()))], ["blk_a", "dist", "dst", "met"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            a, a_ids = _block(r, "_a")
            rows = boxes.open(bound, a, np.frombuffer(r["dist"]), np.frombuffer(r["dst"], np.int64), np.array([number[r["blk_b"]]]))[:, 0]
            if rows.any():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in block_best(a[rows], a_ids[rows], *_block(r, "_b"), k, metric)], ["src", "dst", "dist"])

    a, b = (packed.select(*[F.col(c).alias(f"{c}_{side}") for c in ("blk", "n", "ids", "m")]) for side in "ab")
    # No broadcast: what is packed grows with the table.
    led = packed.select("blk").repartition(tasks, "blk").mapInArrow(seeds, "blk_a long, blk_b long").join(b.hint("merge"), "blk_b")
    led = led.groupBy("blk_a").agg(F.collect_list(F.struct(*[F.col(f"{c}_b").alias(c) for c in ("n", "ids", "m")])).alias("led"))
    met = led.repartition(tasks, "blk_a").join(a.hint("merge"), "blk_a").mapInArrow(bounds, "blk_a long, dist binary, dst binary, met array<long>")
    met = through_files(met, "met").withColumn("blk_b", F.explode("met")).drop("met")
    pairs = met.join(a.hint("merge"), "blk_a").join(b.hint("merge"), "blk_b").repartition(tasks, "blk_a", "blk_b")
    return best(pairs.mapInArrow(products, EDGES), k)


def boxed(metric: D.Metric, block: int, n: int, d: int) -> int:
    """The size of gemm's boxes; 0 where boxes would not tell points apart, or are too few."""
    size = min(block, LEAST_BLOCK)
    return size if metric.block and metric.bound and 1 <= d <= SLIM and n > 4 * size else 0


def exact_knn(vecs: DataFrame, k: int, metric: str | D.Metric = "l2", strategy: str = "gemm", parallelism: int | None = None, block: int = BLOCK) -> DataFrame:
    """vecs: vec_id, v. Returns src, dst, dist, rk (from 1).

    Raises ValueError at once for an empty table, k outside 1..n-1, or vectors that shape() refuses.
    """
    n, d = shape(vecs)
    check_k(n, k)
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    if strategy == "gemm" and (size := boxed(D.metric(metric), block, n, d)):
        return _boxed(vecs, k, D.metric(metric), parallelism, size, n, d)
    if strategy == "native":
        return _native(vecs, k, D.metric(metric), parallelism, block, n, d)
    build = {"gemm": _gemm, "norms": _norms, "tiled": _tiled, "sort_slice": _sort_slice}[strategy]
    return build(vecs, k, D.metric(metric), parallelism, block, n)


def active_path(vecs: DataFrame, metric: str | D.Metric = "l2", strategy: str = "gemm", parallelism: int | None = None, block: int = BLOCK) -> DataFrame:
    """How exact_knn computes the graph of vecs: strategy, metric, kernel (matrix_product, tiles or rows), block and blocks (1 and the whole table where a strategy has none)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    (n, d), m, spark = shape(vecs), D.metric(metric), vecs.sparkSession
    cut = gemm_block(n, block, parallelism or spark.sparkContext.defaultParallelism)
    size = {"tiled": block, "gemm": boxed(m, block, n, d) or cut}.get(strategy, cut)
    kernel = "matrix_product" if strategy in ("gemm", "native") and m.block else "tiles" if strategy != "gemm" and m.tile else "rows"
    return spark.createDataFrame([(strategy, m.name, kernel, size, max(1, math.ceil(n / size)))], "strategy string, metric string, kernel string, block long, blocks long")
