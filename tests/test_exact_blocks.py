"""Exact graphs and pair distances are computed in blocks: no nested-loop join, no sort of all pairs."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from proxigraph.functions import distance as D
from proxigraph.operators import exact
from proxigraph.operators.exact import _in_tiles, _nearest, _scan, _sort, all_pairs, best, cells, exact_knn, row_best
from proxigraph.sources.vectors import from_array, synthetic
from tests.test_graphs import brute, lists


def points(n, d, copies):
    """Rounded points, so that there are ties, the last of them copies of the first."""
    data = np.round(synthetic(n, d, 11).astype(float), 1)
    data[n - copies :] = data[:copies]
    return data


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def in_blocks(df):
    return not any(x in plan_of(df) for x in ("NestedLoop", "CartesianProduct"))


def test_native_ip(spark):
    data = points(90, 6, 40)
    got = exact_knn(from_array(spark, data), 8, "inner_product", "native", block=32)
    assert in_blocks(got)
    assert lists(got) == brute(data, 8, "inner_product")


def test_native_l2(spark):
    """Large offsets, many copies and blocks that don't fill."""
    data = points(75, 3, 60) + 1e4
    got = exact_knn(from_array(spark, data, 7), 9, "l2", "native", block=32)
    assert in_blocks(got)
    assert lists(got) == {i + 7: [(j + 7, x) for j, x in e] for i, e in brute(data, 9, "l2").items()}


def counting(metric, add):
    """The metric, and add is told of each pair that is folded."""
    m = D.metric(metric)

    def rows(a, b):
        add(len(a))
        return m.rows(a, b)

    def tile(a, b):
        add(len(a) * len(b))
        return m.tile(a, b)

    return replace(m, rows=rows, tile=tile)


@pytest.mark.parametrize("metric", ["l2", "inner_product"])
def test_native_folds_few_pairs(spark, metric):
    data = points(1200, 8, 100)
    folded = spark.sparkContext.accumulator(0)
    got = exact_knn(from_array(spark, data), 5, counting(metric, folded.add), "native", block=128)
    assert lists(got) == brute(data, 5, metric)
    assert 0 < folded.value < 1200**2 / 8


def test_scan_keeps_lists():
    """Later tiles fold only what may still be among the k of a point: fewer than the first ones do."""
    data = synthetic(1600, 6, 3).astype(float)
    count = []
    lists = [*_scan(4, counting("l2", count.append), 100)(data[:800], np.arange(800), data[800:], np.arange(800, 1600), False)]
    assert sum(len(src) for src, _, _ in lists) == 1600 * 4
    assert sum(count) < 1600 * 4 * 6
    want = {e for i in range(0, 1600, 800) for e in zip(*_edges(data, np.arange(i, i + 800), np.arange(800 - i, 1600 - i), 4), strict=True)}
    assert {e for x in lists for e in zip(*(v.tolist() for v in x), strict=True)} == want


def _edges(data, of, among, k):
    at, near = row_best(D.L2.distances(data[of], data[among]), k, False)
    return of[at].tolist(), among[near].tolist(), D.L2.distances(data[of], data[among])[at, near].tolist()


@pytest.mark.parametrize("factor", [1e200, 1e-165, 0.0, 1e150])
def test_native_beyond_a_products_range(spark, factor):
    """Where a product overflows or loses its digits, all pairs are folded."""
    data = points(80, 3, 20) * factor
    assert lists(exact_knn(from_array(spark, data), 6, "l2", "native", block=32)) == brute(data, 6, "l2")


def test_parallelism(spark):
    """So many tasks share the pairs of blocks, and the graph stays the same."""
    data = points(70, 4, 20)
    vecs = from_array(spark, data)
    got = exact_knn(vecs, 6, strategy="native", parallelism=5, block=16)
    assert in_blocks(got) and "REPARTITION_BY_NUM" in plan_of(got) and "blk_b" in plan_of(got)
    assert plan_of(got).count(", 5), REPARTITION_BY_NUM") == 2
    assert lists(got) == brute(data, 6, "l2")


def test_parallelism_below_the_sessions(spark):
    """So many tasks also where the session deals joins to more."""
    vecs = from_array(spark, points(90, 3, 10))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    try:
        edges = exact._met(vecs, 8, 90, 5, _nearest(3, D.L2.distances), exact.EDGES)
        assert edges.rdd.getNumPartitions() == 5
        assert lists(best(edges, 3)) == brute(points(90, 3, 10), 3, "l2")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_parallel_folds_few_pairs(spark):
    """More tasks mean more and smaller blocks, but no return to folding all pairs."""
    data = points(1300, 5, 200)
    folded = spark.sparkContext.accumulator(0)
    got = exact_knn(from_array(spark, data), 4, counting("l2", folded.add), "native", parallelism=16, block=128)
    assert lists(got) == brute(data, 4, "l2")
    assert 0 < folded.value < 1300**2 / 8


def test_norms(spark):
    """The distances are the column expression's to the last bit, so copies tie."""
    data = points(80, 5, 30)
    vecs = from_array(spark, data)
    got = exact_knn(vecs, 8, strategy="norms", block=32)
    assert in_blocks(got)
    a, b = (vecs.select(F.col("vec_id").alias(i), F.col("v").alias(i[0])) for i in ("src", "dst"))
    dist = D.l2_from_norms(D.norm_squared(F.col("s")), D.norm_squared(F.col("d")), D.dot_product(F.col("s"), F.col("d")))
    assert lists(got) == lists(best(a.crossJoin(b).where("src <> dst").select("src", "dst", dist.alias("dist")), 8))


def test_sort_slice(spark):
    """What is gathered for a point is k distances a block, whatever the number of points."""
    data = points(100, 3, 50)
    vecs = from_array(spark, data)
    got = exact_knn(vecs, 5, strategy="sort_slice", block=50)
    assert in_blocks(got)
    assert lists(got) == brute(data, 5, "l2")
    tile = _nearest(5, D.L2.distances, _sort)
    assert sum(len(src) for src, _, _ in tile(data[:50], np.arange(50), data[50:], np.arange(50, 100), False)) == 2 * 50 * 5


def test_tiled(spark):
    """Small tiles don't make small pieces to send: many tiles are in one pair of blocks, and k rows a point leave it."""
    data = points(70, 4, 35)
    got = exact_knn(from_array(spark, data), 6, strategy="tiled", block=9)
    assert in_blocks(got) and "MapInArrow" in plan_of(got)
    assert lists(got) == brute(data, 6, "l2")
    tile = _in_tiles(6, D.L2.distances, 4)
    assert [len(src) for src, _, _ in tile(data[:30], np.arange(30), data[30:], np.arange(30, 70), False)] == [70 * 6]
    assert [len(src) for src, _, _ in tile(data, np.arange(70), data, np.arange(70), True)] == [70 * 6]


def all_of(data, metric):
    rows = D.metric(metric).rows
    return {(i, j): x for i in range(len(data)) for j, x in enumerate(rows(np.broadcast_to(data[i], data.shape), data)) if i != j}


def test_all_pairs_ip(spark):
    data = points(61, 5, 20)
    got = all_pairs(from_array(spark, data), "inner_product", block=20)
    assert in_blocks(got)
    rows = got.collect()
    assert len(rows) == 61 * 60 and {(r["src"], r["dst"]): r["dist"] for r in rows} == all_of(data, "inner_product")


def test_all_pairs_l2(spark):
    data = points(45, 3, 15) + 1e3
    got = all_pairs(from_array(spark, data), block=16)
    assert in_blocks(got)
    rows = got.collect()
    assert len(rows) == 45 * 44 and {(r["src"], r["dst"]): r["dist"] for r in rows} == all_of(data, "l2")
    assert all_pairs(from_array(spark, data).limit(0)).count() == 0


@pytest.mark.parametrize("metric", ["l2", "inner_product"])
def test_all_pairs_fold_and_leave_python_once(spark, metric):
    """Both rows of a pair are made of one distance, also of two points of one block; blocks of more and of fewer points than a list has."""
    n = 1100
    data, folded = points(n, 4, 200), spark.sparkContext.accumulator(0)
    got = all_pairs(from_array(spark, data, 5), counting(metric, folded.add))
    assert in_blocks(got) and "Expand" in plan_of(got) and "Generate posexplode" in plan_of(got)
    rows = got.toPandas()
    assert n * (n - 1) / 2 <= folded.value < 0.64 * n**2
    assert len(rows) == n * (n - 1) and not rows.duplicated(["src", "dst"]).any() and (rows.src != rows.dst).all()
    assert (rows.dist.to_numpy() == D.metric(metric).rows(data[rows.src - 5], data[rows.dst - 5])).all()


@pytest.mark.parametrize("metric", ["l2", "inner_product"])
def test_all_pairs_take_little_disk(spark, tmp_path, monkeypatch, metric):
    """A point is sent a few times only, and in a file a pair's second row takes next to nothing: of 24 bytes a row about half a distance is left."""
    n, sent, met = 1200, [], exact._met
    monkeypatch.setattr(exact, "_met", lambda vecs, block, *more: sent.append(block) or met(vecs, block, *more))
    got = all_pairs(from_array(spark, np.random.default_rng(3).normal(size=(n, 8))), metric, parallelism=4, block=16)
    assert n / sent[0] <= 10
    got = all_pairs(from_array(spark, np.random.default_rng(3).normal(size=(n, 8))), metric)
    got.coalesce(1).write.parquet(str(tmp_path / "pairs"))
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 6 * n * (n - 1)
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == n * (n - 1)


@pytest.mark.parametrize("sizes", [(1, 1), (2, 1), (1, 300), (300, 1), (257, 256), (256, 257), (600, 513)])
def test_listed_pairs(sizes):
    """Each pair of two blocks, or of different points of one, is in one list."""
    data = synthetic(sum(sizes), 3, 9).astype(float)
    for a, b in ((range(sizes[0]), range(sizes[0], sum(sizes))), (range(sizes[0]),) * 2):
        found = []
        for batch in (exact._lists(*x) for x in exact._listed(D.L2.distances)(data[a], np.array(a), data[b], np.array(b), a == b)):
            for r in batch.to_pylist():
                assert len(r["lists"]) <= exact.LISTS and len(r["ids"]) <= exact.LISTED
                found += [(x["src"], r["ids"][x["first"] + at], dist) for x in r["lists"] for at, dist in enumerate(x["dists"])]
        want = [(i, j) for i in a for j in b if a != b or i < j]
        assert sorted((i, j) for i, j, _ in found) == want
        src, dst, dist = np.array(found).T if found else np.empty((3, 0))
        assert (dist == D.L2.rows(data[src.astype(int)], data[dst.astype(int)])).all()


def few_values(n, seed):
    """Pairs of few values, with many copies; some negative, so that the largest product depends on the point."""
    rng = np.random.default_rng(seed)
    data = np.stack([rng.integers(-6, 30, n), rng.integers(9000, 9100, n) / 10], 1).astype(float)
    data[: n // 8] = data[0]
    return data


def met_by_boxes(spark, monkeypatch, data, k, metric):
    """The graph, and the number of pairs of points whose product was taken."""
    monkeypatch.setattr(exact, "CUT", 4)
    taken = spark.sparkContext.accumulator(0)
    m = D.metric(metric)

    def counted(a, b):
        taken.add(len(a) * len(b))
        return m.block(a, b)

    got = exact_knn(from_array(spark, data), k, replace(m, block=counted), block=32)
    return lists(got), taken.value


def test_boxes_ip(spark, monkeypatch):
    data = few_values(2000, 4)
    got, taken = met_by_boxes(spark, monkeypatch, data, 5, "inner_product")
    assert got == brute(data, 5, "inner_product")
    assert taken < 2000**2 / 3


def test_boxes_l2(spark, monkeypatch):
    data = few_values(2000, 5)
    got, taken = met_by_boxes(spark, monkeypatch, data, 5, "l2")
    assert got == brute(data, 5, "l2")
    assert taken < 2000**2 / 3


@pytest.mark.parametrize("metric", ["l2", "inner_product"])
def test_rows_look_at_near_boxes_only(spark, monkeypatch, metric):
    """A box leaves most others out as a whole, before each of its rows looks at them."""
    monkeypatch.setattr(exact, "CUT", 4)
    data, looked, m = few_values(3000, 6), spark.sparkContext.accumulator(0), D.metric(metric)

    def counted(a, low, high):
        looked.add(len(a) * len(low))
        return m.bound(a, low, high)

    got = exact_knn(from_array(spark, data), 4, replace(m, bound=counted), block=32)
    assert lists(got) == brute(data, 4, metric)
    assert looked.value < 3000 * math.ceil(3000 / 32) / 2


@pytest.mark.parametrize("name", ["l2", "inner_product"])
def test_apart_is_no_more_than_any_bound(name):
    m, rng = D.metric(name), np.random.default_rng(3)
    for scale, offset in ((1.0, 0.0), (1e-9, 1e4), (1e160, 0.0)):
        rows = rng.normal(size=(40, 3)) * scale + offset
        low = rng.normal(size=(60, 3)) * scale + offset
        high = low + rng.exponential(size=low.shape) * scale
        assert not (m.apart(rows.min(0), rows.max(0), low, high) > m.bound(rows, low, high)).any()


def test_boxes_of_other_shapes(spark):
    """Points that differ in the last bits, one component, and a k of more than a block."""
    for data, k in ((synthetic(300, 3, 8).astype(float) * 1e-9 + 1e4, 6), (np.arange(400.0)[:, None] % 37, 4), (points(200, 2, 90), 45)):
        for metric in ("l2", "inner_product"):
            assert lists(exact_knn(from_array(spark, data), k, metric, block=16)) == brute(data, k, metric)


def test_cells():
    data, ids = np.repeat([[1.0, 2.0]], 100, 0), np.arange(100)[::-1].copy()
    found = cells(data, ids, 16)
    assert max(map(len, found)) <= 16 and sorted(np.concatenate(found)) == list(range(100))
    assert all((np.diff(ids[x]) > 0).all() for x in found)


def test_row_best():
    dist = np.array([[0.0, 2.0, 1.0, 1.0], [3.0, 0.0, np.nan, np.inf]])
    assert [x.tolist() for x in row_best(dist, 2, False)] == [[0, 0, 1, 1], [0, 2, 1, 0]]
    assert [x.tolist() for x in row_best(dist, 4, False)] == [[0] * 4 + [1] * 4, [0, 2, 3, 1, 1, 0, 3, 2]]
    square = np.array([[np.inf, np.nan], [1.0, np.inf]])
    assert [x.tolist() for x in row_best(square, 1, True)] == [[0, 1], [1, 0]]


@pytest.mark.parametrize("name", ["l2", "inner_product"])
def test_tiles_are_left_folds(name):
    a, b, m = synthetic(9, 33, 5).astype(float), synthetic(7, 33, 6).astype(float), D.metric(name)
    assert all((row == m.rows(np.broadcast_to(x, b.shape), b)).all() for row, x in zip(m.distances(a, b), a, strict=True))


@pytest.mark.parametrize("name", ["l2", "inner_product"])
@pytest.mark.parametrize("shape", [(3, 1, 200), (1, 1, 9), (4, 2, 50), (2, 3, 1000), (5, 260, 64), (3, 129, 300), (2, 5, 1), (2, 4, 0), (0, 3, 4), (3, 0, 4)])
def test_folds_of_any_shape(name, shape):
    """One column, columns of several strips, many components, one and none: each sum is taken in order."""
    rng, m = np.random.default_rng(1), D.metric(name)
    a, b = rng.normal(size=(shape[0], shape[2])), rng.normal(size=(shape[1], shape[2]))
    got = m.distances(a, b)
    assert got.shape == shape[:2]
    assert all((row == m.rows(np.broadcast_to(x, b.shape), b)).all() for row, x in zip(got, a, strict=True))
