import numpy as np
import pytest
from pyspark.sql import functions as F

from proxigraph.functions import distance as D
from proxigraph.operators import graph as G
from proxigraph.operators import recall as R
from proxigraph.operators.exact import STRATEGIES, best, block_best, exact_knn
from proxigraph.sources.vectors import from_array, point, shape, synthetic, vectors

#: Two clusters of four; every point has a tie at distance 1.
POINTS = np.array([(0, 0), (1, 0), (0, 1), (1, 1), (4, 4), (5, 4), (4, 5), (5, 5)], float)
NEAR = [[1, 2, 3], [0, 3, 2], [0, 3, 1], [1, 2, 0], [5, 6, 7], [4, 7, 6], [4, 7, 5], [5, 6, 4]]


def lists(edges):
    out = {}
    for r in sorted(edges.collect(), key=lambda r: (r["src"], r["rk"])):
        out.setdefault(r["src"], []).append((r["dst"], r["dist"]))
    return out


def brute(data, k, metric):
    rows = D.metric(metric).rows
    out = {}
    for i in range(len(data)):
        dist = rows(np.broadcast_to(data[i], data.shape), data)
        order = [j for j in np.lexsort((np.arange(len(data)), dist)) if j != i][:k]
        out[i] = [(j, dist[j]) for j in order]
    return out


@pytest.fixture(scope="module")
def eight(spark):
    return from_array(spark, POINTS).cache()


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_two_clusters(eight, strategy):
    for block in (2048, 3, 1):
        got = lists(exact_knn(eight, 3, strategy=strategy, block=block))
        assert [[d for d, _ in got[i]] for i in range(8)] == NEAR
        assert all([x for _, x in got[i]] == [1, 1, 2] for i in range(8))
        if strategy in ("native", "norms", "sort_slice"):
            break
    assert {i: e[0][0] for i, e in lists(exact_knn(eight, 1, strategy=strategy)).items()}[3] == 1


@pytest.mark.parametrize("metric", ["l2", "inner_product"])
def test_strategies_agree(spark, metric):
    data = np.round(synthetic(60, 5, 7).astype(float), 1)  # rounded, so that there are ties
    data[50:] = data[:10]
    vecs = from_array(spark, data).cache()
    want = brute(data, 7, metric)
    for strategy in ("gemm", "native", "tiled", "sort_slice"):
        assert lists(exact_knn(vecs, 7, metric, strategy, block=16)) == want, strategy
    if metric == "l2":
        got = lists(exact_knn(vecs, 7, metric, "norms"))
        assert all(np.allclose([x for _, x in got[i]], [x for _, x in want[i]]) for i in want)
    else:
        with pytest.raises(ValueError):
            exact_knn(vecs, 7, metric, "norms")


def test_gemm_is_exact_where_the_product_is_not(spark):
    """Large offsets cost the product all its digits; the exact pass must still see every candidate."""
    data = synthetic(80, 4, 3).astype(float) * 1e-4 + 1e4
    assert lists(exact_knn(from_array(spark, data), 5, block=20)) == brute(data, 5, "l2")


def test_own_metric(spark, eight):
    l1 = D.Metric("l1", 9, "l1", lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x), lambda a, b: np.abs(a - b).sum(1))
    assert lists(exact_knn(eight, 3, l1)) == lists(exact_knn(eight, 3, l1, "native"))


def test_ramp(spark):
    data = np.repeat([[(i + 1) * 0.1] for i in range(10)], 4, axis=1)
    got, want = lists(exact_knn(from_array(spark, data), 3)), brute(data, 3, "l2")
    assert all(np.allclose([x for _, x in got[i]], [x for _, x in want[i]]) for i in want)


def test_errors(spark, eight):
    for k in (0, 8, -1):
        with pytest.raises(ValueError):
            exact_knn(eight, k)
    with pytest.raises(ValueError):
        exact_knn(eight.limit(0), 1)
    with pytest.raises(ValueError):
        exact_knn(eight, 2, "no such")
    with pytest.raises(ValueError):
        exact_knn(eight, 2, strategy="no such")
    bad = [[(1, [1.0]), (1, [2.0])], [(1, [1.0]), (2, [1.0, 2.0])], [(1, [float("nan")]), (2, [1.0])], [(None, [1.0]), (2, [1.0])], [(1, None), (2, [1.0])], [(1, [None]), (2, [1.0])], [(1, [float("inf")]), (2, [1.0])]]
    for rows in bad:
        with pytest.raises(ValueError):
            exact_knn(spark.createDataFrame(rows, "vec_id long, v array<double>"), 1)


def test_block_best_without_candidates():
    src, dst, dist = block_best(np.ones((1, 2)), np.array([4]), np.ones((1, 2)), np.array([4]), 3, D.L2)
    assert len(src) == len(dst) == len(dist) == 0


def test_top_k(spark):
    rows = [(0, i, d) for i, d in enumerate([0.7, 0.1, 0.9, 0.4, 0.2, 0.8, 0.3, 0.6, 0.5, 0.95])] + [(1, d, 1.0) for d in (7, 2, 5)]
    df = spark.createDataFrame(rows, "src long, dst long, dist double")
    assert {s: [d for d, _ in e] for s, e in lists(best(df, 3)).items()} == {0: [1, 4, 6], 1: [2, 5, 7]}
    assert best(df, 0).count() == 0


def test_merge(spark):
    old = spark.createDataFrame([(0, 5, 1.0, False), (0, 8, 1.0, False), (1, 7, 0.5, False), (2, 7, 0.9, False), (3, 3, 0.7, True), (3, 2, 0.5, True), (3, 1, 0.3, True), (4, 1, 0.5, False)], "src long, dst long, dist double, is_new boolean")
    new = spark.createDataFrame([(0, 3, 1.0), (1, 7, 0.9), (2, 7, 0.4), (3, 4, 0.1), (3, 5, 1.0), (4, 1, 0.5)], "src long, dst long, dist double")
    got = {}
    for r in sorted(G.merge(old, new, 3).collect(), key=lambda r: (r["src"], r["rk"])):
        got.setdefault(r["src"], []).append((r["dst"], r["dist"], r["is_new"]))
    assert got[0] == [(3, 1.0, True), (5, 1.0, False), (8, 1.0, False)]
    assert got[1] == [(7, 0.5, False)] and got[2] == [(7, 0.4, True)] and got[4] == [(1, 0.5, False)]
    assert [d for d, _, _ in got[3]] == [4, 1, 2]
    assert sorted(r["dst"] for r in G.merge(old, new, 2).where("src = 0").collect()) == [3, 5]
    assert not any(r["is_new"] for r in G.mark_all_old(old).collect())


def test_forms(spark, eight):
    edges = exact_knn(eight, 3)
    wide = {r["src"]: r for r in G.wide(edges).collect()}
    assert wide[4]["neighbors"] == [5, 6, 7] and wide[4]["distances"] == [1, 1, 2]
    assert lists(G.long(G.wide(edges))) == lists(edges)
    assert [r["dst"] for r in G.neighbors_of(edges, 1).collect()] == [0, 3, 2]
    worst = {r["src"]: r["worst"] for r in G.worst_distance(edges, spark.range(9).select(F.col("id").alias("src"))).collect()}
    assert worst[0] == 2 and worst[8] == float("inf")
    assert sum(r["in_degree"] for r in G.in_degree(edges).collect()) == 24
    assert G.mutual(edges).count() == 12
    assert point(eight, 3).first()["v"] == [1, 1]


def test_recall(spark):
    def graph(rows):
        return spark.createDataFrame([(i, d, float(j), j + 1) for i, r in enumerate(rows) for j, d in enumerate(r)], "src long, dst long, dist double, rk int")

    truth = graph([(1, 2, 3), (0, 2, 3), (0, 1, 3), (0, 1, 2)])
    assert R.recall_at_k(graph([(3, 1, 2), (2, 0, 3), (3, 1, 0), (1, 2, 0)]), truth) == 1
    assert R.recall_at_k(graph([(4, 5, 6)] * 4), truth) == 0
    half = graph([(1, 2, 99), (0, 2, 3), (0, 88, 99), (77, 88, 99)])
    assert R.recall_at_k(half, truth) == 0.5
    assert [r["hits"] for r in R.recall_per_row(half, truth).orderBy("src").collect()] == [2, 3, 1, 0]
    assert R.recall_at_k(graph([(1, 1, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0)]), truth) == 4 / 12
    assert R.recall_at_k(truth.limit(0), truth.limit(0)) == 1
    for other in (graph([(1, 2, 3)] * 3), graph([(1, 2, 3, 4)] * 4)):
        with pytest.raises(ValueError):
            R.recall_at_k(other, truth)


def test_shards(spark):
    assert G.shard_bounds(8, 4) == [(0, 0, 2), (1, 2, 2), (2, 4, 2), (3, 6, 2)]
    assert G.shard_bounds(10, 3) == [(0, 0, 3), (1, 3, 3), (2, 6, 4)]
    ids = spark.range(10).select("id", G.shard_of(F.col("id"), 10, 3).alias("s"))
    assert [r["s"] for r in ids.orderBy("id").collect()] == [0] * 3 + [1] * 3 + [2] * 4
    with pytest.raises(ValueError):
        G.shard_bounds(3, 0)
    assert G.scatter(from_array(spark, POINTS), 3).count() == 8


def test_requests(spark):
    asked = {0: [10, 10, 20, 20, 30], 1: [1, 1, 2]}
    df = spark.createDataFrame([(s, i) for s, r in asked.items() for i in r], "shard int, vec_id long")
    stats = G.request_stats(df)
    assert [(r["raw"], r["dedup"]) for r in stats.orderBy("shard").collect()] == [(5, 3), (3, 2)]
    total = G.total_request_stats(stats).first()
    assert (total["raw"], total["dedup"], total["reduction_fraction"]) == (8, 5, 3 / 8)
    assert G.total_request_stats(stats.limit(0)).first()["reduction_fraction"] == 0


def test_ingest(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert shape(vectors(df)) == (500, 64)
