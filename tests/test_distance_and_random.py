import numpy as np
import pytest
from pyspark.sql import functions as F

from proxigraph.functions import counters
from proxigraph.functions import distance as D
from proxigraph.functions.random import MASK, XorShift64, below, float01, iteration_seed, step

PAIRS = [([0, 0, 0], [3, 4, 0]), ([], []), ([5], [2]), ([1, 2, 3], [4, 5, 6]), ([i + 1 for i in range(16)], [-i - 1 for i in range(16)]), ([0.5 * i for i in range(17)], [0.25 * i for i in range(17)]), ([float(i) for i in range(23)], [float(23 - i) for i in range(23)])]


@pytest.fixture(scope="module")
def computed(spark):
    df = spark.createDataFrame([(i, [float(x) for x in a], [float(x) for x in b]) for i, (a, b) in enumerate(PAIRS)], "i int, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    norms = D.l2_from_norms(D.norm_squared(a), D.norm_squared(b), D.dot_product(a, b))
    rows = df.select("i", D.squared_l2(a, b).alias("l2"), D.negative_inner_product(a, b).alias("ip"), D.dot_product(a, b).alias("dot"), D.norm_squared(a).alias("norm"), norms.alias("norms")).orderBy("i").collect()
    return rows


def test_hand_values(computed):
    assert [r["l2"] for r in computed[:5]] == [25, 0, 9, 27, 5984]
    assert computed[3]["ip"] == -32 and computed[3]["dot"] == 32 and computed[3]["norm"] == 14
    assert all(np.isclose(r["norms"], r["l2"]) for r in computed)
    assert str(computed[1]["ip"]) == "0.0"


def test_numpy_gives_the_same_bits(computed):
    for r, (a, b) in zip(computed, PAIRS, strict=True):
        a, b = np.array([a], float), np.array([b], float)
        assert D.np_squared_l2(a, b)[0] == r["l2"] and D.np_negative_inner_product(a, b)[0] == r["ip"]
        assert np.isclose(D.L2.block(a, b)[0, 0], r["l2"]) and np.isclose(D.INNER_PRODUCT.block(a, b)[0, 0], r["ip"])


def test_norm_identity_is_cut_at_zero(spark):
    assert spark.range(1).select(D.l2_from_norms(F.lit(1.0), F.lit(1.0), F.lit(1.0000001)).alias("x")).first()["x"] == 0


def test_metric_registry():
    assert D.metric("l2") is D.L2 and D.metric(D.L2) is D.L2
    with pytest.raises(ValueError):
        D.metric("cosine")


def test_generator():
    with pytest.raises(ValueError):
        XorShift64(0)
    r = XorShift64(42)
    with pytest.raises(ValueError):
        r.reseed(0)
    first = [r.next() for _ in range(5)]
    assert len(set(first)) == 5 and first == [XorShift64(42).next(), *first[1:]]
    state = r.state
    again = [r.next() for _ in range(5)]
    r.reseed(state)
    assert [r.next() for _ in range(5)] == again
    before = r.state
    assert r.next_below(0) == r.next_below(1) == 0 and r.state == before
    assert XorShift64(1).next() == 1082269761


def test_generator_is_even():
    r = XorShift64(77777)
    assert min(np.bincount([r.next_below(20) for _ in range(100_000)], minlength=20)) > 1000
    floats = [r.next_float01() for _ in range(10_000)]
    assert 0 <= min(floats) and max(floats) < 1 and abs(np.mean(floats) - 0.5) < 0.02


def test_sql_step_equals_generator(spark):
    seeds = [1, 42, 2**63 - 1, -1, -(2**63), 123456789, -987654321]
    x = spark.createDataFrame([(s,) for s in seeds], "x long").withColumn("y", step(F.col("x")))
    for r in x.select("x", "y", float01(F.col("y")).alias("f"), below(F.col("y"), 1000).alias("b")).collect():
        one, two, three = (XorShift64(r["x"] & MASK) for _ in range(3))
        assert r["y"] & MASK == one.next() and r["f"] == two.next_float01() and r["b"] == three.next_below(1000)
    with pytest.raises(ValueError):
        below(F.col("y"), 1 << 31)


def test_iteration_seeds_differ():
    assert len({iteration_seed(42, i) for i in range(100)}) == 100


def test_counters():
    assert [counters.exact_distance_count(n) for n in (0, 1, 2, 500)] == [0, 0, 2, 249_500]
    assert counters.descent_distance_estimate(10, 3, 2) == 180
    assert counters.counters(4, 2, 1, 1.0, 12)["peak_memory_mb"] > 0
