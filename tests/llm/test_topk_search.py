"""Exact top-k search (5) against whole-number arithmetic on all pairs."""

import math
import random

import numpy as np
import pytest

from proxigraph.llm import topk_search as S


def units(v):
    return [math.floor(256 * x) for x in v]


def brute(rows, k, is_query):
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, vec) in enumerate(good):
        if is_query(q):
            scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(units(vec), units(v), strict=False)))), i) for other, (i, v) in enumerate(good) if other != at]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def table(spark, rows):
    return S.numbered(spark.createDataFrame(rows, "id long, vec array<double>").repartition(3))


def test_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.7]) for _ in range(4)]) for i in range(300)]  # many ties
    rows += [(400, None), (401, [1.0, None, 1.0, 1.0]), (402, [float("nan")] * 4), (450, [float("inf")] * 4), (None, [1.0] * 4), (7, [9.0] * 4), (7, [9.0] * 4), (500, []), (501, [1.0]), (550, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])]
    df = table(spark, rows)
    for shard_rows, block_rows, fan_in in ((2048, 512, 32), (20, 3, 2), (1, 1, 4)):
        if shard_rows == 1:
            df = table(spark, rows[:40])
        got = S.topk_search(df, df.where("id % 50 = 0 or id % 7 = 0"), 5, shard_rows, block_rows, fan_in).collect()
        want = brute(rows if shard_rows > 1 else rows[:40], 5, lambda q: q % 50 == 0 or q % 7 == 0)
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


def test_few_and_none(spark):
    df = table(spark, [(0, [1.0]), (1, [2.0]), (2, [3.0])])
    assert [r["vec_id"] for r in S.topk_search(df, df.where("id = 0"), 5).orderBy("rank").collect()] == [2, 1]
    assert S.topk_search(df.limit(0), df.limit(0), 5).count() == 0
    assert S.topk_search(df, df.limit(0), 5).count() == 0
    assert S.topk_search(df.where("id = 0"), df.where("id = 0"), 5).count() == 0
    with pytest.raises(ValueError):
        S.topk_search(df, df, 0)


def test_large_components(spark):
    rows = [(0, [1e10, 3.0]), (1, [1e10, -3.0]), (2, [2e7, 0.5]), (3, [-1e10, 1.0]), (4, [1e13, 1.0]), (5, [-1e13, 1.0])]
    df = table(spark, rows)
    got = S.topk_search(df, df, 5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 5, lambda q: True)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [3.0, 0.0]), (7, [0.5, 0.5]), (7, [0.5, 0.5])]
    df = table(spark, rows)
    got = S.topk_search(df, df.where("id = 50"), 3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 3, lambda q: q == 50)
    assert sum(r["vec_id"] == 50 for r in got) == 6


def test_groups_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 2)
    rng = random.Random(8)
    rows = [(i, [rng.random() for _ in range(3)]) for i in range(60)]
    df = table(spark, rows)
    got = S.topk_search(df, df, 4, 7, 9, 3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 4, lambda q: True)


def test_sql_gives_the_same_rows(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    got = S.op5_exact_topk(spark, "/root/testdata/sf0.001").select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(S.ORACLE).fetchall())


def test_tile_scores_are_exact():
    rng = np.random.default_rng(4)
    for scale in (10, 2**20, 2**28, 2**40):
        a, b = (rng.integers(-scale, scale, (6, 9)).astype(float) for _ in range(2))
        want = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(r, c, strict=True)))) for c in b] for r in a]
        assert S.tile_scores(a, b).tolist() == want
