"""Exact top-k search by integer inner product: tiled matrix products, partial selection, tree merging.

Candidates are dealt to shards and queries to blocks, both by a hash of the
row's number and both of bounded expected size, so no matrix grows with the
data. A query block is sent to every shard by an equi-join on the shard's
number and the block's group of GROUP blocks, so that a shard's tiles are
several tasks; each pair is one tile: one matrix product, of which only the k
best per query leave the worker. The lists are merged by a tree of window
top-k steps with a bounded fan-in, so that no task sees all lists of a query.

Defined results: vectors that are null or hold a null or non-finite
component take no part, nor do rows without an id. Rows that share an id are
rows of their own: a query's own row, told by its number, is left out, its
twin isn't. Vectors of unequal length are compared as if the shorter ended in
zeros; an empty vector scores 0 with all; a very long one is one row of its
tile. Scores beyond 64 bits are held at its limits. Ties go to the smaller
id. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxigraph.llm.common import table, through_files

SCALE = 256.0
#: Query blocks of a shard that one task takes.
GROUP = 64
PACKED = "part int, n int, d int, rows binary, ids binary, units binary"
_LIMIT = 2**63 - 1


def usable(vector: Column) -> Column:
    x = vector.cast("array<double>")
    return F.coalesce(F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))), F.lit(False))


def _units(vectors: list[np.ndarray]) -> np.ndarray:
    """floor(256 x) as float64 rows, padded with zeros; whole numbers below 2^53 are exact."""
    out = np.zeros((len(vectors), max((len(v) for v in vectors), default=0)))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = np.floor(SCALE * v.astype(np.float64))
    return out


def _pack(groups: pa.Table) -> pa.Table:
    units = _units([np.asarray(v.values) for v in groups["vec"]])
    row = {"part": [groups["part"][0].as_py()], "n": [len(units)], "d": [units.shape[1]], "rows": [groups["row"].to_numpy().astype("<i8").tobytes()], "ids": [groups["id"].to_numpy().astype("<i8").tobytes()], "units": [units.astype("<f8").tobytes()]}
    return pa.table(row, schema=pa.schema([("part", pa.int32()), ("n", pa.int32()), ("d", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("units", pa.binary())]))


def _packed(rows: DataFrame, parts: int, salt: str) -> DataFrame:
    """One row a part; a part has about so many rows as asked for, as rows' numbers are unique and hashed."""
    return rows.withColumn("part", F.pmod(F.xxhash64(F.lit(salt), F.col("row")), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(_pack, PACKED)


def tile_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole rows: float64 where every sum is below 2^53, int64 below 2^63, else Python integers."""
    bound = (np.abs(q).max(initial=0.0)) * (np.abs(x).max(initial=0.0)) * max(1, q.shape[1])
    if bound < 2**53:
        return (q @ x.T).astype(np.int64)
    if bound < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    exact = np.vectorize(int, otypes=[object])
    return np.array([[max(-_LIMIT - 1, min(_LIMIT, v)) for v in row] for row in exact(q).dot(exact(x).T)], dtype=np.int64).reshape(len(q), len(x))


def tile_top(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and score of the k best of each row; of equal scores the first candidates. own: what is left out."""
    n = scores.shape[1]
    scores = np.where(own, -_LIMIT - 1, scores)
    keep = min(k, n)
    if keep == 0 or len(scores) == 0:
        return (np.zeros(0, np.int64),) * 3
    cut = np.partition(scores, n - keep, axis=1)[:, n - keep, None]
    at, which = np.nonzero((scores >= cut) & ~own)
    value = scores[at, which]
    order = np.lexsort((which, ~value, at))
    at, which, value = at[order], which[order], value[order]
    first = np.searchsorted(at, at, "left")
    best = np.arange(len(at)) - first < k
    return at[best], which[best], value[best]


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                q = np.frombuffer(r["q_units"], "<f8").reshape(r["q_n"], r["q_d"])
                x = np.frombuffer(r["units"], "<f8").reshape(r["n"], r["d"])
                q_rows, q_ids, x_rows, x_ids = (np.frombuffer(r[c], "<i8") for c in ("q_rows", "q_ids", "rows", "ids"))
                order = np.lexsort((x_rows, x_ids))
                x, x_ids, x_rows, d = x[order], x_ids[order], x_rows[order], min(r["q_d"], r["d"])
                at, which, value = tile_top(tile_scores(q[:, :d], x[:, :d]), q_rows[:, None] == x_rows, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_rows[at]), pa.array(q_ids[at]), pa.array(x_rows[which]), pa.array(x_ids[which]), pa.array(value), pa.array(np.full(len(at), r["part"], np.int32))], ["q_row", "query_id", "row", "vec_id", "score", "part"])

    return run


def topk_search(candidates: DataFrame, queries: DataFrame, k: int, shard_rows: int = 2048, block_rows: int = 512, fan_in: int = 32) -> DataFrame:
    """Both inputs: row (a number that tells rows apart), id long, vec array. Returns query_id, rank, vec_id, score: the k highest scores of each query among the candidates of another row."""
    if k < 1:
        raise ValueError("k must be at least 1")
    clean = lambda df: df.where(F.col("id").isNotNull() & usable(F.col("vec"))).select("row", "id", F.col("vec").cast("array<double>").alias("vec"))
    shards = max(1, math.ceil(candidates.count() / shard_rows))
    blocks = max(1, math.ceil(queries.count() / block_rows))
    groups = math.ceil(blocks / GROUP)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    packed = _packed(clean(candidates), shards, "shard").withColumn("group", every(groups))
    asked = _packed(clean(queries), blocks, "block").select(F.floor(F.col("part") / GROUP).cast("int").alias("group"), *[F.col(c).alias(f"q_{c}") for c in ("n", "d", "rows", "ids", "units")], every(shards).alias("part"))
    # No broadcast: what is packed grows with the tables.
    best = asked.hint("merge").join(packed.hint("merge"), ["part", "group"]).mapInArrow(_tiles(k), "q_row long, query_id long, row long, vec_id long, score long, part int")
    order = [F.col("score").desc(), F.col("vec_id"), F.col("row")]
    while shards > fan_in:
        shards = math.ceil(shards / fan_in)
        best = best.withColumn("part", F.pmod("part", F.lit(shards)).cast("int"))
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("q_row", "part").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("q_row").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with row, in a written table, as queries and candidates must see the same numbers."""
    return through_files(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 50; candidates: all rows; 5 best each."""
    rows = numbered(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))
    return topk_search(rows, rows.where(F.col("id") % 50 == 0), 5)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS u FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.u, c.u), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
