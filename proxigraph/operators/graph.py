"""Graphs as edge tables (src, dst, dist, rk), their wide form, and what can be read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wide(edges: DataFrame) -> DataFrame:
    """src, neighbors, distances: one row a point, nearest first."""
    near = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("near"))
    return near.select("src", F.col("near.dst").alias("neighbors"), F.col("near.dist").alias("distances"))


def long(graph: DataFrame) -> DataFrame:
    """The edge table of a wide graph."""
    rows = graph.select("src", F.posexplode(F.arrays_zip("neighbors", "distances")).alias("at", "e"))
    return rows.select("src", F.col("e.neighbors").alias("dst"), F.col("e.distances").alias("dist"), (F.col("at") + 1).alias("rk"))


def neighbors_of(edges: DataFrame, src: int) -> DataFrame:
    return edges.where(F.col("src") == src).orderBy("rk").select("rk", "dst", "dist")


def worst_distance(edges: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """src, worst: the largest distance in each list; infinity for points (src) without one."""
    found = edges.groupBy("src").agg(F.max("dist").alias("worst"))
    if points is None:
        return found
    return points.select("src").join(found, "src", "left").select("src", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))


def merge(edges: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Bounded lists (src, dst, dist, is_new) after offering candidates (src, dst, dist): one entry an id, the k smallest by (dist, dst).

    An id that is in the list already keeps its flag unless it comes nearer; what comes in is new.
    """
    offered = candidates.groupBy("src", "dst").agg(F.min("dist").alias("dist")).withColumn("is_new", F.lit(True))
    rows = edges.select("src", "dst", "dist", "is_new").unionByName(offered.select("src", "dst", "dist", "is_new"))
    # Of equal distances the old entry stands: false sorts before true.
    first = rows.groupBy("src", "dst").agg(F.min(F.struct("dist", "is_new")).alias("e")).select("src", "dst", "e.dist", "e.is_new")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return first.withColumn("rk", rank).where(F.col("rk") <= k)


def mark_all_old(edges: DataFrame) -> DataFrame:
    return edges.withColumn("is_new", F.lit(False))


def reverse(edges: DataFrame) -> DataFrame:
    """The same edges seen from their targets."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("vec_id")).agg(F.count(F.lit(1)).alias("in_degree"))


def mutual(edges: DataFrame) -> DataFrame:
    """Edges that exist both ways, each once with src < dst."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.where("src < dst").join(back, ["src", "dst"], "left_semi").select("src", "dst", "dist")


def candidates(edges: DataFrame, use_reverse: bool = True) -> DataFrame:
    """p, u, is_new: for each pivot its neighbours and, with use_reverse, those that have it as a neighbour; a new sighting wins."""
    seen = edges.select(F.col("src").alias("p"), F.col("dst").alias("u"), "is_new")
    if use_reverse:
        seen = seen.unionByName(edges.select(F.col("dst").alias("p"), F.col("src").alias("u"), "is_new"))
    return seen.groupBy("p", "u").agg(F.max("is_new").alias("is_new"))


def joined_pairs(cands: DataFrame) -> DataFrame:
    """u < w, once over all pivots: pairs of a pivot's candidates of which one at least is new."""
    a = cands.select("p", "u", F.col("is_new").alias("new_u"))
    b = cands.select("p", F.col("u").alias("w"), F.col("is_new").alias("new_w"))
    return a.join(b, "p").where((F.col("u") < F.col("w")) & (F.col("new_u") | F.col("new_w"))).select("u", "w").distinct()


def shard_of(vec_id, n: int, shards: int):
    """Contiguous ranges of ids 0..n-1; the last shard takes the remainder."""
    if shards < 1:
        raise ValueError("there must be a shard")
    size = n // shards
    return F.least(F.floor(vec_id / size), F.lit(shards - 1)).cast("int") if size else F.lit(shards - 1)


def shard_bounds(n: int, shards: int) -> list[tuple[int, int, int]]:
    """(shard, first id, ids)."""
    if shards < 1:
        raise ValueError("there must be a shard")
    size = n // shards
    return [(r, r * size, size if r < shards - 1 else n - size * (shards - 1)) for r in range(shards)]


def scatter(vecs: DataFrame, shards: int) -> DataFrame:
    """Partitions of contiguous id ranges."""
    return vecs.repartitionByRange(shards, "vec_id")


def fetch_vectors(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    """pairs (u, w) with their vectors a and b."""
    a = vecs.select(F.col("vec_id").alias("u"), F.col("v").alias("a"))
    b = vecs.select(F.col("vec_id").alias("w"), F.col("v").alias("b"))
    return pairs.join(a, "u").join(b, "w")


def request_stats(requests: DataFrame) -> DataFrame:
    """requests: shard, vec_id. shard, raw, dedup, reduction_fraction: what asking for each vector once a shard saves."""
    return _fraction(requests.groupBy("shard").agg(F.count("vec_id").alias("raw"), F.countDistinct("vec_id").alias("dedup")))


def total_request_stats(stats: DataFrame) -> DataFrame:
    """Over all shards."""
    sums = stats.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("dedup"), F.lit(0)).alias("dedup"))
    return _fraction(sums)


def _fraction(df: DataFrame) -> DataFrame:
    saved = F.when(F.col("raw") > 0, (F.col("raw") - F.col("dedup")) / F.col("raw")).otherwise(F.lit(0.0))
    return df.withColumn("reduction_fraction", saved)
