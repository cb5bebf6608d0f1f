"""Named queries over the driver's tables, each with DuckDB SQL for the same rows where SQL can express it.

``reverse_neighbors``, ``mutual_neighbors``, ``in_degree`` and
``label_agreement_at_k`` are analytics derived from the graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.functions import counters, random
from proxigraph.functions import distance as D
from proxigraph.operators import graph as G
from proxigraph.operators import nn_descent as N
from proxigraph.operators import recall as R
from proxigraph.operators.exact import BLOCK, LEAST_BLOCK, active_path, all_pairs, exact_knn
from proxigraph.sources import graph_file, ground_truth, vecs as vec_files
from proxigraph.sources.vectors import load_vectors, shape
from proxigraph.storage import scratch, through_files

K = 10
SHARDS = 7
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def _knn_sql(metric: str = "l2", k: int = K, where: str = "") -> str:
    """CTEs up to knn(src, dst, dist, rk)."""
    term = "(z[1] - z[2]) * (z[1] - z[2])" if metric == "l2" else "z[1] * z[2]"
    total = f"list_reduce(list_transform(list_zip(a.v, b.v), lambda z: {term}), lambda s, z: s + z)"
    return f"""
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings {where}),
pairs AS (SELECT a.id AS src, b.id AS dst, {total if metric == "l2" else f"0 - {total}"} AS dist FROM v a JOIN v b ON a.id <> b.id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS INTEGER) AS rk FROM pairs),
knn AS (SELECT src, dst, dist, rk FROM ranked WHERE rk <= {k})"""


L2_SQL, IP_SQL = _knn_sql(), _knn_sql("inner_product")
GRAPH = "SELECT src, dst, dist, rk FROM knn"


def _graph(spark: SparkSession, sf_dir: str, metric: str = "l2", k: int = K, **how) -> DataFrame:
    return exact_knn(load_vectors(spark, sf_dir), k, metric, **how)


@_query("knn_exact_l2", f"WITH {L2_SQL} {GRAPH}")
def knn_exact_l2(spark, sf_dir):
    return _graph(spark, sf_dir)


@_query("knn_exact_ip", f"WITH {IP_SQL} {GRAPH}")
def knn_exact_ip(spark, sf_dir):
    return _graph(spark, sf_dir, "inner_product")


@_query("knn_native_l2", f"WITH {L2_SQL} {GRAPH}")
def knn_native_l2(spark, sf_dir):
    return _graph(spark, sf_dir, strategy="native")


@_query("knn_native_ip", f"WITH {IP_SQL} {GRAPH}")
def knn_native_ip(spark, sf_dir):
    return _graph(spark, sf_dir, "inner_product", strategy="native")


@_query("knn_norms_l2", f"WITH {L2_SQL} SELECT src, dst, round(dist, 6) AS dist, rk FROM knn")
def knn_norms_l2(spark, sf_dir):
    return _graph(spark, sf_dir, strategy="norms").withColumn("dist", F.round("dist", 6))


@_query("knn_tiled_l2", f"WITH {L2_SQL} {GRAPH}")
def knn_tiled_l2(spark, sf_dir):
    return _graph(spark, sf_dir, strategy="tiled", block=256)


@_query("knn_sort_slice_l2", f"WITH {L2_SQL} {GRAPH}")
def knn_sort_slice_l2(spark, sf_dir):
    return _graph(spark, sf_dir, strategy="sort_slice")


@_query("knn_parallel_l2", f"WITH {L2_SQL} {GRAPH}")
def knn_parallel_l2(spark, sf_dir):
    return _graph(spark, sf_dir, strategy="native", parallelism=16)


@_query("knn_k1", f"WITH {_knn_sql(k=1)} {GRAPH}")
def knn_k1(spark, sf_dir):
    return _graph(spark, sf_dir, k=1)


@_query("knn_wide", f"WITH {L2_SQL} SELECT src, list(dst ORDER BY rk) AS neighbors, list(dist ORDER BY rk) AS distances FROM knn GROUP BY src")
def knn_wide(spark, sf_dir):
    return G.wide(_graph(spark, sf_dir))


@_query("knn_wide_to_long", f"WITH {L2_SQL} {GRAPH}")
def knn_wide_to_long(spark, sf_dir):
    return G.long(G.wide(_graph(spark, sf_dir)))


@_query("neighbors_of", f"WITH {L2_SQL} SELECT rk, dst, dist FROM knn WHERE src = 0")
def neighbors_of(spark, sf_dir):
    return G.neighbors_of(_graph(spark, sf_dir), 0)


@_query("pair_distances_l2", f"WITH {L2_SQL} SELECT src, dst, dist FROM pairs")
def pair_distances_l2(spark, sf_dir):
    return all_pairs(load_vectors(spark, sf_dir))


@_query("pair_distances_ip", f"WITH {IP_SQL} SELECT src, dst, dist FROM pairs")
def pair_distances_ip(spark, sf_dir):
    return all_pairs(load_vectors(spark, sf_dir), "inner_product")


@_query("norms_squared", "SELECT vec_id, list_reduce(list_transform(embedding::DOUBLE[], lambda x: x * x), lambda s, x: s + x) AS norm_squared FROM embeddings")
def norms_squared(spark, sf_dir):
    return load_vectors(spark, sf_dir).select("vec_id", D.norm_squared(F.col("v")).alias("norm_squared"))


@_query("reverse_neighbors", f"WITH {L2_SQL} SELECT dst AS vec_id, list(src ORDER BY src) AS sources FROM knn GROUP BY dst")
def reverse_neighbors(spark, sf_dir):
    return G.reverse(_graph(spark, sf_dir)).groupBy(F.col("src").alias("vec_id")).agg(F.array_sort(F.collect_list("dst")).alias("sources"))


@_query("mutual_neighbors", f"WITH {L2_SQL} SELECT a.src, a.dst, a.dist FROM knn a JOIN knn b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def mutual_neighbors(spark, sf_dir):
    return G.mutual(_graph(spark, sf_dir))


@_query("in_degree", f"WITH {L2_SQL} SELECT dst AS vec_id, count(*) AS in_degree FROM knn GROUP BY dst")
def in_degree(spark, sf_dir):
    return G.in_degree(_graph(spark, sf_dir))


@_query("worst_dist", f"WITH {L2_SQL} SELECT src, max(dist) AS worst FROM knn GROUP BY src")
def worst_dist(spark, sf_dir):
    return G.worst_distance(_graph(spark, sf_dir))


@_query("recall_ip_vs_l2", f"WITH {L2_SQL}, w AS ({IP_SQL.replace('v AS', 'WITH v AS', 1)} {GRAPH}) SELECT count(*) / (SELECT count(*) FROM knn)::DOUBLE AS recall FROM knn JOIN w ON knn.src = w.src AND knn.dst = w.dst")
def recall_ip_vs_l2(spark, sf_dir):
    value = R.recall_at_k(_graph(spark, sf_dir, "inner_product"), _graph(spark, sf_dir))
    return spark.createDataFrame([(value,)], "recall double")


@_query("recall_per_row", f"WITH {L2_SQL}, a AS (SELECT * FROM knn WHERE (src + dst) % 3 <> 0) SELECT k.src, count(a.dst) AS hits FROM knn k LEFT JOIN a ON k.src = a.src AND k.dst = a.dst GROUP BY k.src")
def recall_per_row(spark, sf_dir):
    truth = _graph(spark, sf_dir)
    return R.recall_per_row(truth.where("(src + dst) % 3 <> 0"), truth)


@_query(
    "two_hop_candidates",
    f"""WITH {L2_SQL},
c AS (SELECT p, u, bool_or(is_new) AS is_new FROM (SELECT src AS p, dst AS u, rk <= 3 AS is_new FROM knn UNION ALL SELECT dst, src, rk <= 3 FROM knn) GROUP BY p, u)
SELECT DISTINCT a.u, b.u AS w FROM c a JOIN c b ON a.p = b.p AND a.u < b.u WHERE a.is_new OR b.is_new""",
)
def two_hop_candidates(spark, sf_dir):
    """Local-join pairs of the exact graph with its three nearest as new entries."""
    return G.joined_pairs(G.candidates(_graph(spark, sf_dir).withColumn("is_new", F.col("rk") <= 3)))


@_query(
    "merge_lists",
    f"""WITH {L2_SQL}, c AS (SELECT src, dst, dist, false AS is_new FROM knn WHERE rk % 2 = 0 UNION ALL SELECT src, dst, dist, true FROM knn),
m AS (SELECT src, dst, min(dist) AS dist, bool_and(is_new) AS is_new FROM c GROUP BY src, dst),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS INTEGER) AS rk FROM m)
SELECT * FROM r WHERE rk <= 5""",
)
def merge_lists(spark, sf_dir):
    """Bounded lists of the even ranks, offered the whole graph, with k = 5."""
    edges = _graph(spark, sf_dir)
    return G.merge(G.mark_all_old(edges.where("rk % 2 = 0")), edges, 5)


@_query("shard_bounds", f"WITH b AS (SELECT least(CAST(floor(vec_id / (SELECT count(*) // {SHARDS} FROM embeddings)) AS INTEGER), {SHARDS - 1}) AS shard, vec_id FROM embeddings) SELECT shard, min(vec_id) AS first, count(*) AS n FROM b GROUP BY shard")
def shard_bounds(spark, sf_dir):
    vecs = load_vectors(spark, sf_dir)
    return vecs.withColumn("shard", G.shard_of(F.col("vec_id"), vecs.count(), SHARDS)).groupBy("shard").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))


_REQUESTS = f"""WITH {L2_SQL}, r AS (SELECT least(CAST(floor(src / (SELECT count(*) // {SHARDS} FROM embeddings)) AS INTEGER), {SHARDS - 1}) AS shard, dst AS vec_id FROM knn),
s AS (SELECT shard, count(*) AS raw, count(DISTINCT vec_id) AS dedup FROM r GROUP BY shard)"""


def _requests(spark, sf_dir):
    edges, n = _graph(spark, sf_dir), load_vectors(spark, sf_dir).count()
    return G.request_stats(edges.select(G.shard_of(F.col("src"), n, SHARDS).alias("shard"), F.col("dst").alias("vec_id")))


@_query("request_dedup_stats", f"{_REQUESTS} SELECT shard, raw, dedup, (raw - dedup) / raw::DOUBLE AS reduction_fraction FROM s")
def request_dedup_stats(spark, sf_dir):
    return _requests(spark, sf_dir)


@_query("request_dedup_total", f"{_REQUESTS} SELECT CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(dedup) AS BIGINT) AS dedup, CAST(sum(raw) - sum(dedup) AS DOUBLE) / CAST(sum(raw) AS DOUBLE) AS reduction_fraction FROM s")
def request_dedup_total(spark, sf_dir):
    return G.total_request_stats(_requests(spark, sf_dir))


@_query("label_agreement_at_k", f"WITH {L2_SQL} SELECT a.label, count(*) AS edges, count(*) FILTER (WHERE a.label = b.label) AS agree FROM knn JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst GROUP BY a.label")
def label_agreement_at_k(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    edges = _graph(spark, sf_dir).join(labels.withColumnRenamed("vec_id", "src"), "src").join(labels.select(F.col("vec_id").alias("dst"), F.col("label").alias("other")), "dst")
    return edges.groupBy("label").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("label") == F.col("other")).alias("agree"))


@_query(
    "xorshift_step",
    """WITH s AS (SELECT CAST(vec_id AS HUGEINT) + 1 AS x FROM embeddings),
a AS (SELECT x, xor(x, (x * 8192) % 18446744073709551616) AS y FROM s),
b AS (SELECT x, xor(y, y // 128) AS y FROM a),
c AS (SELECT x, xor(y, (y * 131072) % 18446744073709551616) AS y FROM b)
SELECT CAST(x AS BIGINT) AS x, CAST(CASE WHEN y >= 9223372036854775808 THEN y - 18446744073709551616 ELSE y END AS BIGINT) AS next,
  CAST(y // 1099511627776 AS DOUBLE) / 16777216 AS f01, CAST(y // 4294967296 * 1000 // 4294967296 AS BIGINT) AS below FROM c""",
)
def xorshift_step(spark, sf_dir):
    """One step from each id + 1, as a long, a float in [0, 1) and a number below 1000."""
    x = load_vectors(spark, sf_dir).select((F.col("vec_id") + 1).alias("x"))
    x = x.withColumn("next", random.step(F.col("x")))
    return x.select("x", "next", random.float01(F.col("next")).alias("f01"), random.below(F.col("next"), 1000).alias("below"))


@_query("dataset_stats", "SELECT count(*) AS n, max(len(embedding)) AS d, count(*) * (count(*) - 1) AS distances FROM embeddings")
def dataset_stats(spark, sf_dir):
    n, d = shape(load_vectors(spark, sf_dir))
    return spark.createDataFrame([(n, d, counters.exact_distance_count(n))], "n long, d long, distances long")


def _part_vectors(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select(F.col("p_partkey").alias("vec_id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("v"))


_PARTS = _knn_sql("l2", 5).replace("SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings", "SELECT p_partkey AS id, [CAST(p_size AS DOUBLE), p_retailprice] AS v FROM part")
_PARTS_IP = _knn_sql("inner_product", 5).replace("SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings", "SELECT p_partkey AS id, [CAST(p_size AS DOUBLE), p_retailprice] AS v FROM part")


@_query("knn_parts_l2", f"WITH {_PARTS} {GRAPH}")
def knn_parts_l2(spark, sf_dir):
    """Vectors of any length, not of unit norm: size and price of all parts."""
    return exact_knn(_part_vectors(spark, sf_dir), 5)


@_query("knn_parts_ip", f"WITH {_PARTS_IP} {GRAPH}")
def knn_parts_ip(spark, sf_dir):
    return exact_knn(_part_vectors(spark, sf_dir), 5, "inner_product")


@_query("nn_descent")
def nn_descent(spark, sf_dir):
    return N.nn_descent(load_vectors(spark, sf_dir), K)


@_query("nn_descent_sampled")
def nn_descent_sampled(spark, sf_dir):
    return N.nn_descent(load_vectors(spark, sf_dir), K, N.Config(rho=0.5, max_iters=8))


@_query("nn_descent_forward")
def nn_descent_forward(spark, sf_dir):
    return N.nn_descent(load_vectors(spark, sf_dir), K, N.Config(use_reverse=False, max_iters=8))


@_query("nn_descent_log")
def nn_descent_log(spark, sf_dir):
    vecs = load_vectors(spark, sf_dir)
    return N.log_table(vecs, N.nn_descent_with_log(vecs, K)[1])


_L2 = "list_reduce(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda s, z: s + z)"
#: CTEs up to start(src, dst, dist): the random graph of seed 42.
_START = f"""
o AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n FROM embeddings),
t AS (SELECT id AS src, place AS own, n, unnest(range(1, {3 * K + N.SPARE + 1})) AS turn FROM o),
w AS (SELECT src, own, turn, CASE WHEN turn <= {2 * K + N.SPARE} THEN CAST('0x' || substr(md5('42:' || src || ':' || turn), 1, 12) AS BIGINT) ELSE own + turn - {2 * K + N.SPARE} END % n AS place FROM t),
d AS (SELECT src, place, row_number() OVER (PARTITION BY src ORDER BY min(turn)) AS r FROM w WHERE place <> own GROUP BY src, place),
start AS (SELECT d.src, b.id AS dst, {_L2} AS dist FROM d JOIN o b ON d.place = b.place JOIN o a ON d.src = a.id WHERE r <= {K})"""


def _step_sql(seen: str) -> str:
    """CTEs from start to step(src, dst, dist, is_new, rk): one iteration over all entries, which are new."""
    return f"""
c AS ({seen}),
j AS (SELECT DISTINCT x.u, y.u AS w FROM c x JOIN c y ON x.p = y.p AND x.u < y.u),
f AS (SELECT j.u, j.w, {_L2} AS dist FROM j JOIN o a ON a.id = j.u JOIN o b ON b.id = j.w),
m AS (
  SELECT src, dst, min(dist) AS dist, bool_and(is_new) AS is_new
  FROM (SELECT src, dst, dist, false AS is_new FROM start UNION ALL SELECT u, w, dist, true FROM f UNION ALL SELECT w, u, dist, true FROM f) GROUP BY src, dst),
step AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS INTEGER) AS rk FROM m) WHERE rk <= {K})"""


_BOTH = _step_sql("SELECT src AS p, dst AS u FROM start UNION SELECT dst, src FROM start")
_FORWARD = _step_sql("SELECT src AS p, dst AS u FROM start")


def _step(spark, sf_dir, use_reverse: bool = True):
    vecs = load_vectors(spark, sf_dir)
    start = through_files(N.init_random_graph(vecs, K), "start")
    return start, N.local_join(start, vecs, K, use_reverse=use_reverse)


@_query("init_random_graph", f"WITH {_START} SELECT *, true AS is_new, CAST(row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS INTEGER) AS rk FROM start")
def init_random_graph(spark, sf_dir):
    return N.init_random_graph(load_vectors(spark, sf_dir), K)


@_query("nn_descent_step", f"WITH {_START}, {_BOTH} SELECT * FROM step")
def nn_descent_step(spark, sf_dir):
    """The random graph after one iteration."""
    return _step(spark, sf_dir)[1].select("src", "dst", "dist", "is_new", "rk")


@_query("nn_descent_step_forward", f"WITH {_START}, {_FORWARD} SELECT * FROM step")
def nn_descent_step_forward(spark, sf_dir):
    return _step(spark, sf_dir, False)[1].select("src", "dst", "dist", "is_new", "rk")


@_query("nn_descent_step_updates", f"WITH {_START}, {_BOTH} SELECT count(*) AS updates FROM step WHERE (src, dst) NOT IN (SELECT (src, dst) FROM start)")
def nn_descent_step_updates(spark, sf_dir):
    return spark.createDataFrame([(N.count_updates(*_step(spark, sf_dir)),)], "updates long")


@_query("recall_of_step", f"WITH {_START}, {_BOTH}, {L2_SQL} SELECT count(*) / (SELECT count(*) FROM knn)::DOUBLE AS recall FROM knn JOIN step ON knn.src = step.src AND knn.dst = step.dst")
def recall_of_step(spark, sf_dir):
    """Recall of an approximate graph."""
    return spark.createDataFrame([(R.recall_at_k(_step(spark, sf_dir)[1], _graph(spark, sf_dir)),)], "recall double")


@_query("ground_truth_round_trip", f"WITH {L2_SQL} {GRAPH}")
def ground_truth_round_trip(spark, sf_dir):
    """The true graph as it is stored and found again."""
    vecs, path = load_vectors(spark, sf_dir), scratch(spark, "truth")
    ground_truth.load_or_compute(vecs, K, path)
    return ground_truth.load_or_compute(vecs, K, path)


@_query("graph_file_round_trip", f"WITH {L2_SQL} SELECT src, dst, CAST(CAST(dist AS FLOAT) AS DOUBLE) AS dist, rk FROM knn")
def graph_file_round_trip(spark, sf_dir):
    """The exact graph as its file holds it."""
    path, n = scratch(spark, "graph"), load_vectors(spark, sf_dir).count()
    graph_file.write_graph(_graph(spark, sf_dir), path, n, K)
    return graph_file.read_graph(spark, path)


def _through_vecs(spark, vecs, kind):
    path = f"{scratch(spark, 'vectors')}.{kind}"
    vec_files.write_vecs(vecs, path)
    return path


@_query("fvecs_round_trip", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, embedding AS v FROM embeddings")
def fvecs_round_trip(spark, sf_dir):
    return vec_files.read_vecs(spark, _through_vecs(spark, load_vectors(spark, sf_dir), "fvecs"))


def _whole(spark, sf_dir, low, high):
    """Vectors of whole numbers: components times 256, cut to low..high."""
    cut = F.transform("v", lambda x: F.greatest(F.lit(low), F.least(F.lit(high), F.floor(x * 256))).cast("int"))
    return load_vectors(spark, sf_dir).select("vec_id", cut.alias("v"))


def _whole_sql(low, high, element):
    return f"SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, list_transform(embedding::DOUBLE[], lambda x: CAST(greatest({low}, least({high}, floor(x * 256))) AS {element})) AS v FROM embeddings"


@_query("ivecs_round_trip", _whole_sql(-1000, 1000, "INTEGER"))
def ivecs_round_trip(spark, sf_dir):
    return vec_files.read_vecs(spark, _through_vecs(spark, _whole(spark, sf_dir, -1000, 1000), "ivecs"))


@_query("bvecs_round_trip", _whole_sql(0, 255, "SMALLINT"))
def bvecs_round_trip(spark, sf_dir):
    return vec_files.read_vecs(spark, _through_vecs(spark, _whole(spark, sf_dir, 0, 255), "bvecs"))


@_query("bvecs_as_float", _whole_sql(0, 255, "FLOAT"))
def bvecs_as_float(spark, sf_dir):
    return vec_files.read_bvecs_as_float(spark, _through_vecs(spark, _whole(spark, sf_dir, 0, 255), "bvecs"))


@_query("active_path", f"WITH s AS (SELECT count(*) AS n, least({BLOCK}, greatest({LEAST_BLOCK}, CAST(ceil(count(*) / 4) AS BIGINT))) AS block FROM embeddings) SELECT 'gemm' AS strategy, 'l2' AS metric, 'matrix_product' AS kernel, block, CAST(ceil(n / block) AS BIGINT) AS blocks FROM s")
def active_path_of_graph(spark, sf_dir):
    """How the graph of the embeddings is computed on eight cores."""
    return active_path(load_vectors(spark, sf_dir), parallelism=8)
