"""True graphs on disk, found again by what they were made from."""

from __future__ import annotations

import struct
from pathlib import PurePosixPath

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.functions import distance as D
from proxigraph.operators.exact import exact_knn
from proxigraph.sources.vectors import shape

#: 64-bit FNV-1a (fixed values).
OFFSET, PRIME, MASK = 14695981039346656037, 1099511628211, (1 << 64) - 1


def fnv1a(data: bytes, state: int = OFFSET) -> int:
    for byte in data:
        state = (state ^ byte) * PRIME & MASK
    return state


def dataset_hash(matrix: np.ndarray) -> int:
    """Of n, d and the rows as float32; sequential, for matrices in the driver's memory."""
    n, d = matrix.shape
    return fnv1a(np.ascontiguousarray(matrix, "<f4").tobytes(), fnv1a(struct.pack("<QQ", n, d)))


def table_hash(vecs: DataFrame) -> int:
    """Of a table: one aggregation, whatever the order of rows; n and d count as well."""
    row = F.xxhash64("vec_id", F.col("v").cast("array<float>"))
    r = vecs.agg(F.bit_xor(row), F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.bit_xor(F.xxhash64(F.lit("second"), "vec_id", F.col("v").cast("array<float>")))).first()
    return fnv1a(struct.pack("<qqqq", r[0] or 0, r[1], r[2], r[3] or 0))


def cache_path(dataset: str, k: int, metric: str | D.Metric = "l2") -> str:
    """Beside the dataset, named after it."""
    where = PurePosixPath(dataset)
    return str(where.with_name(f"{where.stem}.k{k}.{D.metric(metric).file_tag}.gt"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def save(edges: DataFrame, path: str, key: int, n: int, k: int, metric: str | D.Metric = "l2") -> None:
    """Spark's committer makes the table appear as a whole or not at all."""
    stamped = edges.select("src", "dst", "dist", "rk", F.lit(_signed(key)).alias("key"), F.lit(n).cast("long").alias("n"), F.lit(k).alias("k"), F.lit(D.metric(metric).wire_id).alias("metric"))
    stamped.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, key: int, n: int, k: int, metric: str | D.Metric = "l2") -> DataFrame | None:
    """The graph, or None if there is none, it can't be read, or it was made from something else."""
    try:
        stored = spark.read.parquet(path)
        r = stored.agg(F.count(F.lit(1)), *[f(c) for c in ("key", "n", "k", "metric") for f in (F.min, F.max)]).first()
        edges = stored.select("src", "dst", "dist", "rk")
    except AnalysisException:
        return None
    except Exception as e:  # a file that is no Parquet fails in a task
        if "parquet" not in str(e).lower():
            raise
        return None
    want = (_signed(key), n, k, D.metric(metric).wire_id)
    return edges if tuple(r) == (n * k, *(x for w in want for x in (w, w))) else None


def load_or_compute(vecs: DataFrame, k: int, path: str, metric: str | D.Metric = "l2") -> DataFrame:
    """The stored graph if it fits vecs, k and metric; else computed and stored."""
    spark, (n, _), key = vecs.sparkSession, shape(vecs), table_hash(vecs)
    found = load(spark, path, key, n, k, metric)
    if found is None:
        save(exact_knn(vecs, k, metric), path, key, n, k, metric)
        found = load(spark, path, key, n, k, metric)
        if found is None:
            raise OSError(f"{path} can't be read back")
    return found
