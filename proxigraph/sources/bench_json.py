"""Benchmark results as JSON, flattened to one row a measured run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Counters of a run; files keep them in its row or in an object ``counters`` there.
COUNTERS = ("n", "d", "k", "recall_at_k", "peak_memory_mb", "n_distance_computations", "threads", "use_reverse", "rho", "iterations")


def _counter(name: str) -> Column:
    row = F.col("row")
    return F.coalesce(F.get_json_object(row["counters"], f"$.{name}"), row[name]).cast("double").alias(name)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """run_name, real_time and COUNTERS (null where a run has none). Rows of aggregates over repetitions are dropped."""
    rows = spark.read.schema("benchmarks array<map<string,string>>").json(path, multiLine=True).select(F.explode("benchmarks").alias("row"))
    runs = rows.where(F.col("row")["run_type"] == "iteration")
    return runs.select(F.col("row")["run_name"].alias("run_name"), F.col("row")["real_time"].cast("double").alias("real_time"), *map(_counter, COUNTERS))


def of_shape(runs: DataFrame, n: int, d: int) -> DataFrame:
    """Runs whose name carries these sizes."""
    return runs.where(F.col("run_name").contains(f"/{n}/{d}"))


def ladder(runs: DataFrame) -> DataFrame:
    """Single-threaded variants: those that report no threads."""
    return runs.where(F.col("threads").isNull()).select("run_name", "real_time", "recall_at_k")


def scaling(runs: DataFrame) -> DataFrame:
    """Parallel variants by threads, with the speed-up over the family's fewest threads."""
    family = F.regexp_extract("run_name", r"^[^/]+", 0)
    rows = runs.where(F.col("threads").isNotNull()).select(family.alias("family"), "threads", "real_time", "recall_at_k")
    base = rows.groupBy("family").agg(F.min_by("real_time", "threads").alias("base"))
    return rows.join(base, "family").select("family", "threads", "real_time", (F.col("base") / F.col("real_time")).alias("speedup"), "recall_at_k")


def series(runs: DataFrame) -> DataFrame:
    """What a plot of recall, time or memory over n shows, in order, by dimension."""
    return runs.where(F.col("d").isNotNull()).select("d", "n", "run_name", "real_time", "recall_at_k", "peak_memory_mb").orderBy("d", "n", "run_name")
