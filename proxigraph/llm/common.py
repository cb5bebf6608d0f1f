"""What several of the operators share: reading tables, shared scratch folders, worker-wide state."""

from __future__ import annotations

import ctypes
import sys
import time
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.storage import removed_after, scratch, through_files

__all__ = ["lean", "release", "removed_after", "scratch", "shield", "small_batches", "table", "through_files", "worker_state"]

ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
#: Seconds between a task's returns of free memory, each of which takes some 10 ms.
RELEASE_S = 1.0


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_ROWS rows: of documents, Spark's default of 10,000 takes hundreds of MB in each worker."""
    if not 0 < int(spark.conf.get(ARROW)) <= BATCH_ROWS:
        spark.conf.set(ARROW, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shield(documents: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """documents with all columns but the needed ones under names that no operator uses, and what gives the old columns back."""
    names = {c: c if c in needed else f"x{i}_" for i, c in enumerate(documents.columns)}
    return documents.toDF(*names.values()), lambda df: df.select(*[F.col(new).alias(old) for old, new in names.items()])


def worker_state() -> types.ModuleType:
    """A place that lives as long as the Python worker, for caches that tasks share.

    Functions travel by value, so their module globals are made anew in each task.
    """
    return sys.modules.setdefault("_proxigraph_worker_state", types.ModuleType("_proxigraph_worker_state"))


def release() -> None:
    """Returns to the system what Arrow's and the C library's allocators hold free; a worker outlives its tasks, and else keeps it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that returns free memory before it begins, at times between its batches, and when it has ended."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            last = time.monotonic()
            for batch in batches:
                if time.monotonic() - last >= RELEASE_S:
                    release()
                    last = time.monotonic()
                yield batch

        release()
        yield from run(each())
        release()

    return task
