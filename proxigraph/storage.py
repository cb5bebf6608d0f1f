"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir, which the cluster sets. Only a local session may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and re.match(r"local(\[|$)", spark.sparkContext.master):
        base = f"{tempfile.gettempdir()}/proxigraph-{spark.sparkContext.applicationId}"
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The store that holds path, and path as it names it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def file_head(spark: SparkSession, path: str, length: int) -> tuple[bytes, int]:
    """A file's first bytes and its length. Raises FileNotFoundError."""
    fs, where = file_system(spark, path)
    if not fs.exists(where):
        raise FileNotFoundError(path)
    stream = fs.open(where)
    try:
        size = fs.getFileStatus(where).getLen()
        return bytes(stream.read() for _ in range(min(length, size))), size
    finally:
        stream.close()


@contextmanager
def removed_after(spark: SparkSession) -> Iterator[None]:
    """Tables that through_files writes inside are removed at the end, but for those that outlive it; an enclosing scope removes these.

    What is still needed afterwards must be written before the end: a plan that reads a removed table fails.
    """
    outer, paths = _scopes.get(), []
    token = _scopes.set((*outer, paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in paths:
            fs, where = file_system(spark, path)
            fs.delete(where, True)


def through_files(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    if scopes := _scopes.get()[: -1 if outlives else None]:
        scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
