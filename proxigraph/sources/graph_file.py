"""The binary graph format: 64 bytes of header, then ids and distances by row.

    0  8  magic "KNNGRAPH"      28  8  n (uint64)
    8  4  version 1             36  8  k (uint64)
   12  4  bytes of an id, 4     44 20  zeros
   16  4  bytes of a distance   64     n * k uint32 ids
   20  4  metric                       n * k float32 distances
   24  4  algorithm 0

Rows are those of ids in ascending order. Short lists end in the id 2^32 - 1
at an infinite distance. The file is one stream, so the driver writes it,
some rows at a time; tasks read it, in any store that Spark knows.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.functions import distance as D
from proxigraph.storage import file_head, file_system

MAGIC, VERSION, EMPTY = b"KNNGRAPH", 1, 2**32 - 1
HEADER = struct.Struct("<8sIIIIIQQ20x")


#: Bytes that are gathered before a stream gets them.
BUFFER = 1 << 20


@dataclass(frozen=True)
class Head:
    metric: int
    n: int
    k: int


def write_graph(edges: DataFrame, path: str, n: int, k: int, metric: str | D.Metric = "l2") -> None:
    """For ids 0..n-1. The file appears under its name only when it is whole."""
    fs, target = file_system(edges.sparkSession, path)
    part, rest = (file_system(edges.sparkSession, path + end)[1] for end in (".tmp", ".tmp-distances"))
    row_ids, row_dist, at = np.full(k, EMPTY, "<u4"), np.full(k, np.inf, "<f4"), 0
    streams = fs.create(part), fs.create(rest)
    held = bytearray(HEADER.pack(MAGIC, VERSION, 4, 4, D.metric(metric).wire_id, 0, n, k)), bytearray()

    def flush(least: int) -> None:
        for stream, data in zip(streams, held):
            if len(data) >= least:
                stream.write(bytes(data))
                data.clear()

    def end_row() -> None:
        held[0].extend(row_ids.tobytes())
        held[1].extend(row_dist.tobytes())
        row_ids.fill(EMPTY)
        row_dist.fill(np.inf)
        flush(BUFFER)

    try:
        for r in edges.select("src", "dst", "dist", "rk").orderBy("src", "rk").toLocalIterator():
            while at < r["src"]:
                end_row()
                at += 1
            row_ids[r["rk"] - 1], row_dist[r["rk"] - 1] = r["dst"], r["dist"]
        while at < n:
            end_row()
            at += 1
        flush(1)
        streams[1].close()
        jvm = edges.sparkSession.sparkContext._jvm
        source = fs.open(rest)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, streams[0], BUFFER, False)
        source.close()
    finally:
        for stream in streams:
            stream.close()
        fs.delete(rest, False)
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} can't be written")


def read_head(spark: SparkSession, path: str) -> Head:
    """Raises FileNotFoundError, or ValueError for what is no whole graph file of this version."""
    data, size = file_head(spark, path, HEADER.size)
    if len(data) < HEADER.size:
        raise ValueError(f"{path}: {size} bytes hold no header")
    magic, version, id_bytes, dist_bytes, metric, _, n, k = HEADER.unpack(data)
    if magic != MAGIC or (version, id_bytes, dist_bytes) != (VERSION, 4, 4):
        raise ValueError(f"{path} is no graph file of version {VERSION}")
    if size != HEADER.size + 8 * n * k:
        raise ValueError(f"{path}: {size} bytes, where {n} lists of {k} take {HEADER.size + 8 * n * k}")
    return Head(metric, n, k)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, dist (as stored, single precision), rk of a graph file; the ends of short lists are no rows.

    Tasks read parts of the file; an id and its distance lie far apart and meet in one aggregation.
    """
    head = read_head(spark, path)
    slots, skipped = head.n * head.k, HEADER.size // 4
    width = math.gcd(HEADER.size, 4 * head.k or 4)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = np.frombuffer(b"".join(batch["data"].to_pylist()), "<u4")
            at = (np.array(batch["at"])[:, None] * (width // 4) + np.arange(width // 4) - skipped).ravel()
            data, at = data[at >= 0], at[at >= 0]
            far = at >= slots
            yield pa.RecordBatch.from_arrays([pa.array(at - slots * far), pa.array(data.astype("<i8"), mask=far), pa.array(data.view("<f4").astype("<f8"), mask=~far)], ["slot", "dst", "dist"])

    records = spark.createDataFrame(spark.sparkContext.binaryRecords(path, width).zipWithIndex(), "data binary, at long")
    found = records.mapInArrow(words, "slot long, dst long, dist double").groupBy("slot").agg(F.max("dst").alias("dst"), F.max("dist").alias("dist")).where(F.col("dst") != EMPTY)
    return found.select(F.expr(f"slot div {max(1, head.k)}").alias("src"), "dst", "dist", (F.col("slot") % max(1, head.k) + 1).cast("int").alias("rk"))
