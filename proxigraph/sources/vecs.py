"""The ``*vecs`` formats: records of a little-endian int32 dimension and that many elements.

Files are read by record, so Spark splits them and reads from any store it
knows; only the first record's dimension and the file's length are looked
at beforehand.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from proxigraph.storage import file_head, file_system


@dataclass(frozen=True)
class Format:
    dtype: str
    width: int
    element: str


FORMATS = {"fvecs": Format("<f4", 4, "float"), "ivecs": Format("<i4", 4, "int"), "bvecs": Format("u1", 1, "short")}


def _head(spark: SparkSession, path: str) -> tuple[int, int]:
    """Dimension in the first record and length of the file."""
    head, size = file_head(spark, path, 4)
    if size < 4:
        raise ValueError(f"{path}: {size} bytes hold no record")
    return int.from_bytes(head, "little", signed=True), size


def read_vecs(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """vec_id (place in the file), v (array of the format's element type). kind: fvecs, ivecs or bvecs; by default the path's ending.

    Raises FileNotFoundError, or ValueError for what is no such file. A record with another dimension in the middle is found when it is read.
    """
    kind = kind or path.rsplit(".", 1)[-1]
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(FORMATS)}")
    form = FORMATS[kind]
    dim, size = _head(spark, path)
    if dim <= 0:
        raise ValueError(f"{path}: the first record's dimension is {dim}")
    record = 4 + form.width * dim
    if size % record:
        raise ValueError(f"{path}: {size} bytes are no whole number of records of {record}")

    def parse(item: tuple[bytes, int]) -> tuple[int, list]:
        data, at = item
        if (found := int.from_bytes(data[:4], "little", signed=True)) != dim:
            raise ValueError(f"{path}: record {at} has dimension {found}, the first {dim}")
        return at, np.frombuffer(data, form.dtype, offset=4).tolist()

    rows = spark.sparkContext.binaryRecords(path, record).zipWithIndex().map(parse)
    return spark.createDataFrame(rows, f"vec_id long, v array<{form.element}>")


def read_bvecs_as_float(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql import functions as F

    return read_vecs(spark, path, "bvecs").select("vec_id", F.col("v").cast("array<float>").alias("v"))


def to_bytes(data: np.ndarray, kind: str) -> bytes:
    """A whole file's bytes; for tests and small exports."""
    form = FORMATS[kind]
    head = np.int32(data.shape[1]).astype("<i4").tobytes()
    return b"".join(head + row.astype(form.dtype).tobytes() for row in data)


def write_vecs(vecs: DataFrame, path: str, kind: str | None = None, rows: int = 4096) -> None:
    """Vectors in the order of vec_id. The file is one stream, so the driver writes it, some rows at a time."""
    kind = kind or path.rsplit(".", 1)[-1]
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(FORMATS)}")
    fs, where = file_system(vecs.sparkSession, path)
    out = fs.create(where)
    try:
        found = (r["v"] for r in vecs.select("vec_id", "v").orderBy("vec_id").toLocalIterator())
        while some := list(islice(found, rows)):
            out.write(to_bytes(np.array(some), kind))
    finally:
        out.close()
