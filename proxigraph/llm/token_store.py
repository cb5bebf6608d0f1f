"""Token ids in directly addressable codes: random access to any token without decoding a block.

File format of a block (all little-endian):

    magic "DAC1", then uint32: chunk bits (8), levels, documents
    per document: uint8 id present, int64 doc_id (0 if absent), int64 tokens
    per level: uint64 chunks n, then n chunk bytes, ceil(n / 8) bytes of the
    continuation bitmap (bit i of the level is bit i % 8 of byte i // 8) and a
    rank directory: uint32 set bits before every 512th position

Level 0 has the lowest 8 bits of every id; a set bit says that the id goes
on in the next level, at the position that equals the number of set bits
before it. Blocks are rows of a table written by Spark in doc_id order, so
any store that Spark writes will do and its commit protocol covers lost
executors. A document never spans blocks.

Blocks are stored without compression, and ``lookup`` reads single tokens of
named documents; ``read_digest`` reads one token of each document by itself
besides the whole block, and raises if they differ.

Defined results: a null text counts as empty (its only token is the end id);
a null doc_id sorts first; rows that share a doc_id are stored one by one,
in the order of their texts, over as many shards as there are beginnings of
texts. A very long document is one block. Other columns are ignored. An empty
table gives an empty store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxigraph.llm.common import scratch, table
from proxigraph.llm.pretokens import encoder, tokenizer_path

MAGIC, BITS, RANK = b"DAC1", 8, 512
#: A block is closed once it has so many tokens.
BLOCK_TOKENS = 1 << 20
END = 1
BLOCK_SCHEMA = "shard int, block int, start long, n_docs long, n_tokens long, payload binary"


def encode_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    out = [MAGIC, np.array([d is not None for d in doc_ids], np.uint8).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<i8").tobytes()]
    rest, levels = np.asarray(ids, np.uint64), 0
    while levels == 0 or len(rest):
        more = rest >> BITS != 0
        marks = np.packbits(more, bitorder="little")
        before = np.concatenate([[0], np.cumsum(more)])[: max(1, len(more)) : RANK]
        out += [struct.pack("<Q", len(rest)), (rest & 255).astype(np.uint8).tobytes(), marks.tobytes(), before.astype("<u4").tobytes()]
        rest, levels = rest[more] >> BITS, levels + 1
    out.insert(1, struct.pack("<III", BITS, levels, len(doc_ids)))
    return b"".join(out)


class Block:
    """Reads a block; ``block[i]`` touches one byte a level and at most 64 bytes of bitmap."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        _, levels, n = struct.unpack_from("<III", payload, 4)
        at = 16

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(payload, kind, count, at)
            at += found.nbytes
            return found

        known, self.doc_ids, self.lengths = take("u1", n), take("<i8", n), take("<i8", n)
        self.known = known.astype(bool)
        self.levels = []
        for _ in range(levels):
            size = int(take("<u8", 1)[0])
            self.levels.append((take("u1", size), take("u1", -(-size // 8)), take("<u4", max(1, -(-size // RANK)))))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for level, (chunks, marks, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (BITS * level)
            if not marks[i >> 3] >> (i & 7) & 1:
                break
            first = i // RANK * RANK
            i = int(ranks[i // RANK]) + int(np.unpackbits(marks[first >> 3 : (i >> 3) + 1], bitorder="little")[: i - first].sum())
        return value

    def ids(self) -> np.ndarray:
        out = np.zeros(len(self), np.uint64)
        at = np.arange(len(self))
        for level, (chunks, marks, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint64) << np.uint64(BITS * level)
            at = at[np.unpackbits(marks, count=len(chunks), bitorder="little").astype(bool)]
        return out.astype("<u4")


def _writer(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, tail = encoder(path).ids, np.array([end], "<u4").tobytes()
        shard, blocks, start = TaskContext.get().partitionId(), 0, 0
        docs, lengths, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            payload = encode_block(docs, lengths, np.frombuffer(b"".join(parts), "<u4"))
            values = [pa.array([shard], pa.int32()), pa.array([blocks], pa.int32()), *[pa.array([v], pa.int64()) for v in (start, len(docs), held)], pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(values, ["shard", "block", "start", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = encode(text or "") + tail
                docs.append(doc)
                lengths.append(len(ids) // 4)
                parts.append(ids)
                held += lengths[-1]
                if held >= BLOCK_TOKENS:
                    yield close()
                    start, blocks = start + held, blocks + 1
                    docs, lengths, parts, held = [], [], [], 0
        if docs:
            yield close()

    return run


def write_tokens(documents: DataFrame, folder: str, tokenizer: str, end: int = END) -> None:
    """Encodes and writes all documents in ascending doc_id order; a shard is a range of doc_ids."""
    rows = documents.select("doc_id", "text").withColumn("_start", F.substring(F.coalesce("text", F.lit("")), 1, 32))
    rows = rows.repartitionByRange("doc_id", "_start").sortWithinPartitions("doc_id", "_start", "text").drop("_start")
    # Not compressed, as a token's bytes are to be found without unpacking the block.
    rows.mapInArrow(_writer(tokenizer, end), BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(folder)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, payload in zip(batch["first"].to_pylist(), batch["payload"], strict=True):
            block = Block(payload.as_py())
            data = memoryview(block.ids().tobytes())
            ends = np.cumsum(block.lengths)
            starts = ends - block.lengths
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            for at in ((starts + ends) // 2).tolist():
                if block[at] != int.from_bytes(data[4 * at : 4 * at + 4], "little"):
                    raise ValueError(f"token {first + at} of the store reads differently by itself")
            yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, mask=~block.known), pa.array(starts + first), pa.array(block.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with ``first``: tokens of the whole store before them."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(folder)
    # One row a shard: as many as the writer had partitions, a setting and not the data's size.
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return blocks.join(F.broadcast(base), "shard").withColumn("first", F.col("base") + F.col("start")).drop("base")


def read_digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the decoded blocks."""
    return read_blocks(spark, folder).select("first", "payload").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, number, payload in zip(batch["shard"].to_pylist(), batch["block"].to_pylist(), batch["payload"], strict=True):
            block = Block(payload.as_py())
            n = len(block.lengths)
            yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, mask=~block.known), pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array(np.cumsum(block.lengths) - block.lengths), pa.array(block.lengths)], ["doc_id", "shard", "block", "at", "n_tokens"])


def directory(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, shard, block, at (tokens of the block before the document), n_tokens of every stored document."""
    return spark.read.schema(BLOCK_SCHEMA).parquet(folder).select("shard", "block", "payload").mapInArrow(_directory, "doc_id long, shard int, block int, at long, n_tokens long")


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload, wanted in zip(batch["payload"], batch["wanted"].to_pylist(), strict=True):
            block = Block(payload.as_py())
            cols = zip(*((w["doc_id"], w["i"], block[w["at"]]) for w in wanted), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "i", "token"])


def lookup(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """wanted: doc_id, i. doc_id, i and token: the document's i-th token (from 0), read by itself; nothing for places beyond its end.

    A document's null id is asked for as null; rows that share an id give a row each. Requests meet their block in groups of up to 1024.
    """
    at = wanted.select(F.col("doc_id").alias("of"), F.col("i").cast("long").alias("i")).join(directory(spark, folder), F.col("of").eqNullSafe(F.col("doc_id"))).where("i >= 0 and i < n_tokens")
    asked = at.withColumn("group", F.floor((F.col("at") + F.col("i")) / 1024)).groupBy("shard", "block", "group").agg(F.collect_list(F.struct("doc_id", "i", (F.col("at") + F.col("i")).alias("at"))).alias("wanted"))
    return asked.join(spark.read.schema(BLOCK_SCHEMA).parquet(folder), ["shard", "block"]).select("payload", "wanted").mapInArrow(_picked, "doc_id long, i long, token long")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-store")
    write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    return read_digest(spark, folder)
