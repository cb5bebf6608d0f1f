"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents' tokens. In every round a queue
earns a quantum of ``window`` tokens times its share of the mixture, serves
the whole tokens of its credit and carries the fraction (its deficit) on.
A queue that runs dry leaves the others to share the round. The rounds'
output is one stream, cut into sequences of ``seq_len``, so each window
holds the target proportions to within a token or so a queue (at its borders,
to within a queue's part of a round) and nothing is padded but the last
sequence.

What a queue has served after any number of rounds has a closed form, so a
task that knows the place of a document in its queue knows the deficits of
all queues at that round: they carry across windows and partitions without
a sequential pass. Places need one sum a queue and input block.

Every source has a queue of its own, however many there are: the driver and
each task hold one number a source. A source's part of a window is as long as
its share, so with more sources than tokens in a window a source is served in
some of the rounds only, one token each.

Defined results: null text is an empty document (only the end id); a null
source is a queue of its own. Rows that share a doc_id are packed one by one;
a very long document is cut as any other. Other columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proxigraph.llm.common import lean, table, through_files
from proxigraph.llm.pretokens import MEMO, encoder, tokenizer_path

SEQ_LEN, END = 2048, 1
#: Numbers of queues and rounds that a task remembers.
KNOWN = 4_000_000
TOKENS_SCHEMA = "block int, place long, source string, doc_id long, n long, ids binary"
PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long, ids binary"


@dataclass
class Phase:
    round: int
    served: list[int]
    shares: list[int]
    total: int


@dataclass
class Schedule:
    """Tokens that each queue has served after any number of rounds. sizes: tokens by queue; shares: whole-number weights."""

    sizes: list[int]
    shares: list[int]
    window: int
    phases: list[Phase] = field(default_factory=list)

    def __post_init__(self):
        at, served, shares = 0, [0] * len(self.sizes), list(self.shares)
        while any(s < n for s, n in zip(served, self.sizes, strict=True)):
            active = [w if s < n else 0 for w, s, n in zip(shares, served, self.sizes, strict=True)]
            if not any(active):  # only queues without a share are left: they go on in proportion to their sizes
                shares = list(self.sizes)
                continue
            self.phases.append(Phase(at, served, active, sum(active)))
            at += min(-(-(n - s) * sum(active) // (self.window * w)) for w, s, n in zip(active, served, self.sizes, strict=True) if w)
            served = [self._served(self.phases[-1], q, at) for q in range(len(self.sizes))]
        self.rounds = at

    def _served(self, p: Phase, q: int, i: int) -> int:
        return min(self.sizes[q], p.served[q] + (i - p.round) * self.window * p.shares[q] // p.total)

    def _phase(self, i: int) -> Phase:
        found = self.phases[0]
        for p in self.phases:
            if p.round <= i:
                found = p
        return found

    def served(self, i: int) -> list[int]:
        if i >= self.rounds:
            return list(self.sizes)
        p = self._phase(i)
        return [self._served(p, q, i) for q in range(len(self.sizes))]

    def round_of(self, q: int, token: int) -> int:
        """The round that serves this token of the queue."""
        p = self.phases[0]
        for x in self.phases:
            if x.served[q] <= token:
                p = x
        if not p.shares[q]:
            return p.round
        return p.round + ((token - p.served[q] + 1) * p.total - 1) // (self.window * p.shares[q])


def _tokenise(path: str, end: int, memo: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, block = encoder(path, memo).ids, TaskContext.get().partitionId()
        seen: dict[str | None, int] = {}
        schema = pa.schema([("block", pa.int32()), ("place", pa.int64()), ("source", pa.string()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            out: list[tuple] = []
            for doc, source, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "source", "text")), strict=True):
                ids = np.append(np.frombuffer(encode(text or ""), "<u4"), np.uint32(end))
                narrow = ids.astype("<u2") if ids.max() < 1 << 16 else ids
                out.append((block, seen.get(source, 0), source, doc, len(ids), bytes([narrow.itemsize]) + narrow.tobytes()))
                seen[source] = seen.get(source, 0) + len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return run


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype("<u4")


def _cut(plan: Schedule, seq_len: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[list[int], list[int], list[int]]] = {}

        def of(i: int) -> tuple[list[int], list[int], list[int]]:
            """What each queue has served before and after the round, and where its part of the stream begins."""
            if i not in known:
                if len(known) * len(plan.sizes) >= KNOWN:
                    known.clear()
                before, after = plan.served(i), plan.served(i + 1)
                at, starts = sum(before), []
                for a, b in zip(before, after, strict=True):
                    starts.append(at)
                    at += b - a
                known[i] = before, after, starts
            return known[i]

        types = [pa.int64()] * 7 + [pa.binary()]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids"]
        for batch in batches:
            cols: list[list] = [[] for _ in names]

            def flush() -> pa.RecordBatch:
                made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
                for c in cols:
                    c.clear()
                return made

            for doc, n, q, first, packed in zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "queue", "first", "ids")), strict=True):
                data, token, stop = memoryview(_unpack(packed).tobytes()), first, first + n
                i = plan.round_of(q, token)
                while token < stop:
                    before, after, starts = of(i)
                    last = min(after[q], stop)
                    at = starts[q] + token - before[q]
                    while token < last:
                        size = min(last - token, seq_len - at % seq_len)
                        ids = data[4 * (token - first) : 4 * (token - first + size)]
                        for c, v in zip(cols, (doc, token - first, size, n, at // seq_len, at % seq_len, zlib.crc32(ids), bytes(ids) if with_ids else None), strict=True):
                            c.append(v)
                        token, at = token + size, at + size
                    i += 1
                if len(cols[0]) >= 50_000:
                    yield flush()
            yield flush()

    return run


def pack(documents: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN, window: int | None = None, targets: dict[str | None, float] | None = None, end: int = END, with_ids: bool = True, memo: int = MEMO) -> DataFrame:
    """documents: doc_id, source, text. One row a piece, see PIECE_SCHEMA; ids are little-endian uint32.

    targets: tokens of a source in a window, as relative weights; by default the sources' shares of all tokens.
    Sources without a target follow when the others have run dry.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", "source", "text")
    if any(f.dataType.typeName() == "void" for f in rows.schema):
        rows = rows.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    tokens = through_files(rows.mapInArrow(lean(_tokenise(tokenizer, end, memo)), TOKENS_SCHEMA), "packing-tokens")
    blocks = tokens.groupBy("source", "block").agg(F.sum("n").alias("n"))
    totals = blocks.groupBy("source").agg(F.sum("n").alias("n"))
    # One row a source, as a mixture names each; documents have many fewer sources than there are documents.
    top = [(r["source"], r["n"]) for r in totals.orderBy(F.col("n").desc(), F.col("source")).collect()]
    queue_of = {s: i for i, (s, _) in enumerate(top)}
    # Sources are matched as values, not by position, so a recomputed stage finds the same queues.
    # As an Arrow table: rows of Python's would go through workers of a second Python daemon on each executor.
    queues = spark.createDataFrame(pa.table({"source": pa.array(list(queue_of), pa.string()), "queue": pa.array(list(queue_of.values()), pa.int32())}), "source string, queue int")
    numbered = blocks.join(queues.withColumnRenamed("source", "known"), F.col("source").eqNullSafe(F.col("known")))
    order = Window.partitionBy("queue").orderBy("source", "block").rowsBetween(Window.unboundedPreceding, -1)
    base = through_files(numbered.select("source", "block", "queue", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")), "packing-queues")
    sizes = [n for _, n in top]
    shares = list(sizes) if targets is None else [round(1e6 * targets.get(s, 0)) for s, _ in top]
    plan = Schedule(sizes, shares, window or seq_len)
    # base has a row for each source and input block; Spark broadcasts it only below its own size threshold.
    placed = tokens.join(base.withColumnsRenamed({"source": "of", "block": "in"}), F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in")))
    return placed.select("doc_id", "n", "queue", (F.col("base") + F.col("place")).alias("first"), "ids").mapInArrow(lean(_cut(plan, seq_len, with_ids)), PIECE_SCHEMA)


def sequences(pieces: DataFrame, seq_len: int = SEQ_LEN, pad: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids: whole sequences; padded to seq_len unless their length is a power of two."""

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("offset")
        ids = np.frombuffer(b"".join(rows["ids"].to_pylist()), "<u4").astype(np.int32)
        n = len(ids)
        if n & (n - 1):
            ids = np.pad(ids, (0, seq_len - n), constant_values=pad)
        return pa.table({"sequence_id": [rows["sequence_id"][0].as_py()], "n_tokens": pa.array([n], pa.int32()), "ids": pa.array([ids], pa.list_(pa.int32()))})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(build, "sequence_id long, n_tokens int, ids array<int>")


def digest(documents: DataFrame, memo: int = MEMO) -> DataFrame:
    pieces = pack(documents, tokenizer_path("byte_bpe_50k.json"), with_ids=False, memo=memo)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
