"""Benchmark decontamination by greedy string tiling.

Seeds are Karp-Rabin numbers of runs of SEED words. A bitmap of fixed size,
made from the seeds of all test items by an aggregation, lets each task pass
over documents without any seed; what is left (suspects) is written to the
shared folder. Suspects' seeds are joined to the items' by value, pairs
with too few shared seeds to reach the threshold are dropped (a bound, not
an estimate), and for each other pair tiles are laid: the longest run of
words that neither side has marked yet is marked in both, again and again,
down to SEED words. Tiles may come in any order, so a passage that was cut
and reordered is covered all the same. A document is contaminated by an
item of which it covers COVERAGE or more of the words.

Nothing but the bitmap is broadcast by this module; the benchmark may be of any size.

Defined results: null or empty texts have no words; an item of fewer than
SEED words has no seed and matches nothing; documents and items are judged
row by row, so repeated rows give repeated pairs; ids may be null. Very long
texts are tiled whole, in parts of bounded size. Other columns are ignored,
in the pipeline's stage kept. The result is empty if no pair reaches the
threshold, or a table is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.llm.common import lean, shield, table, through_files
from proxigraph.llm.shingles import distinct, grouped, numbers_of, runs, runs_by_text, word_numbers

SEED, COVERAGE = 5, 0.5
#: Bits of the bitmap, as a power of two: 4 MB.
BITS = 25
#: Seed matches that are looked at, and characters whose words are numbered, at a time.
AT_ONCE, CHARS = 1 << 20, 300_000
PAIR_SCHEMA = "doc_id long, item_id long, coverage double, n_tiles int, longest int, item_words int"


def _common_runs(document: np.ndarray, item: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal common runs of ``least`` words or more: place in item, place in document, words.

    The document is read AT_ONCE / item words at a time; a run that goes on in the next part is joined afterwards.
    """
    own, other = runs(item, least), runs(document, least)
    order = np.argsort(own, kind="stable")
    own = own[order]
    parts = [np.zeros((3, 0), np.int64)]
    step = max(1, AT_ONCE // max(1, len(item)))
    for start in range(0, len(other), step):
        at = other[start : start + step]
        first = np.searchsorted(own, at, "left")
        many = np.searchsorted(own, at, "right") - first
        j = np.repeat(np.arange(start, start + len(at)), many)
        i = order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]
        by_diagonal = np.lexsort((i, j - i))
        i, j = i[by_diagonal], j[by_diagonal]
        new = np.ones(len(i), bool)
        new[1:] = (np.diff(i) != 1) | (np.diff(j) != 1)
        at = np.flatnonzero(new)
        parts.append(np.stack([i[at], j[at], np.diff(at, append=len(i))]))
    i, j, n = np.concatenate(parts, 1)
    by_diagonal = np.lexsort((i, j - i))
    i, j, n = i[by_diagonal], j[by_diagonal], n[by_diagonal]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != (i + n)[:-1]) | (j[1:] != (j + n)[:-1])
    at = np.flatnonzero(new)
    return i[at], j[at], (np.add.reduceat(n, at) if len(at) else n) + least - 1


def _cut(i: np.ndarray, j: np.ndarray, n: np.ndarray, at: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is left of runs before and after a stretch of ``size`` words that begins ``at`` words after them, if ``least`` words or more."""
    before = np.clip(at, 0, n)
    skip = np.clip(at + size, 0, n)
    left, right = before >= least, n - skip >= least
    # A stretch that misses a run leaves all of it, on one side.
    return tuple(np.concatenate(x) for x in ((i[left], (i + skip)[right]), (j[left], (j + skip)[right]), (before[left], (n - skip)[right])))


def tile(document: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in document, words), longest first, then by place.

    Memory is some 100 bytes a common run; an item has at most len(item) / least tiles.
    """
    i, j, n = _common_runs(document, item, least)
    tiles = []
    while len(n):
        best = np.flatnonzero(n == n.max())
        best = best[np.lexsort((j[best], i[best]))[0]]
        a, b, size = int(i[best]), int(j[best]), int(n[best])
        if not np.array_equal(item[a : a + size], document[b : b + size]):
            n[best] = 0  # equal numbers of different words
            continue
        tiles.append((a, b, size))
        i, j, n = _cut(i, j, n, a - i, size, least)
        i, j, n = _cut(i, j, n, b - j, size, least)
    return tiles


def _bits(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each seed."""
    return (seeds >> np.uint64(64 - BITS)).astype(np.int64), (seeds & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
            numbers = word_numbers(text)
            seeds = runs(numbers, SEED)
            one, two = _bits(seeds)
            n = len(seeds)
            yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array(seeds.view(np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array([len(numbers)] * n, pa.int32()), pa.array(one), pa.array(two)], ["item", "seed", "pos", "words", "one", "two"])


def _suspects(bitmap, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            keep, seeds, at = [], [], 0
            for texts in grouped(batch["text"].to_pylist(), CHARS):
                found, per = runs_by_text(*numbers_of(texts), SEED)
                one, two = _bits(found)
                hit = ((bits[one >> 3] >> (one & 7)) & (bits[two >> 3] >> (two & 7)) & 1).astype(bool)
                ends = np.cumsum(per)
                per = np.diff(np.searchsorted(np.flatnonzero(hit), ends), prepend=0)
                found, _, per = distinct(found[hit], per)
                keep += (np.flatnonzero(per) + at).tolist()
                seeds += [x.view(np.int64) for x in np.split(found, np.cumsum(per)[:-1]) if len(x)]
                at += len(texts)
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(seeds, pa.list_(pa.int64()))], [*names, "seeds"])

    return run


def _lay(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, item, text, passage, digest in zip(*(batch[c].to_pylist() for c in ("doc_id", "item_id", "text", "passage", "digest")), strict=True):
                numbers = word_numbers(passage)
                tiles = tile(word_numbers(text), numbers)
                covered = sum(n for _, _, n in tiles)
                if covered >= threshold * len(numbers):
                    out.append((doc, item, covered / len(numbers), len(tiles), max(n for _, _, n in tiles), len(numbers), digest))
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "coverage", "n_tiles", "longest", "item_words", "digest"])

    return run


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """documents: doc_id, text. benchmark: item_id, text. Returns the pairs whose coverage reaches threshold, see PAIR_SCHEMA."""
    return _found(documents, benchmark, threshold).drop("digest")


def _found(documents: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = documents.sparkSession
    items = through_files(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("passage")).withColumn("item", F.monotonically_increasing_id()), "benchmark-items")
    seeds = through_files(items.select("item", F.col("passage").alias("text")).mapInArrow(_item_seeds, "item long, seed long, pos int, words int, one long, two long"), "benchmark-seeds")
    # One row for each of the bitmap's words that has a bit set: 2^BITS / 64 at most, however many items there are.
    marks = seeds.select(F.explode(F.array("one", "two")).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).collect()
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    for r in marks:
        bitmap[r["word"]] = r["bits"]
    bitmap = spark.sparkContext.broadcast(bitmap.view(np.uint8))
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    suspects = rows.mapInArrow(lean(_suspects(bitmap, rows.columns)), "doc_id long, text string, seeds array<long>")
    suspects = through_files(suspects.withColumn("row", F.monotonically_increasing_id()), "suspects")
    shared = suspects.select("row", F.explode("seeds").alias("seed")).join(seeds.select("item", "seed", "pos", "words"), "seed").groupBy("row", "item").agg(F.count(F.lit(1)).alias("n"), F.first("words").alias("words"))
    # A tile of L words has L - SEED + 1 >= L / SEED seeds, each at a place of its own in the item.
    pairs = shared.where(F.col("n") >= F.ceil(F.lit(threshold) * F.col("words") / SEED - 1e-9)).select("row", "item")
    joined = pairs.join(items, "item").join(suspects.select("row", "doc_id", "text"), "row")
    return joined.select("doc_id", "item_id", "text", "passage", F.md5("text").alias("digest")).mapInArrow(_lay(threshold), PAIR_SCHEMA + ", digest string")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item of which the document covers COVERAGE or more."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def uncontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pipeline's stage: documents that no item contaminates, all columns kept.

    Whether a document is contaminated depends on its text alone, so rows are told apart by a digest of the text.
    """
    plain, restore = shield(documents, "doc_id", "text")
    flagged = _found(plain, benchmark, COVERAGE).select("digest").distinct()
    return restore(plain.withColumn("own", F.md5(F.coalesce("text", F.lit("")))).join(flagged, F.col("own") == F.col("digest"), "left_anti"))
