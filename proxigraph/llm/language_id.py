"""Language identification by hyperdimensional profiles.

Every letter, and the word border, has a fixed random vector of +1 and -1,
drawn from its code point. A letter with its two neighbours is an n-gram:
the neighbours' vectors are permuted (rotated by two and one) and bound to
the letter's by elementwise product. A document is the bundle (sum) of its
n-grams' vectors, a language the bundle of all its training documents; the
prediction is the language of highest cosine. Bundles of all tasks are
whole numbers and add up in any order, so results don't depend on
partitioning.

All labelled training documents take part, none is sampled. A task makes
one bundle a language; they are summed in two steps of grouping, and what
reaches the driver and each task is one vector for each distinct label.

Defined results: null text, text without a letter, and any text when there
is nothing to learn from (an empty table, too), give ``und`` and 0. Ties go
to the language first in order. Rows without doc_id count as held out. Very
long texts are read in pieces, and of the n-grams of a piece NGRAMS at a
time, so memory is bounded for scripts of any size. Repeated rows are predicted (and learned from) one by one; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.llm.common import lean, table, worker_state

DIMENSIONS = 1024
#: The pipeline's, where unrelated texts' cosines spread by about 0.01, and those of n-grams' vectors that are made at a time.
STAGE_DIMENSIONS, AT_ONCE = 10_240, 1024
#: N-grams whose vectors are made at a time: a large script has as many as a text has letters.
NGRAMS = 4096
#: N-grams that a task counts before it bundles them.
COUNTED = 200_000
SEED = 20_260
#: Characters and documents that are counted at a time.
CHARS, DOCS = 300_000, 128
UNKNOWN = "und"
#: The pipeline rejects what is less alike to every language than this.
LEAST = 0.05
FAN_IN = 256


def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """Of the letter, or of the word border for 0."""
    cache = worker_state().__dict__.setdefault("letters", {})
    if (code, dimensions) not in cache:
        cache[code, dimensions] = np.random.default_rng([SEED, code]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1
    return cache[code, dimensions]


def ngram_vectors(letters: np.ndarray, trigrams: np.ndarray, dimensions: int, part: slice = slice(None)) -> np.ndarray:
    """letters: code points by local number; trigrams: rows of three local numbers; part: the dimensions that are wanted."""
    used, local = np.unique(trigrams, return_inverse=True)
    local = local.reshape(trigrams.shape)
    v = np.array([letter_vector(int(c), dimensions) for c in letters[used]], np.int8).reshape(-1, dimensions)
    return np.roll(v, 2, 1)[:, part][local[:, 0]] * v[:, part][local[:, 1]] * np.roll(v, 1, 1)[:, part][local[:, 2]]


def bundled(of: np.ndarray, ngram: np.ndarray, n: np.ndarray, rows: int, letters: np.ndarray, trigrams: np.ndarray, dimensions: int, kind: type) -> np.ndarray:
    """A bundle a row: n times the vector of each n-gram. The n-grams ascend; NGRAMS of them and AT_ONCE dimensions are held at a time."""
    out = np.zeros((rows, dimensions), kind)
    for first in range(0, len(trigrams), NGRAMS):
        a, b = np.searchsorted(ngram, [first, first + NGRAMS])
        width = min(NGRAMS, len(trigrams) - first)
        counts = np.bincount(of[a:b] * width + ngram[a:b] - first, n[a:b], rows * width).reshape(rows, width).astype(kind)
        for i in range(0, dimensions, AT_ONCE):
            part = slice(i, i + AT_ONCE)
            out[:, part] += counts @ ngram_vectors(letters, trigrams[first : first + NGRAMS], dimensions, part).astype(kind)
    return out


def count_ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, n-gram and count of those that occur, by n-gram; the letters, and the n-grams as local letter numbers."""
    joined = "\0".join(["", *texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    owner = np.repeat(np.arange(-1, len(texts)), [1, *(len(t) + 1 for t in texts)])
    present = np.flatnonzero(np.bincount(codes)) if codes.max() < 1 << 17 else np.unique(codes)
    letters = np.array([0, *(c for c in present.tolist() if chr(c).isalpha())])
    number = np.zeros(int(codes.max()) + 1, np.int64)
    number[letters] = np.arange(len(letters))
    slots = number[codes]
    at = np.flatnonzero(slots)
    size = len(letters)
    keys = (slots[at - 1] * size + slots[at]) * size + slots[at + 1]
    if size**3 <= 1 << 22:
        found = np.flatnonzero(np.bincount(keys, minlength=1))
        local = np.zeros(size**3, np.int64)
        local[found] = np.arange(len(found))
        keys = local[keys]
    else:
        found, keys = np.unique(keys, return_inverse=True)
    pairs = keys * len(texts) + owner[at]
    if len(found) * len(texts) <= 1 << 22:
        counts = np.bincount(pairs, minlength=1)
        pairs = np.flatnonzero(counts)
        counts = counts[pairs]
    else:
        pairs, counts = np.unique(pairs, return_counts=True)
    return pairs % len(texts), pairs // len(texts), counts, letters, np.stack([found // size**2, found // size % size, found % size], 1)


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of lower-cased texts of bounded total size, with their positions; longer texts in pieces cut at word borders where there are any."""
    at, held, size = [], [], 0
    for i, text in enumerate(texts):
        text = (text or "").lower()
        while text:
            cut = len(text)
            if cut > CHARS:
                cut = max(text.rfind(" ", 1, CHARS), text.rfind("\n", 1, CHARS))
                cut = CHARS if cut < 1 else cut
            piece, text = text[:cut], text[cut:]
            if held and (size + len(piece) > CHARS or len(held) >= DOCS):
                yield at, held
                at, held, size = [], [], 0
            at.append(i)
            held.append(piece)
            size += len(piece)
    if held:
        yield at, held


def _bundles(dimensions: int):
    """(lang, text) -> one row a language: lang, part, bundle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict[str, np.ndarray] = {}
        counted: dict[str, Counter] = {}

        def flush() -> None:
            """Bundles of what has been counted: each n-gram's vector is made once for many texts."""
            used = np.array(sorted({key for c in counted.values() for key in c}), np.int64).reshape(-1, 3)
            letters, trigrams = np.unique(used, return_inverse=True)
            number = {tuple(key): i for i, key in enumerate(used.tolist())}
            names = sorted(counted)
            at = sorted((number[key], i, n) for i, name in enumerate(names) for key, n in counted[name].items())
            ngram, of, n = np.array(at, np.int64).reshape(-1, 3).T
            for name, bundle in zip(names, bundled(of, ngram, n, len(names), letters, trigrams.reshape(-1, 3), dimensions, np.float64), strict=True):
                sums[name] = sums.get(name, 0) + bundle.astype(np.int64)
            counted.clear()

        for batch in batches:
            langs, texts = batch["lang"].to_pylist(), batch["text"].to_pylist()
            for at, group in pieces(texts):
                of, ngram, n, letters, trigrams = count_ngrams(group)
                if not len(trigrams):
                    continue
                names = sorted({langs[i] for i in at})
                number = np.array([names.index(langs[i]) for i in at])
                totals = np.bincount(number[of] * len(trigrams) + ngram, n, len(names) * len(trigrams)).astype(np.int64).reshape(len(names), -1)
                codes = letters[trigrams]
                for name, total in zip(names, totals, strict=True):
                    some = np.flatnonzero(total)
                    counted.setdefault(name, Counter()).update(dict(zip(map(tuple, codes[some].tolist()), total[some].tolist(), strict=True)))
                if sum(map(len, counted.values())) > COUNTED:
                    flush()
        if counted:
            flush()
        part = TaskContext.get().partitionId() % FAN_IN
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([part] * len(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["lang", "part", "bundle"])

    return run


def _add(rows: pa.Table) -> pa.Table:
    total = np.sum([np.asarray(b.values) for b in rows["bundle"]], axis=0, dtype=np.int64)
    return pa.table({"lang": rows["lang"][:1].combine_chunks(), "part": rows["part"][:1].combine_chunks(), "bundle": pa.array([total], pa.list_(pa.int64()))})


def learn(labelled: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """labelled: lang, text. The prototype of each language, as a bundle of all its texts."""
    schema = "lang string, part int, bundle array<long>"
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    parts = rows.mapInArrow(lean(_bundles(dimensions)), schema).groupBy("lang", "part").applyInArrow(_add, schema)
    return {r["lang"]: np.array(r["bundle"], np.int64) for r in parts.groupBy("lang").applyInArrow(_add, schema).collect()}


def _predict(names: list[str], prototypes: np.ndarray, dimensions: int):
    units = (prototypes / np.maximum(np.linalg.norm(prototypes.astype(np.float64), axis=1, keepdims=True), 1e-12)).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            best, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for i in range(0, len(texts), DOCS):
                some = texts[i : i + DOCS]
                bundles = np.zeros((len(some), dimensions), np.float32)
                lettered = np.zeros(len(some), bool)
                for at, group in pieces(some):
                    of, ngram, n, letters, trigrams = count_ngrams(group)
                    if len(trigrams):
                        np.add.at(bundles, at, bundled(of, ngram, n, len(group), letters, trigrams, dimensions, np.float32))
                        lettered[np.array(at)[of]] = True
                if names:
                    wide = bundles.astype(np.float64)
                    cosines = wide @ units.T / np.maximum(np.linalg.norm(wide, axis=1, keepdims=True), 1e-12)
                    first = cosines.argmax(1)
                    best[i : i + DOCS][lettered] = np.array(names, object)[first[lettered]]
                    score[i : i + DOCS][lettered] = np.clip(cosines[np.arange(len(some)), first], 0, 1)[lettered]
            out = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(best, pa.string()), pa.array(score)], [*(n for n in batch.schema.names if n != "text"), "lang_pred", "score"])

    return run


def predict(documents: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, keep: str = "doc_id long") -> DataFrame:
    """documents: text and what keep names. Returns keep, lang_pred, score."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.int64).reshape(len(names), dimensions)
    columns = [c.split()[0] for c in keep.split(",")]
    return documents.select(*columns, "text").mapInArrow(lean(_predict(names, matrix, dimensions)), f"{keep}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    return predict(docs, learn(docs.where(~F.col("held_out"))), keep="doc_id long, held_out boolean")


def accepted(documents: DataFrame) -> DataFrame:
    """The pipeline's stage: documents whose language can be told; learned as in op10, all columns kept.

    The text goes through the workers with its row, so that repeated or null doc_ids need no join.
    """
    labelled = documents.where(~held_out(F.col("doc_id")))
    prototypes = learn(labelled, STAGE_DIMENSIONS)
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.int64).reshape(len(names), STAGE_DIMENSIONS)
    judge = _predict(names, matrix, STAGE_DIMENSIONS)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (found,) = judge(iter([batch.select(["text"])]))
            good = np.array([n != UNKNOWN for n in found["lang_pred"].to_pylist()], bool) & (found["score"].to_numpy() >= LEAST)
            yield batch.filter(pa.array(good))

    return documents.mapInArrow(lean(keep), documents.schema)
