"""Near duplicates by improved consistent weighted sampling over TF-IDF weights of word shingles.

1. Document frequencies of all shingles go to a table of fixed size: a
   shingle's count is that of its cell less the mean load of the others. A
   weight is the term frequency times 1 + the inverse document frequency
   scaled to 0..1, so that what a whole group of copies shares still counts.
2. A shingle that occurs k times is k replicas, each of the weight of a single
   occurrence. Each replica draws its consistent weighted sample (r, c, beta
   from the shingle's number and the occurrence's) once and competes in one of
   BANDS * ROWS bins; a bin's winner and its quantised weight are the bin's
   sample. So a heavy shingle takes part in as many bins as its weight asks
   for, and what two texts share of it are the same replicas. Empty bins
   borrow from the filled bin that a fixed random order names. ROWS bins are
   a band. The plain set of shingles is sampled alike, each with weight 1,
   into as many bins and bands of its own.
3. Texts with the same words are one node from here on. Nodes that share a
   band's value meet in its bucket; each is paired with the bucket's hub, the
   node that meets most others over all its buckets (of a group of copies,
   most likely the one they were made from).
4. Pairs that can't be similar go: by their total weights and counts (a
   bound), and by far too few equal samples of both kinds. The others are
   verified on whole texts: weighted Jaccard similarity, or that of the plain
   sets of shingles, of SIMILARITY or more makes a link.
5. Buckets that then hold several components are searched wholly. A shingle
   that only one component has there can't be shared with another one: a node
   outside its buckets' main components whose own shingles of that kind are
   too many for SIMILARITY has no further link, which is exact. The others
   meet all of their buckets' other components in blocks of about BLOCK by
   BLOCK nodes; what no bound and no count of equal samples excludes is
   verified. So a group of copies, each edited in places of its own, costs one
   pass over its shingles and not the square of its size.
6. Classes are the connected components; a class's id is its smallest
   doc_id, and that document is the one that is kept.

Two texts of similarity 0.8 miss all bands of a kind about 5 times in 100,000,
and the test of equal samples about once in 10 million; no number of partners,
candidates or rounds is limited. Only the table of frequencies (fixed size) is broadcast
by this module.

Defined results: words are runs of letters, digits and underscores in lower
case. A text of fewer than SHINGLE words is a single shingle of all of them;
texts without words are alike only if equal (null counts as empty). Very long
texts are sampled in pieces and verified whole. A null doc_id comes last; of
repeated rows one is kept. Other columns are ignored, in the pipeline's stage
kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proxigraph.llm.common import lean, removed_after, shield, table, through_files
from proxigraph.llm.components import components
from proxigraph.llm.shingles import BASE, grouped, mix, shingles_of

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of a kind of samples; first the weighted ones, then the plain ones.
BANDS, ROWS, KINDS = 25, 5, 2
BINS = BANDS * ROWS
#: Cells of the table of document frequencies, as a power of two, and the rows a task sends it in.
CELLS, CHUNK, FAN_IN = 18, 1 << 12, 256
#: Replicas that are sampled, and characters whose shingles are found, at a time.
AT_ONCE, CHARS = 50_000, 300_000
#: How far the share of equal samples of a pair of SIMILARITY may lie below it, in standard deviations.
DEVIATIONS = 5.3
#: Nodes on a block's side, and pairs that are compared at a time.
BLOCK, PAIRS = 1024, 8192
#: Texts of so many shingles or fewer bring them all to their block, as 32 bits each.
FEW = 512


def shingle_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles text by text, their counts, shingles of each text; all words' numbers, words of each text."""
    return shingles_of(texts, SHINGLE)


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELLS)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    cells, docs = np.zeros(1 << CELLS, np.int64), 0
    for batch in batches:
        for texts in grouped(batch["text"].to_pylist(), CHARS):
            docs += len(texts)
            cells += np.bincount(_cell(shingle_counts(texts)[0]), minlength=1 << CELLS)
    if docs:
        n = (1 << CELLS) // CHUNK
        data = [cells[i * CHUNK : (i + 1) * CHUNK].astype("<i8").tobytes() for i in range(n)]
        part = TaskContext.get().partitionId() % FAN_IN
        yield pa.RecordBatch.from_arrays([pa.array([*range(n), -1], pa.int32()), pa.array([part] * (n + 1), pa.int32()), pa.array([*data, np.int64(docs).tobytes()], pa.binary())], ["chunk", "part", "data"])


def _add(rows: pa.Table) -> pa.Table:
    total = sum((np.frombuffer(d, "<i8") for d in rows["data"].to_pylist()), np.int64(0))
    return pa.table({"chunk": rows["chunk"][:1].combine_chunks(), "part": rows["part"][:1].combine_chunks(), "data": [total.astype("<i8").tobytes()]})


def idf_table(documents: DataFrame) -> np.ndarray:
    """1 + scaled inverse document frequency by cell, over all documents."""
    schema = "chunk int, part int, data binary"
    parts = documents.select("text").mapInArrow(lean(_frequencies), schema).groupBy("chunk", "part").applyInArrow(_add, schema)
    rows = parts.groupBy("chunk").applyInArrow(_add, schema).collect()  # 2^CELLS / CHUNK rows and one
    cells, docs = np.zeros(1 << CELLS), 0
    for r in rows:
        values = np.frombuffer(r["data"], "<i8")
        if r["chunk"] < 0:
            docs = int(values[0])
        else:
            cells[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = values
    noise = (cells.sum() - cells) / max(1, len(cells) - 1)
    frequency = np.clip(cells - noise, 1, max(1, docs))
    return 1 + np.log((1 + docs) / (1 + frequency)) / max(np.log1p(docs), 1e-9)


def _unit(x: np.ndarray, salt: int) -> np.ndarray:
    """Uniform in (0, 1) from the shingle's number."""
    return ((mix(x ^ np.uint64(salt)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


SALTS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377, 0xBE5466CF34E90C6C)
BORROW = np.random.default_rng(377).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)


def draws(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a shingle's sample depends on besides its weight: r, log c, beta and its bin."""
    r = -np.log(_unit(shingles, SALTS[0]) * _unit(shingles, SALTS[1]))
    c = np.log(-np.log(_unit(shingles, SALTS[2]) * _unit(shingles, SALTS[3])))
    return r, c, _unit(shingles, SALTS[4]), (mix(shingles ^ np.uint64(SALTS[5])) % np.uint64(BINS)).astype(np.int64)


def sample(shingles: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, drawn: tuple | None = None) -> np.ndarray:
    """n rows of BINS samples; 0 marks an empty bin (rows without any shingle only)."""
    r, c, beta, bins = drawn or draws(shingles)
    t = np.floor(np.log(weights) / r + beta)
    cost = c - r * (t - beta) - r
    slot = owner * BINS + bins
    cheapest = np.full(n * BINS, np.inf)
    np.minimum.at(cheapest, slot, cost)
    won = np.flatnonzero(cost == cheapest[slot])
    out = np.zeros(n * BINS, np.uint64)
    out[slot[won]] = mix(shingles[won] + t[won].astype(np.int64).astype(np.uint64) * np.uint64(SALTS[0])) | np.uint64(1)
    out, filled = out.reshape(n, BINS), np.isfinite(cheapest).reshape(n, BINS)
    row, empty = np.nonzero(filled.any(1)[:, None] & ~filled)
    turn = 0
    while len(row):
        lender = BORROW[empty, turn]
        good = filled[row, lender]
        out[row[good], empty[good]] = out[row[good], lender[good]]
        row, empty, turn = row[~good], empty[~good], turn + 1
    return out


def replicas(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each occurrence of a shingle, the first's being the shingle's own, and the shingles' positions."""
    at = np.repeat(np.arange(len(shingles)), counts)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    return shingles[at] + nth.astype(np.uint64) * BASE, at


def band_values(samples: np.ndarray) -> np.ndarray:
    parts = samples.reshape(len(samples), -1, ROWS)
    out = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        out = mix(out * np.uint64(SALTS[1]) + parts[:, :, i])
    return out.view(np.int64)


def signatures(texts: list[str | None], table: np.ndarray) -> tuple[list[bytes], np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Of each text: a digest of its words, band values, samples' last bytes, number of shingles and their weight."""
    import xxhash

    shingles, counts, per, numbers, words = shingle_counts(texts)
    ends = np.cumsum(words).tolist()
    data = memoryview(numbers.tobytes())
    digests = [xxhash.xxh3_128_digest(data[8 * (e - n) : 8 * e]) if n else xxhash.xxh3_128_digest(b"text" + (text or "").encode()) for text, e, n in zip(texts, ends, words.tolist(), strict=True)]
    owner = np.repeat(np.arange(len(texts)), per)
    weights = table[_cell(shingles)]
    totals = np.bincount(owner, counts * weights, len(texts))
    samples = np.zeros((len(texts), KINDS, BINS), np.uint64)
    if len(texts) == 1 and counts.sum() > AT_ONCE:
        samples[0] = _long_sample(shingles, counts, weights)
    else:
        units, at = replicas(shingles, counts)
        drawn = draws(units)
        samples[:, 0] = sample(units, weights[at], owner[at], len(texts), drawn)
        first = np.cumsum(counts) - counts
        samples[:, 1] = sample(shingles, np.ones(len(shingles)), owner, len(texts), tuple(x[first] for x in drawn))
    samples = samples.reshape(len(texts), KINDS * BINS)
    return digests, band_values(samples), [row.tobytes() for row in (samples >> np.uint64(8)).astype(np.uint8)], per, totals


def _long_sample(shingles: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Samples of one long text, of which about AT_ONCE replicas are held at a time; every bin of it is filled but by ill luck."""
    best, out = np.full((KINDS, BINS), np.inf), np.zeros((KINDS, BINS), np.uint64)

    def compete(kind: int, units: np.ndarray, weight: np.ndarray) -> None:
        r, c, beta, bins = draws(units)
        t = np.floor(np.log(weight) / r + beta)
        cost = c - r * (t - beta) - r
        cheapest = np.full(BINS, np.inf)
        np.minimum.at(cheapest, bins, cost)
        won = np.flatnonzero((cost == cheapest[bins]) & (cost < best[kind, bins]))
        out[kind, bins[won]] = mix(units[won] + t[won].astype(np.int64).astype(np.uint64) * np.uint64(SALTS[0])) | np.uint64(1)
        best[kind, bins[won]] = cost[won]

    for i in range(0, len(shingles), AT_ONCE):
        part = slice(i, i + AT_ONCE)
        compete(1, shingles[part], np.ones(len(shingles[part])))
        live, lo = np.arange(i, min(i + AT_ONCE, len(shingles))), 0
        while len(live):
            step = max(1, AT_ONCE // len(live))
            units, at = replicas(shingles[live] + np.array([lo], np.uint64) * BASE, np.minimum(counts[live] - lo, step))
            compete(0, units, weights[live][at])
            lo += step
            live = live[counts[live] > lo]
    filled = np.isfinite(best)
    for kind in range(KINDS):
        for bin in np.flatnonzero(~filled[kind]):
            out[kind, bin] = out[kind, BORROW[bin][filled[kind, BORROW[bin]].argmax()]]
    return out


def _sign(idf, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signatures(texts, idf.value) for texts in grouped(batch["text"].to_pylist(), CHARS)]
            values = np.concatenate([f[1] for f in found]) if found else np.zeros((0, KINDS * BANDS), np.int64)
            bands = pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), KINDS * BANDS).cast(pa.list_(pa.int64()))
            join = lambda i: [x for f in found for x in f[i]]
            made = [pa.array(join(0), pa.binary()), bands, pa.array(join(2), pa.binary()), pa.array(join(3), pa.int64()), pa.array(join(4), pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema=schema)

    return run


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _bags(texts: list[str | None], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Shingles and weights of each text."""
    shingles, counts, per, _, _ = shingle_counts(texts)
    weights, ends = counts * idf[_cell(shingles)], np.cumsum(per).tolist()
    return [(shingles[e - n : e], weights[e - n : e]) for e, n in zip(ends, per.tolist(), strict=True)]


def _alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Weighted and plain Jaccard similarity."""
    (s, ws), (t, wt) = a, b
    if not len(s) or not len(t):
        return 0.0, 0.0
    at = np.minimum(np.searchsorted(t, s), len(t) - 1)
    i = np.flatnonzero(t[at] == s)
    least = np.minimum(ws[i], wt[at[i]]).sum()
    return float(least / (ws.sum() + wt.sum() - least)), len(i) / (len(s) + len(t) - len(i))


def similar(a: str | None, b: str | None, idf: np.ndarray) -> tuple[float, float]:
    """Weighted and plain Jaccard similarity of two texts' shingles."""
    return _alike(*_bags([a, b], idf))


def _verify(idf, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good: list[bool] = []
            u, v = (batch[c].to_pylist() for c in ("text_u", "text_v"))
            at = 0
            for left in grouped(u, CHARS):
                bags = _bags([*left, *v[at : at + len(left)]], idf.value)
                good += [max(_alike(a, b)) >= least for a, b in zip(bags[: len(left)], bags[len(left) :], strict=True)]
                at += len(left)
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def least_equal(n: np.ndarray, least: float) -> np.ndarray:
    """The share of equal samples that a pair of similarity ``least`` has at the least, by the smaller number of shingles.

    With n shingles, F of B bins are filled and each lends to about (B - F) / F others.
    """
    filled = BINS * -np.expm1(-np.maximum(n, 1) / BINS)
    lent = (BINS - filled) / filled
    return least - DEVIATIONS * np.sqrt(least * (1 - least) * filled * ((1 + lent) ** 2 + lent)) / BINS


def _may(a: list[np.ndarray], b: list[np.ndarray], least: float) -> np.ndarray:
    """Pairs that may be similar. a, b: size, weight, those of the shingles that only its own component has, and marks.

    By one of the kinds: totals are near enough, what may be shared is enough, and enough samples are equal.
    """
    equal = (a[4] == b[4]).mean(-1)
    enough = least_equal(np.minimum(a[0], b[0]), least)
    found = np.zeros(len(enough), bool)
    for kind, total, own in ((1, 0, 2), (0, 1, 3)):
        n, m = a[total], b[total]
        near = np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9
        shared = np.minimum(n - a[own], m - b[own]) * (1 + least) >= least * (n + m) - 1e-6 * (n + m)
        found |= near & shared & (equal[:, kind] >= enough)
    return found


def _matrix(marks: pa.Array) -> np.ndarray:
    """Row, kind, bin."""
    return np.frombuffer(b"".join(marks.to_pylist()), np.uint8).reshape(len(marks), KINDS, BINS) if len(marks) else np.zeros((0, KINDS, BINS), np.uint8)


FACTS = ("size", "weight", "own_size", "own_weight")


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = np.zeros(len(batch))
            a, b = ([batch[f"size_{s}"].to_numpy(), batch[f"weight_{s}"].to_numpy(), none, none, _matrix(batch[f"marks_{s}"])] for s in "uv")
            yield batch.select(["u", "v"]).filter(pa.array(_may(a, b, least)))

    return run


def _buckets(nodes: DataFrame) -> DataFrame:
    """nodes: node, bands. value, node and n (the bucket's size) of those that share their bucket. A value tells its band."""
    members = nodes.select(F.explode("bands").alias("value"), "node")
    return members.join(members.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "value")


def _stars(buckets: DataFrame) -> DataFrame:
    """Pairs of a bucket's hub and each other node."""
    score = buckets.groupBy("node").agg(F.sum("n").alias("score"))
    hubs = buckets.join(score, "node").groupBy("value").agg(F.max(F.struct("score", (-F.col("node")).alias("back"))).alias("hub")).select("value", (-F.col("hub.back")).alias("hub"))
    pairs = buckets.join(hubs, "value").where("node <> hub")
    return pairs.select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()


def _shingle_rows(idf):
    """node, class, minor, text -> a row a shingle, less its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in grouped(batch["text"].to_pylist(), CHARS):
                shingles, counts, per, _, _ = shingle_counts(texts)
                rows = pa.array(np.repeat(np.arange(at, at + len(texts)), per))
                at += len(texts)
                weights = counts * idf.value[_cell(shingles)]
                yield pa.RecordBatch.from_arrays([*(batch[c].take(rows) for c in ("node", "class", "minor")), pa.array(shingles.view(np.int64)), pa.array(weights)], ["node", "class", "minor", "shingle", "weight"])

    return run


def _own(people: DataFrame, idf) -> DataFrame:
    """people: node, class, minor, text. Of each minor node: how many shingles, and of what weight, only its class has."""
    rows = through_files(people.mapInArrow(_shingle_rows(idf), "node long, class long, minor boolean, shingle long, weight double"), "mixed-shingles")
    shared = rows.groupBy("shingle").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("shingle")
    own = rows.where("minor").join(shared, "shingle", "left_anti")
    return own.groupBy("node").agg(F.count(F.lit(1)).alias("own_size"), F.sum("weight").alias("own_weight"))


def _unpacked(packed: bytes | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    if packed is None:
        return None
    shingles, counts = np.frombuffer(packed, "<u4").reshape(2, -1)
    return shingles, counts * idf[shingles >> np.uint32(32 - CELLS)]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The upper halves of a text's shingles, in order, and their counts; null if there are more than FEW, or two with one half.

    Two texts' shingles of one half count as the same, so similarities by halves are never smaller than by whole numbers.
    """
    for batch in batches:
        out: list[bytes | None] = []
        for texts in grouped(batch["text"].to_pylist(), CHARS):
            shingles, counts, per, _, _ = shingle_counts(texts)
            ends = np.cumsum(per).tolist()
            for e, n in zip(ends, per.tolist(), strict=True):
                halves = (shingles[e - n : e] >> np.uint64(32)).astype("<u4")
                same = n > 1 and bool((halves[1:] == halves[:-1]).any())
                out.append(None if n > FEW or same else np.stack([halves, counts[e - n : e].astype("<u4")]).tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i, c in enumerate(batch.schema.names) if c != "text"), pa.array(out, pa.binary())], [*(c for c in batch.schema.names if c != "text"), "packed"])


def _strangers(idf, least: float):
    """Rows ordered by block -> pairs of different classes between its left and right rows that may be similar."""

    def pairs(left: np.ndarray, right: np.ndarray, rows: list[np.ndarray]) -> Iterator[np.ndarray]:
        node, kind, minor, packed, *facts = rows
        step = max(1, PAIRS // max(1, len(right)))
        bags: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}

        def bag(i: int):
            if i not in bags:
                bags[i] = _unpacked(packed[i], idf.value)
            return bags[i]

        def alike(i: int, j: int) -> bool:
            x, y = bag(i), bag(j)
            return x is None or y is None or max(_alike(x, y)) >= least - 1e-9

        for i in range(0, len(left), step):
            a, b = (x.reshape(-1) for x in np.meshgrid(left[i : i + step], right, indexing="ij"))
            apart = (kind[a] != kind[b]) & (~minor[b] | (node[a] > node[b]))  # two outsiders meet twice
            a, b = a[apart], b[apart]
            good = np.flatnonzero(_may([x[a] for x in facts], [x[b] for x in facts], least))
            good = good[[alike(i, j) for i, j in zip(a[good].tolist(), b[good].tolist(), strict=True)]] if len(good) else good
            yield np.sort(np.stack([node[a[good]], node[b[good]]]), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def searched(keys: np.ndarray, rest: list[np.ndarray]) -> pa.RecordBatch:
            bounds = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            found = [np.zeros((2, 0), np.int64)]
            for start, end in zip(bounds[:-1], bounds[1:], strict=True):
                at = np.arange(start, end)
                is_left = rest[0][at]
                found += pairs(at[is_left], at[~is_left], rest[1:])
            u = np.unique(np.concatenate(found, 1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(u[1], pa.int64()), pa.array(u[0], pa.int64())], ["u", "v"])

        for batch in batches:
            keys = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("value", "a", "b")], 1)
            rows = [keys, *(batch[c].to_numpy(zero_copy_only=False) for c in ("left", "node", "class", "minor")), np.array(batch["packed"].to_pylist(), object), *(batch[c].to_numpy() for c in FACTS), _matrix(batch["marks"])]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            # The last block may go on in the next batch.
            done = int(np.flatnonzero((rows[0] != rows[0][-1]).any(1)).max(initial=-1)) + 1 if len(rows[0]) else 0
            held = [x[done:] for x in rows]
            if done:
                yield searched(rows[0][:done], [x[:done] for x in rows[1:]])
        if held is not None and len(held[0]):
            yield searched(held[0], held[1:])

    return run


def _left_over(buckets: DataFrame, nodes: DataFrame, idf, least: float) -> DataFrame:
    """buckets: value, node, class; nodes: those in buckets, with texts. All pairs of different classes in a bucket that may be similar."""
    counts = buckets.groupBy("value", "class").agg(F.count(F.lit(1)).alias("c"))
    mixed = counts.groupBy("value").agg(F.max(F.struct("c", "class")).alias("main"), F.sum("c").alias("all")).where("all > main.c").select("value", F.col("main.class").alias("main"))
    rows = through_files(buckets.join(mixed, "value").select("value", "node", "class", (F.col("class") != F.col("main")).alias("minor")), "mixed")
    people = through_files(rows.groupBy("node", "class").agg(F.max("minor").alias("minor")), "mixed-nodes")
    own = _own(nodes.select("node", "text").join(people, "node"), idf)
    facts = people.select("node").join(nodes.select("node", "text", "size", "weight", "marks"), "node").join(own, "node", "left").na.fill(0, ["own_size"]).na.fill(0.0, ["own_weight"])

    def partner(total: str, own: str) -> Column:
        """The largest size or weight of a text that may be similar."""
        return (F.col(total) - F.col(own)) * (1 + least) / least - F.col(total)

    few_own = lambda total, own, smallest: partner(total, own) * (1 + 1e-6) >= smallest
    alive = facts.where(few_own("size", "own_size", least * F.col("size")) | few_own("weight", "own_weight", least * F.col("weight")))
    columns = ["node long", "size double", "weight double", "own_size double", "own_weight double", "marks binary"]
    alive = alive.selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1].replace('long', 'bigint')}) AS {c.split()[0]}" for c in columns], "text")
    alive = through_files(alive.mapInArrow(_packed, ", ".join([*columns, "packed binary"])), "mixed-alive")
    rows = rows.join(alive.select("node", *FACTS), "node")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = rows.groupBy("value").agg(F.count_if("minor").alias("few"), F.count(F.lit(1)).alias("many"), F.min("size").alias("least_size"), F.min("weight").alias("least_weight")).where("few > 0")
    rows = rows.join(sizes.withColumns({"few": blocks(F.col("few")), "many": blocks(F.col("many"))}), "value")
    rows = rows.withColumn("minor_alive", F.col("minor") & (few_own("size", "own_size", F.col("least_size")) | few_own("weight", "own_weight", F.col("least_weight")))).drop(*FACTS)
    part = lambda n: F.pmod(F.xxhash64("node", "value"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("minor_alive").withColumn("a", part(F.col("few"))).withColumn("b", every("many")).withColumn("left", F.lit(True))
    right = rows.withColumn("b", part(F.col("many"))).withColumn("a", every("few")).withColumn("left", F.lit(False))
    key = ["value", "a", "b"]
    both = left.unionByName(right).join(alive, "node").select(*key, "left", "node", "class", F.col("minor_alive").alias("minor"), *FACTS, "marks", "packed")
    return both.repartition(*key).sortWithinPartitions(*key).mapInArrow(_strangers(idf, least), "u long, v long").distinct()


def _classes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node and class, for all nodes."""
    found = components(links).select(F.col("u").alias("node"), F.col("v").alias("class"))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("class", "node").alias("class"))


def find_classes(documents: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """documents with _row and _digest, and for each _digest: _class (smallest doc_id) and _first (the _row that stays).

    Both are written tables; all others that the search writes are removed at its end.
    """
    with removed_after(documents.sparkSession):
        return _searched(documents, least)


def _searched(documents: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    spark = documents.sparkSession
    idf = spark.sparkContext.broadcast(idf_table(documents))
    rows = documents.withColumn("_row", F.monotonically_increasing_id())
    made = [T.StructField("_digest", T.BinaryType()), T.StructField("_bands", T.ArrayType(T.LongType())), T.StructField("_marks", T.BinaryType()), T.StructField("_size", T.LongType()), T.StructField("_weight", T.DoubleType())]
    schema = T.StructType([*rows.schema.fields, *made])
    signed = through_files(rows.mapInArrow(lean(_sign(idf, _arrow_schema(schema))), schema), "signed", outlives=True)
    # Rows of one node have the same samples; the first row in the order of doc_id speaks for it.
    rank = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), F.col("_row").alias("row"))
    nodes = through_files(signed.groupBy("_digest").agg(F.min(rank).alias("rank"), F.first("_bands").alias("bands"), F.first("_size").alias("size")).withColumn("node", F.col("rank.row")), "nodes")
    buckets = through_files(_buckets(nodes.where("size > 0")), "buckets")
    met = through_files(buckets.select("node").distinct(), "met")
    bucketed = through_files(signed.select(F.col("_row").alias("node"), "text", *[F.col(f"_{c}").alias(c) for c in ("size", "weight", "marks")]).join(met, "node", "left_semi"), "bucketed")
    texts, tokens = bucketed.select("node", "text"), bucketed.drop("text")

    def sided(df: DataFrame, side: str) -> DataFrame:
        return df.withColumnsRenamed({c: side if c == "node" else f"{c}_{side}" for c in df.columns})

    def verified(likely: DataFrame) -> DataFrame:
        both = likely.join(sided(texts, "u"), "u").join(sided(texts, "v"), "v")
        return through_files(both.mapInArrow(lean(_verify(idf, least)), "u long, v long"), "verified")

    marked = _stars(buckets).join(sided(tokens, "u"), "u").join(sided(tokens, "v"), "v")
    pairs = through_files(marked.mapInArrow(_likely(least), "u long, v long"), "pairs")
    links = verified(pairs)
    classes = through_files(_classes(nodes, links), "classes")
    fresh = through_files(_left_over(buckets.select("value", "node").join(classes, "node"), bucketed, idf, least).join(pairs, ["u", "v"], "left_anti"), "pairs")
    more = verified(fresh)
    if more.limit(1).count():
        classes = through_files(_classes(nodes, links.unionByName(more)), "classes")
    named = nodes.select("_digest", "node", "rank").join(classes, "node")
    firsts = named.groupBy("class").agg(F.min("rank").alias("first"))
    found = named.join(firsts, "class").select("_digest", F.col("first.id").alias("_class"), F.col("first.row").alias("_first"))
    return signed, through_files(found, "near-classes", outlives=True)


def near_duplicates(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """documents: doc_id, text. One row a document: doc_id, class_id (the class's smallest doc_id; null if it has none), kept."""
    signed, classes = find_classes(documents.select("doc_id", "text"), least)
    found = signed.select("doc_id", "_row", "_digest").join(classes, "_digest")
    return found.select("doc_id", F.when(F.col("_class") < 2**63 - 1, F.col("_class")).alias("class_id"), (F.col("_row") == F.col("_first")).alias("kept"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def distinct_documents(documents: DataFrame) -> DataFrame:
    """The pipeline's stage: one document of each class, all columns kept."""
    plain, restore = shield(documents, "doc_id", "text")
    signed, classes = find_classes(plain)
    gone = through_files(signed.select("_row", "_digest").join(classes, "_digest").where("_row <> _first").select("_row"), "gone")
    return restore(signed.join(gone, "_row", "left_anti"))
