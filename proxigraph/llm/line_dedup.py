"""Line deduplication with a log-template tree of fixed depth.

A line's path in the tree is its token count and its LEAD first tokens;
tokens that look variable (a digit, ``@`` or ``://``) are wildcards on the
way down, unless they are more than half of the line. So every line has one
whole template. The leaf generalises the fields that don't look variable: of
the different whole templates in it, a token is a field where fewer than
COMMON of them (and fewer than two) have it at its place. If a template of
MIN_GENERAL or more tokens has one field or more, but at most one in
FIELD_EVERY tokens (at least one is allowed), its fields become wildcards;
if templates of MIN_FIRST or more different first documents then are the
same, they are one template from there on. Otherwise it stays as it was. So a
line has exactly one template, whatever the order of documents.

A template recurs if ``min_docs`` or more documents have it. Its first
document (smallest doc_id) keeps its lines; in all others, lines of a
recurring template are dropped. As a line has one template, every template
that a line is dropped for is still there in its first document.

One row of hashes a line is written and shuffled, with counts combined before
the shuffle, so a template that a third of all documents share is one row a
task; the join back to its lines is one that Spark can split. Tokens are
looked at for templates only whose leaf holds several: a bitmap of 2^BITS bits
(all that is broadcast) lets most other lines pass in the second reading, and
a join settles the rest. Of these, a template is cut into one stretch more than
it may have fields, so one stretch has none: only templates that share one with
others have their fields looked for.

Defined results: null text is empty. Lines end at ``\\n``; blank lines are
kept always. A line of mostly variable tokens is its own template, so rows of
numbers don't match each other. Repeats within a document are no recurrence.
Very long lines are lines like others. Rows that share a doc_id count as one
document as to who keeps a line, but each loses only its own lines; a null
doc_id (and 2^63 - 1) comes after all others, and each row with it is a
document of its own, the first row first. A document that loses all its
lines stays, with empty text; other columns are kept. An empty table gives an
empty result. Rows are numbered in a written table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.llm.common import lean, removed_after, shield, table, through_files

LEAD, MIN_GENERAL, MIN_DOCS, MIN_FIRST = 2, 5, 2, 3
#: A token is a field if fewer than one in COMMON of its leaf's templates have it; a template has at most one field in FIELD_EVERY tokens.
COMMON, FIELD_EVERY = 10, 6
#: Bits of the bitmap, as a power of two: 4 MB. Templates that a task remembers to have sent already.
BITS, SENT = 25, 100_000
WILDCARD = b"<*>"
#: Joins tokens; no token holds it, as it is white space to bytes.split.
GLUE = b" "
_variable = re.compile(rb"[0-9@]|://").search
LINE_SCHEMA = "row long, doc long, line int, n int, leaf long, k1 long, k2 int"
TOKEN_SCHEMA = "k1 long, k2 int, tokens array<int>, stretches array<long>"
LAST = 2**63 - 1


def template(line: bytes) -> list[bytes]:
    """The tokens of the line's whole template."""
    tokens = line.split()
    if _variable(line):
        masked = [WILDCARD if _variable(t) else t for t in tokens]
        if 2 * masked.count(WILDCARD) <= len(tokens):
            return masked
    return tokens


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, doc, text -> LINE_SCHEMA; a whole template once a row of the input but for its lines' numbers."""
    import xxhash

    digest, short = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest
    for batch in batches:
        keys: list[bytes] = []
        cols: list[list[int]] = [[] for _ in range(5)]

        def flush() -> pa.RecordBatch:
            whole = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
            row, doc, line, n, leaf = (np.array(c, t) for c, t in zip(cols, ("i8", "i8", "i4", "i4", "u8"), strict=True))
            made = pa.RecordBatch.from_arrays([pa.array(c) for c in (row, doc, line, n, leaf.view("i8"), whole[:, 0].astype("<i8"), (whole[:, 1] & np.uint64(0xFFFFFFFF)).astype("<u4").view("<i4"))], ["row", "doc", "line", "n", "leaf", "k1", "k2"])
            for c in (keys, *cols):
                c.clear()
            return made

        for row, doc, text in zip(*(batch[c].to_pylist() for c in ("row", "doc", "text")), strict=True):
            for i, line in enumerate((text or "").encode().split(b"\n")):
                tokens = template(line)
                if tokens:
                    keys.append(digest(GLUE.join(tokens)))
                    for c, v in zip(cols, (row, doc, i, len(tokens), short(b"%d %s" % (len(tokens), GLUE.join(tokens[:LEAD])))), strict=True):
                        c.append(v)
            if len(keys) > 50_000:
                yield flush()
        yield flush()


def stretches(tokens: list[bytes]) -> list[bytes]:
    """One more than the fields that a template may have."""
    n, parts = len(tokens), max(1, len(tokens) // FIELD_EVERY) + 1
    return [b"%d %s" % (j, GLUE.join(tokens[n * j // parts : n * (j + 1) // parts])) for j in range(parts)]


def _tokens(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """text -> TOKEN_SCHEMA of the templates that are in the bitmap, each about once a task."""
        import xxhash

        digest, short, bits = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest, bitmap.value
        sent: set[bytes] = set()
        for batch in batches:
            keys: list[bytes] = []
            tokens: list[np.ndarray] = []
            parts: list[np.ndarray] = []
            for text in batch["text"].to_pylist():
                for line in (text or "").encode().split(b"\n"):
                    found = template(line)
                    if len(found) < MIN_GENERAL:
                        continue
                    key = digest(GLUE.join(found))
                    at = int.from_bytes(key[:8], "little") >> (64 - BITS)
                    if bits[at >> 3] >> (at & 7) & 1 and key not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(key)
                        keys.append(key)
                        tokens.append((np.array([*map(short, found)], np.uint64) >> np.uint64(32)).astype("<u4").view("<i4"))
                        leaf = b"%d %s " % (len(found), GLUE.join(found[:LEAD]))
                        parts.append(np.array([short(leaf + s) for s in stretches(found)], np.uint64).view("<i8"))
            whole = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(whole[:, 0].astype("<i8")), pa.array((whole[:, 1] & np.uint64(0xFFFFFFFF)).astype("<u4").view("<i4")), pa.array(tokens, pa.list_(pa.int32())), pa.array(parts, pa.list_(pa.int64()))], ["k1", "k2", "tokens", "stretches"])

    return run


def _document(doc: str, row: str) -> Column:
    """What a document is told by, in order; of documents with an id, the id says it all."""
    return F.struct(F.col(doc).alias("doc"), F.when(F.col(doc) == LAST, F.col(row)).otherwise(F.lit(-1)).alias("row"))


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Of the highest BITS bits of k1; 2^BITS / 64 rows reach the driver at most, however many keys there are."""
    at = keys.select(F.shiftrightunsigned("k1", 64 - BITS).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).collect()
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    for r in words:
        bitmap[r["word"]] = r["bits"]
    return bitmap.view(np.uint8)


def _generalised(documents: DataFrame, wholes: DataFrame) -> DataFrame:
    """wholes: k1, k2, leaf, n, doc, row (of the first document). k1, k2, owner and firsts of the templates that have become one with others."""
    long = wholes.where(F.col("n") >= MIN_GENERAL).drop("n")
    leaves = long.groupBy("leaf").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    loose = through_files(long.join(leaves, "leaf"), "loose-templates")
    bitmap = documents.sparkSession.sparkContext.broadcast(_bitmap(loose.select("k1")))
    found = documents.select("text").mapInArrow(lean(_tokens(bitmap)), TOKEN_SCHEMA).groupBy("k1", "k2").agg(F.first("tokens").alias("tokens"), F.first("stretches").alias("stretches"))
    loose = through_files(found.join(loose, ["k1", "k2"]), "loose-tokens")
    parts = loose.select("k1", "k2", F.explode("stretches").alias("stretch"))
    shared = parts.groupBy("stretch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_FIRST).select("stretch")
    likely = through_files(loose.drop("stretches").join(parts.join(shared, "stretch").select("k1", "k2").distinct(), ["k1", "k2"], "left_semi"), "likely-templates")
    # How many of its leaf's templates have a token at its place: of all, as the others count too.
    around = loose.select("leaf", "tokens").join(likely.select("leaf").distinct(), "leaf", "left_semi")
    place = lambda df, *more: df.select(*more, "leaf", F.posexplode("tokens").alias("place", "token")).withColumn("at", F.xxhash64("leaf", "place", "token"))
    counts = place(around).groupBy("at").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    marked = place(likely, "k1", "k2", "m", "doc", "row").join(counts, "at", "left").withColumn("fixed", F.coalesce(F.col("c") * COMMON >= F.col("m"), F.lit(False)))
    made = marked.groupBy("k1", "k2", "leaf").agg(F.array_sort(F.collect_list(F.struct("place", F.when(F.col("fixed"), F.col("token")).alias("token")))).alias("path"), F.count_if(~F.col("fixed")).alias("fields"), F.count(F.lit(1)).alias("n"), F.first(_document("doc", "row")).alias("first"))
    made = made.where((F.col("fields") > 0) & (F.col("fields") <= F.greatest(F.lit(1), F.floor(F.col("n") / FIELD_EVERY)))).select("k1", "k2", "leaf", "first", F.xxhash64("path").alias("t1"), F.hash("path").alias("t2"))
    made = through_files(made, "general-templates")
    same = made.groupBy("leaf", "t1", "t2").agg(F.count_distinct("first").alias("firsts"), F.min("first").alias("owner")).where(F.col("firsts") >= MIN_FIRST)
    return made.join(same, ["leaf", "t1", "t2"]).select("k1", "k2", "owner", "firsts")


def dropped_lines(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """documents: doc_id, text, _row (its number, the same each time it is read). Returns row and lines: numbers (from 0) of the lines to drop; one row a row that has any."""
    rows = documents.select(F.col("_row").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text")
    lines = through_files(rows.mapInArrow(lean(_lines), LINE_SCHEMA), "lines")
    document, nameless = _document("doc", "row"), F.when(F.col("doc") == LAST, F.col("row"))
    found = lines.groupBy("k1", "k2").agg(F.first("leaf").alias("leaf"), F.first("n").alias("n"), F.min("doc").alias("d"), F.max("doc").alias("last"), F.min(nameless).alias("r"), F.max(nameless).alias("last_row"), *([] if min_docs == 2 else [F.count_distinct(document).alias("docs")]))
    many = (F.col("d") < F.col("last")) | ((F.col("d") == LAST) & (F.col("r") < F.col("last_row"))) if min_docs == 2 else F.col("docs") >= min_docs
    wholes = through_files(found.select("k1", "k2", "leaf", "n", F.col("d").alias("doc"), F.col("r").alias("row"), many.alias("many")), "templates")
    general = _generalised(rows, wholes.drop("many")).where(F.col("firsts") >= min_docs).drop("firsts")
    owners = wholes.join(general, ["k1", "k2"], "left").where("many or owner is not null").select("k1", "k2", F.coalesce("owner", document).alias("owner"))
    return lines.select("row", "doc", "line", "k1", "k2").join(owners, ["k1", "k2"]).where(document > F.col("owner")).groupBy("row").agg(F.collect_set("line").alias("lines"))


def dedup_lines(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id and text, less its dropped lines, and other columns of documents; adds n_lines and n_dropped, in place of columns of these names."""
    documents = documents.drop("n_lines", "n_dropped")
    numbered = through_files(documents.withColumn("_row", F.monotonically_increasing_id()), "line-rows")
    with removed_after(documents.sparkSession):
        drops = through_files(dropped_lines(numbered, min_docs).select(F.col("row").alias("_of"), F.col("lines").alias("_lines")), "line-drops", outlives=True).hint("merge")
    joined = numbered.join(drops, F.col("_row") == F.col("_of"), "left")
    parts = joined.withColumn("_parts", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_lines")), lambda i: F.element_at("_parts", i + 1))
    text = F.when(F.col("_lines").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(left, "\n"))
    gone = F.when(F.col("_lines").isNull(), F.lit(0)).otherwise(F.size("_parts") - F.size(left))
    return parts.select(*[text.alias("text") if c == "text" else F.col(c) for c in documents.columns], F.size("_parts").alias("n_lines"), gone.alias("n_dropped"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_dropped")


def deduplicated(documents: DataFrame) -> DataFrame:
    """The pipeline's stage: the same columns, with n_chars of the text that is left."""
    plain, restore = shield(documents, "doc_id", "text", "n_chars")
    out = dedup_lines(plain)
    if "n_chars" in plain.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(plain.schema["n_chars"].dataType))
    return restore(out)


def _oracle() -> str:
    space, variable, wild = "[ \\t\\r\\f\\v]+", "[0-9@]|://", WILDCARD.decode()
    return f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents),
t AS (SELECT doc_id, line, list_filter(string_split_regex(content, '{space}'), lambda x: x <> '') AS raw FROM l),
v AS (SELECT *, len(raw) AS n, list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '{variable}') THEN '{wild}' ELSE x END) AS masked FROM t),
m AS (SELECT doc_id, line, n, CASE WHEN 2 * len(list_filter(masked, lambda x: x = '{wild}')) <= n THEN masked ELSE raw END AS tokens FROM v WHERE n > 0),
w AS (SELECT tokens, n, n || ' ' || array_to_string(tokens[1:{LEAD}], ' ') AS leaf, min(doc_id) AS first, count(DISTINCT doc_id) AS docs FROM m GROUP BY tokens, n),
lo AS (SELECT *, count(*) OVER (PARTITION BY leaf) AS m FROM w WHERE n >= {MIN_GENERAL}),
tk AS (SELECT tokens, leaf, m, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM lo WHERE m > 1),
c AS (SELECT *, count(*) OVER (PARTITION BY leaf, place, token) AS c FROM tk),
g AS (
  SELECT tokens, leaf, array_to_string(list(CASE WHEN c >= 2 AND c * {COMMON} >= m THEN token ELSE '' END ORDER BY place), ' ') AS path, count(*) FILTER (WHERE NOT (c >= 2 AND c * {COMMON} >= m)) AS fields, count(*) AS n
  FROM c GROUP BY tokens, leaf),
s AS (
  SELECT g.tokens, min(lo.first) OVER p AS owner, g.leaf, g.path, lo.first
  FROM g JOIN lo ON g.tokens = lo.tokens WHERE fields BETWEEN 1 AND greatest(1, g.n // {FIELD_EVERY}) WINDOW p AS (PARTITION BY g.leaf, g.path)),
e AS (SELECT leaf, path FROM s GROUP BY leaf, path HAVING count(DISTINCT first) >= {MIN_FIRST}),
o AS (
  SELECT w.tokens, coalesce(x.owner, w.first) AS owner
  FROM w LEFT JOIN (SELECT s.tokens, s.owner FROM s JOIN e ON s.leaf = e.leaf AND s.path = e.path) x ON w.tokens = x.tokens WHERE w.docs >= {MIN_DOCS} OR x.owner IS NOT NULL),
d AS (SELECT m.doc_id, m.line FROM m JOIN o ON m.tokens = o.tokens WHERE m.doc_id > o.owner)
SELECT l.doc_id, coalesce(string_agg(l.content, chr(10) ORDER BY l.line) FILTER (WHERE d.line IS NULL), '') AS text, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(d.line) AS INTEGER) AS n_dropped
FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.line = d.line GROUP BY l.doc_id"""


ORACLE = _oracle()
