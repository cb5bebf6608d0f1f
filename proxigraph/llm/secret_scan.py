"""Secret scanning with DataFrame functions only: fixed patterns, then sliding-window Shannon entropy.

Base spans are the leftmost non-overlapping matches of each pattern in
KINDS; those under the kind's least length are dropped afterwards, so they
still consume their text. The entropy method looks at candidate strings
(runs of CANDIDATE), assigns each a character class and slides a window of
WINDOW characters over it. The window's entropy is log2(w) - S / w with S
the sum of c * log2(c) over character counts c; a step changes two counts,
so S is kept by two table look-ups, in whole millionths. Windows at or over
the class's threshold are joined to one span a candidate, unless the
candidate fits the allow-list or the span overlaps a base span.

Positions are code points, ends exclusive. Text is matched as a whole;
nothing is exploded or shuffled. Positions come from the lengths of what a
pattern matches and of what lies between; their running sums are taken in
blocks, so a document with very many matches stays cheap.

Defined results: null text is empty; rows are judged one by one, so repeated
rows and null doc_ids are kept; other columns are ignored; an empty table
gives an empty result. Very long texts are matched whole, and very long
candidates cost time in proportion to their length (some microseconds a
character) and nothing recurses on them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.llm.common import table


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Least length of the group, or of the whole match for group 0.
    group: int
    least: int
    #: Lower-cased text without any of these has no match.
    hints: tuple[str, ...]


_WORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = rf"""({"|".join(map(_either_case, _WORDS))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs over {32,} are those of + with 32 characters or more, as runs are maximal either way; likewise for AKIA.
KINDS = (
    Kind("assign", ASSIGN, 2, 8, ("password", "passwd", "secret", "token", "api_key", "apikey")),
    Kind("access", "AKIA[A-Z0-9]{12,}", 0, 16, ("akia",)),
    Kind("hex", "[0-9a-f]{32,}", 0, 32, ()),
)
WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Class, pattern of the whole candidate, bits a character from which a window counts. The first that fits holds.
CLASSES = (("digits", r"[0-9+/_=-]*", math.inf), ("hex", r"[0-9a-f]*|[0-9A-F]*", 3.0), ("mixed", r".*[0-9].*", 3.7), ("letters", r".*", 4.05))
#: Whole candidates that are no secrets: words, UUIDs, documented placeholders, alphabets in order, rows of one character.
ALLOW = (r"[A-Z]?[a-z]+([_-][A-Za-z]?[a-z]*)*", r"[A-Z]+([_-][A-Z]*)*", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r".*(EXAMPLE|example|PLACEHOLDER|placeholder|CHANGEME|changeme|XXXX|xxxx).*", r".*(0123456789|abcdefghijklm|ABCDEFGHIJKLM).*", r"(.)\1*")
UNIT = 1_000_000
PLOGP = tuple(round(c * math.log2(c) * UNIT) if c else 0 for c in range(WINDOW + 1))
BLOCK = 256


def sum_limit(bits: float) -> int:
    """S at or below this is an entropy of at least so many bits; -1: never."""
    return -1 if bits == math.inf else math.floor((math.log2(WINDOW) - bits) * WINDOW * UNIT)


def running_sums(sizes: Column) -> Column:
    """Sum before each element of an array of int, in blocks so that no long array is rebuilt element by element."""
    starts = F.when(F.size(sizes) > 0, F.sequence(F.lit(1), F.size(sizes), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda at: F.slice(sizes, at, BLOCK))

    def scan(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    before = scan(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x)))
    return F.flatten(F.zip_with(blocks, before, lambda b, first: F.transform(scan(b), lambda x: x + first)))


def _spans(found: Column, gaps: Column, before: Column, order: int, name: str, keep) -> Column:
    parts = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"), before.alias("b"))
    spans = F.transform(parts, lambda p: F.struct((p["b"] + F.char_length(p["g"])).alias("start"), F.lit(order).alias("order"), (p["b"] + F.char_length(p["g"]) + F.char_length(p["m"])).alias("end"), F.lit(name).alias("kind"), p["m"].alias("text")))
    return F.filter(spans, lambda s: keep(s["text"]))


NO_SPANS = "array<struct<start:int,order:int,end:int,kind:string,text:string>>"


def _entropy_span(text: Column, start: Column, limit: Column) -> Column:
    """First and last window with S at most limit, as a span; start -1 if none.

    The candidate is cut into stretches of BLOCK characters with the WINDOW before them (blanks before the first), so
    that a character is never looked up from the far end of a long string. A step's change of S depends on the window
    before it alone: the coming character's count grows by one, and that of the one that goes falls.
    """
    table = F.array(*map(F.lit, PLOGP))
    value = lambda c: F.element_at(table, c + 1)
    part = lambda x, at, n: F.call_function("substring", x, at, n if isinstance(n, Column) else F.lit(n))
    padded = F.concat(F.lit(" " * WINDOW), text)
    stretches = F.transform(F.sequence(F.lit(1), F.char_length(text), F.lit(BLOCK)), lambda at: part(padded, at, BLOCK + WINDOW))

    def change(stretch: Column, at: Column) -> Column:
        before, come, gone = part(stretch, at, WINDOW), part(stretch, at + WINDOW, 1), part(stretch, at, 1)
        had = lambda c: WINDOW - F.char_length(F.call_function("replace", before, c, F.lit("")))
        grown = value(had(come) + 1) - value(had(come))
        fallen = F.when(gone == " ", F.lit(0)).otherwise(value(had(gone) - 1) - value(had(gone)))
        return F.when(come == gone, F.lit(0)).otherwise(grown + fallen)

    changes = F.flatten(F.transform(stretches, lambda x: F.transform(F.sequence(F.lit(1), F.char_length(x) - WINDOW), lambda at: change(x, at))))
    # The limit is part of the state, as a step would work it out anew from the whole candidate.
    state = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("s"), limit.alias("limit"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(acc: Column, moved: Column) -> Column:
        i, s = acc["i"] + 1, acc["s"] + moved
        hit = (i >= WINDOW) & (s <= acc["limit"])
        return F.struct(i.alias("i"), s.alias("s"), acc["limit"].alias("limit"), F.when(hit & (acc["first"] < 0), i - WINDOW).otherwise(acc["first"]).alias("first"), F.when(hit, i).otherwise(acc["last"]).alias("last"))

    done = F.aggregate(changes, state, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))
    span = lambda d: F.struct(F.when(d["first"] < 0, F.lit(-1)).otherwise(start + d["first"]).alias("start"), F.lit(len(KINDS)).alias("order"), (start + d["last"]).alias("end"), F.lit("entropy").alias("kind"), text.alias("text"))
    return F.element_at(F.transform(F.array(done), span), 1)


def _limit(text: Column) -> Column:
    found = F.lit(-1)
    for _, pattern, bits in reversed(CLASSES):
        found = F.when(text.rlike(f"^(?:{pattern})$"), F.lit(sum_limit(bits))).otherwise(found)
    return found.cast("long")


def _allowed(text: Column) -> Column:
    """One of ALLOW fits. The two for words are put so that no group repeats, as Java's patterns recurse for each repeat."""
    words = text.rlike("^[A-Za-z_-]+$") & text.rlike("^[A-Z]?[a-z]") & ~text.rlike("[A-Za-z][A-Z]")
    capitals = text.rlike("^[A-Z][A-Z_-]*$")
    same = F.call_function("replace", text, F.call_function("substring", text, F.lit(1), F.lit(1)), F.lit("")) == ""
    return words | capitals | text.rlike("^(?:" + "|".join(f"(?:{p})" for p in ALLOW[2:-1]) + ")$") | same


def find_secrets(documents: DataFrame) -> DataFrame:
    """documents: doc_id, text. Returns doc_id, base and entropy: arrays of spans (start, order, end, kind, text)."""
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).withColumn("low", F.lower("t"))
    searches = [*((k.name, k.pattern, k.hints) for k in KINDS), ("entropy", CANDIDATE, ())]

    def hinted(pattern: str, hints: tuple[str, ...]) -> Column:
        if not hints:
            return F.col("t").rlike(pattern)
        found = F.lit(False)
        for h in hints:
            found = found | F.col("low").contains(h)
        return found

    none = F.array().cast("array<string>")
    docs = docs.select("doc_id", "t", *[hinted(p, h).alias(f"has_{n}") for n, p, h in searches])
    docs = docs.select("doc_id", *[F.when(F.col(f"has_{n}"), F.regexp_extract_all("t", F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{n}") for n, p, _ in searches], *[F.when(F.col(f"has_{n}"), F.split("t", p, -1)).otherwise(none).alias(f"g_{n}") for n, p, _ in searches])
    sizes = lambda n: F.zip_with(F.slice(F.col(f"g_{n}"), 1, F.size(f"m_{n}")), F.col(f"m_{n}"), lambda g, m: F.char_length(g) + F.char_length(m))
    docs = docs.select("*", *[F.when(F.size(f"m_{n}") > 0, running_sums(sizes(n))).otherwise(F.array().cast("array<int>")).alias(f"b_{n}") for n, _, _ in searches])
    keep = {k.name: (lambda text, k=k: F.char_length(F.regexp_extract(text, f"^{k.pattern}$", k.group) if k.group else text) >= k.least) for k in KINDS}
    keep["entropy"] = lambda text: (_limit(text) >= 0) & ~_allowed(text)
    made = [F.when(F.size(f"m_{n}") > 0, _spans(F.col(f"m_{n}"), F.col(f"g_{n}"), F.col(f"b_{n}"), i, n, keep[n])).otherwise(F.array().cast(NO_SPANS)).alias(f"s_{n}") for i, (n, _, _) in enumerate(searches)]
    docs = docs.select("doc_id", *made)
    docs = docs.select("doc_id", F.array_sort(F.concat(*[F.col(f"s_{k.name}") for k in KINDS])).alias("base"), F.transform("s_entropy", lambda s: _entropy_span(s["text"], s["start"], _limit(s["text"]))).alias("windows"))
    clear = lambda s: (s["start"] >= 0) & ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return docs.select("doc_id", "base", F.filter("windows", clear).alias("entropy"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_digest(documents: DataFrame) -> DataFrame:
    found = find_secrets(documents)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k.name).alias(f"n_{k.name}") for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "entropy"))).alias("spans"), F.size("entropy").cast("long").alias("n_entropy"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_digest(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = " UNION ALL ".join(
        f"SELECT r, t, {quote(k.name)} AS kind, {i} AS ord, regexp_extract_all(t, {quote(k.pattern)}) AS ms, string_split_regex(t, {quote(k.pattern)}) AS gs FROM d"
        for i, k in enumerate((*KINDS, Kind("entropy", CANDIDATE, 0, WINDOW, ())))
    )
    total = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
    least = " ".join(f"WHEN kind = '{k.name}' THEN length({f'regexp_extract(x, {quote(k.pattern)}, {k.group})' if k.group else 'x'}) >= {k.least}" for k in KINDS)
    limits = " ".join(f"WHEN regexp_full_match(x, {quote(p)}) THEN {sum_limit(bits)}" for _, p, bits in CLASSES)
    allowed = " OR ".join(f"regexp_full_match(x, {quote(p)})" for p in ALLOW[:-1]) + " OR replace(x, x[1], '') = ''"
    window = f"x[i + 1:i + {WINDOW}]"
    entropy = f"list_sum(list_transform(list_distinct(string_split({window}, '')), lambda c: p[length({window}) - length(replace({window}, c, '')) + 1]))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({kinds}),
u AS (SELECT r, kind, ord, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM m),
a AS (SELECT r, kind, ord, ms[i] AS x, CAST({total("ms[1:i - 1]")} + {total("gs[1:i]")} AS INTEGER) AS pos FROM u),
base AS (SELECT r, kind, ord, pos AS s, pos + length(x) AS e FROM a WHERE ord < {len(KINDS)} AND CASE {least} END),
c AS (SELECT r, kind, ord, pos, x, CASE {limits} END AS most, {list(PLOGP)} AS p FROM a WHERE ord = {len(KINDS)} AND NOT ({allowed})),
w AS (SELECT r, kind, ord, pos, list_filter(range(0, length(x) - {WINDOW - 1}), lambda i: {entropy} <= most) AS hits FROM c WHERE most >= 0),
extra AS (SELECT r, kind, ord, pos + list_min(hits) AS s, pos + list_max(hits) + {WINDOW} AS e FROM w WHERE len(hits) > 0),
good AS (SELECT * FROM base UNION ALL SELECT * FROM extra y WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = y.r AND b.s < y.e AND y.s < b.e)),
g AS (
  SELECT r, {", ".join(f"count(*) FILTER (WHERE kind = '{k.name}') AS n_{k.name}" for k in KINDS)}, count(*) FILTER (WHERE kind = 'entropy') AS n_entropy,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (WHERE ord < {len(KINDS)}) AS firsts, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans
  FROM good GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in (*(k.name for k in KINDS), "entropy"))}, sha256(coalesce(firsts, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.r = g.r"""


ORACLE = _oracle()
