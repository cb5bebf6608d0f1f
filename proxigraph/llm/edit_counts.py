"""Edit-aware token counts: a segment tree of pre-tokens per document, re-encoded only where edits touch it.

A leaf holds a run of pre-tokens: its text and token count; inner nodes
hold sums of characters and tokens. An edit descends to the leaves that it
touches and starts again at a leaf border far enough to the left that no
pre-token before it can change, scans until its cuts meet an old border to
the right of the edit, encodes that stretch and updates the sums above.

Defined results: null text is empty; null or empty edits change nothing;
edits apply in order, each to the text that the ones before have left, with
bounds clipped to that text. Texts of all scripts have their tree; one with
the string of a special token, before or after an edit, and any text of a
vocabulary that changes texts before it cuts them, is counted whole by the
library. A very long text is one tree, of some 100 bytes a leaf besides its
text. Every row is counted on its own, so repeated doc_ids stay apart; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxigraph.llm.common import table
from proxigraph.llm.pretokens import Encoder, encoder, tokenizer_path

#: Pre-tokens in a leaf at first.
LEAF = 64
#: A pre-token's end depends on at most this many characters from its end on (a failed contraction and one look ahead).
CONTEXT = 4
COUNTS_SCHEMA = "doc_id long, n_tokens long, n_chars_edited long, n_tokens_edited long, chars_reencoded long"


class SegmentTree:
    """Sums over leaves in two arrays; leaf i is node size + i."""

    def __init__(self, texts: list[str], tokens: list[int]):
        self.size = 1
        while self.size < max(1, len(texts)):
            self.size *= 2
        self.texts = texts or [""]
        self.chars, self.tokens = ([0] * self.size + leaves + [0] * (self.size - len(leaves)) for leaves in ([len(t) for t in self.texts], tokens or [0]))
        for node in range(self.size - 1, 0, -1):
            for sums in (self.chars, self.tokens):
                sums[node] = sums[2 * node] + sums[2 * node + 1]

    def put(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        node = self.size + leaf
        self.chars[node], self.tokens[node] = len(text), tokens
        while node > 1:
            node //= 2
            for sums in (self.chars, self.tokens):
                sums[node] = sums[2 * node] + sums[2 * node + 1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at, and the characters before that leaf; at the end, the last leaf."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at - before >= self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        leaf = min(node - self.size, len(self.texts) - 1)
        return leaf, before


class Document:
    """A text under edits. tokens: its count; reencoded: characters scanned by edits so far."""

    def __init__(self, text: str, enc: Encoder):
        self.enc, self.reencoded = enc, 0
        self.whole = text if enc.lower or self._special(text) else None
        if self.whole is None:
            pieces = enc.cuts(text)
            counts = enc.counts(pieces)
            cuts = range(0, len(pieces), LEAF)
            self.tree = SegmentTree(["".join(pieces[i : i + LEAF]) for i in cuts], [sum(counts[i : i + LEAF]) for i in cuts])

    def _special(self, text: str) -> bool:
        return any(s in text for s in self.enc.special)

    @property
    def tokens(self) -> int:
        return self.tree.tokens[1] if self.whole is None else len(self.enc.ids(self.whole)) // 4

    @property
    def chars(self) -> int:
        return self.tree.chars[1] if self.whole is None else len(self.whole)

    def text(self) -> str:
        return "".join(self.tree.texts) if self.whole is None else self.whole

    def edit(self, start: int, stop: int, new: str) -> None:
        start = max(0, min(start, self.chars))
        stop = max(start, min(stop, self.chars))
        if start == stop and not new:
            return
        if self.whole is not None:
            self.whole = self.whole[:start] + new + self.whole[stop:]
            self.reencoded += len(self.whole)
            return
        tree = self.tree
        first, before = tree.find(max(0, start - CONTEXT))
        last, _ = tree.find(max(start, stop - 1))
        last = max(first, last)
        old = "".join(tree.texts[first : last + 1])
        text = old[: start - before] + new + old[stop - before :]
        safe = len(text) - (len(old) - (stop - before))  # the edit's end in text
        while True:
            ends = last + 1 >= len(tree.texts)
            pieces = self.enc.cuts(text if ends else text + self._ahead(last + 1))
            if ends:
                break
            # The scan has met the next leaf's border if a cut falls on it; from a border on, cuts depend only on what follows.
            done, kept = 0, 0
            for piece in pieces:
                if done >= len(text):
                    break
                done, kept = done + len(piece), kept + 1
            if done == len(text) and done >= safe:
                pieces = pieces[:kept]
                break
            last += 1
            text += tree.texts[last]
        self.reencoded += len(text)
        if self._special(self._around(first, last, text)):
            self.whole = "".join(tree.texts[:first]) + text + "".join(tree.texts[last + 1 :])
            return
        tree.put(first, text, sum(self.enc.counts(pieces)))
        for leaf in range(first + 1, last + 1):
            if tree.texts[leaf]:
                tree.put(leaf, "", 0)

    def _ahead(self, leaf: int) -> str:
        """The whole following text as far as a pre-token that ends before it can look: the next leaf with text and its run of white space."""
        out = ""
        while leaf < len(self.tree.texts):
            out += self.tree.texts[leaf]
            if out.strip():
                break
            leaf += 1
        return out

    def _around(self, first: int, last: int, text: str) -> str:
        """text with enough of its neighbours to show a special token's string that crosses its ends."""
        reach = max(map(len, self.enc.special), default=0)
        left, right = "", ""
        while first > 0 and len(left) < reach:
            first -= 1
            left = self.tree.texts[first] + left
        while last + 1 < len(self.tree.texts) and len(right) < reach:
            last += 1
            right += self.tree.texts[last]
        return left[-reach:] + text + right[:reach]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text, edits in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "edits")), strict=True):
                d = Document(text or "", enc)
                n = d.tokens
                for e in edits or ():
                    if e is not None:
                        d.edit(e["start"] or 0, (e["start"] or 0) if e["stop"] is None else e["stop"], e["text"] or "")
                out.append((doc, n, d.chars, d.tokens, d.reencoded))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, ["doc_id", "n_tokens", "n_chars_edited", "n_tokens_edited", "chars_reencoded"])

    return run


def count_with_edits(documents: DataFrame, tokenizer: str) -> DataFrame:
    """documents: doc_id, text, edits (array of start, stop, text; characters, stop exclusive). See COUNTS_SCHEMA."""
    return documents.select("doc_id", "text", "edits").mapInArrow(_count(tokenizer), COUNTS_SCHEMA)


def with_edits(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """Joins edits (doc_id, seq, start, stop, text) to their documents; those without any keep a null list."""
    grouped = edits.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "text"))), lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["text"].alias("text"))).alias("edits"))
    return documents.select("doc_id", "text").join(grouped, "doc_id", "left")


def revision(text: str = "text"):
    """The query's edits of every document: a replacement at a quarter, a deletion at the middle, a line at the end."""
    edit = lambda start, stop, new: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(new).alias("text"))
    n = F.coalesce(F.char_length(F.col(text)), F.lit(0))
    quarter, middle = F.floor(n / 4), F.floor(n / 2)
    return F.array(edit(quarter, quarter + 8, "[edited] "), edit(middle, middle + 5, ""), edit(n + 16, n + 16, "\nRevised edition.\n"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every whole document before and after revision()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", revision().alias("edits"))
    return count_with_edits(docs, tokenizer_path("byte_bpe_50k.json"))
