"""Language ID (10): vectors against a letter-by-letter version, and held-out accuracy on the driver's tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from proxigraph.llm import language_id as L
from proxigraph.llm.common import table


def brute(text, dimensions):
    letters = [c if c.isalpha() else None for c in f" {text.lower()} "]
    total = np.zeros(dimensions, np.int64)
    vector = lambda c: L.letter_vector(ord(c) if c else 0, dimensions).astype(np.int64)
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        if b:
            total += np.roll(vector(a), 2) * vector(b) * np.roll(vector(c), 1)
    return total


def bundle(group):
    of, ngram, n, letters, trigrams = L.count_ngrams(group)
    return L.bundled(of, ngram, n, len(group), letters, trigrams, 64, np.float64).astype(np.int64).sum(0)


def test_many_ngrams_in_little_memory():
    """A text of a large script, whose trigrams all differ."""
    import tracemalloc

    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 300_000)))
    L.bundled(*(x[:1] for x in L.count_ngrams(["ab"])[:3]), 1, *L.count_ngrams(["ab"])[3:], 1024, np.float32)
    ((_, group),) = L.pieces([text])
    for c in set(text):
        L.letter_vector(ord(c), 1024)
    tracemalloc.start()
    of, ngram, n, letters, trigrams = L.count_ngrams(group)
    assert len(trigrams) > 290_000
    L.bundled(of, ngram, n, 1, letters, trigrams, 1024, np.float32)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


@pytest.mark.parametrize("text", ["", "a", "A b", "Été, où? 12 naïve", "中文 text", "x" * 300, "".join(chr(0x4E00 + i) for i in range(400))])
def test_bundles(text):
    total = np.zeros(64, np.int64)
    for _, group in L.pieces([text]):
        total += bundle(group)
    assert total.tolist() == brute(text, 64).tolist()


def test_long_texts_are_read_whole(monkeypatch):
    monkeypatch.setattr(L, "CHARS", 50)
    text = "several words of a long text " * 40
    total = sum(bundle(g) for _, g in L.pieces([text]))
    assert total.tolist() == brute(text, 64).tolist()


def test_held_out_accuracy(spark):
    rows = L.op10_language_id(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["lang"] for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    assert len(rows) == len(labels)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    tested = [r["lang_pred"] == labels[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(tested) > 0.98 and len(tested) > 100


def test_edges(spark, docs_of):
    rows = [(i, "the quick brown fox", "en") for i in range(8)] + [(i + 20, "der schnelle Fuchs", "de") for i in range(8)] + [(50, None, "en"), (51, "", None), (52, "123 !?", "de"), (53, "schnelle", None), (None, "quick fox", "en"), (None, "quick fox", "en")]
    docs = docs_of(rows).withColumn("held_out", L.held_out(F.col("doc_id")))
    got = L.predict(docs, L.learn(docs.where("not held_out"))).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (50, 51, 52)] == ["und"] * 3 and by_id[51]["score"] == 0
    assert by_id[53]["lang_pred"] == "de" and by_id[None]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in L.predict(docs, {}).collect()} == {"und"}
    assert L.learn(docs.limit(0)) == {} and L.predict(docs.limit(0), {}).count() == 0


def test_partitioning_does_not_matter(docs_of):
    rows = [(i, f"text number {i} in english words", "en") for i in range(30)]
    one, many = L.learn(docs_of(rows, 1)), L.learn(docs_of(rows, 9))
    assert one["en"].tolist() == many["en"].tolist()


def test_stage_keeps_rows_and_columns(docs_of):
    rows = [(i, f"plain english words {i}", "en") for i in range(10)] + [(20, None, "en"), (21, "", "en"), (22, "### 123", "en"), (3, "plain english words twice", "en")]
    docs = docs_of(rows)
    kept = L.accepted(docs)
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([*range(10), 3])


def test_stage_rejects_foreign_scripts_and_keeps_short_texts(spark):
    import random

    rng, docs = random.Random(3), table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    texts = {}
    for i in range(120):
        start = rng.choice([0x3B1, 0x430, 0x561, 0x5D0, 0x905, 0xE01, 0x10D0, 0x1200, 0x3041, 0x4E00])
        letters = [chr(start + j) for j in range(24)]
        texts[10**6 + i] = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(300))
    common = docs.where("lang = 'en' AND text IS NOT NULL").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("length(w) > 3").groupBy("w").count().orderBy(F.desc("count"), "w").limit(20)
    words = [r["w"] for r in common.collect()]
    short = {2 * 10**6 + i: " ".join(words[i : i + 3]) for i in range(len(words) - 2)}
    extra = spark.createDataFrame([(i, t, None) for i, t in (texts | short).items()], docs.schema)
    kept = {r["doc_id"] for r in L.accepted(docs.unionByName(extra)).select("doc_id").collect()}
    assert not kept & set(texts)
    assert set(short) <= kept
