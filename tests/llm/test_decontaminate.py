"""Decontamination (4): tiles against a quadratic greedy version, coverage on planted passages."""

import random

import numpy as np
import pytest

from proxigraph.llm import decontaminate as D


def brute(document, item, least):
    mine, theirs, tiles = [False] * len(item), [False] * len(document), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(document)):
                n = 0
                while i + n < len(item) and j + n < len(document) and item[i + n] == document[j + n] and not mine[i + n] and not theirs[j + n]:
                    n += 1
                if n >= least and (best is None or (-n, i, j) < best):
                    best = (-n, i, j)
        if best is None:
            return tiles
        n, i, j = -best[0], best[1], best[2]
        for t in range(n):
            mine[i + t] = theirs[j + t] = True
        tiles.append((i, j, n))


def test_tiles():
    rng = random.Random(6)
    for _ in range(200):
        letters = rng.choice([2, 4, 20])
        item = [rng.randrange(letters) for _ in range(rng.randint(0, 25))]
        document = [rng.randrange(letters) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.5 and item:
            cut = rng.randrange(len(item))
            document += item[cut:] + [99] + item[:cut]
        least = rng.choice([2, 3, 5])
        assert D.tile(np.array(document, np.uint64), np.array(item, np.uint64), least) == brute(document, item, least)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_planted(spark, docs_of):
    rng = random.Random(8)
    items = [(i, sentence(rng, 40)) for i in range(6)]
    halves = items[1][1].split(" ")
    rows = [
        (1, sentence(rng, 60) + " " + items[0][1].upper() + ", " + sentence(rng, 60)),
        (2, " ".join(halves[20:]) + " and then " + " ".join(halves[:20])),  # reordered
        (3, " ".join(items[2][1].split(" ")[:15])),  # too little
        (4, sentence(rng, 300)),
        (5, None),
        (6, ""),
        (7, " ".join(w if i % 4 else "other" for i, w in enumerate(items[3][1].split(" ")))),  # no run of five
        (8, sentence(rng, 80_000) + " " + items[4][1]),
        (9, items[5][1]),
        (9, items[5][1]),
        (None, items[0][1]),
    ]
    bench = spark.createDataFrame([*items, (50, "too short"), (51, None), (52, ""), (0, items[0][1])], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in D.contaminated(docs_of(rows, 3), bench).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (2, 1), (8, 4), (9, 5), (9, 5), (None, 0), (None, 0)], key=str)
    pair = next(r for r in D.contaminated(docs_of(rows, 3), bench).collect() if r["doc_id"] == 2)
    assert pair["coverage"] == 1.0 and pair["n_tiles"] == 2 and pair["longest"] == 20 and pair["item_words"] == 40
    kept = D.uncontaminated(docs_of(rows, 3), bench)
    assert kept.columns == docs_of(rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 7]


def test_every_pair_over_the_threshold_is_found(spark, docs_of):
    """The bound on shared seeds drops no pair: compare with tiles of all pairs."""
    rng = random.Random(12)
    items = [(i, sentence(rng, rng.choice([5, 12, 30]))) for i in range(12)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(3):
            source = rng.choice(items)[1].split(" ")
            a = rng.randrange(len(source))
            words += source[a : a + rng.randint(1, 20)] + ["gap"] * rng.randint(0, 2)
        rows.append((i, " ".join(words)))
    want = set()
    for d, text in rows:
        for i, passage in items:
            numbers = D.word_numbers(passage)
            if sum(n for _, _, n in D.tile(D.word_numbers(text), numbers)) >= 0.5 * len(numbers):
                want.add((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs_of(rows), bench).collect()} == want and len(want) > 10


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = docs_of([(1, "one two three four five six")])
    assert D.contaminated(docs.limit(0), bench).count() == 0
    assert D.contaminated(docs, bench.limit(0)).count() == 0
    assert D.uncontaminated(docs, bench.limit(0)).count() == 1
    with pytest.raises(ValueError):
        D.contaminated(docs, bench, 0)


def test_repetitive_texts_in_little_memory(monkeypatch):
    """A long text of one word against an item of the same word, by parts of the document; memory is by common runs."""
    import tracemalloc

    one = np.full(1_000_000, 7, np.uint64)
    tracemalloc.start()
    assert D.tile(one, one[:200]) == [(0, 0, 200)]
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    rng = random.Random(9)
    item, document = ([rng.randrange(3) for _ in range(n)] for n in (24, 60))
    whole = D.tile(np.array(document, np.uint64), np.array(item, np.uint64), 3)
    monkeypatch.setattr(D, "AT_ONCE", 24 * 7)
    assert D.tile(np.array(document, np.uint64), np.array(item, np.uint64), 3) == whole == brute(document, item, 3)
