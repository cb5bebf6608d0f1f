"""Near duplicates (8): classes against a comparison of all pairs, the sampling's collision rate, and edges."""

import random

import numpy as np
import pytest

from proxigraph.llm import near_dedup as N
from proxigraph.llm.components import components
from proxigraph.llm.shingles import word_numbers


def prose(rng, n):
    return [rng.choice("abcdefghijklmnop") + str(rng.randrange(400)) for _ in range(n)]


def edit(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return words


def brute(rows, idf):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            same = word_numbers(a).tolist() == word_numbers(b).tolist() if len(word_numbers(a)) else (a or "") == (b or "")
            if find(i) != find(j) and (same or max(N.similar(a, b, idf)) >= N.SIMILARITY):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        order = 2**63 - 1 if doc is None else doc
        smallest[find(i)] = min(smallest.get(find(i), 2**63 - 1), order)
    return [(doc, None if smallest[find(i)] == 2**63 - 1 else smallest[find(i)]) for i, (doc, _) in enumerate(rows)]


def corpus():
    rng = random.Random(17)
    texts = [None, "", "!?", "!?", "one", "ONE.", "two words", "a b c d", "a b c d e", "a b c d f"]
    for _ in range(8):
        base = prose(rng, rng.choice([6, 30, 120, 400]))
        texts += [" ".join(edit(rng, base, rng.choice([0, 0, 1, 1, 2, 6]))) for _ in range(rng.choice([1, 3, 12]))]
    hub = prose(rng, 300)
    texts += [" ".join(edit(rng, hub, 3)) for _ in range(40)]
    chain = prose(rng, 200)
    for _ in range(12):  # each is like the one before, the ends are not alike
        texts.append(" ".join(chain))
        chain = edit(rng, chain, 2)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def test_classes_equal_all_pairs(docs_of):
    rows = [*corpus(), (None, "a text without an id of its own"), (None, "a text without an id of its own"), (3, "a repeated row stands here once"), (3, "a repeated row stands here once")]
    docs = docs_of(rows, 4)
    got = N.near_duplicates(docs).collect()
    key = lambda p: tuple((x is None, x or 0) for x in p)
    want = brute(rows, N.idf_table(docs))
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=key) == sorted(want, key=key)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({w[1] for w in want}) and all(r["doc_id"] == r["class_id"] for r in kept)


def test_group_without_a_centre(docs_of):
    """Copies of copies: most are alike, many only to a few others."""
    rng = random.Random(30)
    texts = [prose(rng, 150)]
    for _ in range(140):
        texts.append(edit(rng, rng.choice(texts[-25:]), rng.choice([1, 2, 3, 4])))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = docs_of(rows, 3)
    want = brute(rows, N.idf_table(docs))
    assert sorted((r["doc_id"], r["class_id"]) for r in N.near_duplicates(docs).collect()) == sorted(want)


def test_samples_collide_as_weighted_jaccard():
    rng = np.random.default_rng(5)
    shingles = rng.integers(0, 2**63, 4_000).astype(np.uint64)
    weights = rng.uniform(0.5, 4, 4_000)
    other = weights * rng.choice([1, 1, 1, 0.5, 2], 4_000)
    want = np.minimum(weights, other).sum() / np.maximum(weights, other).sum()
    zeros = np.zeros(len(shingles), np.int64)
    rates = []
    for salt in range(12):
        s = N.mix(shingles ^ np.uint64(salt))
        rates.append((N.sample(s, weights, zeros, 1) == N.sample(s, other, zeros, 1)).mean())
    assert abs(np.mean(rates) - want) < 0.04


def test_long_texts_and_stage(docs_of):
    rng = random.Random(1)
    long = prose(rng, 60_000)
    rows = [(2, " ".join(long)), (1, " ".join(edit(rng, long, 50))), (3, "something else entirely in here"), (4, None), (4, None)]
    docs = docs_of(rows)
    out = N.distinct_documents(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4]
    assert N.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 30)]
    links = [p for p in links if p[0] != p[1]]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_heavy_shingles_collide_as_weighted_jaccard():
    """A few shingles with most of the weight: each counts in as many bins as its weight asks for."""
    rng, rates = np.random.default_rng(8), []
    for _ in range(20):
        shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (10, 200, 200))
        samples = []
        for own in (a, b):
            units, at = N.replicas(np.concatenate([shared, own]), np.repeat([200, 1], [10, 200]))
            samples.append(N.sample(units, np.ones(len(units)), np.zeros(len(at), np.int64), 1))
        rates.append((samples[0] == samples[1]).mean())
    assert abs(np.mean(rates) - 2000 / 2400) < 0.04


def test_repeated_lines_with_own_text(docs_of):
    rng = random.Random(12)
    rows = []
    for i in range(6):
        line = prose(rng, 10)
        rows += [(2 * i + j, " ".join(line * 200 + prose(rng, 100))) for j in (0, 1)]
    docs = docs_of(rows, 2)
    want = brute(rows, N.idf_table(docs))
    assert len({c for _, c in want}) == 6
    assert sorted((r["doc_id"], r["class_id"]) for r in N.near_duplicates(docs).collect()) == sorted(want)


def test_plain_similarity_is_enough(docs_of):
    """A text and the same text pasted twice: alike as sets, not by weight."""
    rng, rows = random.Random(21), []
    for i in range(12):
        text = prose(rng, rng.choice([40, 400]))
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text * 2))]
    docs = docs_of(rows, 2)
    want = brute(rows, N.idf_table(docs))
    assert len({c for _, c in want}) == 12
    assert sorted((r["doc_id"], r["class_id"]) for r in N.near_duplicates(docs).collect()) == sorted(want)


def test_twins_among_texts_of_one_template(docs_of, monkeypatch):
    """What the hub's pairs leave is found all the same, over several blocks."""
    monkeypatch.setattr(N, "BLOCK", 16)
    rng, rows = random.Random(41), []
    template = prose(rng, 190)
    for i in range(60):
        text = template + prose(rng, 36)
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[:-12] + prose(rng, 12)))]
    docs = docs_of(rows, 3)
    want = brute(rows, N.idf_table(docs))
    assert 50 < len({c for _, c in want}) < 100
    assert sorted((r["doc_id"], r["class_id"]) for r in N.near_duplicates(docs).collect()) == sorted(want)


def test_left_over_pairs_are_all_found(spark, monkeypatch):
    """All strangers in a bucket meet, once, over blocks and batches; those of too different sizes are left out, and what shares too little."""
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "_own", lambda people, idf: spark.createDataFrame([(n, 30, 0.0) for n in range(0, 60, 7)] + [(n, 0, 90.0) for n in range(0, 60, 7) if n % 2], "node long, own_size long, own_weight double").groupBy("node").agg(N.F.max("own_size").alias("own_size"), N.F.max("own_weight").alias("own_weight")))
    rng = random.Random(6)
    kind = {n: n if rng.random() < 0.5 else 0 for n in range(60)}
    buckets = spark.createDataFrame([(band, n, kind[n]) for n in kind for band in (1, 2) if band == 1 or n % 3 == 0], "value long, node long, class long")
    size = {n: 100 if n % 5 else 300 for n in kind}
    nodes = spark.createDataFrame([(n, "", size[n], float(size[n]), bytes(N.KINDS * N.BINS)) for n in kind], "node long, text string, size long, weight double, marks binary")
    idf = spark.sparkContext.broadcast(np.ones(1 << N.CELLS))
    monkeypatch.setattr(N, "FEW", -1)  # texts are of no account here
    lost = {n for n in range(0, 60, 7) if n % 2 and size[n] == 100}
    want = [(u, v) for u in kind for v in range(u) if kind[u] != kind[v] and size[u] == size[v] and not {u, v} & lost]
    assert sorted(map(tuple, N._left_over(buckets, nodes, idf, 0.8).collect())) == sorted(want)


def test_own_shingles(spark):
    idf = spark.sparkContext.broadcast(np.ones(1 << N.CELLS))
    rows = [(1, 1, True, "a b c d e x y"), (2, 1, False, "a b c d e x"), (3, 3, False, "a b c d e"), (4, 4, True, "p q r s t u p q r s t"), (5, 5, True, "")]
    own = N._own(spark.createDataFrame(rows, "node long, class long, minor boolean, text string"), idf)
    assert {r["node"]: (r["own_size"], r["own_weight"]) for r in own.collect()} == {1: (2, 2.0), 4: (6, 7.0)}


def test_long_texts_are_sampled_alike(monkeypatch):
    """In pieces or at once, also with a shingle that occurs very often."""
    rng = random.Random(3)
    for text in (" ".join(prose(rng, 3000)), "again " * 2000 + " ".join(prose(rng, 40)), "a b c d e"):
        table = np.random.default_rng(1).uniform(1, 2, 1 << N.CELLS)
        at_once = N.signatures([text], table)
        monkeypatch.setattr(N, "AT_ONCE", 300)
        in_pieces = N.signatures([text], table)
        monkeypatch.undo()
        assert (at_once[1] == in_pieces[1]).all() and at_once[2] == in_pieces[2] and at_once[0] == in_pieces[0]


def test_enough_equal_samples():
    """Pairs of similarity 0.8 pass the test of equal samples at any size."""
    rng = np.random.default_rng(2)
    for n in (5, 9, 18, 45, 90, 180, 450, 900):
        shared = round(n * 8 / 9)
        low = N.least_equal(np.array([n]), 0.8)[0]
        for _ in range(60):
            both, a, b = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (shared, n - shared, n - shared))
            x, y = (N.sample(s, np.ones(n), np.zeros(n, np.int64), 1) for s in (np.concatenate([both, a]), np.concatenate([both, b])))
            assert (x == y).mean() >= low


def test_recall_on_a_whole_table(spark):
    """Every link that a comparison of all pairs finds is found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    idf = N.idf_table(docs)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    bags = N._bags([t for _, t in rows], idf)
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(docs).collect()}
    links = lost = 0
    sizes, weights = np.array([len(b[0]) for b in bags]), np.array([b[1].sum() for b in bags])
    near = lambda x, i: np.minimum(x[:i], x[i]) >= 0.8 * np.maximum(x[:i], x[i])
    for i in range(len(rows)):
        for j in np.flatnonzero(near(sizes, i) | near(weights, i)).tolist():
            if max(N._alike(bags[i], bags[j])) >= N.SIMILARITY:
                links += 1
                lost += got[rows[i][0]] != got[rows[j][0]]
    assert links > 10 and lost == 0
