"""Token counts (3), packing (6) and the token store (9) against the library's own ids."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from proxigraph.llm import edit_counts, packing, pretokens, token_store
from proxigraph.llm.common import scratch

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
ALPHABET = [*"abcXYZ  \n\t'''smtdrevl019²½éß\xa0\x85\x1c!?.-_", "Ā", "ſ", "İ", "<|endoftext|>", "'re", "'LL", "é", "中", " "]


def fuzz(n, size=40, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_memo_gives_the_librarys_ids(name):
    path = pretokens.tokenizer_path(name)
    texts = ["", "a", *fuzz(4000)]
    enc = pretokens.Encoder(path, memo=50)  # a small memo turns over often
    assert [np.frombuffer(enc.ids(t), "<u4").tolist() for t in texts] == pretokens.library_ids(path, texts)


def ids_of(name, text):
    return [*pretokens.library_ids(pretokens.tokenizer_path(name), [text or ""])[0], 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_edits_equal_a_full_count():
    path = pretokens.tokenizer_path(BYTE)
    enc = pretokens.encoder(path)
    rng = random.Random(3)
    words = ["word", "don't", "  ", "\n", "x1", "!?", " ", "we'll", "<|endof", "text|>", "é", "“quoted”", "слово", "中文字", "😀", "\u3000", "e\u0301", "—", "٣٤"]
    for trial in range(150):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 200, 900])))
        doc = edit_counts.Document(text, enc)
        for _ in range(6):
            a = rng.randint(0, len(text) + 2)
            b = a + rng.choice([0, 0, 1, 3, 40, 400])
            new = "".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 60])))
            text = text[:a] + new + text[b:]
            doc.edit(a, b, new)
            assert doc.text() == text, trial
            assert doc.tokens == len(pretokens.library_ids(path, [text])[0]), (trial, text)


def test_edits_scan_little_of_a_long_text():
    enc = pretokens.encoder(pretokens.tokenizer_path(BYTE))
    doc = edit_counts.Document("some words here " * 20_000, enc)
    doc.edit(100_000, 100_010, "changed")
    assert doc.reencoded < 2_000
    doc = edit_counts.Document("слово “здесь” 中文 " * 20_000, enc)
    doc.edit(100_000, 100_010, "другое")
    assert doc.whole is None and doc.reencoded < 2_000


def test_counts_of_no_documents(docs_of):
    docs = docs_of([(1, "x")]).limit(0)
    assert edit_counts.count_with_edits(docs.withColumn("edits", edit_counts.revision()), pretokens.tokenizer_path(BYTE)).count() == 0


def test_count_query(spark, docs_of):
    texts = [None, "", "short", "é" * 50, "<|endoftext|> and more", "word " * 30_000, *fuzz(20)]
    docs = docs_of([*enumerate(texts), (2, "short"), (None, "no id")])
    rows = edit_counts.count_with_edits(docs.withColumn("edits", edit_counts.revision()), pretokens.tokenizer_path(BYTE)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "no id" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        after = text
        n = len(text)
        for a, b, new in ((n // 4, n // 4 + 8, "[edited] "), (n // 2, n // 2 + 5, ""), (n + 16, n + 16, "\nRevised edition.\n")):
            after = after[:a] + new + after[b:]
        assert r["n_tokens"] == len(ids_of(BYTE, text)) - 1
        assert r["n_tokens_edited"] == len(ids_of(BYTE, after)) - 1, text
        assert r["n_chars_edited"] == len(after)


def test_edit_table_joins(spark, docs_of):
    docs = docs_of([(1, "one two"), (2, None), (3, "same")])
    edits = spark.createDataFrame([(1, 2, 0, 3, "ten"), (1, 1, 3, 7, ""), (2, 1, 0, 0, "new text")], "doc_id long, seq int, start int, stop int, text string")
    rows = {r["doc_id"]: r for r in edit_counts.count_with_edits(edit_counts.with_edits(docs, edits), pretokens.tokenizer_path(BYTE)).collect()}
    assert rows[1]["n_chars_edited"] == 3 and rows[2]["n_chars_edited"] == 8 and rows[3]["n_tokens_edited"] == rows[3]["n_tokens"]


def check_packing(pieces, documents, seq_len):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    for doc, texts in documents.items():
        ids = ids_of(BYTE, texts)
        at = 0
        for p in sorted(by_doc.pop(doc), key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == crc(ids[at : at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    assert not by_doc
    for s, parts in by_seq.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == seq_len or s == max(by_seq) and at < seq_len
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_packing_every_id_once(spark, docs_of):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([0, 1, 30, 400]))), None, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(120)]
    rows += [(500, None, None, "b"), (501, "long " * 20_000, None, "a")]
    pieces = packing.pack(docs_of(rows, 5), pretokens.tokenizer_path(BYTE)).collect()
    check_packing(pieces, {r[0]: r[1] for r in rows}, 2048)
    for targets in ({"a": 1, "b": 3}, {"c": 1}):
        pieces = packing.pack(docs_of(rows, 3), pretokens.tokenizer_path(BYTE), seq_len=256, targets=targets).collect()
        check_packing(pieces, {r[0]: r[1] for r in rows}, 256)


def test_packing_holds_proportions(spark, docs_of):
    rows = [(i, "word " * 300, None, "big" if i % 4 else "small") for i in range(80)]
    pieces = packing.pack(docs_of(rows, 4), pretokens.tokenizer_path(BYTE)).collect()
    source = {r[0]: r[3] for r in rows}
    share = {}
    for p in pieces:
        share.setdefault(p["sequence_id"], [0, 0])[source[p["doc_id"]] == "big"] += p["length"]
    for s, (small, big) in share.items():
        if s < max(share):
            assert abs(big - 0.75 * 2048) <= 3 and small + big == 2048


def test_packing_holds_proportions_of_many_sources(spark, docs_of):
    rows = [(i, "word " * (20 + i % 3), None, f"s{i % 300}") for i in range(900)]
    pieces = packing.pack(docs_of(rows, 3), pretokens.tokenizer_path(BYTE)).collect()
    check_packing(pieces, {r[0]: r[1] for r in rows}, 2048)
    total, windows = {}, {}
    for p in pieces:
        source = rows[p["doc_id"]][3]
        total[source] = total.get(source, 0) + p["length"]
        windows.setdefault(p["sequence_id"], {}).setdefault(source, 0)
        windows[p["sequence_id"]][source] += p["length"]
    everything = sum(total.values())
    served = dict.fromkeys(total, 0)
    for s in sorted(windows)[:-1]:
        part = {x: 2048 * n / everything for x, n in total.items()}
        # A round's part of the few queues at a window's border falls to one side of it; nothing adds up.
        assert sum(abs(windows[s].get(x, 0) - part[x]) > 2 for x in total) < len(total) / 6
        for x in total:
            served[x] += windows[s].get(x, 0)
            assert abs(served[x] - (s + 1) * part[x]) <= part[x] + 2


def test_packing_empty_and_sequences(spark, docs_of):
    assert packing.pack(docs_of([(1, "x")]).limit(0), pretokens.tokenizer_path(BYTE)).count() == 0
    pieces = packing.pack(docs_of([(1, "one two three"), (2, "four")]), pretokens.tokenizer_path(BYTE))
    (row,) = packing.sequences(pieces, seq_len=16).collect()
    assert row["n_tokens"] == len(ids_of(BYTE, "one two three")) + len(ids_of(BYTE, "four"))
    assert len(row["ids"]) == (16 if row["n_tokens"] & (row["n_tokens"] - 1) else row["n_tokens"])


def test_schedule_inverse():
    rng = random.Random(4)
    for _ in range(30):
        sizes = [rng.randint(1, 500) for _ in range(rng.randint(1, 6))]
        shares = rng.choice([sizes, [rng.randint(0, 5) for _ in sizes]])
        plan = packing.Schedule(sizes, shares, rng.choice([1, 7, 64]))
        rounds = [plan.served(i) for i in range(plan.rounds + 1)]
        assert rounds[-1] == sizes
        for q, n in enumerate(sizes):
            for token in range(n):
                i = plan.round_of(q, token)
                assert rounds[i][q] <= token < rounds[i + 1][q]


def test_directly_addressable_codes():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.array([0, 255, 256, 65_535, 65_536, 2**32 - 1], np.uint32), rng.integers(0, 50_000, 5_000).astype(np.uint32), np.full(1500, 300, np.uint32)):
        block = token_store.Block(token_store.encode_block([4, None], [len(ids), 0], ids))
        assert block.ids().tolist() == ids.tolist() == [block[i] for i in range(len(block))]
        assert block.known.tolist() == [True, False]
    with pytest.raises(IndexError):
        block[len(block)]


def test_store_round_trip(spark, docs_of, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_TOKENS", 500)
    rows = [(i * 7 % 101, t) for i, t in enumerate([None, "", "LOUD words", "long text " * 3_000, *fuzz(60)])] + [(3, "b twin"), (3, "a twin"), (None, "no id")]
    folder = scratch(spark, "store-test")
    token_store.write_tokens(docs_of(rows, 3), folder, pretokens.tokenizer_path(WORD))
    got = sorted(token_store.read_digest(spark, folder).collect(), key=lambda r: r["start"])
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (doc, text) in zip(got, want, strict=True):
        ids = ids_of(WORD, text)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, at, len(ids), crc(ids))
        at += len(ids)


def test_lookup_of_single_tokens(spark, docs_of, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_TOKENS", 300)
    texts = {i: t for i, t in enumerate(["", "LOUD words", "long text " * 500, *fuzz(20)])}
    folder = scratch(spark, "store-lookup")
    token_store.write_tokens(docs_of([*texts.items(), (None, "no id")], 3), folder, pretokens.tokenizer_path(WORD))
    rng = random.Random(2)
    ids = {d: ids_of(WORD, t) for d, t in [*texts.items(), (None, "no id")]}
    wanted = [(d, i) for d in ids for i in {0, len(ids[d]) - 1, rng.randrange(len(ids[d]))}]
    got = token_store.lookup(spark, folder, spark.createDataFrame([*wanted, (0, 5), (1, -1), (999, 0)], "doc_id long, i long")).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((r["doc_id"], r["i"], r["token"]) for r in got), key=key) == sorted(((d, i, ids[d][i]) for d, i in wanted), key=key)


def test_store_empty(spark, docs_of):
    folder = scratch(spark, "store-empty")
    token_store.write_tokens(docs_of([(1, "x")]).where(F.lit(False)), folder, pretokens.tokenizer_path(WORD))
    assert token_store.read_digest(spark, folder).count() == 0
