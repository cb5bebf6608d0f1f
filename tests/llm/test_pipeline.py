"""The pipeline against the brute-force versions of its stages, one after another."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline as P
from proxigraph.llm import decontaminate as D
from proxigraph.llm import near_dedup, registry
from test_line_dedup import brute as drop_lines
from test_near_dedup import brute as classes
from test_tokens import check_packing


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs_of):
    rng = random.Random(21)
    bench = [(i, words(rng, 30)) for i in range(5)]
    footer = "all rights are reserved by the owners of this page"
    rows = []
    for _ in range(60):
        rows.append("\n".join([*(words(rng, rng.randint(5, 40)) for _ in range(3)), *([footer] if rng.random() < 0.5 else [])]))
    rows += [rows[3], rows[4], rows[5] + " extra", "", None, "12 34 ###", words(rng, 20) + " " + bench[1][1], bench[2][1]]
    long = words(rng, 200)
    rows += [long, long.replace(long.split(" ")[100], "changed"), words(rng, 30_000)]
    path = tmp_path_factory.mktemp("tables")
    docs_of([(i, t, "en", f"s{i % 3}") for i, t in enumerate(rows)]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, bench


def test_stages(spark, folder):
    path, rows, bench = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stage = dict(P.STAGES)
    assert list(stage) == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]

    kept = [(i, t) for i, t in enumerate(rows) if t and any(c.isalpha() for c in t)]
    docs1 = P.through_files(stage["language_id"](spark, docs, path), "t")
    assert sorted((r["doc_id"], r["text"]) for r in docs1.collect()) == kept

    lines = [(d, t) for d, t, _, _ in drop_lines(kept)]
    docs2 = P.through_files(stage["line_dedup"](spark, docs1, path), "t")
    assert sorted((r["doc_id"], r["text"]) for r in docs2.collect()) == sorted(lines)

    smallest = {d: c for d, c in classes(lines, near_dedup.idf_table(docs2))}
    one = [(d, t) for d, t in lines if smallest[d] == d]
    docs3 = P.through_files(stage["near_dedup"](spark, docs2, path), "t")
    assert sorted((r["doc_id"], r["text"]) for r in docs3.collect()) == sorted(one)
    assert len(one) < len(lines)

    def covered(text):
        return any(sum(n for _, _, n in D.tile(D.word_numbers(text), D.word_numbers(b))) >= 0.5 * 30 for _, b in bench)

    clean = {d: t for d, t in one if not covered(t)}
    docs4 = P.through_files(stage["decontamination"](spark, docs3, path), "t")
    assert {r["doc_id"]: r["text"] for r in docs4.collect()} == clean and len(clean) == len(one) - 2
    for d in (docs1, docs2, docs3, docs4):
        assert d.schema == docs.schema
        assert all(r["n_chars"] == len(r["text"]) for r in d.collect())

    check_packing(P.run(spark, path).collect(), clean, 2048)


def test_clashing_columns(spark, folder):
    """Names that the operators use inside are a table's own columns here; they come back with their values."""
    path, _, _ = folder
    names = ["_row", "_digest", "digest", "own", "N_LINES", "n_dropped", "node", "doc", "line", "lang_pred", "score", "class", "x0_", "seeds", "row", "_order"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for i, n in enumerate(names):
        docs = docs.withColumn(n, docs.doc_id + i)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == r["doc_id"] + i for r in rows for i, n in enumerate(names)), name
    assert P.STAGES[-1][1](spark, docs, path).count() > 0


def test_empty_documents(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, docs, path).count() == 0, name


def test_registry():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 11)) and set(registry.ORACLES) <= set(registry.QUERIES)
