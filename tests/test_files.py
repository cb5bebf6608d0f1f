import struct
from pathlib import Path

import numpy as np
import pytest

from proxigraph import __main__ as cli
from proxigraph.operators.exact import exact_knn
from proxigraph.sources import ground_truth as T
from proxigraph.sources.graph_file import EMPTY, HEADER, Head, read_graph, read_head, write_graph
from proxigraph.sources.vecs import read_bvecs_as_float, read_vecs, to_bytes, write_vecs
from proxigraph.sources.vectors import from_array, synthetic
from proxigraph.storage import removed_after, scratch, through_files
from tests.test_graphs import NEAR, POINTS, lists


def rows(df):
    return [r["v"] for r in sorted(df.collect(), key=lambda r: r["vec_id"])]


def test_vecs(spark, tmp_path):
    cases = {"fvecs": [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12]], "ivecs": [[10, 20, 30], [40, 50, 60]], "bvecs": [[0, 127, 255], [1, 2, 3]]}
    for kind, data in cases.items():
        path = tmp_path / f"a.{kind}"
        path.write_bytes(to_bytes(np.array(data), kind))
        assert rows(read_vecs(spark, str(path))) == data
    assert rows(read_bvecs_as_float(spark, str(tmp_path / "a.bvecs"))) == cases["bvecs"]
    assert dict(read_vecs(spark, str(tmp_path / "a.ivecs")).dtypes)["v"] == "array<int>"
    many = synthetic(3000, 3)
    (tmp_path / "many.fvecs").write_bytes(to_bytes(many, "fvecs"))
    assert np.array_equal(np.array(rows(read_vecs(spark, str(tmp_path / "many.fvecs"))), np.float32), many)


def test_vecs_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_vecs(spark, str(tmp_path / "none.fvecs"))
    good = to_bytes(np.ones((2, 4)), "fvecs")
    for name, data in {"empty": b"", "stray": good + b"x", "short": b"\1\0", "zero": struct.pack("<i", 0) * 2, "negative": struct.pack("<i", -1) * 2}.items():
        (tmp_path / f"{name}.fvecs").write_bytes(data)
        with pytest.raises(ValueError):
            read_vecs(spark, str(tmp_path / f"{name}.fvecs"))
    with pytest.raises(ValueError):
        read_vecs(spark, str(tmp_path / "empty.txt"))
    (tmp_path / "mixed.fvecs").write_bytes(struct.pack("<i4f", 4, 1, 2, 3, 4) + struct.pack("<i4f", 3, 1, 2, 3, 4))
    with pytest.raises(Exception, match="record 1 has dimension 3"):
        read_vecs(spark, str(tmp_path / "mixed.fvecs")).collect()


def test_hashes(spark):
    data = POINTS.astype(np.float32)
    base = T.dataset_hash(data)
    assert T.fnv1a(b"a") == 0xAF63DC4C8601EC8C and T.fnv1a(b"") == T.OFFSET
    changed = data.copy()
    changed[3, 1] += 1
    assert len({base, T.dataset_hash(changed), T.dataset_hash(data[:4]), T.dataset_hash(data.reshape(4, 4))}) == 4
    vecs = from_array(spark, data)
    assert T.table_hash(vecs) == T.table_hash(vecs.repartition(5)) != T.table_hash(from_array(spark, changed))
    assert T.table_hash(vecs.limit(0)) != T.table_hash(vecs)


def test_ground_truth(spark, tmp_path):
    vecs, path = from_array(spark, POINTS), str(tmp_path / "base.gt")
    key = T.table_hash(vecs)
    assert T.load(spark, path, key, 8, 3) is None
    made = T.load_or_compute(vecs, 3, path)
    assert lists(made) == lists(exact_knn(vecs, 3))
    assert lists(T.load(spark, path, key, 8, 3)) == lists(made)
    for miss in ((key, 8, 4, "l2"), (key, 8, 3, "inner_product"), (key + 1, 8, 3, "l2"), (key, 9, 3, "l2")):
        assert T.load(spark, path, *miss) is None
    other = from_array(spark, POINTS + [[0, 1]])
    assert lists(T.load_or_compute(other, 2, path)) == lists(exact_knn(other, 2))
    assert T.load(spark, path, key, 8, 3) is None
    broken = tmp_path / "broken.gt"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"no parquet")
    assert T.load(spark, str(broken), key, 8, 3) is None


def test_cache_path():
    assert T.cache_path("datasets/sift1m/base.fvecs", 42, "inner_product") == "datasets/sift1m/base.k42.negip.gt"
    assert T.cache_path("x.fvecs", 3) == "x.k3.l2.gt"


def raw_graph(path):
    data = path.read_bytes()
    head = HEADER.unpack_from(data)
    n, k = head[6:]
    return head, np.frombuffer(data, "<u4", n * k, 64).reshape(n, k), np.frombuffer(data, "<f4", n * k, 64 + 4 * n * k).reshape(n, k), len(data)


def test_graph_file(spark, tmp_path):
    edges = exact_knn(from_array(spark, POINTS), 3)
    write_graph(edges, str(tmp_path / "g.graph"), 8, 3)
    head, ids, dist, size = raw_graph(tmp_path / "g.graph")
    assert head == (b"KNNGRAPH", 1, 4, 4, 0, 0, 8, 3) and size == 64 + 8 * 3 * 8
    assert ids.tolist() == NEAR and dist.tolist() == [[1, 1, 2]] * 8
    write_graph(edges.where("rk < 3 and src <> 5"), str(tmp_path / "g.graph"), 8, 3, "inner_product")
    head, ids, dist, _ = raw_graph(tmp_path / "g.graph")
    assert head[4] == 1 and ids[5].tolist() == [EMPTY] * 3 and ids[0, 2] == EMPTY and np.isinf(dist[7, 2])
    assert not (tmp_path / "g.graph.tmp").exists() and not (tmp_path / "g.graph.tmp-distances").exists()


def test_graph_file_reader(spark, tmp_path):
    edges, path = exact_knn(from_array(spark, POINTS), 3), str(tmp_path / "g.graph")
    of = lambda df: sorted(tuple(r) for r in df.select("src", "dst", "dist", "rk").collect())
    write_graph(edges, path, 8, 3, "inner_product")
    assert read_head(spark, path) == Head(1, 8, 3) and of(read_graph(spark, path)) == of(edges)
    short = edges.where("rk < 3 and src <> 5")
    write_graph(short, path, 8, 3)
    assert of(read_graph(spark, path)) == of(short)
    write_graph(edges.where("false"), path, 0, 3)
    assert of(read_graph(spark, path)) == []
    whole = (tmp_path / "g.graph").read_bytes()
    for name, data in (("stub", whole[:20]), ("long", whole + b"1234"), ("other", b"NOTGRAPH" + whole[8:])):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            read_graph(spark, str(tmp_path / name))
    with pytest.raises(FileNotFoundError):
        read_graph(spark, str(tmp_path / "no"))


def test_write_vecs(spark, tmp_path):
    vecs = from_array(spark, POINTS).orderBy("v")
    for kind in ("fvecs", "ivecs", "bvecs"):
        write_vecs(vecs, str(tmp_path / f"w.{kind}"), rows=3)
        assert (tmp_path / f"w.{kind}").read_bytes() == to_bytes(POINTS, kind)
    with pytest.raises(ValueError):
        write_vecs(vecs, str(tmp_path / "w.txt"))


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr("proxigraph.session.get_session", lambda: spark)
    path = tmp_path / "p.fvecs"
    path.write_bytes(to_bytes(POINTS, "fvecs"))
    assert cli.main(["--dataset", str(path), "--k", "3"]) == 0
    assert raw_graph(tmp_path / "p.fvecs.graph")[1].tolist() == NEAR
    assert cli.main(["--dataset", str(path), "--k", "3", "--algorithm", "nn_descent", "--metric", "inner_product", "--output", str(tmp_path / "o")]) == 0
    assert raw_graph(tmp_path / "o")[0][4] == 1
    assert cli.main(["--dataset", str(path), "--k", "8"]) == 1
    assert cli.main(["--dataset", str(tmp_path / "no.fvecs"), "--k", "1"]) == 1
    for bad in (["--k", "1"], ["--dataset", "x"], ["--dataset", "x", "--k", "0"], ["--dataset", "x", "--k", "-1"], ["--dataset", "x", "--k", "+1"], ["--dataset", "x", "--k", "1", "--metric", "cosine"], ["--dataset", "x", "--k", "1", "--other", "1"], ["stray", "--dataset", "x", "--k", "1"]):
        with pytest.raises(SystemExit) as e:
            cli.main(bad)
        assert e.value.code == 2
    for fine in (["--help"], ["--version"]):
        with pytest.raises(SystemExit) as e:
            cli.main(fine)
        assert e.value.code == 0


def test_scratch_folder(spark):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value if key == "spark.checkpoint.dir" else default

    class Session:
        def __init__(self, value, master):
            self.conf = Conf(value)
            self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1", "getConf": lambda _: Conf(value)})()

    assert scratch(Session("hdfs://shared/", "yarn"), "t").startswith("hdfs://shared/t-")
    assert "proxigraph-app-1/t-" in scratch(Session(None, "local[4]"), "t")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError):
            scratch(Session(None, master), "t")
    assert scratch(spark, "t") != scratch(spark, "t")


def test_removed_tables(spark):
    def there(df):
        return all(Path(f.removeprefix("file://")).exists() for f in df_files[id(df)])

    df_files = {}

    def write(outlives=False):
        df = through_files(spark.range(3), "t", outlives)
        df_files[id(df)] = df.inputFiles()
        return df

    before = write()
    with pytest.raises(KeyError), removed_after(spark):
        outer = write()
        with removed_after(spark):
            gone, kept = write(), write(outlives=True)
            assert there(gone) and there(kept)
        assert not there(gone) and there(kept) and there(outer) and kept.count() == 3
        last = write(outlives=True)
        raise KeyError
    assert not there(kept) and not there(outer) and there(last) and there(before)
    assert all(f and len(f) for f in df_files.values())


def test_benchmark_results(spark, tmp_path):
    import json

    from proxigraph.sources import bench_json as J

    rows = [
        {"run_name": "exact/1024/128", "run_type": "iteration", "real_time": 70.5, "recall_at_k": 1.0, "n": 1024, "d": 128},
        {"run_name": "exact/256/32", "run_type": "iteration", "real_time": 2.0, "recall_at_k": 1.0, "n": 256, "d": 32},
        {"run_name": "exact/1024/128", "run_type": "aggregate", "real_time": 71.0},
        {"run_name": "par/1024/128/1", "run_type": "iteration", "real_time": 64.0, "counters": {"threads": 1, "recall_at_k": 1.0, "n": 1024, "d": 128}},
        {"run_name": "par/1024/128/4", "run_type": "iteration", "real_time": 16.0, "counters": {"threads": 4, "recall_at_k": 1.0, "n": 1024, "d": 128}},
        {"run_name": "descent/1024/128", "run_type": "iteration", "real_time": 66.7, "counters": {"use_reverse": 1, "rho": 0.5, "iterations": 32, "recall_at_k": 0.6}},
    ]
    (tmp_path / "b.json").write_text(json.dumps({"context": {}, "benchmarks": rows}))
    runs = J.read_runs(spark, str(tmp_path / "b.json")).cache()
    assert runs.count() == 5
    assert {r["run_name"] for r in J.ladder(J.of_shape(runs, 1024, 128)).collect()} == {"exact/1024/128", "descent/1024/128"}
    assert [(r["family"], r["threads"], r["speedup"]) for r in J.scaling(runs).orderBy("threads").collect()] == [("par", 1, 1), ("par", 4, 4)]
    assert [(r["d"], r["n"]) for r in J.series(runs).collect()] == [(32, 256), (128, 1024), (128, 1024), (128, 1024)]
    assert runs.where("rho = 0.5").first()["iterations"] == 32
