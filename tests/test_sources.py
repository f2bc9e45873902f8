"""Readers and streams on files written here."""

import json

import numpy as np

from tests.conftest import rows
from weftgraph.core.graph import Dataset, Graph
from weftgraph.sources import readers as R
from weftgraph.streaming import windows as W


def put(folder, **files):
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)
    return str(folder)


def test_text_formats(spark, tmp_path):
    d = put(tmp_path, e__txt="# c\n0 1 0.5\n1,2\nx y\n3\n", v__txt="3 2\n7 1.0 2.5\n9 3 4\n", a__txt="1, 2,x\n3,4,5\n")
    assert rows(R.edge_list(spark, f"{d}/e.txt").fillna(-1.0)) == [(0, 1, 0.5), (1, 2, -1.0)]
    assert rows(R.embeddings_text(spark, f"{d}/v.txt").selectExpr("id", "x[0]", "x[1]")) == [(7, 1.0, 2.5), (9, 3.0, 4.0)]
    assert [r["x"] for r in R.text_array(spark, f"{d}/a.txt").orderBy("line_no").collect()] == [[1.0, 2.0, None], [3.0, 4.0, 5.0]]


def test_tu_family(spark, tmp_path):
    d = put(tmp_path, T_A__txt="1, 2\n2, 1\n1, 2\n2, 2\n3, 4\n", T_graph_indicator__txt="1\n1\n2\n2\n", T_graph_labels__txt="1\n-1\n", T_node_labels__txt="5\n6\n5\n5\n")
    n, e, g = R.tu_family(spark, d, "T")
    assert rows(e) == [(0, 0, 1), (0, 1, 0), (1, 2, 3)] and rows(g) == [(0, 1), (1, -1)]
    assert rows(n.select("id", "graph_id", "label")) == [(0, 0, 5), (1, 0, 6), (2, 1, 5), (3, 1, 5)]
    assert [r["o"] for r in R.one_hot(n, "id", "label", "o").orderBy("id").collect()] == [[1, 0], [0, 1], [1, 0], [1, 0]]


def test_hgb(spark, tmp_path):
    d = put(tmp_path, node__dat="0\ta\t0\t1.0,2.0\n1\tb\t1\n", link__dat="0\t1\t0\t1.0\n", label__dat="0\ta\t0\t2\n")
    g = R.hgb(spark, d)
    assert g.metadata() == (["0", "1"], [("0", "0", "1")]) and rows(g.edges["0", "0", "1"]) == [(0, 1, 1.0)]
    assert rows(R.labels_tsv(spark, f"{d}/label.dat")) == [(0, "2")]


def test_triples_json_npz(spark, tmp_path):
    d = put(tmp_path, t__nt='<a> <knows> <b> .\n<b> <name> "x y" .\nbroken\n', w__json=json.dumps({"features": [[1, 2], [3, 4]], "labels": [0, 1], "links": [[1], [0]]}))
    g = R.ntriples_graph(R.ntriples(spark, f"{d}/t.nt"))
    assert g.nodes.count() == 3 and g.edges.count() == 4
    j = R.adjacency_json(spark, f"{d}/w.json")
    assert rows(j.edges) == [(0, 1), (1, 0)] and rows(j.nodes.select("id", "y")) == [(0, 0), (1, 1)]
    np.savez(tmp_path / "g.npz", adj_indptr=[0, 2, 3], adj_indices=[0, 1, 0], labels=[1, 0])
    z = R.csr_npz(spark, f"{d}/g.npz")
    assert rows(z.edges.select("src", "dst")) == [(0, 1), (1, 0)] and rows(z.nodes) == [(0, 1), (1, 0)]


def test_dataset_is_processed_once(spark, tmp_path):
    put(tmp_path, x__txt="0 1\n")
    calls = []

    def process(s, raw):
        calls.append(raw)
        return Graph(s.createDataFrame([(0,), (1,)], "id bigint"), R.edge_list(s, f"{tmp_path}/x.txt"))

    for _ in range(2):
        d = Dataset(str(tmp_path / "root"), process, transform=lambda g: Graph(g.nodes, g.edges.drop("w")))
        assert rows(d.graph(spark).edges) == [(0, 1)]
    assert len(calls) == 1


def test_writers(spark, tmp_path):
    e = spark.createDataFrame([(2, 1, 0.5), (0, 3, 1.0)], "src bigint, dst bigint, w double")
    for fmt in ("parquet", "orc", "json", "csv"):
        R.write_edges(e, str(tmp_path / fmt), fmt, by="src", parts=2)
    assert rows(spark.read.parquet(str(tmp_path / "parquet"))) == rows(e)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_late_rows_and_duplicates(spark, tmp_path):
    from datetime import datetime

    for i, day in enumerate((1, 20, 2)):  # the last file is late
        spark.createDataFrame([(7, 8, datetime(2024, 1, day))] * 2, "src bigint, dst bigint, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / f"d/{i}"))
    schema = "src bigint, dst bigint, at timestamp"
    import glob
    import shutil
    import time

    (tmp_path / "in").mkdir()
    for i in range(3):
        shutil.copy(glob.glob(str(tmp_path / f"d/{i}/*.parquet"))[0], tmp_path / f"in/{i}.parquet")
        time.sleep(0.05)
    s = W.edge_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    out = W.run_to_table(W.distinct_edges(s, ["src", "dst"], "at", "1 day"), "append")
    assert out.count() <= 2  # within the watermark once, and again long after


def test_only_a_missing_file_is_optional(spark, tmp_path):
    import pytest

    d = put(tmp_path, U_A__txt="1, 2\n", U_graph_indicator__txt="1\n1\n", U_graph_labels__txt="1\n")
    assert "label" not in R.tu_family(spark, d, "U")[0].columns
    with pytest.raises(ValueError):
        R.collect_bounded(spark.range(5), 3, "kinds")


def test_data_sets_by_name(spark, tmp_path):
    import pytest

    from weftgraph.sources import datasets as D

    d = put(tmp_path, out1_node_feature_label__txt="id\tf\ty\n0\t1.0,2.0\t1\n1\t3,4\t0\n", out1_graph_edges__txt="a\tb\n0\t1\n0\t1\n1\t1\n")
    g = D.load(spark, "texas", d)
    assert rows(g.nodes) == [(0, [1.0, 2.0], 1), (1, [3.0, 4.0], 0)] and rows(g.edges) == [(0, 1), (1, 1)]
    assert rows(D.load(spark, "actor", d).nodes.select("id", "x_at")) == [(0, [1, 2]), (1, [3, 4])]
    np.savez(tmp_path / "facebook.npz", features=[[1.0, 2.0], [0.0, 1.0]], target=[1, 0], edges=[[0, 1], [1, 0], [0, 0]])
    np.savez(tmp_path / "inj_cora.npz", x=[[1.0], [2.0]], y=[0, 1], edge_index=[[0, 1], [1, 1]])
    g = D.load(spark, "facebook", d)
    assert rows(g.nodes) == [(0, [1.0, 2.0], 1), (1, [0.0, 1.0], 0)] and rows(g.edges) == [(0, 0), (0, 1), (1, 0)]
    assert rows(D.load(spark, "inj_cora", d).edges) == [(0, 1), (1, 1)]
    put(tmp_path, bail_B1__csv="A,B\n1,x\n", bail_B1_edges__txt="0 1\n0 1\n1 1\n")
    g = D.load(spark, "bail_B1", d)
    assert rows(g.edges.select("src", "dst")) == [(0, 1)] and g.nodes.columns == ["A", "B"]
    for s in range(2):
        np.savez(tmp_path / f"texas_split_0.6_0.2_{s}.npz", train_mask=[s == 0, True], val_mask=[False, False], test_mask=[s == 1, False])
    assert rows(D.split_masks(spark, d, "texas", 2)) == [(0, 0, "train"), (0, 1, "test"), (1, 0, "train"), (1, 1, "train")]
    with pytest.raises(KeyError):
        D.load(spark, "unknown", d)
