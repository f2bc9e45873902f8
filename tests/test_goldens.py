"""Hand-written expectations of the single operators."""

import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from weftgraph.core.graph import BatchGraph, FeatureStore, Graph, GraphStore, HeteroGraph
from weftgraph.functions import vec
from weftgraph.operators import edges as E
from weftgraph.operators import features as X
from weftgraph.operators import hetero as H
from weftgraph.operators import norm as N
from weftgraph.operators import pool as P
from weftgraph.operators import segment as G
from weftgraph.operators import spmm as S
from weftgraph.operators import traverse as T


def edge(table, src, dst, w=None):
    w = w or [1.0] * len(src)
    return table(list(zip(src, dst, map(float, w))), "src bigint, dst bigint, w double")


def ids(table, n):
    return table([(i,) for i in range(n)], "id bigint")


def weights(df):
    return {(r["src"], r["dst"]): r["w"] for r in df.collect()}


def test_coalesce(table):
    e = edge(table, [0, 1, 0, 1], [1, 0, 1, 0], [1, 2, -5, 0])
    assert weights(E.coalesce(e)) == {(0, 1): -4, (1, 0): 2}
    assert weights(E.coalesce(e, "max")) == {(0, 1): 1, (1, 0): 2}


def test_degree(table):
    e = table([(i, 0) for i in (0, 1, 0, 2, 0)], "src bigint, dst bigint")
    assert rows(G.degree(e, "src", ids(table, 4))) == [(0, 3), (1, 1), (2, 1), (3, 0)]


def test_sort(table):
    got = [tuple(r) for r in E.sort_edges(edge(table, [2, 1, 1, 0], [1, 2, 0, 1], [1, 2, 3, 4])).collect()]
    assert got == [(0, 1, 4), (1, 0, 3), (1, 2, 2), (2, 1, 1)]


def test_self_loops(table):
    e = edge(table, [0, 1, 0], [1, 0, 0], [0.5] * 3)
    assert E.contains_self_loops(e).first()[0] is True
    assert E.contains_self_loops(edge(table, [0, 1, 1], [1, 0, 2])).first()[0] is False
    assert rows(E.remove_self_loops(e)) == [(0, 1, 0.5), (1, 0, 0.5)]
    assert rows(E.add_self_loops(e, ids(table, 2), 2.0)) == [(0, 0, 0.5), (0, 0, 2.0), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 2.0)]
    assert rows(E.add_remaining_self_loops(e, ids(table, 2))) == [(0, 0, 1.0), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 1.0)]


def test_undirected(table):
    assert E.is_undirected(edge(table, [0, 1, 0], [1, 0, 0], [0, 0, 1])).first()[0]
    assert not E.is_undirected(edge(table, [0, 1, 0], [1, 0, 0], [0, 1, 1])).first()[0]
    assert not E.is_undirected(edge(table, [0, 1, 1], [1, 0, 2])).first()[0]
    got = weights(E.to_undirected(edge(table, [0, 1, 1], [1, 0, 2], [1, 2, -5])))
    assert got == {(0, 1): 3, (1, 0): 3, (1, 2): -5, (2, 1): -5}


@pytest.mark.parametrize("kind,off,diag", [(None, [-1, -2, -2, -4], [1, 4, 4]), ("sym", [-0.5, -1, -0.5, -1], [1, 1, 1]), ("rw", [-1, -0.5, -0.5, -1], [1, 1, 1])])
def test_laplacian(table, kind, off, diag):
    e = edge(table, [0, 1, 1, 2], [1, 0, 2, 1], [1, 2, 2, 4])
    got = weights(N.laplacian(e, ids(table, 3), kind))
    assert [got[i, i] for i in range(3)] == pytest.approx(diag)
    want = {(0, 1): off[0], (1, 0): off[1], (1, 2): off[2], (2, 1): off[3]}
    if kind != "sym":
        assert {k: got[k] for k in want} == pytest.approx(want)
    else:
        d = {0: 1, 1: 4, 2: 4}
        assert all(got[s, t] == pytest.approx(-w / math.sqrt(d[s] * d[t])) for (s, t), w in {(0, 1): 1, (1, 0): 2, (1, 2): 2, (2, 1): 4}.items())


def test_gcn_norm(table):
    e = edge(table, [0, 1, 1, 2, 2, 3], [1, 0, 2, 1, 3, 2])
    got = weights(N.gcn_norm(e))
    deg = [1, 2, 2, 1]
    assert all(got[s, d] == pytest.approx(deg[s] ** -0.5 * deg[d] ** -0.5) for s, d in got)


def test_dangling_degree_is_zero_or_infinite(table):
    e = edge(table, [0], [1])
    assert weights(N.gcn_norm(e)) == {(0, 1): 0.0}
    assert weights(N.gcn_norm(e, zero_isolated=False))[0, 1] == math.inf


def test_homophily(table):
    e = edge(table, [0, 1, 2, 3], [1, 2, 0, 4])
    y = table([(0, 0), (1, 0), (2, 0), (3, 0), (4, 1)], "id bigint, y bigint")
    b = table([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)], "id bigint, graph_id bigint")
    assert X.homophily(e, y).first()["value"] == pytest.approx(0.75)
    assert X.homophily(e, y, "node").first()["value"] == pytest.approx(0.6)
    assert X.homophily(e, y, "edge_insensitive").first()["value"] == pytest.approx(0.2)
    assert {r["graph_id"]: r["value"] for r in X.homophily(e, y, "edge", b).collect()}[0] == 1.0
    assert {r["graph_id"]: r["value"] for r in X.homophily(e, y, "node", b).collect()}[0] == 1.0


def test_k_hop(table):
    e = table(list(zip([0, 1, 2, 3, 4, 5], [2, 2, 4, 4, 6, 6])), "src bigint, dst bigint")
    nodes, sub, masked = T.k_hop_subgraph(e, table([(6,)], "id bigint"), 2)
    assert sorted(r["id"] for r in nodes.collect()) == [2, 3, 4, 5, 6]
    assert rows(sub.select("src", "dst")) == [(0, 2), (1, 2), (2, 4), (3, 4)]
    assert {(r["src"], r["dst"]): r["mask"] for r in masked.collect()} == {(0, 2): False, (1, 2): False, (2, 4): True, (3, 4): True, (4, 6): True, (5, 6): True}
    e = table(list(zip([1, 2, 4, 5], [0, 1, 5, 6])), "src bigint, dst bigint")
    assert sorted(r["id"] for r in T.k_hop_nodes(e, table([(0,), (6,)], "id bigint"), 2).collect()) == [0, 1, 2, 4, 5, 6]


def test_simple_paths(table):
    e = table(list(zip([0, 0, 1, 1, 2], [1, 2, 0, 3, 1])), "src bigint, dst bigint")
    pairs = table([(0, 3), (0, 4)], "src bigint, dst bigint")
    assert sorted(r["path"] for r in T.simple_paths(e, pairs, 4).collect()) == [[0, 1, 3], [0, 2, 1, 3]]
    assert [r["path"] for r in T.simple_paths(e, table([(0, 0)], "src bigint, dst bigint"), 1).collect()] == [[0]]


def test_shortest_paths_and_order(table):
    und = [(0, 1), (1, 2), (2, 3), (3, 0), (1, 3)]
    e = table(und + [(b, a) for a, b in und], "src bigint, dst bigint")
    tree = T.shortest_paths(e, table([(0,)], "source bigint"), 5)
    assert {r["id"]: r["dist"] for r in tree.collect()} == {0: 0, 1: 1, 3: 1, 2: 2}
    assert {r["id"]: r["path"] for r in T.with_paths(tree, 5).collect()}[2] == [0, 1, 2]
    assert [r["id"] for r in T.bfs_order(tree).orderBy("pos").collect()] == [0, 1, 3, 2]


def test_cycles(table):
    k4 = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    e = table(k4 + [(0, 1)], "src bigint, dst bigint")
    assert tuple(T.cycle_counts(e).first()) == (4, 3)
    assert rows(T.triangles(e)) == [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)]


def test_drnl(spark):
    pick = lambda a, b: spark.range(1).select(T.drnl(F.lit(a).cast("int"), F.lit(b).cast("int"))).first()[0]
    assert [pick(1, 1), pick(1, 2), pick(2, 2), pick(0, 3), pick(1, None)] == [2, 3, 5, 1, 0]


def test_masks_and_counts(table):
    i = table([(1,), (3,), (5,)], "id bigint")
    m = E.index_to_mask(i, ids(table, 7))
    assert [r["mask"] for r in m.orderBy("id").collect()] == [False, True, False, True, False, True, False]
    assert rows(E.mask_to_index(m)) == [(1,), (3,), (5,)]
    e = table([("social", "user", 0, 2), ("user", "user", 1, 2)], "s string, d string, src bigint, dst bigint")
    assert {r["node_type"]: r["n"] for r in E.num_nodes_by_type(e, "s", "d").collect()} == {"social": 1, "user": 3}


def test_dense_batch(table):
    n = table([(0, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0]), (2, 1, [5.0, 6.0]), (3, 1, [6.0, 7.0])], "id bigint, graph_id bigint, x array<double>")
    got = [tuple(r) for r in P.dense_batch(n, 2, 3).orderBy("graph_id", "slot").collect()]
    assert [g[2] for g in got] == [[1, 2], [0, 0], [0, 0], [3, 4], [5, 6], [6, 7]]
    assert [g[3] for g in got] == [True, False, False, True, True, True]


def test_propagate(table):
    n = table([(i, [2.0 * i, 2.0 * i + 1]) for i in range(4)], "id bigint, x array<double>")
    e = edge(table, [0, 1, 2, 2, 3], [1, 2, 1, 0, 3])
    want = {"sum": [[4, 5], [4, 6], [2, 3], [6, 7]], "mean": [[4, 5], [2, 3], [2, 3], [6, 7]], "max": [[4, 5], [4, 5], [2, 3], [6, 7]]}
    for how, x in want.items():
        assert [r["x"] for r in S.propagate(n, e, 2, aggr=how).orderBy("id").collect()] == x


def test_gspmm(table):
    n = table([(i, [2.0]) for i in range(5)], "id bigint, x array<double>")
    e = edge(table, [0, 1, 1, 1, 2, 3, 3, 4], [1, 0, 2, 3, 1, 1, 4, 3], [2.0] * 8)
    assert [r["x"] for r in S.gspmm(e, n, 1).orderBy("id").collect()] == [[4], [12], [4], [8], [4]]


def test_segments(table):
    df = table([(0, [1.0, 2, 3, 4]), (2, [4.0, 3, 2, 1]), (0, [5.0, 6, 7, 8])], "seg bigint, x array<double>")
    u = table([(0,), (1,), (2,)], "seg bigint")
    get = lambda how: [r["x"] for r in G.segment_vectors(df, "seg", "x", 4, how, u).orderBy("seg").collect()]
    assert get("sum") == [[6, 8, 10, 12], [0] * 4, [4, 3, 2, 1]]
    assert get("mean") == [[3, 4, 5, 6], [0] * 4, [4, 3, 2, 1]]
    assert get("max") == [[5, 6, 7, 8], [0] * 4, [4, 3, 2, 1]]


def test_segment_div_and_prefix(table):
    df = table([(0, 2, 4.0), (0, 1, 24.0), (0, 3, 3.0), (1, 1, 5.0)], "id bigint, pos bigint, v double")
    assert rows(G.segment_div(df, "id", "v", "pos")) == [(0, 2.0), (1, 5.0)]
    e = table([(0, 1), (2, 1), (2, 0)], "src bigint, dst bigint")
    ptr = G.ind2ptr(e, "src", ids(table, 4)).select("id", "ptr", "n")
    assert rows(ptr) == [(0, 0, 1), (1, 1, 0), (2, 1, 2), (3, 3, 0)]
    assert rows(G.ptr2ind(ptr)) == [(0, 0), (2, 1), (2, 2)]


def test_softmax(table):
    df = table([(0, 1.0), (0, 1.0), (1, 3.0)], "seg bigint, v double")
    assert [r["alpha"] for r in G.segment_softmax(df, "seg", "v").orderBy("seg").collect()] == pytest.approx([0.5, 0.5, 1.0])
    m = table([(0, 1.0, True), (0, 9.0, False), (1, 2.0, False)], "seg bigint, v double, m boolean")
    assert rows(G.masked_softmax(m, "seg", "v", "m").select("seg", "v", "alpha")) == [(0, 1.0, 1.0), (0, 9.0, 0.0), (1, 2.0, 2.0)]


def test_sort_pool(table):
    n = table([(0, 0, [5.0]), (1, 0, [4.0]), (2, 0, [6.0]), (3, 1, [3.0]), (4, 1, [2.0]), (5, 2, [1.0])], "id bigint, graph_id bigint, x array<double>")
    assert [r["x"] for r in P.sort_pool(n, 1, 2).orderBy("graph_id").collect()] == [[6, 5], [3, 2], [1, 0]]


def test_normalize_features_and_sign(table):
    n = table([(0, [1.0, 0, 1]), (1, [0.0, 1, 0]), (2, [0.0, 0, 0])], "id bigint, x array<double>")
    assert [r["x"] for r in X.normalize_features(n).orderBy("id").collect()] == [[0.5, 0, 0.5], [0, 1, 0], [0, 0, 0]]
    n = table([(0, [2.0, 6]), (1, [2.0, 0]), (2, [4.0, 9])], "id bigint, x array<double>")
    x = X.normalize_features(n)
    assert [r["x"] for r in x.orderBy("id").collect()] == [pytest.approx(v) for v in ([0.25, 0.75], [1, 0], [4 / 13, 9 / 13])]
    assert len(X.sign(edge(table, [0, 1, 1, 2], [1, 0, 2, 1]), x, 2, 2)) == 2


def test_metapath(table):
    a = table([(0, 2), (1, 3), (2, 4)], "src bigint, dst bigint")
    c = table([(2, 5), (3, 5), (4, 5)], "src bigint, dst bigint")
    assert rows(H.metapath([a, c])) == [(0, 5), (1, 5), (2, 5)]
    g = HeteroGraph({}, {("author", "writes", "paper"): a, ("paper", "in", "conf"): c}).add_metapath("at", [("author", "writes", "paper"), ("paper", "in", "conf")])
    assert rows(g.edge_table("at")) == [(0, 5), (1, 5), (2, 5)]


def test_collate_round_trip(table):
    one = [(0, 1), (1, 0), (1, 2), (2, 1)]
    nodes = table([(g, i) for g in range(2) for i in range(3)], "graph_id bigint, id bigint")
    edges = table([(g, a, b) for g in range(2) for a, b in one], "graph_id bigint, src bigint, dst bigint")
    m, e, ptr = H.collate(nodes, edges)
    assert rows(ptr) == [(0, 0, 3), (1, 3, 3)]
    assert rows(e.select("src", "dst")) == sorted(one + [(a + 3, b + 3) for a, b in one])
    n2, e2 = H.separate(m, e, ptr)
    assert rows(e2) == rows(edges) and rows(n2) == rows(nodes)
    assert rows(BatchGraph(nodes, edges).get(1).edges) == sorted(one)


def test_graph_container(table, spark, tmp_path):
    g = Graph(table([(0, 1.0), (1, 2.0), (2, 3.0)], "id bigint, v double"), edge(table, [0, 0, 1, 1, 2], [1, 1, 0, 2, 1]), {"name": "t"})
    assert rows(g.out_degree()) == [(0, 2), (1, 2), (2, 1)] and rows(g.in_degree()) == [(0, 1), (1, 3), (2, 1)]
    assert not g.is_coalesced() and g.is_directed() and not g.has_isolated_nodes()
    g.dump(str(tmp_path / "g"), bucket_by="dst")
    h = Graph.load(spark, str(tmp_path / "g"))
    assert rows(h.edges) == rows(g.edges) and h.meta == {"name": "t"}
    assert rows(g.subgraph(table([(0,), (1,)], "id bigint")).edges.select("src", "dst")) == [(0, 1), (0, 1), (1, 0)]


def test_hetero_round_trip(table):
    n = {"a": table([(0, 1.0), (1, 2.0)], "id bigint, v double"), "b": table([(0, 5.0)], "id bigint, v double")}
    e = {("a", "r", "b"): table([(0, 0), (1, 0)], "src bigint, dst bigint")}
    g = HeteroGraph(n, e).to_homogeneous()
    assert rows(g.edges) == [(0, 2, "r"), (1, 2, "r")]
    back = g.to_hetero()
    assert rows(back.edges["a", "r", "b"]) == [(0, 0), (1, 0)] and rows(back.nodes["b"].select("id", "v")) == [(0, 5.0)]
    assert HeteroGraph(n, e).rename("a", "z").metadata()[0] == ["b", "z"]


def test_stores(table):
    f = FeatureStore()
    f.put("n", "x", table([(0, 1.0), (1, 2.0)], "id bigint, x double"))
    f.update("n", "x", table([(1, 9.0), (2, 3.0)], "id bigint, x double"))
    assert rows(f.get("n", "x", table([(1,), (2,)], "id bigint"))) == [(1, 9.0), (2, 3.0)]
    assert f.remove("n", "x") and not f.remove("n", "x")
    s = GraphStore()
    s.put(("a", "r", "b"), table([(1, 0), (0, 1)], "src bigint, dst bigint"))
    assert rows(s.get(("a", "r", "b"), "csc")) == [(0, 1), (1, 0)] and s.types() == [("a", "r", "b")]


def test_edge_numbers(spark):
    n = 6
    for mode, pairs in (("undirected", [(a, b) for a in range(n) for b in range(a + 1, n)]), ("directed", [(a, b) for a in range(n) for b in range(n) if a != b])):
        df = spark.createDataFrame(pairs, "s bigint, d bigint").withColumn("k", E.edge_number(F.col("s"), F.col("d"), n, mode).cast("bigint"))
        assert sorted(r["k"] for r in df.collect()) == list(range(len(pairs)))
        s, d = E.edge_of_number(F.col("k"), n, mode)
        assert df.filter((s != F.col("s")) | (d != F.col("d"))).count() == 0


def test_vectors_with_zero_norm(table):
    df = table([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(vec.cosine(F.col("a"), F.col("b"))).first()[0] is None


def test_empty_tables(table):
    e, n = edge(table, [], []), table([], "id bigint, x array<double>")
    assert E.num_nodes(e).first()[0] == 0 and E.contains_self_loops(e).first()[0] is False and E.is_coalesced(e).first()[0]
    assert S.gspmm(e, n, 2).count() == 0 and N.laplacian(e, n.select("id"), "sym").count() == 0
    assert T.k_hop_nodes(e, n.select("id"), 2).count() == 0 and G.unique(table([], "value double"), "value").count() == 0


def test_dense_batch_keeps_every_node(table):
    n = table([(i, 0 if i < 2 else 1, [i]) for i in range(7)], "id bigint, graph_id bigint, x array<double>")
    for least, slots in ((1, 5), (3, 5), (6, 6)):
        got = P.dense_batch(n, 1, least, fill=-1.0).collect()
        assert len(got) == 2 * slots and sorted(r["x"][0] for r in got if r["mask"]) == [0, 1, 2, 3, 4, 5, 6]
        assert all(r["x"] == [-1] for r in got if not r["mask"])


def test_dense_batch_query_keeps_large_graphs(spark, tmp_path):
    from weftgraph.plans.features import dense_batch

    rows_ = [(i, 5 if i < 450 else 6, [float(i + 1)] * 64) for i in range(453)]
    spark.createDataFrame(rows_, "id bigint, graph_id bigint, x array<double>").write.parquet(f"{tmp_path}/graph_nodes.parquet")
    got = dense_batch(spark, str(tmp_path)).collect()
    assert len(got) == 900 and sum(r["mask"] for r in got) == 453


def test_cycles_by_brute_force(table):
    """Against counts from powers of the adjacency matrix, with hubs, loops and repeated edges."""
    import numpy as np

    r = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 40, (250, 2))] + [(0, i) for i in range(40)] + [(i, 1) for i in range(40)]
    m = np.zeros((40, 40), int)
    for a, b in pairs:
        m[a, b] = m[b, a] = a != b
    deg, m2 = m.sum(1), m @ m
    c4 = (np.trace(m2 @ m2) - 2 * (deg**2).sum() + deg.sum()) // 8
    assert tuple(T.cycle_counts(edge(table, *zip(*pairs))).first()) == (np.trace(m2 @ m) // 6, c4)


def test_all_types_take_part(spark, tmp_path):
    """A triangle and a square of mixed types (one of none) count in the queries over all edges."""
    from weftgraph.plans.features import R as features
    from weftgraph.plans.sampling import R as sampling

    e = [(1, 2, "follows"), (2, 3, "similar"), (1, 3, "cites"), (3, 4, "links"), (4, 1, None)]
    spark.createDataFrame([(a, b, 1.0, t) for a, b, t in e], "src bigint, dst bigint, w double, edge_type string").write.parquet(f"{tmp_path}/graph_edges.parquet")
    spark.createDataFrame([("graph", 1)], "scope string, node_id bigint").write.parquet(f"{tmp_path}/anchor_nodes.parquet")
    spark.createDataFrame([(1, 4, None)], "src bigint, dst bigint, matched boolean").write.parquet(f"{tmp_path}/graph_matches.parquet")
    spark.createDataFrame([(2,), (3,)], "id bigint").write.parquet(f"{tmp_path}/graph_nodes.parquet")
    run = lambda name: rows((features if name.startswith("target") else sampling).queries[name](spark, str(tmp_path)))
    assert run("cycle_counts") == [(2, 1)] and run("triangles") == [(1, 2, 3), (1, 3, 4)]
    assert [r[0] for r in run("khop_nodes")] == [1, 3, 4] and [r[0] for r in run("khop_nodes_out")] == [1, 2, 3, 4]
    assert len(run("khop_subgraph")) == 3 and sum(r[3] for r in run("khop_edge_mask")) == 3
    assert sorted(r[2] for r in run("simple_paths")) == ["1,2,3,4", "1,3,4"]
    assert {r[1]: r[2] for r in run("shortest_path_distance")} == {1: 0, 2: 1, 3: 1, 4: 2}
    assert {r[1]: r[2] for r in run("shortest_path_nodes")}[4] == "1,3,4" and len(run("bfs_tree_order")) == 4
    assert {r[1] for r in run("enclosing_subgraph_labels")} == {1, 2, 3, 4}
    assert len(run("target_matrix")) == 10
    edges = spark.createDataFrame([(a, b, 1.0) for a, b, _ in e], "src bigint, dst bigint, w double")
    from weftgraph.operators.sample import node2vec_probabilities

    assert node2vec_probabilities(edges, 0.5, 4.0).count() == 6
    asked = spark.createDataFrame([(1, 2), (2, 1)], "prev bigint, cur bigint")  # the second is no edge
    assert rows(node2vec_probabilities(edges, 0.5, 4.0, asked)) == [(1, 2, 3, 1.0)]


def test_attributes_of_all_nodes(spark, tmp_path):
    from weftgraph.plans.features import gather_attributes

    spark.createDataFrame([(i, i + 10) for i in range(7)], "id bigint, y bigint").write.parquet(f"{tmp_path}/graph_nodes.parquet")
    spark.createDataFrame([("graph", 1)], "scope string, node_id bigint").write.parquet(f"{tmp_path}/anchor_nodes.parquet")
    assert rows(gather_attributes(spark, str(tmp_path))) == [(i, i + 10) for i in range(7)]


def test_lists_and_repeats_come_in_blocks(table, monkeypatch):
    e = table([(1, 5), (1, 3), (1, 3), (2, 9), (1, 7)], "src bigint, dst bigint")
    assert rows(E.csr(e, 2)) == [(1, 0, [3, 5]), (1, 1, [7]), (2, 0, [9])]
    monkeypatch.setattr(G, "BLOCK", 2)
    assert rows(G.ptr2ind(table([(1, 0, 3), (2, 3, 0), (3, 3, 2)], "id bigint, ptr bigint, n bigint"))) == [(1, 0), (1, 1), (1, 2), (3, 3), (3, 4)]
    assert rows(G.repeat_interleave(table([("a", 5), ("b", 0), ("c", None)], "v string, n int"), "v", "n")) == [("a",)] * 5


def test_knn_ties_and_nothing(table):
    v = [(i, [float(i % 3), 1.0]) for i in range(9)] + [(20, None), (21, [0.0, 0.0]), (None, [1.0, 1.0])]
    n = table(v, "id bigint, x array<double>")
    got = rows(X.knn_blocked(n, n.filter("id = 4"), 3, block=4).select("id", "other", "rank"))
    assert got == [(4, 1, 1), (4, 5, 3), (4, 7, 2)] or [g[1] for g in sorted(got, key=lambda g: g[2])] == [1, 7, 2]
    assert X.knn_blocked(n.filter("id > 99"), n, 3).count() == 0
    assert [r[1] for r in rows(X.knn_blocked(n, n.filter("id = 4"), 3, "euclidean", include_self=True).select("rank", "other"))] == [1, 4, 7]


def test_large_maps_equal_small_ones(table, monkeypatch):
    from weftgraph.nn import layers as L

    n = table([(1, [1.0, 2.0]), (2, None), (3, [0.5])], "id bigint, x array<double>")
    monkeypatch.setattr(L, "LITERALS", 0)
    got = L.dense(n, [[1.0, 0.0, 2.0], [3.0, 1.0, 0.0]], [0.5, 0.0, -3.0], vec.relu)
    assert {r["id"]: r["x"] for r in got.collect()} == {1: [7.5, 2.0, 0.0], 2: None, 3: None}


def test_bipartite_relations(table):
    e = table([(1, 2)], "src bigint, dst bigint")
    g = HeteroGraph({}, {("a", "r", "b"): e, ("a", "s", "a"): e.select("*")})
    assert g.is_bipartite("r") and not g.is_bipartite("s")
