"""Results that no SQL states, against numpy."""

import numpy as np
import pytest

from weftgraph.core.session import cut
from weftgraph.nn import layers as L
from weftgraph.nn import models as M
from weftgraph.operators import features as X
from weftgraph.operators import traverse as T


def vectors(table, x):
    return table([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")


def back(df):
    return np.array([r["x"] for r in df.orderBy("id").collect()])


def test_svd(table):
    x = np.random.default_rng(1).normal(size=(40, 5))
    got = back(X.svd_reduce(vectors(table, x), 5, 2))
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs(u[:, :2] * s[:2]), abs=1e-8)


def test_kmeans(table):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(c, 0.1, (20, 2)) for c in (0, 5, 10)])
    codes, c = X.kmeans(vectors(table, x), 2, 3, 8)
    got = {q["id"]: q["code"] for q in codes.collect()}
    near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
    assert all(got[i] == near[i] for i in got)


def test_implicit_layer_is_a_fixed_point(table):
    x = np.random.default_rng(3).normal(size=(4, 2))
    a = np.array([[0, 0.5, 0, 0], [0.5, 0, 0.5, 0], [0, 0.5, 0, 0.5], [0, 0, 0.5, 0]])
    e = table([(i, j, float(a[i, j])) for i in range(4) for j in range(4) if a[i, j]], "src bigint, dst bigint, w double")
    f = [[1.0, 0.2], [0.1, 0.8]]
    z = back(L.mgnni(vectors(table, x), e, f, 0.5, 1, 1e-9, 40))
    ff = np.array(f).T @ np.array(f)
    assert z == pytest.approx(a.T @ (z @ (0.5 * ff / (np.linalg.norm(ff) + 1e-12))) + x, abs=1e-6)


def test_edge_encoding_and_labels(table):
    e = table([(0, 1), (1, 2), (2, 3), (3, 0), (1, 4)], "src bigint, dst bigint")
    tree = T.with_paths(T.shortest_paths(e, table([(0,)], "source bigint"), 3), 3)
    x = table([(a, b, [float(a + b)]) for a, b in [(0, 1), (1, 2), (2, 3), (3, 0), (1, 4)]], "src bigint, dst bigint, x array<double>")
    got = {r["id"]: r["value"] for r in L.edge_encoding(tree, x, [[1.0], [2.0], [3.0]]).collect()}
    assert got == {1: 1.0, 2: (1 + 6) / 2, 3: (1 + 6 + 15) / 3, 4: (1 + 10) / 2}
    nodes, inside = T.enclosing_subgraphs(e, table([(9, 0, 1)], "pair_id bigint, a bigint, b bigint"), 1)
    z = {r["id"]: r["z"] for r in nodes.collect()}
    assert (z[0], z[1]) == (1, 1) and set(z) == {0, 1, 2, 3, 4}
    assert {tuple(sorted((r["src"], r["dst"]))) for r in inside.collect()} == {(1, 2), (2, 3), (0, 3), (1, 4)}
    assert z[4] == 0 and z[2] == z[3] == 3  # distances (-, 1), and (2, 1) or (1, 2)


def test_edge_posterior(table):
    c = table([(0, 1, 5, 5), (1, 2, 4, 5), (2, 3, 0, 5), (3, 0, 1, 5)], "src bigint, dst bigint, seen bigint, tries bigint")
    q = {(r["src"], r["dst"]): r["q"] for r in M.edge_posterior(c, table([(i, 0) for i in range(4)], "id bigint, y bigint"), 5).collect()}
    assert q[0, 1] > 0.9 > 0.1 > q[2, 3] and all(0 <= v <= 1 for v in q.values())


def test_estimates_of_sizes_do_not_grow_over_rounds(table):
    e = table([(i, i + 1) for i in range(20)], "v bigint, up bigint")
    for _ in range(5):  # pointers are doubled
        up = e.selectExpr("v as up", "up as higher")
        e = cut(e.join(up, "up").selectExpr("v", "up").join(e.selectExpr("v", "up as again"), "v").select("v", "up"))
        assert "E+" not in e._jdf.queryExecution().optimizedPlan().stats().simpleString()
    assert e.count() == 15
