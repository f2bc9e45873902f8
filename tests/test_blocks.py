"""Products in blocks, paths through hubs."""

import numpy as np
import pyarrow as pa
import pytest
from tests.conftest import rows

from weftgraph.operators import features as X
from weftgraph.operators import product as B
from weftgraph.operators import spmm as S
from weftgraph.operators import traverse as T


@pytest.mark.parametrize("cells, long", [(2_000_000, 256), (50, 2), (7, 1), (50, 10**6)])
@pytest.mark.parametrize("n, share", [(30, 0.3), (200, 0.01)])
def test_cells_equal_dense_products(monkeypatch, cells, long, n, share):
    monkeypatch.setattr(B, "CELLS", cells)
    monkeypatch.setattr(B, "LONG", long)
    monkeypatch.setattr(B, "BATCH", 5)
    r = np.random.default_rng(n)
    a, b = [(r.random((n, n)) < share) * r.integers(-2, 3, (n, n)) for _ in range(2)]  # sums of 0 are results too
    has = [(r.random((n, n)) < share) | (m != 0) for m in (a, b)]
    part = lambda left, m, h: [(left, i * 10, j * 10, float(m[i, j])) for i, j in zip(*np.nonzero(h))]
    table = pa.table(dict(zip(("left", "src", "dst", "p"), map(list, zip(*part(False, b, has[1]), *part(True, a, has[0]))))))
    got = {(x["src"], x["dst"]): x["p"] for t in B._cell(iter(table.to_batches(max_chunksize=11))) for x in t.to_pylist()}
    there, want = has[0].astype(float) @ has[1], a.astype(float) @ b
    assert set(got) == {(i * 10, j * 10) for i, j in zip(*np.nonzero(there))}
    assert all(got[i * 10, j * 10] == want[i, j] for i, j in zip(*np.nonzero(there)))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_transition_does_not_shuffle_partial_products(table, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 3)  # several blocks of rows and of columns
    a = table([(i, 5, 1.0) for i in range(1, 5)] + [(1, 6, 3.0)], "src bigint, dst bigint, w double")
    b = table([(5, j, 2.0) for j in range(10, 14)] + [(6, 10, 1.0), (7, 11, 1.0)], "src bigint, dst bigint, w double")
    p = S.transition([a, b])
    assert "Aggregate" not in _plan(p)
    assert rows(p) == [(1, 10, 0.8125), *[(1, j, 0.0625) for j in (11, 12, 13)], *[(i, j, 0.25) for i in (2, 3, 4) for j in range(10, 14)]]
    assert rows(S.transition([a, b, b])) == []


def test_target_matrix_does_not_shuffle_partial_products(table):
    e = table([(1, 2, 1.0), (1, 1, 3.0), (2, 3, 2.0), (2, 1, 2.0)], "src bigint, dst bigint, w double")
    m = X.target_matrix(e)
    assert "Aggregate" not in _plan(m)
    p = np.array([[0.75, 0.25, 0], [0.5, 0, 0.5], [0, 0, 0]])
    want = (p + p @ p) / 2
    assert rows(m) == [(i + 1, j + 1, want[i, j]) for i, j in zip(*np.nonzero(want))]


def test_paths_do_not_expand_hubs(table, monkeypatch):
    """A hub of 300 in- and out-edges lies on the way; only what may reach the ends is formed."""
    made, cut = [], T.cut
    monkeypatch.setattr(T, "cut", lambda df: made.append(x := cut(df)) or x)
    e = [(1, 0), *[(0, i) for i in range(2, 302)], *[(i, 0) for i in range(2, 302)], *[(i, i + 1) for i in range(2, 301)], (301, 500)]
    got = T.simple_paths(table(e, "src bigint, dst bigint"), table([(1, 500), (1, 1), (1, 600)], "src bigint, dst bigint"), 5)
    assert [r["path"] for r in got.orderBy("src", "dst", "path").collect()] == [[1], [1, 0, 300, 301, 500], [1, 0, 301, 500]]
    assert max(x.count() for x in made) <= 901 and sum(x.count() for x in made[1:]) < 1600


def test_induced_edges_are_not_expanded_from_hubs(table):
    """A hub of 400 edges each way is in all 50 key combinations, its neighbours in one each."""
    e = [(0, i) for i in range(1, 401)] + [(i, 0) for i in range(1, 401)] + [(i, i + 1) for i in range(1, 400)]
    held = [(b, 0) for b in range(50)] + [(b, b * 8 + i) for b in range(50) for i in range(1, 9)]
    nodes = table(held, "b bigint, id bigint")
    got = T.induced(table(e, "src bigint, dst bigint"), nodes, ["b"])
    own = set(held)
    assert rows(got.select("b", "src", "dst")) == sorted((b, x, y) for b in range(50) for x, y in e if (b, x) in own and (b, y) in own)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan()
    made, nodes_ = [], [plan.executedPlan() if hasattr(plan, "executedPlan") else plan]
    while nodes_:
        x = nodes_.pop()
        if "Join" in x.nodeName():
            made.append(x.metrics().apply("numOutputRows").value())
        inner = [x.children().apply(i) for i in range(x.children().size())]
        nodes_ += inner or ([x.plan()] if "QueryStage" in x.nodeName() else [])
    assert 0 < sum(made) < 4000


def _joined(df):
    """Rows that the joins of a plan gave, in all."""
    df.collect()
    todo, made = [df._jdf.queryExecution().executedPlan().executedPlan()], 0
    while todo:
        x = todo.pop()
        made += x.metrics().apply("numOutputRows").value() if "Join" in x.nodeName() else 0
        todo += [x.children().apply(i) for i in range(x.children().size())] or ([x.plan()] if "QueryStage" in x.nodeName() else [])
    return made


def test_transitions_of_hubs_are_formed_once(table, monkeypatch):
    from weftgraph.operators import sample as P

    monkeypatch.setattr(P, "TRANSITIONS", 500)  # the hub comes in several parts
    e = [(0, i) for i in range(1, 61)] + [(i, 0) for i in range(1, 61)] + [(i, i + 1) for i in range(1, 60)]
    w = {x: 1.0 + (x[0] + x[1]) % 3 for x in e}
    m = {(a, b, c): w[b, c] * (2.0 if c == a else 1.0 if (a, c) in w else 0.25) for a, b in e for c in range(61) if (b, c) in w}
    total = {}
    for (a, b, _), v in m.items():
        total[a, b] = total.get((a, b), 0.0) + v
    got = P.node2vec_probabilities(table([(*x, v) for x, v in w.items()], "src bigint, dst bigint, w double"), 0.5, 4.0)
    probs = {tuple(r)[:3]: r["prob"] for r in got.collect()}
    assert set(probs) == set(m) and all(abs(probs[k] - v / total[k[:2]]) < 1e-12 for k, v in m.items())
    assert _joined(got) < 1.7 * len(m)


def test_edges_of_hubs_go_to_few_parts(table, monkeypatch):
    """By TRANSITIONS alone the hub's 60 edges would go to a part for each of its 60 states."""
    from weftgraph.operators import sample as P

    monkeypatch.setattr(P, "TRANSITIONS", 60)
    e = table([(0, i, 1.0) for i in range(1, 61)] + [(i, 0, 1.0) for i in range(1, 61)] + [(1, 1, 2.0)], "src bigint, dst bigint, w double")
    got = P.node2vec_probabilities(e, 0.5, 4.0)
    assert len(got.collect()) == 60 * 60 + 59 + 2 + 2
    todo, sent = [got._jdf.queryExecution().executedPlan().executedPlan()], 0
    while todo:
        x = todo.pop()
        sent += x.metrics().apply("numOutputRows").value() if x.nodeName() == "Generate" else 0
        todo += [x.children().apply(i) for i in range(x.children().size())] or ([x.plan()] if "QueryStage" in x.nodeName() else [])
    assert 121 < sent < 2000


def test_left_rows_of_a_cell_pass_in_runs(monkeypatch):
    """Results come before the last left row is read; a src that fills more than a run is one row."""
    monkeypatch.setattr(B, "RUN", 4)
    right = [(False, k, 7, 1.0) for k in range(3)]
    left = [(True, 0, 0, 1.0), *[(True, 1, k % 3, 1.0) for k in range(20)], *[(True, i, 0, 1.0) for i in range(2, 30)]]
    table, read = pa.table(dict(zip(("left", "src", "dst", "p"), map(list, zip(*right, *left))))), []
    got = B._cell(read.append(b) or b for b in table.to_batches(max_chunksize=3))
    assert next(got).to_pylist()[0] == {"src": 0, "dst": 7, "p": 1.0} and len(read) < 5
    assert [(x["src"], x["p"]) for b in got for x in b.to_pylist()] == [(i, 20.0 if i == 1 else 1.0) for i in range(1, 30)]
