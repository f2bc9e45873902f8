import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import neighbours as B


def brute(vectors, k, min_cos):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    n = np.linalg.norm(x, axis=1)
    out = {}
    for a, i in enumerate(ids):
        cos = (x @ x[a]) / (n * n[a])
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-round(cos[b], 12), ids[b]))[:k]
        out[i] = [ids[b] for b in order if cos[b] >= min_cos]
    return out


def near(df, **kw):
    out = {}
    for r in B.nearest(df, "id", "x", n_dims=8, sample_rows=2000, **kw).orderBy("id", F.desc("cos"), "other").collect():
        out.setdefault(r["id"], []).append(r["other"])
    return out


def data(seed=1, n=400):
    r = np.random.default_rng(seed)
    x = r.normal(0, 1, (n, 8)).round(2)
    for i in range(0, n, 4):  # near copies
        x[i + 1] = (x[i] + r.normal(0, 0.1, 8)).round(2)
    x[50:58] = x[50]  # exact copies, more than k of them
    x[60:62] = x[60]
    return {i: v.tolist() for i, v in enumerate(x)}


SCHEMA = "id bigint, x array<double>, vec string, rep int"


def frame(table, vectors, extra=()):
    return table([(i, v, "c", 1) for i, v in vectors.items()] + [(i, v, "c", 1) for i, v in extra], SCHEMA)


@pytest.mark.parametrize("chunk", [8192, 16])
def test_close_pairs(table, chunk):
    v = data()
    bad = [(900, None), (901, [1.0] * 7), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [None] * 8), (905, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (3, v[3])]
    got, want = near(frame(table, v, bad), k=3, min_cos=0.9, chunk=chunk, probes=8), brute(v, 3, 0.9)
    true = {(a, b) for a, l in want.items() for b in l}
    found = {(a, b) for a, l in got.items() for b in l}
    assert found <= true and len(found) >= 0.97 * len(true)
    assert got[55] == [50, 51, 52] and got[50] == [51, 52, 53]


def test_recall_of_any_neighbours(table):
    v = data(2)
    got = near(frame(table, v), k=10, queries=F.col("id") % 20 == 0, chunk=64)
    want = brute(v, 10, -1)
    assert sorted(got) == [i for i in range(400) if i % 20 == 0]
    hit = sum(len(set(got[i]) & set(want[i])) for i in got) / (10 * len(got))
    assert hit >= 0.95 and all(len(l) == 10 for l in got.values())


def test_tiny_tables(table):
    assert near(frame(table, {}), k=3) == {}
    assert near(frame(table, {7: [1.0] * 8}), k=3) == {}
    got = near(frame(table, {7: [1.0] * 8, 3: [2.0] * 8, 5: [1.0] * 8}), k=3)
    assert got[3] == [5, 7] and sorted(got[5]) == [3, 7] and sorted(got[7]) == [3, 5]


def test_codes_reconstruct():
    r = np.random.default_rng(3)
    x = r.normal(0, 1, (3000, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = B.fit_codebooks(x, 20, 3, 4, rounds=4)
    for beam in (1, 4):
        _, codes, back = books.encode(x[:500], beam, None)
        assert codes.shape == (500, 3)
        err = ((x[:500] - back) ** 2).sum(1).mean()
        assert err < 0.12


@pytest.mark.parametrize("share, chunk", [(3, 8192), (3, 500), (1, 8192)])
def test_dense_group_of_different_near_copies(table, share, chunk):
    """A 1/share of all rows are near copies of one vector, in far more cells than are probed."""
    r = np.random.default_rng(5)
    n, dims = 3000, 64
    x = r.normal(0, 1, (n, dims))
    x[: n // share] = x[0] + r.normal(0, 0.27, (n // share, dims))
    df = table([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    got = {(p["id"], p["other"]) for p in B.nearest(df, "id", "x", k=3, min_cos=0.9, probes=4, chunk=chunk).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    top = np.argsort(-cos, axis=1)[:, :3]
    want = {(i, int(j)) for i in range(n) for j in top[i] if cos[i, j] >= 0.9}
    assert len(want) > 2 * (n // share) and got == want
