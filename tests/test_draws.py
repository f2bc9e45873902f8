"""Draws by digests in numpy."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from weftgraph.operators import draws as D
from weftgraph.operators import sample as P
from tests.conftest import rows


def _key(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_rows_draw_the_smallest_digests(monkeypatch):
    r, n = random.Random(3), 3000
    eid = np.array(sorted(r.sample(range(10**7), n)))
    texts = [f"12:{r.randrange(10 ** r.randrange(1, 7))}:" for _ in range(60)]
    first = np.array([r.randrange(n) for _ in texts])
    count = np.array([r.randrange(min(n - f, 10 ** r.randrange(1, 5)) + 1) for f in first])
    for draft in (48, 2):  # with 2 expected below the threshold, many rows are done again
        monkeypatch.setattr(D, "DRAFT", draft)
        monkeypatch.setattr(D, "CHUNK", 500)
        got = {}
        for row, place in D._drawn(pa.array(texts), first, count, eid, 4):
            for a, b in zip(row.tolist(), place.tolist()):
                got.setdefault(a, []).append(int(eid[b]))
        for i, t in enumerate(texts):
            own = [int(x) for x in eid[first[i] : first[i] + count[i]]]
            assert got.get(i, []) == sorted(own, key=lambda x: (_key(f"{t}{x}"), x))[:4]


def test_hubs_are_not_sorted_by_batch(table):
    """Each of 60 batches draws from a hub of 200 in-edges: no window over the 12,000 candidates."""
    e = table([(i, 7, i) for i in range(200)] + [(7, i, 200 + i) for i in range(20)], "src bigint, dst bigint, eid bigint")
    f = table([(b, 7) for b in range(60)] + [(b, b % 20) for b in range(0, 60, 9)] + [(3, 999)], "batch_id bigint, id bigint").distinct()
    got = P.sample_neighbours(e, f, 3, 5, ["batch_id"])
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    every = [(i, 7, i) for i in range(200)] + [(7, 7, 207)]
    want = [(b, 7, *next((s, x) for s, d, x in every if x == i)) for b in range(60) for i in sorted([x for _, _, x in every], key=lambda i: _key(f"5:{b}:{i}"))[:3]]
    want += [(b, b % 20, 7, 200 + b % 20) for b in range(0, 60, 9) if b % 20 != 7]
    assert rows(got.select("batch_id", "dst", "src", "eid")) == sorted(want)


def test_edges_of_blocks_are_distinct_where_they_are_drawn(spark, monkeypatch):
    monkeypatch.setattr(D, "PART", 16)  # several parts of several ranges
    monkeypatch.setattr(D, "RANGE", 100)
    e = P.block_model(spark, [40, 30], [[0.5, 0.5], [0.0, 0.5]], 5)
    assert "Aggregate" not in e._jdf.queryExecution().executedPlan().toString()
    got = rows(e)
    assert len(got) == len(set(got)) and rows(P.block_model(spark, [40, 30], [[0.5, 0.5], [0.0, 0.5]], 5)) == got
    for inside, pairs in ((lambda s, d: d < 40, 780), (lambda s, d: s < 40 <= d, 1200), (lambda s, d: s >= 40, 435)):
        n = sum(inside(s, d) for s, d in got)  # of so many draws with replacement 1 - exp(-1/2) are expected
        assert abs(n / pairs - 0.3935) < 0.06
    blocks = [(0, 0, 780, 20_000, 40, 0, 0), (0, 1, 1200, 20_000, 30, 0, 40), (1, 1, 435, 20_000, 30, 40, 40)]
    assert rows(D.block_pairs(spark, blocks, 1)) == [(s, d) for s in range(70) for d in range(s + 1, 70)]  # that many meet every pair


def test_draws_of_large_blocks_are_even_and_exact():
    n = 10**8
    r = pa.RecordBatch.from_pylist([dict(seed=3, range=7, i=0, j=0, lo=n * (n - 1) // 2 - 10**12, hi=n * (n - 1) // 2, n=50_000, width=n, first=5, second=5)])
    src, dst = (np.concatenate([b.column(c).to_numpy() for b in D._pairs(iter([r]))]) - 5 for c in ("src", "dst"))
    number = [int(s) * (2 * n - 1 - int(s)) // 2 + int(d) - int(s) - 1 for s, d in zip(src, dst)]
    assert (src < dst).all() and dst.max() < n and number == sorted(set(number)) and len(number) > 49_900
    share = (np.array(number) - (n * (n - 1) // 2 - 10**12)) / 1e12
    assert 0 <= share.min() and share.max() < 1 and abs(np.histogram(share, 10, (0, 1))[0] - 5000).max() < 350
