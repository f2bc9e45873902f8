import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from weftgraph.llm.cooccur import cooccurrence


def brute(rows, min_count, min_lift):
    baskets = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            baskets[b].add(i)
    n, single, both = len(baskets), Counter(), Counter()
    for items in baskets.values():
        single.update(items)
        both.update(combinations(sorted(items), 2))
    return {(a, b): (k, single[a], single[b], n) for (a, b), k in both.items() if k >= min_count and k * n >= min_lift * single[a] * single[b]}


def run(table, rows, **kw):
    df = table([(*r, 1, "x") for r in rows], "basket bigint, thing bigint, n_ab int, item string")
    got = cooccurrence(df, "basket", "thing", **kw).collect()
    assert len({(r["item_a"], r["item_b"]) for r in got}) == len(got) and all(r["item_a"] < r["item_b"] for r in got)
    return {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in got}


def data(seed):
    r = random.Random(seed)
    rows = []
    for b in range(120):
        group = r.randrange(6)
        for _ in range(r.randrange(1, 9)):
            rows.append((b, 10 * group + r.randrange(10) if r.random() < 0.8 else r.randrange(80)))
    for b in range(200, 208):  # large baskets, sharing some items that meet nowhere else
        rows += [(b, i) for i in range(100, 112)] + [(b, r.randrange(80)) for _ in range(20)]
    return rows + rows[:50] + [(None, 3), (4, None), (None, None)]


@pytest.mark.parametrize("block,chunk", [(256, 4096), (6, 5), (1, 3)])
def test_same_answer_whatever_the_blocking(table, block, chunk):
    rows = data(1)
    want = brute(rows, 5, 3)
    assert any(a >= 100 for a, _ in want)
    assert run(table, rows, block=block, chunk=chunk) == want


def test_thresholds(table):
    rows = data(2)
    assert run(table, rows, min_count=2, min_lift=1.0, block=8, chunk=7) == brute(rows, 2, 1.0)


def test_empty_and_lonely(table):
    assert run(table, []) == {}
    assert run(table, [(1, 1), (2, 1), (3, 1)], min_count=1, min_lift=0.0) == {}


def test_product_at_the_bound_of_the_lift():
    """n_ab * n equals 3 * n_a * n_b above 2^24, where single precision would round it down."""
    import pandas as pd

    from weftgraph.llm.cooccur import _products

    sides = [(b, i, side, n_item) for b in range(6) for i, side, n_item in ((1, 0, 5_592_407), (2, 1, 6))]
    pdf = pd.DataFrame(sides, columns=["basket", "item", "side", "n_item"]).assign(n=16_777_221, ci=0, cj=1)
    assert 6 * 16_777_221 == 3 * 5_592_407 * 6
    assert _products(5, 3.0)(pdf).to_numpy().tolist() == [[1, 2, 6]]
