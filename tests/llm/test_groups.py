import random

import pytest

from weftgraph.llm.groups import group_matches


def brute(nodes, pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            up[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes if n is not None}


def check(table, nodes, pairs, extra=False, **kw):
    n = table([(i,) for i in nodes], "id bigint")
    p = table(pairs, "src bigint, dst bigint")
    if extra:  # columns with the names that are used inside
        for c in ("v", "parent", "a", "b", "group_id", "deg"):
            n, p = n.selectExpr("*", f"1 as {c}"), p.selectExpr("*", f"'x' as {c}")
    got = group_matches(n, p, **kw).collect()
    assert len(got) == len(set(nodes) - {None})
    assert {r["id"]: r["group_id"] for r in got} == brute(nodes, pairs)


def test_shapes(table):
    path = [(i, i + 1) for i in range(60)]
    cycle = [(100 + i, 100 + (i + 1) % 17) for i in range(17)]
    star = [(200, 200 + i) for i in range(1, 40)]
    clique = [(300 + a, 300 + b) for a in range(7) for b in range(a)]
    caterpillar = [(400 + i, 401 + i) for i in range(10)] + [(400 + i, 450 + i) for i in range(10)]
    pairs = path + cycle + star + clique + caterpillar + [(205, 303), (None, 5), (7, None), (8, 8), (3, 2), (3, 2), (500, 501)]
    check(table, [*range(0, 520), 5, None], pairs, extra=True)


@pytest.mark.parametrize("seed", [1, 2])
def test_random(table, seed):
    r = random.Random(seed)
    n = 150
    check(table, list(range(n)), [(r.randrange(n), r.randrange(n)) for _ in range(110 * seed)])


def test_core_is_contracted(table):
    """A dense graph that raking never touches."""
    r = random.Random(3)
    check(table, list(range(80)), [(r.randrange(40) + 40 * (i % 2), r.randrange(40) + 40 * (i % 2)) for i in range(700)])


def test_end_outside_nodes_links_and_counts(table):
    n = table([(5,), (9,)], "id bigint")
    got = group_matches(n, table([(5, 1), (1, 9)], "src bigint, dst bigint")).collect()
    assert {r["id"]: r["group_id"] for r in got} == {5: 1, 9: 1}


def test_empty(table):
    none = table([], "src bigint, dst bigint")
    assert group_matches(table([], "id bigint"), none).count() == 0
    assert [tuple(r) for r in group_matches(table([(4,)], "id bigint"), none).collect()] == [(4, 4)]
