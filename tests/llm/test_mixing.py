import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm.mixing import EPS, flight, land, mix_sources


def test_flight_keeps_both_totals():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 500):
        p, t = r.random(n).tolist(), r.integers(1, 400, n).astype(float).tolist()
        got = flight(p, t, r)
        assert sum(EPS < v < 1 - EPS for v in got) <= 2
        assert sum(got) == pytest.approx(sum(p)) and np.dot(got, t) == pytest.approx(np.dot(p, t))
        assert all(v in (0.0, 1.0) for v in land(got, t))


def test_flight_is_unbiased():
    p, t = [0.2, 0.5, 0.7, 0.4, 0.3], [3.0, 10.0, 4.0, 8.0, 5.0]
    mean = np.mean([flight(p, t, np.random.default_rng(i)) for i in range(3000)], axis=0)
    assert np.abs(mean - p).max() < 0.04


def test_equal_sizes_are_decided_in_pairs():
    got = flight([0.5] * 100, [7.0] * 100, np.random.default_rng(2))
    assert sorted(set(got)) == [0.0, 1.0] and sum(got) == 50


@pytest.mark.parametrize("block", [20_000, 40])
def test_mix(table, block):
    r = random.Random(3)
    docs = [(i, r.choice("aaaab"), r.randrange(20, 300)) for i in range(900)] + [(5000, None, 50), (5001, "a", 0), (5002, "a", None), (7000, "small", 100)]
    docs += docs[:1]
    t = [("m", "a", 0.5, 0.4, 1), ("m", "b", 0.5, 0.9, 3), ("caps", "small", 0.9, 1.0, 2), ("caps", "a", 0.1, 1.0, 2), ("ghost", "nobody", 1.0, 1.0, 2), ("whole", "b", 1.0, 2.0, 2)]
    d = table([(i, s, n) for i, s, n in docs[:-1]], "doc_id bigint, source string, n_tokens bigint").withColumn("p", F.lit("x"))
    sel, rep = mix_sources(d, table(t, "mix_name string, source string, target_share double, size_factor double, max_repeats int"), block=block)
    size = {s: sum(n or 0 for _, x, n in docs[:-1] if x == s) for s in ("a", "b", "small", "nobody")}
    caps = {(m, s): k for m, s, _, _, k in t}
    got = sel.collect()
    assert len({(g["mix_name"], g["doc_id"]) for g in got}) == len(got)
    assert all(1 <= g["copies"] <= caps[g["mix_name"], g["source"]] for g in got)
    for x in rep.collect():
        m, s = x["mix_name"], x["source"]
        n = sum(size[b] for a, b, *_ in t if a == m)
        share, factor = next((c, f) for a, b, c, f, _ in t if (a, b) == (m, s))
        want = share * factor * n
        assert x["met"] == (not want > caps[m, s] * size[s])
        assert x["actual_tokens"] == sum(g["copies"] * g["n_tokens"] for g in got if (g["mix_name"], g["source"]) == (m, s))
        assert abs(x["actual_tokens"] - min(want, caps[m, s] * size[s])) <= 600
    assert sum(x["actual_share"] for x in rep.collect() if x["mix_name"] == "m") == pytest.approx(1)


def test_nothing(table):
    d = table([], "doc_id bigint, source string, n_tokens bigint")
    t = table([("m", "a", 1.0, 0.4, 1)], "mix_name string, source string, target_share double, size_factor double, max_repeats int")
    sel, rep = mix_sources(d, t)
    assert sel.count() == 0 and [(r["met"], r["actual_tokens"]) for r in rep.collect()] == [(True, 0)]
    assert mix_sources(d, t.limit(0))[1].count() == 0
