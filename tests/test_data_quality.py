"""Filling, parsing and skew-proof profiles against plain Python."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.operators import missing as M
from weftgraph.operators import parsing as R
from weftgraph.operators import skew as K

RULES = R.Rules({"item": "item", "f": "f"}, {("f", "b", "item"): ("f", "B", "item")}, 3)


# --- skew ---------------------------------------------------------------------------


def test_profile_against_brute_force(table):
    r = random.Random(4)
    data = [(1 if r.random() < 0.6 else r.randrange(8), r.choice([None, float("nan"), 1.0, 2.0, 2.5, 7.0, r.random()])) for _ in range(600)] + [(None, 1.0), (99, None)]
    df = table(data, "k bigint, v double").withColumn("n", F.lit("clash")).withColumn("pid", F.lit(1))
    got = {x["k"]: x for x in K.profile_by_key(df, ["k"], "v", {"p50": 0.5, "p90": 0.9}).collect()}
    by = defaultdict(list)
    for k, v in data:
        if k is not None:
            by[k].append(v)
    assert set(got) == set(by)
    for k, vs in by.items():
        ok = sorted(v for v in vs if v is not None and not math.isnan(v))
        x = got[k]
        assert (x["n_rows"], x["n_values"], x["n_distinct"]) == (len(vs), len(ok), len(set(ok)))
        if not ok:
            assert x["total"] is None and x["mode"] is None and x["p50"] is None
            continue
        top = max(Counter(ok).values())
        assert x["total"] == pytest.approx(sum(ok)) and x["mode"] == min(v for v, n in Counter(ok).items() if n == top) and x["mode_count"] == top
        assert x["p50"] == ok[math.ceil(0.5 * len(ok)) - 1] and x["p90"] == ok[math.ceil(0.9 * len(ok)) - 1]


def test_keys_may_have_inner_names(table):
    df = table([(1, 2, 5.0), (1, 2, 7.0)], "n bigint, pid bigint, v double")
    got = K.profile_by_key(df, ["n", "pid"], "v", {"p50": 0.5}).first()
    assert (got["n"], got["pid"], got["n_rows"], got["p50"]) == (1, 2, 2, 5.0)


def test_profile_of_nothing(table):
    assert K.profile_by_key(table([], "k bigint, v double"), ["k"], "v", {"p50": 0.5}).count() == 0


def test_hot_keys_count_all_rows(table):
    e = table([(1, 2)] * 3 + [(None, 5), (3, None)], "s bigint, d bigint")
    p = K.profile_by_key(K.both_sides(e, "s", "d"), ["side", "node_id"], "value")
    hot = K.hot_keys(p, e.count(), 0.4)
    assert sorted((r["side"], r["node_id"]) for r in hot.collect()) == [("dst", 2), ("src", 1)]


# --- parsing ------------------------------------------------------------------------

CASES = [
    ("a_nodes.csv", '1,item,1:2:3', None), ("a_nodes.csv", ' "2" ,\t"F" , \r', None), ("a_nodes.csv", "0000000000000000000000003,ITEM,+1.:-.5:1e3", None),
    ("a_nodes.csv", '1,"item,1:2:3', "quoting"), ("a_nodes.csv", '1,"item"x,', "quoting"), ("a_nodes.csv", '1,it"em,', "quoting"), ("a_nodes.csv", '1,"it""em",', "value"),
    ("a_nodes.csv", "1,item", "columns"), ("a_nodes.csv", "", "columns"), ("a_nodes.csv", None, "columns"), ("a_nodes.csv", '1,"item,f",,', "columns"),
    ("a_nodes.csv", ",item,", "value"), ("a_nodes.csv", "-1,item,", "value"), ("a_nodes.csv", "9223372036854775808,item,", "value"), ("a_nodes.csv", "9223372036854775807,item,", None),
    ("a_nodes.csv", "1,other,", "value"), ("a_nodes.csv", "1,item,1:2", "value"), ("a_nodes.csv", "1,item,1:2:nan", "value"), ("a_nodes.csv", "1,item,1:2:1e999", "value"),
    ("a_nodes.csv", "1,item,1:2: 3", "value"), ("a_nodes.csv", "1,item,.:1:2", "value"), ("a_nodes.csv", "１,item,", "value"), ("a_nodes.csv", '1," item",', "value"),
    ("a_edges.csv", "1,2,f,item,B", None), ("a_edges.csv", "1,2,F,Item,b", None), ("a_edges.csv", "1,2,item,f,B", "value"), ("a_edges.csv", "1,2,f,item", "columns"),
    ("a_edges.csv", "x,2,f,item,B", "value"), ("other.csv", "1,2", "columns"), ("other.csv", '"', "quoting"), ("a_nodes.csv", "1,item,1:2:3\r\r", "value"),
]


def test_parse_cases(table):
    df = table([(f, i, line, 7) for i, (f, line, _) in enumerate(CASES)], "file_name string, line_no bigint, line string, reason int")
    got = {r["line_no"]: r for r in R.parse_records(df, RULES).collect()}
    assert {i: got[i]["reason"] for i in got} == {i: c[2] for i, c in enumerate(CASES)}
    assert got[1]["node_id"] == 2 and got[1]["node_type"] == "f" and got[1]["node_embeds"] == []
    assert got[2]["node_id"] == 3 and got[2]["node_embeds"] == [1.0, -0.5, 1000.0]
    assert R.rejects(R.parse_records(df.limit(0), RULES)).count() == 0


def test_bisection_keeps_good_stretches():
    lines = ["1,item,1:2:3"] * 500
    for i in (0, 77, 78, 499):
        lines[i] = "bad"
    lines[5] = '2,"f",'
    where, columns, bad = R._walk(pa.array(lines), "node", RULES)
    assert sorted(bad) == [(i, "columns") for i in (0, 77, 78, 499)]
    assert sorted(where) == [i for i in range(500) if i not in (0, 77, 78, 499)]
    at = list(where).index(5)
    assert (columns["node_id"][at].as_py(), columns["node_type"][at].as_py(), columns["node_embeds"][at].as_py()) == (2, "f", [])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='01,"ifteman:. \t+-e\r', max_size=30))
def test_columnar_path_accepts_only_what_the_scanner_does(line):
    for kind in ("node", "edge"):
        reason, record = R.diagnose(line, kind, RULES)
        try:
            got = R.parse_block(pa.array([line]), kind, RULES)
        except R.BadBlock:
            continue
        assert reason is None and {k: v[0].as_py() for k, v in got.items()} == record


# --- missing values -----------------------------------------------------------------


def _sessions(seed=5, sessions=40, per=30, dims=4):
    """Sessions with a main type and a centre; a tenth of the values is hidden."""
    r = np.random.default_rng(seed)
    out, truth = [], {}
    t0 = datetime(2024, 1, 1)
    for s in range(sessions):
        main, centre = r.integers(3), r.normal(0, 2, dims)
        for i in range(per):
            n = s * per + i
            kind = "abc"[main if r.random() < 0.8 else r.integers(3)]
            x = (centre + r.normal(0, 1, dims)).round(2)
            hide_t, hide_x = r.random() < 0.1, r.random() < 0.1
            truth[n] = (kind, x)
            out.append((n, None if hide_t else kind.upper() + " ", None if hide_x else x.tolist(), s, t0 + timedelta(hours=s)))
    return out, truth


SCHEMA = "node_id bigint, node_type string, node_embeds array<double>, session_id bigint, seen_at timestamp"


def test_fill_beats_the_overall_guess(table):
    data, truth = _sessions()
    types = table([("a",), ("b",), ("c",)], "node_type string")
    got = M.fill_missing(table(data, SCHEMA), types, n_dims=4, components=4, iterations=5).collect()
    assert len(got) == len(data)
    overall = np.mean([x for _, x in truth.values()], axis=0)
    hit = n = 0
    mine = base = 0.0
    for g in got:
        kind, x = truth[g["node_id"]]
        if g["node_type_filled"]:
            n, hit = n + 1, hit + (g["node_type"] == kind)
        else:
            assert g["node_type"] == kind
        if g["node_embeds_filled"]:
            mine += ((np.array(g["node_embeds"]) - x) ** 2).sum()
            base += ((overall - x) ** 2).sum()
        else:
            assert g["node_embeds"] == pytest.approx(list(x))
    assert hit / n > 0.65 and mine < 0.45 * base


def test_what_is_missing(table):
    ok, inf = [1.0, 2.0], float("inf")
    data = [
        (0, " A\t", ok, 1, None), (1, "x", ok, None, datetime(2024, 1, 1)), (2, None, None, None, None), (3, "", [], 1, None), (4, "a", [1.0], 1, None),
        (5, "a", [1.0, None], 1, None), (6, "a", [1.0, inf], 1, None), (7, "a", [float("nan"), 1.0], 1, None), (8, "b", [0.0, -0.0], 1, None), (9, "b", [1.0, 2.0, 3.0], 1, None), (9, "b", [1.0, 2.0, 3.0], 1, None),
    ]
    df = table(data, SCHEMA).withColumn("grp", F.lit("clash")).withColumn("code", F.lit(3))
    types = table([("a",), ("b",), (None,)], "node_type string")
    filled = M.fill_missing(df, types, n_dims=2, components=2, iterations=2)
    got = M.filled_fields(filled, "node_id", ["node_type", "node_embeds"])
    assert sorted(map(tuple, got.collect())) == sorted([(1, "node_type"), (2, "node_type"), (3, "node_type")] + [(i, "node_embeds") for i in (2, 3, 4, 5, 6, 7, 8)])
    assert filled.count() == len(data) and filled.filter("node_type is null or node_embeds is null").count() == 0


def test_fill_nothing_and_only_missing(table):
    types = table([("a",)], "node_type string")
    assert M.fill_missing(table([], SCHEMA), types, n_dims=2, components=2, iterations=1).count() == 0
    only = M.fill_missing(table([(1, None, None, None, None)], SCHEMA), types, n_dims=2, components=2, iterations=1).first()
    assert only["node_type"] == "a" and len(only["node_embeds"]) == 2


def test_few_records_far_out_do_not_decide_a_mean(table):
    """A tenth of each session's vectors is fifty times as long as the others."""
    import random

    r = random.Random(4)
    data, truth, means = [], {}, {}
    for g in range(12):
        centre = [r.gauss(0, 1) for _ in range(4)]
        drawn = [[c + r.gauss(0, 0.3) for c in centre] for _ in range(30)]
        drawn = [[50 * v for v in x] if i % 10 == 1 else x for i, x in enumerate(drawn)]
        truth[100 * g], means[100 * g] = centre, np.mean(drawn[1:], axis=0)
        data += [(100 * g + i, "a", x if i else None, g, None) for i, x in enumerate(drawn)]
    mean_error = np.mean([(means[n] - truth[n]) ** 2 for n in truth])
    for components, share in ((1, 0.01), (2, 0.2)):  # with more, those far out may be a component
        got = M.fill_missing(table(data, SCHEMA), table([("a", 4)], "node_type string, n_dims int"), n_dims=4, components=components).filter("node_embeds_filled").collect()
        assert len(got) == 12
        assert np.mean([(np.array(row["node_embeds"]) - truth[row["node_id"]]) ** 2 for row in got]) < share * mean_error
