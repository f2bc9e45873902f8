import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftgraph.llm.quota import cell_quotas, sample_quotas


def test_flow_takes_what_is_there_and_reports_the_rest():
    got, short = cell_quotas({0: (2, 10), 1: (5, 8)}, {(0, 0): 6, (0, 1): 6, (1, 0): 3})
    assert sum(q for (y, _), q in got.items() if y == 0) == 10 and short == {0: 0, 1: 5} and got[1, 0] == 3


def test_flow_keeps_strata_proportional_where_free():
    got, _ = cell_quotas({0: (0, 50), 1: (0, 50)}, {(y, s): n for y in (0, 1) for s, n in ((0, 60), (1, 30), (2, 10))})
    assert [sum(got[y, s] for y in (0, 1)) for s in range(3)] == [60, 30, 10]


@pytest.mark.parametrize("bucket_rows", [50_000, 7])
def test_sample(table, bucket_rows):
    r = random.Random(1)
    rows = [(i, r.choice([0, 0, 0, 0, 1, 1, 2]), r.random() < 0.9, r.choice([None, 1, 2])) for i in range(400)]
    rows += rows[:40] + [(1000, None, True, 1), (1001, -1, True, 1), (1002, 0, None, 1), (None, 0, True, 1)]
    n = table(rows, "id bigint, y bigint, train_idx boolean, graph_id bigint").withColumn("s", F.lit("x")).withColumn("h", F.lit(0))
    t = table([("a", 0, 0.2, 5, 0.5), ("a", 1, 0.3, 5, 0.5), ("a", 2, 0.5, 5, 0.5), ("b", 2, 0.01, 30, 0.1), ("b", 0, 0.99, 30, 0.1), ("c", 9, 1.0, 1, 0.1), ("d", None, 1.0, None, None)],
              "target_set string, y bigint, target_share double, min_count bigint, sample_frac double")
    sample, report = sample_quotas(n, t, bucket_rows=bucket_rows)
    got = sample.collect()
    assert len({(x["target_set"], x["id"]) for x in got}) == len(got)
    have = {i: y for i, y, ok, _ in rows if ok and y is not None and y >= 0 and i is not None}
    assert all(have[x["id"]] == x["y"] for x in got)
    counts = Counter((x["target_set"], x["y"]) for x in got)
    avail = Counter(have.values())
    for x in report.collect():
        if x["y"] is None:
            assert x["met"]
            continue
        share, floor, frac = {("a", 0): (0.2, 5, 0.5), ("a", 1): (0.3, 5, 0.5), ("a", 2): (0.5, 5, 0.5), ("b", 2): (0.01, 30, 0.1), ("b", 0): (0.99, 30, 0.1), ("c", 9): (1.0, 1, 0.1)}[x["target_set"], x["y"]]
        want = max(floor, share * frac * len(have))
        assert x["met"] == (not avail[x["y"]] < want - 1e-6)
        assert counts[x["target_set"], x["y"]] == x["drawn"] == min(avail[x["y"]], -int(-(want - 1e-6) // 1))
    assert sample.exceptAll(sample_quotas(n, t, bucket_rows=bucket_rows)[0]).count() == 0


def test_empty_population(table):
    n = table([], "id bigint, y bigint, train_idx boolean, graph_id bigint")
    t = table([("a", 0, 1.0, 5, 0.5)], "target_set string, y bigint, target_share double, min_count bigint, sample_frac double")
    sample, report = sample_quotas(n, t)
    assert sample.count() == 0 and [r["met"] for r in report.collect()] == [False]
    assert sample_quotas(n, t.limit(0))[1].count() == 0
