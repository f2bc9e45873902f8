"""Invariants of seeded sampling and splits."""

import random

from pyspark.sql import functions as F

from weftgraph.operators import sample as P
from weftgraph.operators import split as L


def random_edges(table, n=100, m=500, seed=1):
    r = random.Random(seed)
    return table(sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)}), "src bigint, dst bigint")


def test_neighbour_batches(table):
    e = P.with_edge_ids(random_edges(table), ["src", "dst"])
    b = P.batches(table([(i,) for i in range(100)], "id bigint"), 20)
    nodes, sampled = P.neighbour_batches(e, b, [5, 5], 3)
    assert nodes.select("batch_id").distinct().count() == 5
    assert sampled.join(e, ["src", "dst", "eid"], "left_anti").count() == 0
    assert sampled.groupBy("batch_id", "dst").count().agg(F.max("count")).first()[0] <= 5
    again = P.neighbour_batches(e, b, [5, 5], 3)[1]
    assert sampled.exceptAll(again).count() == 0
    assert P.sample_neighbours(e, table([(1,)], "id bigint"), -1, 0).count() == e.filter("dst = 1").count()


def test_walk_steps_are_edges(table):
    e = random_edges(table, m=300)
    s = table([(i, i) for i in range(100)], "walk_id bigint, id bigint")
    for walks in (P.random_walks(e, s, 3, 7), P.node2vec_walks(e.withColumn("w", F.lit(1.0)), s, 3, 0.5, 2.0, 7)):
        a = walks.select("walk_id", "step", F.col("id").alias("src"))
        b = walks.select("walk_id", (F.col("step") - 1).alias("step"), F.col("id").alias("dst"))
        moves = a.join(b, ["walk_id", "step"])
        assert moves.count() == 300
        sinks = {r[0] for r in s.select("id").subtract(e.select("src")).collect()}
        bad = moves.join(e, ["src", "dst"], "left_anti").collect()
        assert all(r["src"] == r["dst"] and r["src"] in sinks for r in bad)


def test_node2vec_probabilities_sum_to_one(table):
    p = P.node2vec_probabilities(random_edges(table).withColumn("w", F.lit(2.0)), 0.5, 4.0)
    s = p.groupBy("prev", "cur").agg(F.sum("prob").alias("s"))
    assert s.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_negatives(table):
    e = random_edges(table)
    n = P.negative_edges(e, 200, 100, 100, 5)
    assert n.count() == 200 and n.distinct().count() == 200
    assert n.filter("src = dst").count() == 0 and n.join(e, ["src", "dst"]).count() == 0


def test_block_model(spark):
    e = P.block_model(spark, [20, 30], [[0.5, 0.1], [0.1, 0.5]], 1)
    assert e.filter("src >= dst or src < 0 or dst >= 50").count() == 0 and e.count() > 100


def test_block_model_of_large_blocks(spark):
    e = P.block_model(spark, [60_000, 5], [[2e-7, 0.0], [0.0, 1.0]], 1)
    big = e.filter("dst < 60000")
    assert 340 < big.count() <= 360 and big.filter("src >= dst or src < 0").count() == 0
    assert e.filter("dst >= 60000").filter("src < 60000 or src >= dst or dst >= 60005").count() == 0
    assert P.block_model(spark, [], [], 1).count() == 0


def test_numbers_of_edges_of_large_graphs(table):
    from weftgraph.operators.edges import edge_of_number

    n = 10**8  # row starts of this size are no exact doubles
    start = lambda r: r * (2 * n - r - 1) // 2
    rows = [0, 1, n // 3, n // 2 + 1, n - 3]
    t = table([(r, start(r) + x) for r in rows for x in (0, 1)], "r bigint, k bigint")
    s, d = edge_of_number(F.col("k"), n, "undirected")
    assert sorted(tuple(x) for x in t.select(s, d).collect()) == sorted((r, r + 1 + x) for r in rows for x in (0, 1))


def test_splits(table):
    y = table([(i, i % 3) for i in range(1000)], "id bigint, y bigint")
    parts = {r["part"]: r["count"] for r in L.random_split(y, {"train": 0.6, "val": 0.2, "test": 0.2}, 0).groupBy("part").count().collect()}
    assert parts == {"train": 600, "val": 200, "test": 200}
    m = L.masks(L.random_split(y, {"train": 0.6, "test": 0.4}, 0), ["train", "test"])
    assert m.filter("train_mask = test_mask").count() == 0
    few = L.per_class_split(y, 5, 10, 1).groupBy("y", "part").count()
    assert sorted(r["count"] for r in few.collect()) == [5] * 3 + [10] * 3
    st = {(r["y"], r["part"]): r["count"] for r in L.stratified_split(y, 0.5, 1).groupBy("y", "part").count().collect()}
    assert st == {(0, "train"): 167, (0, "test"): 167, (1, "train"): 166, (1, "test"): 167, (2, "train"): 166, (2, "test"): 167}


def test_link_split(table):
    path = [(i, i + 1) for i in range(5)]
    e = table(path + [(b, a) for a, b in path], "src bigint, dst bigint")
    s = L.link_split(e, 0.2, 0.2, 3, undirected=True, neg_ratio=2.0, n_nodes=100)
    assert (s["train"].count(), s["val"].count(), s["test"].count()) == (6, 6, 8)
    labels = {p: {r["label"]: r["count"] for r in s[f"{p}_label"].groupBy("label").count().collect()} for p in ("train", "val", "test")}
    assert labels == {"train": {1: 3, 0: 6}, "val": {1: 1, 0: 2}, "test": {1: 1, 0: 2}}


def test_saint_and_drop(table):
    e = P.with_edge_ids(random_edges(table), ["src", "dst"])
    nodes, sub = P.saint_node_sample(e, 40, 2)
    ids = {r["id"] for r in nodes.collect()}
    assert all(r["src"] in ids and r["dst"] in ids for r in sub.collect())
    assert 0 < P.keep_edges(e, 0.5, 1, ["eid"]).count() < e.count()
    assert P.keep_edges(e, 1.0, 1, ["eid"]).count() == 0


def test_negatives_of_a_dense_graph_are_as_many_as_there_are(table):
    e = table([(a, b) for a in range(12) for b in range(12) if (a + b) % 7], "src bigint, dst bigint")
    free = {(a, b) for a in range(12) for b in range(12) if not (a + b) % 7 and a != b}
    got = [tuple(r) for r in P.negative_edges(e, len(free), 12, 12, 5).collect()]
    assert set(got) == free and len(got) == len(free)
    assert P.negative_edges(e, 500, 12, 12, 5).count() == len(free)
    assert P.negative_edges(e, 3, 12, 12, 5).count() == 3
