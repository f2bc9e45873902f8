"""Splits and task construction: seeded, exact sizes without sorting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.core.session import cut
from weftgraph.functions.rand import order_key
from weftgraph.operators.sample import negative_edges
from weftgraph.operators.segment import with_dense_ids


def shuffled_ranks(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds `pos`, the 0-based place of a row in the order of its digest (keys must be distinct)."""
    k = F.struct(order_key(seed, F.col(key)).alias("h"), F.col(key).alias("i"))
    return with_dense_ids(df.withColumn("__k", k), "__k", "pos").drop("__k")


def random_split(ids: DataFrame, parts: dict[str, float], seed: int, key: str = "id") -> DataFrame:
    """(key, part): consecutive shares of the shuffled ids; the last part takes what is left."""
    r = cut(shuffled_ranks(ids.select(key), key, seed))
    n = r.count()
    names, at, case = list(parts), 0.0, None
    for name in names[:-1]:
        at += parts[name]
        hit = F.col("pos") < int(n * at + 1e-9)
        case = F.when(hit, F.lit(name)) if case is None else case.when(hit, F.lit(name))
    return r.select(key, (F.lit(names[-1]) if case is None else case.otherwise(F.lit(names[-1]))).alias("part"))


def masks(split: DataFrame, parts: list[str]) -> DataFrame:
    return split.select("id", *[(F.col("part") == p).alias(f"{p}_mask") for p in parts])


def per_class_split(labelled: DataFrame, shots: int, rest: int, seed: int) -> DataFrame:
    """(id, y, part): `shots` of each class train, the next `rest` of each test, others null.

    A top-k per class: tasks keep at most shots + rest rows of a class before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("y").orderBy(order_key(seed, F.col("id")), "id"))
    top = labelled.select("id", "y").withColumn("r", rank).filter(F.col("r") <= shots + rest)
    return top.select("id", "y", F.when(F.col("r") <= shots, "train").otherwise("test").alias("part"))


def stratified_split(labelled: DataFrame, share: float, seed: int) -> DataFrame:
    """(id, y, part): the share of each class, rounded down, in `train`, the rest in `test`.

    Ranks within a class come from positions in one distributed order of (y, digest), so a class
    with a third of all rows is spread over partitions.
    """
    k = F.struct(F.col("y"), order_key(seed, F.col("id")).alias("h"), F.col("id").alias("i"))
    r = cut(with_dense_ids(labelled.select("id", "y", k.alias("__k")), "__k", "pos").drop("__k"))
    by = r.groupBy("y").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    inside = r.join(by, "y")
    train = F.col("pos") - F.col("first") < F.floor(F.col("n") * F.lit(share))
    return inside.select("id", "y", F.when(train, "train").otherwise("test").alias("part"))


def link_split(
    edges: DataFrame, num_val: float, num_test: float, seed: int, undirected: bool = False, neg_ratio: float = 0.0, n_nodes: int = 0, disjoint: float = 0.0
) -> dict[str, DataFrame]:
    """Edges (src, dst) split into message-passing edges and labelled ones for train, val and test.

    Returns tables train, val, test (message edges) and train_label, val_label, test_label
    (src, dst, label): label 1 for edges, 0 for negatives (neg_ratio times as many).  Undirected
    graphs are split by pairs src <= dst and mirrored.  `disjoint` is the share of train edges
    that only supervise.
    """
    e = edges.select("src", "dst").distinct()
    if undirected:
        e = e.filter("src <= dst")
    e = e.withColumn("k", F.struct("src", "dst"))
    k = F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("src").cast("string"), F.col("dst").cast("string"))).alias("h"), F.col("k"))
    r = cut(with_dense_ids(e.withColumn("__k", k), "__k", "pos").select("src", "dst", "pos"))
    n = r.count()
    n_val, n_test = int(n * num_val), int(n * num_test)
    n_train = n - n_val - n_test
    n_sup = int(n_train * disjoint)
    part = {
        "train": r.filter(F.col("pos") < n_train), "val": r.filter((F.col("pos") >= n_train) & (F.col("pos") < n_train + n_val)),
        "test": r.filter(F.col("pos") >= n_train + n_val),
    }
    label = {"train": part["train"].filter(F.col("pos") < n_sup) if disjoint else part["train"], "val": part["val"], "test": part["test"]}
    sizes = {"train": n_sup if disjoint else n_train, "val": n_val, "test": n_test}

    def mirror(d: DataFrame) -> DataFrame:
        d = d.select("src", "dst")
        return d.unionByName(d.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if undirected else d

    message = part["train"].filter(F.col("pos") >= n_sup) if disjoint else part["train"]
    out = {"train": mirror(message), "val": mirror(part["train"]), "test": mirror(part["train"].unionByName(part["val"]))}
    total = int(neg_ratio * sum(sizes.values()))
    neg = None
    if total and n_nodes:
        drawn = negative_edges(edges, total, n_nodes, n_nodes, seed + 1)
        neg = cut(shuffled_pairs(drawn, seed + 2))
    at = 0
    for name in ("train", "val", "test"):
        rows = label[name].select("src", "dst", F.lit(1).alias("label"))
        if neg is not None:
            m = int(neg_ratio * sizes[name])
            rows = rows.unionByName(neg.filter((F.col("pos") >= at) & (F.col("pos") < at + m)).select("src", "dst", F.lit(0).alias("label")))
            at += m
        out[f"{name}_label"] = rows
    return out


def shuffled_pairs(pairs: DataFrame, seed: int) -> DataFrame:
    k = F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("src").cast("string"), F.col("dst").cast("string"))).alias("h"), "src", "dst")
    return with_dense_ids(pairs.select("src", "dst", k.alias("__k")), "__k", "pos").drop("__k")
