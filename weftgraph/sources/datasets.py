"""Public data sets by name: which files they have and which reader reads them.

    load(spark, "cornell", folder) -> Graph

`folder` holds the raw files under their published names; nothing is downloaded.  Text is read by
Spark in parallel; npz archives, one in-memory object each, on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.core.graph import Graph, HeteroGraph
from weftgraph.operators.edges import coalesce
from weftgraph.sources import readers as R


def _feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, values, y) of `id <tab> v,v,... <tab> class` lines; a header (whose id is no number) is skipped."""
    p = F.split("value", "\t")
    lines = spark.read.text(path).select(
        F.get(p, F.lit(0)).try_cast("bigint").alias("id"), F.transform(F.split(F.get(p, F.lit(1)), ","), lambda v: F.trim(v).try_cast("double")).alias("x"),
        F.get(p, F.lit(2)).try_cast("bigint").alias("y"),
    )
    return lines.filter("id is not null")


def geom_gcn(spark: SparkSession, folder: str, name: str = "", sparse: bool = False) -> Graph:
    """Node lines with all components (or, `sparse`, the positions of ones: `x_at`), tab-separated edges without repeats."""
    nodes = _feature_lines(spark, f"{folder}/out1_node_feature_label.txt")
    if sparse:
        nodes = nodes.select("id", F.sort_array(F.array_distinct(F.transform("x", lambda v: v.cast("bigint")))).alias("x_at"), "y")
    edges = R.edge_list(spark, f"{folder}/out1_graph_edges.txt").select("src", "dst").distinct()
    return Graph(nodes, edges)


def split_masks(spark: SparkSession, folder: str, name: str, n: int = 10) -> DataFrame:
    """(id, split, part): part of train, val or test of each node in each published split."""
    out = {"id": [], "split": [], "part": []}
    for s in range(n):
        z = np.load(f"{folder}/{name}_split_0.6_0.2_{s}.npz", allow_pickle=False)
        for part in ("train", "val", "test"):
            ids = np.flatnonzero(z[f"{part}_mask"])
            out["id"] += ids.tolist()
            out["split"] += [s] * len(ids)
            out["part"] += [part] * len(ids)
    rows = {"id": np.array(out["id"], np.int64), "split": np.array(out["split"], np.int32), "part": np.array(out["part"])}
    return spark.createDataFrame(R._arrow(**rows))


def _npz(features: str, labels: str, edges: str, file: str, by_rows: bool = True) -> Callable[[SparkSession, str, str], Graph]:
    def read(spark: SparkSession, folder: str, name: str) -> Graph:
        """Dense features and labels by node, edges as pairs (or two rows)."""
        import pyarrow as pa

        z = np.load(f"{folder}/{file.format(name=name.lower())}", allow_pickle=False)
        x, e = np.asarray(z[features], float), np.asarray(z[edges], np.int64)
        e = e if by_rows else e.T
        ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
        nodes = pa.table({"id": np.arange(len(x)), "x": pa.ListArray.from_arrays(ends, pa.array(x.ravel())), "y": np.asarray(z[labels]).reshape(-1).astype(np.int64)})
        return Graph(spark.createDataFrame(nodes), spark.createDataFrame(R._arrow(src=e[:, 0].copy(), dst=e[:, 1].copy())))

    return read


def polblogs(spark: SparkSession, folder: str, name: str = "") -> Graph:
    """Edges and, line by line, the class of each node; a node's feature is its own number."""
    y = R.text_array(spark, f"{folder}/labels.tsv", kind="bigint").select(F.col("line_no").alias("id"), F.get("x", F.lit(0)).alias("y"))
    return Graph(y, R.edge_list(spark, f"{folder}/adjacency.tsv").select("src", "dst"))


def ca_grqc(spark: SparkSession, folder: str, name: str = "") -> Graph:
    """Train and test edges as text; `part` tells them apart."""
    parts = [R.edge_list(spark, f"{folder}/data/link_prediction/CA-GrQc_{p}.txt").select("src", "dst", F.lit(p).alias("part")) for p in ("train", "test")]
    edges = parts[0].unionByName(parts[1])
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Graph(ids, edges)


def movielens(spark: SparkSession, folder: str, name: str) -> HeteroGraph:
    """Users, items and ratings, tab-separated under typed headers; ids start from 0."""
    t = lambda part: spark.read.option("sep", "\t").option("header", True).csv(f"{folder}/{name}.{part}")
    number = lambda c: (F.col(f"`{c}`").cast("bigint") - 1)
    rated = t("inter").select(number("user_id:token").alias("src"), number("item_id:token").alias("dst"), F.col("`rating:float`").cast("double").alias("w"))
    return HeteroGraph(
        {"user": t("user").select(number("user_id:token").alias("id")), "item": t("item").select(number("item_id:token").alias("id"))},
        {("user", "rates", "item"): rated},
    )


def _csr(file: str) -> Callable[[SparkSession, str, str], Graph]:
    return lambda spark, folder, name: R.csr_npz(spark, f"{folder}/{file.format(name=name.lower(), short=name[:3].lower())}")


def entities(spark: SparkSession, folder: str, name: str) -> Graph:
    return R.ntriples_graph(R.ntriples(spark, f"{folder}/{name}_stripped.nt.gz"))


def sensitive(spark: SparkSession, folder: str, name: str) -> Graph:
    """A header CSV of node attributes and a text of edges, without loops and repeats."""
    nodes = spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/{name}.csv")
    return Graph(nodes, coalesce(R.edge_list(spark, f"{folder}/{name}_edges.txt").filter("src <> dst").withColumn("w", F.lit(1.0)), "max"))


#: Names of public data sets and of their raw files.
LOADERS: dict[str, Callable] = {
    **{n: geom_gcn for n in ("cornell", "texas", "wisconsin", "chameleon", "squirrel", "crocodile")},
    "actor": lambda s, f, n: geom_gcn(s, f, n, sparse=True),
    "facebook": _npz("features", "target", "edges", "facebook.npz"),
    "github": _npz("features", "target", "edges", "github.npz"),
    "deezer_europe": _npz("features", "target", "edges", "deezer_europe.npz"),
    **{n: _npz("node_features", "node_labels", "edges", "{name}.npz") for n in ("roman-empire", "tolokers")},
    **{n: _npz("x", "y", "edge_index", "{name}.npz", by_rows=False) for n in ("inj_cora", "inj_amazon", "reddit")},
    "polblogs": polblogs,
    "ca-grqc": ca_grqc,
    **{n: movielens for n in ("ml-100k", "ml-1m")},
    **{n: _csr("amazon_electronics_{name}.npz") for n in ("computers", "photo")},
    **{n: _csr("ms_academic_{short}.npz") for n in ("cs", "physics")},
    **{n: entities for n in ("aifb", "mutag", "bgs", "am")},
    **{f"bail_B{i}": sensitive for i in range(5)},
    **{f"credit_C{i}": sensitive for i in range(5)},
    "wikics": lambda s, f, n: R.adjacency_json(s, f"{f}/data.json"),
    **{n: lambda s, f, n: R.hgb(s, f) for n in ("hgb-acm", "hgb-dblp", "hgb-imdb", "hgb-freebase")},
}


def load(spark: SparkSession, name: str, folder: str) -> Graph | HeteroGraph:
    """The data set `name` (a key of LOADERS) from its raw files in `folder`."""
    if name not in LOADERS:
        raise KeyError(f"{name}: known are {', '.join(sorted(LOADERS))}")
    return LOADERS[name](spark, folder, name)


def tu(spark: SparkSession, name: str, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Any data set of the TU family (MUTAG, PROTEINS, ENZYMES, ...): nodes, edges and graphs."""
    return R.tu_family(spark, folder, name)
