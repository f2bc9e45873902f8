"""Typed graphs and batches of graphs: types and graphs are columns, ids become dense by offsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.core.session import cut
from weftgraph.operators.segment import with_dense_ids


def to_homogeneous(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_type, id) and edges (src_type, src, dst_type, dst, edge_type) -> one id space.

    New ids are dense in the order of (node_type, id).  Edges with an end that is no node are left out.
    """
    m = cut(with_dense_ids(nodes.select("node_type", "id").distinct().withColumn("k", F.struct("node_type", "id")), "k", "new").drop("k"))
    s = m.select(F.col("node_type").alias("src_type"), F.col("id").alias("src"), F.col("new").alias("__s"))
    d = m.select(F.col("node_type").alias("dst_type"), F.col("id").alias("dst"), F.col("new").alias("__d"))
    e = edges.join(s, ["src_type", "src"]).join(d, ["dst_type", "dst"])
    return m, e.select(F.col("__s").alias("src"), F.col("__d").alias("dst"), "edge_type")


def to_heterogeneous(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, node_type) and edges (src, dst, edge_type) -> ids that count from 0 within each type."""
    m = cut(with_dense_ids(nodes.select("id", "node_type").withColumn("k", F.struct("node_type", "id")), "k", "pos").drop("k"))
    first = m.groupBy("node_type").agg(F.min("pos").alias("first"))
    m = cut(m.join(first, "node_type").select("id", "node_type", (F.col("pos") - F.col("first")).alias("local")))
    s = m.select(F.col("id").alias("src"), F.col("node_type").alias("src_type"), F.col("local").alias("__s"))
    d = m.select(F.col("id").alias("dst"), F.col("node_type").alias("dst_type"), F.col("local").alias("__d"))
    e = edges.join(s, "src").join(d, "dst").select("src_type", "edge_type", "dst_type", F.col("__s").alias("src"), F.col("__d").alias("dst"))
    return m, e


def node_offsets(nodes: DataFrame) -> DataFrame:
    """(node_type, n, offset): prefix sums of type sizes in the order of names (types are few)."""
    n = nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("node_type").rowsBetween(Window.unboundedPreceding, -1))
    return n.withColumn("offset", F.coalesce(before, F.lit(0)))


def typed_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type", "dst").agg(F.count(F.lit(1)).alias("deg"))


def metadata(edges: DataFrame) -> DataFrame:
    """(src_type, edge_type, dst_type): the relations that occur."""
    return edges.select("src_type", "edge_type", "dst_type").distinct()


def rename_type(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))


def collect_attr(tables: dict[str, DataFrame], attr: str) -> DataFrame:
    """(node_type, id, attr) of all types that have the attribute."""
    parts = [t.select(F.lit(name).alias("node_type"), "id", attr) for name, t in tables.items() if attr in t.columns]
    return reduce(DataFrame.unionByName, parts)


def metapath(chain: list[DataFrame], weighted: bool = False) -> DataFrame:
    """(src, dst[, n]): pairs linked along a chain of edge tables; distinct after each hop, or with path counts."""
    out = chain[0].select("src", "dst")
    out = out.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")) if weighted else out.distinct()
    for e in chain[1:]:
        nxt = e.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
        nxt = nxt.groupBy("dst", "to").agg(F.count(F.lit(1)).alias("m")) if weighted else nxt.distinct()
        j = out.join(nxt, "dst")
        if weighted:
            out = j.groupBy("src", F.col("to").alias("dst")).agg(F.sum(F.col("n") * F.col("m")).alias("n"))
        else:
            out = j.select("src", F.col("to").alias("dst")).distinct()
    return out


def group_relations(parts: list[DataFrame], width: int, how: str) -> DataFrame:
    """(id, x): outputs of several relations reduced per node (sum, mean, min, max)."""
    from weftgraph.functions import vec

    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(vec.reduce_vectors("x", width, how).alias("x"))


def collate(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graph-by-graph ids -> one disjoint graph: ((graph_id, id, new), edges, (graph_id, ptr, n)).

    nodes (graph_id, id), edges (graph_id, src, dst); new ids are dense in the order of
    (graph_id, id), ptr is where a graph's ids start.
    """
    m = cut(with_dense_ids(nodes.select("graph_id", "id").distinct().withColumn("k", F.struct("graph_id", "id")), "k", "new").drop("k"))
    s, d = m.select("graph_id", F.col("id").alias("src"), F.col("new").alias("__s")), m.select("graph_id", F.col("id").alias("dst"), F.col("new").alias("__d"))
    e = edges.join(s, ["graph_id", "src"]).join(d, ["graph_id", "dst"]).select("graph_id", F.col("__s").alias("src"), F.col("__d").alias("dst"))
    ptr = m.groupBy("graph_id").agg(F.min("new").alias("ptr"), F.count(F.lit(1)).alias("n"))
    return m, e, ptr


def separate(nodes: DataFrame, edges: DataFrame, ptr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inverse of `collate`: ids count from 0 within each graph."""
    p = ptr.select("graph_id", "ptr")
    n = nodes.join(p, "graph_id").select("graph_id", (F.col("new") - F.col("ptr")).alias("id"))
    e = edges.join(p, "graph_id").select("graph_id", (F.col("src") - F.col("ptr")).alias("src"), (F.col("dst") - F.col("ptr")).alias("dst"))
    return n, e


def gather(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Attributes of sampled nodes or edges: a semi-join on their ids."""
    return table.join(ids.select(key).distinct(), key, "left_semi")
