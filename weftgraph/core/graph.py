"""Graphs as tables: homogeneous, typed and batched containers, and the stores that name tables.

A container holds DataFrames and adds methods that plan; nothing is computed before an action.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import edges as E
from weftgraph.operators import hetero as H
from weftgraph.operators.segment import degree
from weftgraph.operators.traverse import induced

EdgeType = tuple[str, str, str]
Transform = Callable[["Graph"], "Graph"]


@dataclass
class Graph:
    """nodes (id, attributes...) and edges (src, dst, attributes...)."""

    nodes: DataFrame
    edges: DataFrame
    meta: dict = field(default_factory=dict)

    def num_nodes(self) -> int:
        return self.nodes.select("id").distinct().count()

    def num_edges(self) -> int:
        return self.edges.count()

    def node_attrs(self) -> list[str]:
        return [c for c in self.nodes.columns if c != "id"]

    def edge_attrs(self) -> list[str]:
        return [c for c in self.edges.columns if c not in ("src", "dst")]

    def in_degree(self) -> DataFrame:
        return degree(self.edges, "dst", self.nodes)

    def out_degree(self) -> DataFrame:
        return degree(self.edges, "src", self.nodes)

    def is_undirected(self) -> bool:
        return E.is_undirected(self.edges, weighted="w" in self.edges.columns).first()[0]

    def is_directed(self) -> bool:
        return not self.is_undirected()

    def has_self_loops(self) -> bool:
        return E.contains_self_loops(self.edges).first()[0]

    def has_isolated_nodes(self) -> bool:
        return E.isolated_nodes(self.edges, self.nodes).limit(1).count() > 0

    def is_coalesced(self) -> bool:
        return E.is_coalesced(self.edges).first()[0]

    def subgraph(self, ids: DataFrame) -> Graph:
        """The graph that the ids induce."""
        return Graph(H.gather(self.nodes, ids), induced(self.edges, ids), dict(self.meta))

    def transform(self, *steps: Transform) -> Graph:
        g = self
        for step in steps:
            g = step(g)
        return g

    def to_hetero(self) -> HeteroGraph:
        """Split by `node_type` and `edge_type`; ids count from 0 within each type."""
        m, e = H.to_heterogeneous(self.nodes, self.edges)
        types = sorted(r[0] for r in m.select("node_type").distinct().collect())  # types are few
        rels = sorted((r[0], r[1], r[2]) for r in H.metadata(e).collect())
        nodes = {t: m.filter(F.col("node_type") == t).join(self.nodes.drop("node_type"), "id").drop("id", "node_type").withColumnRenamed("local", "id") for t in types}
        parts = {}
        for s, r, d in rels:
            hit = (F.col("src_type") == s) & (F.col("edge_type") == r) & (F.col("dst_type") == d)
            parts[s, r, d] = e.filter(hit).select("src", "dst")
        return HeteroGraph(nodes, parts)

    def dump(self, path: str, bucket_by: str | None = None, buckets: int = 64) -> None:
        """Write nodes and edges as Parquet below `path`; edges sorted by `bucket_by` within hash partitions."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        edges = self.edges
        if bucket_by:
            edges = edges.repartition(buckets, bucket_by).sortWithinPartitions(bucket_by)
        edges.write.mode("overwrite").parquet(f"{path}/edges")
        self.nodes.sparkSession.createDataFrame([(json.dumps(self.meta),)], "meta string").write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Graph:
        meta = spark.read.parquet(f"{path}/meta").first()
        return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), json.loads(meta[0]) if meta else {})


@dataclass
class HeteroGraph:
    """A node table a type and an edge table a (source type, relation, destination type)."""

    nodes: dict[str, DataFrame]
    edges: dict[EdgeType, DataFrame]

    def metadata(self) -> tuple[list[str], list[EdgeType]]:
        return sorted(self.nodes), sorted(self.edges)

    def edge_table(self, *key: str) -> DataFrame:
        """By full type, by relation name, or by both end types, if that is unique."""
        if len(key) == 3:
            return self.edges[key]
        hits = [t for t in self.edges if (t[1] == key[0] if len(key) == 1 else (t[0], t[2]) == key)]
        if len(hits) != 1:
            raise KeyError(f"{key}: {len(hits)} relations")
        return self.edges[hits[0]]

    def is_bipartite(self, *key: str) -> bool:
        """Whether a relation (named as in `edge_table`) joins two types of nodes."""
        hits = [t for t in self.edges if self.edges[t] is self.edge_table(*key)]
        return hits[0][0] != hits[0][2]

    def rename(self, old: str, new: str) -> HeteroGraph:
        swap = lambda t: new if t == old else t
        return HeteroGraph({swap(t): v for t, v in self.nodes.items()}, {(swap(s), r, swap(d)): v for (s, r, d), v in self.edges.items()})

    def collect(self, attr: str) -> DataFrame:
        return H.collect_attr(self.nodes, attr)

    def to_homogeneous(self) -> Graph:
        """One id space; attributes that all node types have are kept."""
        shared = set.intersection(*[set(t.columns) for t in self.nodes.values()]) - {"id"}
        nodes, edges = None, None
        for name, t in sorted(self.nodes.items()):
            part = t.select(F.lit(name).alias("node_type"), "id", *sorted(shared))
            nodes = part if nodes is None else nodes.unionByName(part)
        for (s, r, d), t in sorted(self.edges.items()):
            part = t.select(F.lit(s).alias("src_type"), "src", F.lit(d).alias("dst_type"), "dst", F.lit(r).alias("edge_type"))
            edges = part if edges is None else edges.unionByName(part)
        m, e = H.to_homogeneous(nodes, edges)
        return Graph(nodes.join(m, ["node_type", "id"]).drop("id").withColumnRenamed("new", "id"), e)

    def add_metapath(self, name: str, path: list[EdgeType], drop_original: bool = False) -> HeteroGraph:
        """A relation between the ends of a chain of relations (distinct pairs)."""
        out = {} if drop_original else dict(self.edges)
        out[path[0][0], name, path[-1][2]] = H.metapath([self.edges[t] for t in path])
        return HeteroGraph(self.nodes, out)

    def transform(self, f: Callable[[DataFrame], DataFrame]) -> HeteroGraph:
        return HeteroGraph({t: f(v) for t, v in self.nodes.items()}, self.edges)


@dataclass
class BatchGraph:
    """Many graphs in one table pair: nodes (graph_id, id, ...), edges (graph_id, src, dst, ...)."""

    nodes: DataFrame
    edges: DataFrame

    def get(self, graph_id: int) -> Graph:
        pick = F.col("graph_id") == graph_id
        return Graph(self.nodes.filter(pick).drop("graph_id"), self.edges.filter(pick).drop("graph_id"))

    def select(self, graph_ids: DataFrame) -> BatchGraph:
        return BatchGraph(H.gather(self.nodes, graph_ids, "graph_id"), H.gather(self.edges, graph_ids, "graph_id"))

    def collate(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return H.collate(self.nodes, self.edges.select("graph_id", "src", "dst"))

    def loader(self, size: int, seed: int | None = None) -> DataFrame:
        """(batch_id, id) of graphs: what a loader iterates."""
        from weftgraph.operators.sample import batches

        return batches(self.nodes.select(F.col("graph_id").alias("id")).filter("id is not null").distinct(), size, seed)


class FeatureStore:
    """Attributes by (group, attribute): tables (id, value) that are put, looked up by ids, updated and removed."""

    def __init__(self) -> None:
        self._tables: dict[tuple[str, str], DataFrame] = {}

    def put(self, group: str, attr: str, table: DataFrame) -> None:
        self._tables[group, attr] = table

    def get(self, group: str, attr: str, ids: DataFrame | None = None) -> DataFrame:
        t = self._tables[group, attr]
        return t if ids is None else H.gather(t, ids)

    def multi_get(self, keys: list[tuple[str, str]], ids: DataFrame | None = None) -> list[DataFrame]:
        return [self.get(g, a, ids) for g, a in keys]

    def update(self, group: str, attr: str, rows: DataFrame) -> None:
        """Rows replace those of equal id; new ids are added."""
        old = self._tables[group, attr]
        self._tables[group, attr] = old.join(rows.select("id"), "id", "left_anti").unionByName(rows)

    def remove(self, group: str, attr: str) -> bool:
        return self._tables.pop((group, attr), None) is not None

    def keys(self) -> Iterator[tuple[str, str]]:
        return iter(sorted(self._tables))

    def size(self, group: str, attr: str) -> int:
        return self._tables[group, attr].count()


class GraphStore:
    """Edge tables by type; a layout is a sort order of the same rows."""

    LAYOUTS = {"coo": (), "csr": ("src", "dst"), "csc": ("dst", "src")}

    def __init__(self) -> None:
        self._tables: dict[tuple[EdgeType, str], DataFrame] = {}

    def put(self, edge_type: EdgeType, edges: DataFrame, layout: str = "coo") -> None:
        self._tables[edge_type, layout] = edges

    def get(self, edge_type: EdgeType, layout: str = "coo") -> DataFrame:
        """The stored table, or another layout of it: partitioned by its first key and sorted within."""
        if (edge_type, layout) not in self._tables:
            have = next((t for (e, _), t in self._tables.items() if e == edge_type), None)
            if have is None:
                raise KeyError(edge_type)
            order = self.LAYOUTS[layout]
            self._tables[edge_type, layout] = have.repartition(order[0]).sortWithinPartitions(*order) if order else have
        return self._tables[edge_type, layout]

    def remove(self, edge_type: EdgeType) -> bool:
        gone = [k for k in self._tables if k[0] == edge_type]
        for k in gone:
            del self._tables[k]
        return bool(gone)

    def types(self) -> list[EdgeType]:
        return sorted({e for e, _ in self._tables})


class Dataset:
    """raw files -> process -> Parquet cache -> transform.

    `process(spark, raw_dir)` gives a Graph; its tables are written once below `root`.
    """

    def __init__(self, root: str, process: Callable[[SparkSession, str], Graph], transform: Transform | None = None, pre_transform: Transform | None = None) -> None:
        self.root, self.process, self.transform_, self.pre = root, process, transform, pre_transform

    def graph(self, spark: SparkSession) -> Graph:
        path = str(PurePosixPath(self.root) / "processed")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/edges/_SUCCESS")
        if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            g = self.process(spark, str(PurePosixPath(self.root) / "raw"))
            (self.pre(g) if self.pre else g).dump(path)
        g = Graph.load(spark, path)
        return self.transform_(g) if self.transform_ else g
