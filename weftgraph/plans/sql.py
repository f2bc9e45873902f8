"""The tables and graph views as temporary views, for `spark.sql`."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from weftgraph.core.session import read
from weftgraph.plans import views as V

GRAPH_VIEWS = {
    "g_edges": V.edges, "g_typed_edges": V.typed, "g_nodes": V.nodes, "g_vectors": V.vectors, "g_features": V.features, "g_labels": V.labels, "g_graphs": V.graphs,
    "g_hetero_edges": V.alircd_edges,
}


def register(spark: SparkSession, folder: str, tables: Iterable[str]) -> list[str]:
    """Create views of Parquet `tables` in `folder` under their names, and the graph views; returns all names."""
    names = list(tables)
    for t in names:
        read(spark, folder, t).createOrReplaceTempView(t)
    for name, view in GRAPH_VIEWS.items():
        view(spark, folder).createOrReplaceTempView(name)
    return names + list(GRAPH_VIEWS)
