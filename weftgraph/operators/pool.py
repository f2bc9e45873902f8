"""Per-graph readouts and padding: graphs are a `graph_id` column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import vec
from weftgraph.operators.segment import segment_vectors


def global_pool(nodes: DataFrame, width: int, how: str, batch: str = "graph_id") -> DataFrame:
    """(batch, x): sum, mean, max or min of the vectors of each graph."""
    return segment_vectors(nodes, batch, "x", width, how)


def sort_pool(nodes: DataFrame, width: int, k: int, batch: str = "graph_id") -> DataFrame:
    """(batch, x): the k nodes of largest last component (ties by id), flattened, zero-padded to k * width.

    A top-k per graph, then at most k rows a graph are gathered.
    """
    r = F.row_number().over(Window.partitionBy(batch).orderBy(F.desc(F.get("x", F.lit(width - 1))), "id"))
    top = nodes.filter(F.col(batch).isNotNull()).withColumn("r", r).filter(F.col("r") <= k)
    rows = top.groupBy(batch).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("r", "x"))), lambda s: s["x"])).alias("x"))
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), F.lit(k * width) - F.size("x"))))


def dense_batch(nodes: DataFrame, width: int, least: int = 1, batch: str = "graph_id", fill: float = 0.0) -> DataFrame:
    """(batch, slot, x, mask): as many slots a graph as the largest has nodes, but at least `least`.

    Slots are filled by id, then padded with `fill`; no node is left out.
    """
    slot = F.row_number().over(Window.partitionBy(batch).orderBy("id")) - 1
    own = nodes.filter(F.col(batch).isNotNull()).withColumn("slot", slot).select(batch, "slot", "x")
    last = own.agg(F.greatest(F.max("slot"), F.lit(least - 1)).alias("last"))  # one row
    slots = own.select(batch).distinct().crossJoin(last).select(batch, F.explode(F.sequence(F.lit(0), F.col("last"))).alias("slot"))
    j = slots.join(own, [batch, "slot"], "left")
    return j.select(batch, "slot", F.coalesce("x", F.array_repeat(F.lit(fill), F.lit(width))).alias("x"), F.col("x").isNotNull().alias("mask"))


def moments(nodes: DataFrame, width: int, batch: str = "graph_id") -> DataFrame:
    """(batch, x): mean, min, max and standard deviation of each component, concatenated."""
    c = [F.get("x", F.lit(i)) for i in range(width)]
    parts = [F.array(*[f(v) for v in c]) for f in (F.avg, F.min, F.max, F.stddev_pop)]
    return nodes.filter(F.col(batch).isNotNull()).groupBy(batch).agg(F.concat(*parts).alias("x"))


def attention_pool(nodes: DataFrame, width: int, score: str, batch: str = "graph_id") -> DataFrame:
    """(batch, x): softmax of the scores within a graph weighs its vectors."""
    from weftgraph.operators.segment import segment_softmax

    a = segment_softmax(nodes.filter(F.col(batch).isNotNull()), batch, score, "__a")
    return segment_vectors(a.withColumn("x", vec.scale(F.col("x"), F.col("__a"))), batch, "x", width, "sum")
