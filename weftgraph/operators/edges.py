"""Edge-table algebra: edges are rows (src, dst[, w][, edge_type]).

Every result has the columns it names and no others; rows with a null end are edges of
nothing and are dropped by `clean`, which all callers apply first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.segment import REDUCERS


def clean(edges: DataFrame, weight: str | None = "w") -> DataFrame:
    """(src, dst[, w]) without null ends and without null or NaN weights."""
    e = edges.filter("src is not null and dst is not null")
    if weight is None:
        return e.select("src", "dst")
    return e.filter(F.col(weight).isNotNull() & ~F.isnan(weight)).select("src", "dst", F.col(weight).alias("w"))


def coalesce(edges: DataFrame, reduce: str = "add", weight: str = "w") -> DataFrame:
    """Each (src, dst) once, weights reduced by add, mean, min, max or mul."""
    how = {"add": "sum"}.get(reduce, reduce)
    return edges.groupBy("src", "dst").agg(REDUCERS[how](F.col(weight)).alias(weight))


def sort_edges(edges: DataFrame, by_row: bool = True) -> DataFrame:
    """Globally ordered by (src, dst), or by (dst, src)."""
    return edges.orderBy("src", "dst") if by_row else edges.orderBy("dst", "src")


def contains_self_loops(edges: DataFrame) -> DataFrame:
    """One row, one BOOLEAN."""
    return edges.agg(F.coalesce(F.bool_or(F.col("src") == F.col("dst")), F.lit(False)).alias("value"))


def remove_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def add_self_loops(edges: DataFrame, nodes: DataFrame, fill: float = 1.0, times: int = 1) -> DataFrame:
    """Existing loops stay; `times` loops of weight `fill` are added for every node."""
    loops = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(fill).alias("w"))
    for _ in range(times):
        edges = edges.select("src", "dst", "w").unionByName(loops)
    return edges


def add_remaining_self_loops(edges: DataFrame, nodes: DataFrame, fill: float = 1.0) -> DataFrame:
    """All existing loops are replaced by exactly one of weight `fill` for every node."""
    return add_self_loops(remove_self_loops(edges), nodes, fill)


def transpose(edges: DataFrame) -> DataFrame:
    swap = {"src": "dst", "dst": "src"}
    return edges.select(*[F.col(c).alias(swap.get(c, c)) for c in edges.columns])


def to_undirected(edges: DataFrame, reduce: str = "add") -> DataFrame:
    """Both directions, then coalesced; the weight of a loop therefore doubles under `add`."""
    both = F.array(F.struct(F.col("src").alias("s"), F.col("dst").alias("d")), F.struct(F.col("dst").alias("s"), F.col("src").alias("d")))
    doubled = edges.select("w", F.explode(both).alias("e")).select(F.col("e.s").alias("src"), F.col("e.d").alias("dst"), "w")
    return coalesce(doubled, reduce)


def is_undirected(edges: DataFrame, weighted: bool = True) -> DataFrame:
    """One row (value): the multiset of edges equals its transpose.

    One pass and one shuffle: each edge counts +1 as itself and -1 turned; all must cancel.
    """
    keys = ["src", "dst"] + (["w"] if weighted else [])
    e = edges.select(*keys, F.lit(1).alias("n")).unionByName(transpose(edges.select(*keys)).withColumn("n", F.lit(-1)))
    open_ = e.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0")
    return open_.agg((F.count(F.lit(1)) == 0).alias("value"))


def is_coalesced(edges: DataFrame) -> DataFrame:
    d = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.coalesce(F.max("n") <= 1, F.lit(True)).alias("value"))


def isolated_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ids that are no edge's dst (nodes with out-edges only count as isolated)."""
    return nodes.select("id").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def num_nodes(edges: DataFrame) -> DataFrame:
    """One row: the largest id + 1; 0 without edges."""
    return edges.agg(F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0)).alias("n"))


def num_nodes_by_type(edges: DataFrame, src_type: str, dst_type: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node_type, n): the largest id + 1 of each type over all relations."""
    ends = F.array(F.struct(F.col(src_type).alias("t"), F.col(src).alias("i")), F.struct(F.col(dst_type).alias("t"), F.col(dst).alias("i")))
    e = edges.select(F.explode(ends).alias("e")).filter("e.i is not null")
    return e.groupBy(F.col("e.t").alias("node_type")).agg((F.max("e.i") + 1).alias("n"))


def index_to_mask(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, mask): whether each node is among `ids`."""
    return nodes.select("id").join(ids.select("id").distinct().withColumn("m", F.lit(True)), "id", "left").select("id", F.coalesce("m", F.lit(False)).alias("mask"))


def mask_to_index(masked: DataFrame) -> DataFrame:
    return masked.filter("mask").select("id")


def to_adjacency(edges: DataFrame) -> DataFrame:
    """Symmetric, without diagonal, binary: the distinct pairs in both directions."""
    return to_undirected(remove_self_loops(edges.withColumn("w", F.lit(1.0)))).select("src", "dst")


def dense_adjacency(edges: DataFrame, batch: str | None = None, weight: str = "w") -> DataFrame:
    """Long form of [batch, i, j]: sums of weights of equal coordinates."""
    keys = ([batch] if batch else []) + ["src", "dst"]
    return edges.groupBy(*keys).agg(F.sum(weight).alias("value"))


def upper_triangle(edges: DataFrame, keep: str = "upper") -> DataFrame:
    """Edges with src <= dst (`upper`) or src >= dst (`lower`)."""
    return edges.filter("src <= dst" if keep == "upper" else "src >= dst")


def csr(edges: DataFrame, block: int = 65_536) -> DataFrame:
    """(id, part, neighbours): distinct neighbours in order, at most `block` in a row, parts numbered from 0."""
    from weftgraph.core.session import cut
    from weftgraph.operators.segment import with_dense_ids

    e = edges.select("src", "dst").distinct().withColumn("__k", F.struct("src", "dst"))
    e = cut(with_dense_ids(e, "__k", "__p").drop("__k"))
    first = e.groupBy("src").agg(F.min("__p").alias("__f"))
    e = e.join(first, "src").withColumn("part", F.floor((F.col("__p") - F.col("__f")) / block).cast("bigint"))
    return e.groupBy(F.col("src").alias("id"), "part").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def edge_number(src: Column, dst: Column, n: int, mode: str = "bipartite") -> Column:
    """The number of an edge in the enumeration of all possible ones.

    `bipartite`: src * n + dst (n: size of the dst side).  `directed`: without the diagonal.
    `undirected`: the strict upper triangle, row by row.
    """
    if mode == "bipartite":
        return src * n + dst
    if mode == "directed":
        return src * (n - 1) + dst - (src < dst).cast("bigint")
    return src * (2 * n - src - 1) / 2 + dst - src - 1


def edge_of_number(number: Column, n: int, mode: str = "bipartite") -> tuple[Column, Column]:
    """Inverse of `edge_number`."""
    if mode == "bipartite":
        return F.floor(number / n).cast("bigint"), F.pmod(number, F.lit(n))
    if mode == "directed":
        src = F.floor(number / (n - 1)).cast("bigint")
        low = F.pmod(number, F.lit(n - 1))
        return src, low + (low >= src).cast("bigint")
    a = F.lit(2 * n - 1).cast("bigint")  # its square is no INT from n = 23,171 on
    starts = lambda row: F.shiftright(row * (a - row), 1)  # the first number of a row
    near = F.floor((a - F.sqrt(a * a - 8 * number)) / 2).cast("bigint")  # a root in double precision may miss by one
    src = near + F.when(number < starts(near), -1).when(number >= starts(near + 1), 1).otherwise(0)
    return src, (number - starts(src) + src + 1).cast("bigint")
