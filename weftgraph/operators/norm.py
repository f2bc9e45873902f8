"""Edge weights from degrees: symmetric, random-walk and Laplacian normalisations.

Each is one degree aggregate and one or two joins of the edges with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import edges as E


def power(deg: Column, p: float, zero_isolated: bool = True) -> Column:
    """deg ** p; a degree of 0 gives 0 (pseudo-inverse), or infinity with zero_isolated=False."""
    raised = F.pow(deg, F.lit(p))
    return F.when(deg > 0, raised).otherwise(0.0) if zero_isolated else F.when(deg == 0, float("inf")).otherwise(raised)


def weighted_degree(edges: DataFrame, side: str) -> DataFrame:
    return edges.groupBy(F.col(side).alias("id")).agg(F.sum("w").alias("deg"))


def _with_degrees(edges: DataFrame, deg: DataFrame) -> DataFrame:
    """Edges with `ds` and `dd`, the degrees of both ends (0 where there is none)."""
    s, d = deg.select(F.col("id").alias("src"), F.col("deg").alias("ds")), deg.select(F.col("id").alias("dst"), F.col("deg").alias("dd"))
    return edges.join(s, "src", "left").join(d, "dst", "left").fillna(0.0, ["ds", "dd"])


def gcn_norm(edges: DataFrame, side: str = "src", zero_isolated: bool = True) -> DataFrame:
    """w' = deg(src)^-1/2 * w * deg(dst)^-1/2, both degrees being weighted sums by `side`."""
    e = _with_degrees(edges.select("src", "dst", "w"), weighted_degree(edges, side))
    w = power(F.col("ds"), -0.5, zero_isolated) * F.col("w") * power(F.col("dd"), -0.5, zero_isolated)
    return e.select("src", "dst", w.alias("w"))


def side_norm(edges: DataFrame, side: str = "dst") -> DataFrame:
    """w' = w / deg(side): rows (src) or columns (dst) sum to 1."""
    deg = weighted_degree(edges, side).withColumnRenamed("id", side)
    return edges.select("src", "dst", "w").join(deg, side).select("src", "dst", (F.col("w") * power(F.col("deg"), -1.0)).alias("w"))


def a_norm_hat(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """D^-1/2 (A + I) D^-1/2 with D the row sums of A + I; duplicate edges are summed first."""
    with_loops = E.coalesce(E.add_self_loops(edges.select("src", "dst", "w"), nodes))
    return gcn_norm(with_loops, "src")


def gcn_norm_loops(edges: DataFrame, nodes: DataFrame, fill: float = 1.0) -> DataFrame:
    """Symmetric norm by dst degree after every loop is replaced by one of weight `fill`."""
    return gcn_norm(E.add_remaining_self_loops(edges, nodes, fill), "dst")


def diag_norm(edges: DataFrame, nodes: DataFrame, diag: float = 1.0) -> DataFrame:
    """Unit weights off the diagonal, `diag` on it, then the symmetric norm by src degree."""
    unit = E.remove_self_loops(edges).select("src", "dst", F.lit(1.0).alias("w"))
    return gcn_norm(E.add_self_loops(unit, nodes, diag), "src")


def laplacian(edges: DataFrame, nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """L = D - A (None), I - D^-1/2 A D^-1/2 (`sym`) or I - D^-1 A (`rw`): off-diagonal rows, then a row a node.

    Self-loops are left out first, D are the row sums by src; nodes without edges have 0 (None) or 1.
    """
    e = E.remove_self_loops(edges).select("src", "dst", "w")
    deg = weighted_degree(e, "src")
    if kind is None:
        off = e.withColumn("w", -F.col("w"))
        diag = nodes.select("id").join(deg, "id", "left").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.coalesce("deg", F.lit(0.0)).alias("w"))
    else:
        n = _with_degrees(e, deg)
        w = power(F.col("ds"), -0.5) * F.col("w") * power(F.col("dd"), -0.5) if kind == "sym" else power(F.col("ds"), -1.0) * F.col("w")
        off = n.select("src", "dst", (-w).alias("w"))
        diag = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    return off.unionByName(diag)


def scaled_laplacian(edges: DataFrame, nodes: DataFrame, lambda_max: float = 2.0) -> DataFrame:
    """2 L_sym / lambda_max - I, coalesced: the operator of Chebyshev recurrences."""
    lap = laplacian(edges, nodes, "sym").withColumn("w", F.col("w") * (2.0 / lambda_max))
    minus = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(-1.0).alias("w"))
    return E.coalesce(lap.unionByName(minus))


def fuzzy_laplacian(edges: DataFrame, theta: str = "theta") -> DataFrame:
    """Directional weights of an edge with angle theta: (src, dst, w_out, w_in).

    cos^2 of the angle goes out, sin^2 comes in; each is divided by the square roots of the
    out and in sums of its ends.
    """
    o, i = F.pow(F.cos(theta), F.lit(2.0)), F.pow(F.sin(theta), F.lit(2.0))
    e = edges.select("src", "dst", o.alias("o"), i.alias("i"))
    s = e.groupBy("src").agg(F.sum("o").alias("so"), F.sum("i").alias("si"))
    d = e.groupBy("dst").agg(F.sum("o").alias("do"), F.sum("i").alias("di"))
    j = e.join(s, "src").join(d, "dst")
    w_out = F.col("o") * power(F.col("so"), -0.5) * power(F.col("do"), -0.5)
    w_in = F.col("i") * power(F.col("si"), -0.5) * power(F.col("di"), -0.5)
    return j.select("src", "dst", w_out.alias("w_out"), w_in.alias("w_in"))


def scale_by_node(edges: DataFrame, factors: DataFrame, side: str) -> DataFrame:
    """diag(f) A (`src`) or A diag(f) (`dst`) for factors (id, f); nodes without factor scale to 0."""
    f = factors.select(F.col("id").alias(side), "f")
    return edges.join(f, side, "left").select("src", "dst", (F.col("w") * F.coalesce("f", F.lit(0.0))).alias("w"))
