"""Gather - transform - aggregate: sparse products and message passing.

One logical plan: edges join the features of their source and are aggregated by
destination at once, so the partial aggregate sits directly on the join and no edge-sized
table of messages is stored.  The node side is broadcast by the optimiser if it is small;
hubs among the sources are hot keys of an inner join, which the adaptive skew join splits,
and hubs among the destinations are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.core.session import cut
from weftgraph.functions import vec
from weftgraph.operators.product import product

Message = Callable[[Column, Column], Column]


def gspmm(edges: DataFrame, nodes: DataFrame, width: int, how: str = "sum", weighted: bool = True, x: str = "x") -> DataFrame:
    """(id, x): out[dst] = reduce over edges of w * x[src]; zeros for nodes without messages.

    The mean divides by the number of messages, not by the sum of weights.
    """
    e = edges.select("src", "dst", "w") if weighted else edges.select("src", "dst")
    j = e.join(nodes.select(F.col("id").alias("src"), F.col(x).alias("x")), "src")
    m = [F.get("x", F.lit(i)) * F.col("w") if weighted else F.get("x", F.lit(i)) for i in range(width)]
    agg = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how]
    out = j.groupBy(F.col("dst").alias("id")).agg(F.array(*[agg(c) for c in m]).alias("x"))
    return nodes.select("id").join(out, "id", "left").select("id", F.coalesce("x", vec.zeros(width)).alias("x"))


def gspmm_max_arg(edges: DataFrame, nodes: DataFrame, value: str = "value") -> DataFrame:
    """(id, value, arg): the largest w * value[src] and its source (the smallest of equals)."""
    j = edges.select("src", "dst", "w").join(nodes.select(F.col("id").alias("src"), F.col(value).alias("v")), "src")
    m = F.max(F.struct((F.col("w") * F.col("v")).alias("m"), (-F.col("src")).alias("s")))
    return j.groupBy(F.col("dst").alias("id")).agg(m.alias("t")).select("id", F.col("t.m").alias("value"), (-F.col("t.s")).alias("arg"))


def bspmm(edges: DataFrame, features: DataFrame) -> DataFrame:
    """Multi-head sums.  edges (src, dst, head, w), features (id, head, k, value) -> (id, head, k, value)."""
    j = edges.join(features.withColumnRenamed("id", "src"), ["src", "head"])
    return j.groupBy(F.col("dst").alias("id"), "head", "k").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def propagate(
    nodes: DataFrame,
    edges: DataFrame,
    width: int,
    message: Message | None = None,
    aggr: str = "sum",
    update: Callable[[Column], Column] | None = None,
    x: str = "x",
    need_dst: bool = False,
) -> DataFrame:
    """Message passing with user functions on columns: message(x_src, x_dst) -> vector, update(x) -> vector.

    `aggr`: sum, mean, max or min.  An edge column `w` is visible to `message` as F.col("w").
    x_dst is null unless `need_dst`, which costs a second join.
    """
    own = nodes.select("id", F.col(x).alias("__x"))
    j = edges.join(own.select(F.col("id").alias("src"), F.col("__x").alias("__xs")), "src")
    if need_dst:
        j = j.join(own.select(F.col("id").alias("dst"), F.col("__x").alias("__xd")), "dst")
    else:
        j = j.withColumn("__xd", F.lit(None).cast("array<double>"))
    m = (message or (lambda s, d: s))(F.col("__xs"), F.col("__xd"))
    out = j.select(F.col("dst").alias("id"), m.alias("__m")).groupBy("id").agg(vec.reduce_vectors("__m", width, aggr).alias("x"))
    out = own.select("id").join(out, "id", "left").select("id", F.coalesce("x", vec.zeros(width)).alias("x"))
    return out if update is None else out.select("id", update(F.col("x")).alias("x"))


def spmm_scalar(edges: DataFrame, values: DataFrame, value: str = "value") -> DataFrame:
    """(id, value): sum of w * value[src] by dst, 0 for nodes without messages."""
    j = edges.select("src", "dst", "w").join(values.select(F.col("id").alias("src"), F.col(value).alias("v")), "src")
    out = j.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("v")).alias("value"))
    return values.select("id").join(out, "id", "left").fillna(0.0, ["value"])


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int, keep: int = 3) -> DataFrame:
    """`rounds` applications of a step; lineage is cut every `keep` rounds."""
    for i in range(rounds):
        state = step(state, i)
        if (i + 1) % keep == 0 and i + 1 < rounds:
            state = cut(state)
    return state


def axpy(a: DataFrame, b: DataFrame, fa: float, fb: float) -> DataFrame:
    """(id, x) = fa * a + fb * b for two vector tables with the same ids."""
    j = a.select("id", F.col("x").alias("xa")).join(b.select("id", F.col("x").alias("xb")), "id")
    return j.select("id", F.zip_with("xa", "xb", lambda p, q: p * F.lit(fa) + q * F.lit(fb)).alias("x"))


def power_filter(edges: DataFrame, nodes: DataFrame, width: int, rounds: int, keep_old: float, mix_new: float) -> DataFrame:
    """x <- mix_new * A x + keep_old * x0, `rounds` times (personalised propagation)."""
    return iterate(nodes.select("id", "x"), lambda x, _: axpy(gspmm(edges, x, width), nodes, mix_new, keep_old), rounds)


def _filtered(edges: DataFrame, start: DataFrame, width: int, rounds: int, alpha: float, gain: float) -> DataFrame:
    """p <- gain * A p + alpha * start, from p = start."""
    start = cut(start)
    step = lambda p, _: axpy(gspmm(edges, p, width), start, gain, alpha)
    return iterate(start, step, rounds)


def low_pass(edges: DataFrame, nodes: DataFrame, width: int, rounds: int, alpha: float, mu: float) -> DataFrame:
    """Low-frequency filter by power iteration (instead of the inverse of a dense matrix)."""
    c = 1 + alpha * mu - alpha
    start = axpy(gspmm(edges, nodes, width), nodes, (1 - mu) / c, mu / c)
    return _filtered(edges, start, width, rounds, alpha, (1 - 2 * alpha + mu * alpha) / c)


def high_pass(edges: DataFrame, nodes: DataFrame, width: int, rounds: int, alpha: float, beta: float) -> DataFrame:
    """High-frequency filter by power iteration."""
    c = alpha * beta + 1
    start = axpy(gspmm(edges, nodes, width), nodes, -beta / c, (1 + beta) / c)
    return _filtered(edges, start, width, rounds, alpha, (alpha * beta + 1 - alpha) / c)


def pagerank_diffusion(edges: DataFrame, seeds: DataFrame, alpha: float, rounds: int) -> DataFrame:
    """(source, id, value): sum over k <= rounds of alpha (1 - alpha)^k A^k, from the rows of `seeds` (id).

    Truncated power series of the personalised-PageRank matrix; the rest is at most
    (1 - alpha)^(rounds + 1).
    """
    cur = seeds.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("value"))
    out = cur.withColumn("value", F.col("value") * alpha)
    for k in range(1, rounds + 1):
        cur = (
            cur.join(edges.select(F.col("src").alias("id"), F.col("dst").alias("to"), "w"), "id")
            .groupBy("source", F.col("to").alias("id")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))
        )
        if k % 2 == 0:
            cur = cut(cur)
        out = out.unionByName(cur.withColumn("value", F.col("value") * (alpha * (1 - alpha) ** k)))
    return out.groupBy("source", "id").agg(F.sum("value").alias("value"))


def spectral_energy(laplacian: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: sum(X' L X) / sum(X' X)."""
    xs = nodes.select(F.col("id").alias("src"), F.col("x").alias("xs"))
    xd = nodes.select(F.col("id").alias("dst"), F.col("x").alias("xd"))
    top = laplacian.join(xs, "src").join(xd, "dst").agg(F.sum(F.col("w") * vec.dot(F.col("xs"), F.col("xd"))).alias("a"))
    low = nodes.agg(F.sum(vec.dot(F.col("x"), F.col("x"))).alias("b"))
    return top.crossJoin(low).select((F.col("a") / F.nullif(F.col("b"), F.lit(0.0))).alias("value"))  # one row each


def gaussian_gradient(edges: DataFrame, nodes: DataFrame, width: int, sigma: float = 1.0) -> DataFrame:
    """(id, x): sum over in-edges of exp(-|xi - xj|^2 / (2 sigma^2)) (xj - xi)."""

    def message(xs: Column, xd: Column) -> Column:
        diff = vec.sub(xs, xd)
        return vec.scale(diff, F.exp(-vec.dot(diff, diff) / F.lit(2 * sigma * sigma)))

    return propagate(nodes, edges, width, message, need_dst=True)


def transition(chain: list[DataFrame]) -> DataFrame:
    """Row-normalised transition probabilities along a chain of edge tables: (src, dst, p)."""
    out = None
    for e in chain:
        n = e.groupBy("src").agg(F.sum("w").alias("s"))
        p = cut(e.join(n, "src").select("src", "dst", (F.col("w") / F.col("s")).alias("p")).groupBy("src", "dst").agg(F.sum("p").alias("p")))
        out = p if out is None else product(cut(out) if len(chain) > 2 else out, p)
    return out
