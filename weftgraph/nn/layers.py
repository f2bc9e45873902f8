"""Forward passes of graph convolutions with supplied weights.

Nodes are (id, x ARRAY<DOUBLE>), edges (src, dst[, w]); weights are nested lists (in x out).
Dense maps are literal dot products in the JVM; what differs between layers is the message.
A linear map is applied before propagation wherever it commutes with a linear aggregate,
so the narrower side is shuffled.  Training is no part of this engine.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.core.session import cut
from weftgraph.functions import vec
from weftgraph.operators import norm as N
from weftgraph.operators import spmm as S
from weftgraph.operators.edges import add_self_loops
from weftgraph.operators.segment import degree

Matrix = Sequence[Sequence[float]]
Act = Callable[[Column], Column]


LITERALS = 256  # weights up to which a map is written out as JVM expressions


def _product(weight: np.ndarray, bias: np.ndarray):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, out = weight.shape
        for part in parts:
            good = part.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == wide
            x = part.column(1).filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)
            ends = np.concatenate([[0], np.cumsum(good * out)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((x @ weight + bias).ravel()), mask=pa.array(~good))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["id", "x"])

    return run


def dense(nodes: DataFrame, weight: Matrix, bias: Sequence[float] | None = None, act: Act | None = None) -> DataFrame:
    """(id, x): x @ weight + bias, through `act` component by component.

    A small map is JVM expressions; a large one is a matrix product of whole Arrow batches (a vector
    that is null or of another length gives null).
    """
    if len(weight) * len(weight[0]) > LITERALS:
        w = np.array(weight, float)
        b = np.zeros(w.shape[1]) if bias is None else np.array(bias, float)
        kind = dict(nodes.dtypes)["id"]
        y = nodes.select("id", F.col("x").cast("array<double>").alias("x")).mapInArrow(_product(w, b), f"id {kind}, x array<double>")
        return _act(y, act)
    y = vec.linear(F.col("x"), weight, bias)
    return nodes.select("id", (y if act is None else F.transform(y, act)).alias("x"))


def _width(weight: Matrix) -> int:
    return len(weight[0])


def _plus(nodes: DataFrame, bias: Sequence[float] | None) -> DataFrame:
    return nodes if bias is None else nodes.select("id", vec.add(F.col("x"), vec.vector(bias)).alias("x"))


def _act(nodes: DataFrame, act: Act | None) -> DataFrame:
    return nodes if act is None else nodes.select("id", F.transform("x", act).alias("x"))


def _ends(edges: DataFrame, nodes: DataFrame, *extra: str) -> DataFrame:
    """Edges with the vectors of both ends, xs and xd."""
    s, d = nodes.select(F.col("id").alias("src"), F.col("x").alias("xs")), nodes.select(F.col("id").alias("dst"), F.col("x").alias("xd"))
    return edges.select("src", "dst", *extra).join(s, "src").join(d, "dst")


def edge_softmax(scored: DataFrame, scores: list[str], eps: float = 1e-16, by: tuple[str, ...] = ("dst",)) -> DataFrame:
    """Each score column becomes its softmax within dst; two mergeable aggregates for all heads together."""
    keys = list(by)
    top = scored.groupBy(*keys).agg(*[F.max(c).alias(f"__m_{c}") for c in scores])
    e = scored.join(top, keys).withColumns({c: F.exp(F.col(c) - F.col(f"__m_{c}")) for c in scores}).drop(*[f"__m_{c}" for c in scores])
    s = e.groupBy(*keys).agg(*[F.sum(c).alias(f"__s_{c}") for c in scores])
    e = e.join(s, keys).withColumns({c: F.col(c) / (F.col(f"__s_{c}") + F.lit(eps)) for c in scores})
    return e.drop(*[f"__s_{c}" for c in scores])


def _gather(messages: DataFrame, nodes: DataFrame, width: int, how: str = "sum") -> DataFrame:
    """(dst, m) -> (id, x), zeros for nodes without messages."""
    out = messages.groupBy(F.col("dst").alias("id")).agg(vec.reduce_vectors("m", width, how).alias("x"))
    return nodes.select("id").join(out, "id", "left").select("id", F.coalesce("x", vec.zeros(width)).alias("x"))


def _head(x: Column, h: int, width: int) -> Column:
    return F.slice(x, h * width + 1, width)


def _attended(alpha: DataFrame, nodes: DataFrame, heads: int, width: int, concat: bool, value: str = "xs") -> DataFrame:
    """Sum of a_h * value_h over in-edges, heads concatenated or averaged."""
    parts = [vec.scale(_head(F.col(value), h, width), F.col(f"a{h}")) for h in range(heads)]
    out = _gather(alpha.select("dst", F.concat(*parts).alias("m")), nodes, heads * width)
    if concat:
        return out
    mean = F.array(*[sum((F.get("x", F.lit(h * width + i)) for h in range(heads)), F.lit(0.0)) / heads for i in range(width)])
    return out.select("id", mean.alias("x"))


def gcn(nodes: DataFrame, edges: DataFrame, weight: Matrix, bias=None, norm: str = "both") -> DataFrame:
    """norm: both, left (by out-degree of src), right (by in-degree of dst) or none; degrees count rows."""
    e = edges.select("src", "dst", "w")
    p = -0.5 if norm == "both" else -1.0
    if norm in ("left", "both"):
        d = degree(e, "src").select(F.col("id").alias("src"), "deg")
        e = e.join(d, "src").select("src", "dst", (F.col("w") * N.power(F.col("deg"), p)).alias("w"))
    if norm in ("right", "both"):
        d = degree(e, "dst").select(F.col("id").alias("dst"), "deg")
        e = e.join(d, "dst").select("src", "dst", (F.col("w") * N.power(F.col("deg"), p)).alias("w"))
    return _plus(S.gspmm(e, dense(nodes, weight), _width(weight)), bias)


def gat(nodes, edges, weight: Matrix, att: Matrix, heads: int = 1, concat: bool = True, slope: float = 0.2, bias=None) -> DataFrame:
    """att: a row a head, of 2 x out numbers (source part, then destination part)."""
    width = _width(weight) // heads
    j = _ends(edges, dense(nodes, weight))
    score = lambda h: vec.leaky_relu(
        vec.dot(_head(F.col("xs"), h, width), vec.vector(att[h][:width])) + vec.dot(_head(F.col("xd"), h, width), vec.vector(att[h][width:])), slope
    )
    j = j.select("dst", "xs", *[score(h).alias(f"a{h}") for h in range(heads)])
    return _plus(_attended(edge_softmax(j, [f"a{h}" for h in range(heads)]), nodes, heads, width, concat), bias)


def gatv2(nodes, edges, weight: Matrix, att_src: Matrix, att_dst: Matrix, heads: int = 1, concat: bool = True, slope: float = 0.2, bias=None) -> DataFrame:
    """Scores are means over channels of LeakyReLU(x) times the attention of each end."""
    width = _width(weight) // heads
    relu = lambda x: F.transform(x, lambda v: vec.leaky_relu(v, slope))
    j = _ends(edges, dense(nodes, weight))
    score = lambda h: (
        vec.dot(relu(_head(F.col("xs"), h, width)), vec.vector(att_src[h])) + vec.dot(relu(_head(F.col("xd"), h, width)), vec.vector(att_dst[h]))
    ) / width
    j = j.select("dst", "xs", *[score(h).alias(f"a{h}") for h in range(heads)])
    return _plus(_attended(edge_softmax(j, [f"a{h}" for h in range(heads)]), nodes, heads, width, concat), bias)


def hard_gat(nodes, edges, proj: Sequence[float], k: int, weight: Matrix, att_src, att_dst, slope: float = 0.2) -> DataFrame:
    """Only the k in-edges of highest |p.x| / |p| (ties by src) attend; features are gated by its sigmoid."""
    size = math.sqrt(sum(v * v for v in proj))
    y = F.abs(vec.dot(F.col("x"), vec.vector(proj))) / F.lit(size)
    scored = nodes.select("id", y.alias("y"), "x")
    j = edges.select("src", "dst").join(scored.select(F.col("id").alias("src"), "y"), "src")
    r = F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("y"), "src"))
    kept = j.withColumn("r", r).filter(F.col("r") <= k).select("src", "dst")
    gated = scored.select("id", vec.scale(F.col("x"), vec.sigmoid(F.col("y"))).alias("x"))
    return gat(gated, kept, weight, [list(att_src) + list(att_dst)], slope=slope)


def gaan(nodes, edges, lin: Matrix, m_lin: Matrix, att_src: Matrix, att_dst: Matrix, g_lin: Matrix, out_lin: Matrix, heads: int, slope: float = 0.1) -> DataFrame:
    """Attention whose heads are gated by the node, the max of its neighbours and their mean: one aggregate for all three."""
    v, m = _width(lin) // heads, _width(m_lin)
    relu = lambda x: vec.leaky_relu(x, slope)
    own = nodes.select("id", "x", F.transform(vec.linear(F.col("x"), lin), relu).alias("l"), vec.linear(F.col("x"), m_lin).alias("mx"))
    s = own.select(F.col("id").alias("src"), F.col("l").alias("ls"), F.col("mx").alias("ms"))
    d = own.select(F.col("id").alias("dst"), F.col("l").alias("ld"))
    j = edges.select("src", "dst").join(s, "src").join(d, "dst")
    score = lambda h: relu(vec.dot(_head(F.col("ls"), h, v), vec.vector(att_src[h])) + vec.dot(_head(F.col("ld"), h, v), vec.vector(att_dst[h])))
    j = edge_softmax(j.select("dst", "ls", "ms", *[score(h).alias(f"a{h}") for h in range(heads)]), [f"a{h}" for h in range(heads)])
    mixed = F.concat(*[vec.scale(_head(F.col("ls"), h, v), F.col(f"a{h}")) for h in range(heads)])
    agg = j.withColumn("at", mixed).groupBy(F.col("dst").alias("id")).agg(
        vec.reduce_vectors("at", v * heads, "sum").alias("at"), vec.reduce_vectors("ms", m, "max").alias("g1"), vec.reduce_vectors("ls", v * heads, "mean").alias("g2")
    )
    t = own.select("id", "x").join(agg, "id", "left").select(
        "id", "x", *[F.coalesce(c, vec.zeros(w)).alias(c) for c, w in (("at", v * heads), ("g1", m), ("g2", v * heads))]
    )
    gate = F.transform(vec.linear(F.concat("x", "g1", "g2"), g_lin), vec.sigmoid)
    t = t.withColumn("g", gate)
    gated = F.concat(*[vec.scale(_head(F.col("at"), h, v), F.get("g", F.lit(h))) for h in range(heads)])
    return t.select("id", vec.linear(F.concat("x", gated), out_lin).alias("x"))


def agnn(nodes, edges, beta: float, width: int) -> DataFrame:
    """Softmax of beta * cosine; a zero vector has cosine 0."""
    j = _ends(edges, nodes)
    cos = F.coalesce(vec.cosine(F.col("xs"), F.col("xd")), F.lit(0.0))
    return _attended(edge_softmax(j.select("dst", "xs", (cos * F.lit(beta)).alias("a0")), ["a0"]), nodes, 1, width, True)


def sage(nodes, edges, neigh: Matrix, own: Matrix | None = None, aggr: str = "mean", pool: Matrix | None = None, bias=None, dst_nodes: DataFrame | None = None) -> DataFrame:
    """aggr: mean, gcn (normalised sum with loops, no own part) or pool (max of ReLU(pool x)).

    `dst_nodes`: the destination side of a bipartite graph.
    """
    target, width = dst_nodes if dst_nodes is not None else nodes, _width(neigh)
    if aggr == "gcn":
        e = N.gcn_norm(add_self_loops(edges.select("src", "dst", F.lit(1.0).alias("w")), nodes), "src")
        return _plus(S.gspmm(e, dense(nodes, neigh), width), bias)
    if aggr == "mean":
        m = dense(nodes, neigh).select(F.col("id").alias("src"), F.col("x").alias("m"))
        got = _gather(edges.select("src", "dst").join(m, "src"), target, width, "mean")
    else:
        m = dense(nodes, pool, None, vec.relu).select(F.col("id").alias("src"), F.col("x").alias("m"))
        got = dense(_gather(edges.select("src", "dst").join(m, "src"), target, _width(pool), "max"), neigh)
    return _plus(S.axpy(got, dense(target, own), 1.0, 1.0), bias)


def gin(nodes, edges, width: int, eps: float = 0.0, mlp: Sequence[Matrix] = ()) -> DataFrame:
    """(1 + eps) x + sum of neighbours, through a perceptron with ReLU between its maps."""
    out = S.axpy(S.gspmm(edges, nodes, width, weighted=False), nodes, 1.0, 1 + eps)
    for i, w in enumerate(mlp):
        out = dense(out, w, None, vec.relu if i + 1 < len(mlp) else None)
    return out


def sgc(nodes, edges, weight: Matrix, k: int) -> DataFrame:
    return S.iterate(dense(nodes, weight), lambda x, _: S.gspmm(edges, x, _width(weight)), k)


def appnp(nodes, edges, weight: Matrix, k: int, alpha: float) -> DataFrame:
    h = cut(dense(nodes, weight))
    return S.power_filter(edges, h, _width(weight), k, alpha, 1 - alpha)


def cheb(nodes, edges, weights: Sequence[Matrix], width: int, lambda_max: float = 2.0) -> DataFrame:
    """Chebyshev recurrence on the scaled Laplacian; `width` is that of x."""
    lap = cut(N.scaled_laplacian(edges, nodes, lambda_max))
    t0, t1 = nodes.select("id", "x"), None
    out = dense(t0, weights[0])
    for i, w in enumerate(weights[1:]):
        if i == 0:
            t1 = cut(S.gspmm(lap, t0, width))
        else:
            t0, t1 = t1, cut(S.axpy(S.gspmm(lap, t1, width), t0, 2.0, -1.0))
        out = S.axpy(out, dense(t1, w), 1.0, 1.0)
    return out


def gcnii(nodes, start, edges, weight: Matrix, alpha: float, beta: float, weight0: Matrix | None = None) -> DataFrame:
    """Initial residual and identity map; with `weight0` its variant form."""
    width = _width(weight)
    x = S.gspmm(edges, nodes, width)
    if weight0 is None:
        x = S.axpy(x, start, 1 - alpha, alpha)
        return S.axpy(x, dense(x, weight), 1 - beta, beta)
    x = x.select("id", vec.scale(F.col("x"), 1 - alpha).alias("x"))
    x0 = start.select("id", vec.scale(F.col("x"), alpha).alias("x"))
    return S.axpy(S.axpy(x, dense(x, weight), 1 - beta, beta), S.axpy(x0, dense(x0, weight0), 1 - beta, beta), 1.0, 1.0)


def gpr(nodes, edges, gamma: Sequence[float], width: int) -> DataFrame:
    """Sum over k of gamma_k A^k x."""
    cur, out = nodes.select("id", "x"), nodes.select("id", vec.scale(F.col("x"), gamma[0]).alias("x"))
    for i, g in enumerate(gamma[1:]):
        cur = S.gspmm(edges, cur, width)
        if i % 2:
            cur = cut(cur)
        out = S.axpy(out, cur, 1.0, g)
    return out


def gpr_weights(k: int, alpha: float, init: str = "PPR") -> list[float]:
    """Initial coefficients: SGC (one at k = alpha), PPR, or NPPR (normalised powers)."""
    if init == "SGC":
        return [1.0 if i == int(alpha) else 0.0 for i in range(k + 1)]
    if init == "PPR":
        return [alpha * (1 - alpha) ** i for i in range(k)] + [(1 - alpha) ** k]
    raw = [alpha**i for i in range(k + 1)]
    return [r / sum(map(abs, raw)) for r in raw]


def mixhop(nodes, edges, weights: dict[int, Matrix], width: int) -> DataFrame:
    """Powers of A normalised by the DST degree on both ends, each through its map, concatenated."""
    d = degree(edges, "dst")
    e = edges.select("src", "dst", "w").join(d.select(F.col("id").alias("src"), F.col("deg").alias("a")), "src", "left").join(
        d.select(F.col("id").alias("dst"), F.col("deg").alias("b")), "dst"
    )
    w = F.col("w") * N.power(F.coalesce("a", F.lit(0)), -0.5) * N.power(F.col("b"), -0.5)
    e = cut(e.select("src", "dst", w.alias("w")))
    cur, out = nodes.select("id", "x"), None
    for j in range(max(weights) + 1):
        if j in weights:
            part = dense(cur, weights[j])
            out = part if out is None else out.join(part.withColumnRenamed("x", "y"), "id").select("id", F.concat("x", "y").alias("x"))
        if j < max(weights):
            cur = S.gspmm(e, cur, width)
    return out


def fagcn(nodes, edges, att_src, att_dst, width: int) -> DataFrame:
    """tanh(a.x_src + b.x_dst) * w weighs each message."""
    j = _ends(edges, nodes, "w")
    gate = F.tanh(vec.dot(F.col("xs"), vec.vector(att_src)) + vec.dot(F.col("xd"), vec.vector(att_dst))) * F.col("w")
    return _gather(j.select("dst", vec.scale(F.col("xs"), gate).alias("m")), nodes, width)


def film(nodes, edges, skip_lin: Matrix, skip_film: Matrix, lin: Matrix, film_: Matrix, act: Act | None = vec.relu, fixed_orientation: bool = False) -> DataFrame:
    """act(gamma x + beta), own and per edge.  Features are gathered at dst and gamma, beta at src; fixed_orientation swaps them."""
    out = _width(lin)
    f = lambda c: c if act is None else F.transform(c, act)
    b, g = vec.linear(F.col("x"), skip_film), vec.linear(F.col("x"), lin)
    own = nodes.select("id", "x", b.alias("f"), vec.linear(F.col("x"), skip_lin).alias("s"))
    own = own.select("id", f(vec.add(vec.mul(F.slice("f", out + 1, out), F.col("s")), F.slice("f", 1, out))).alias("x"))
    h = nodes.select("id", F.struct(g.alias("l"), vec.linear(F.col("x"), film_).alias("f")).alias("x"))
    j = _ends(edges, h)
    feat, mod = ("xs", "xd") if fixed_orientation else ("xd", "xs")
    m = f(vec.add(vec.mul(F.slice(F.col(f"{mod}.f"), out + 1, out), F.col(f"{feat}.l")), F.slice(F.col(f"{mod}.f"), 1, out)))
    return S.axpy(own, _gather(j.select("dst", m.alias("m")), nodes, out), 1.0, 1.0)


def edge_conv(nodes, edges, mlp: Matrix, act: Act | None = vec.relu) -> DataFrame:
    """Max over in-edges of act([x_i, x_j - x_i] @ mlp), i the destination."""
    j = _ends(edges, nodes)
    m = vec.linear(F.concat("xd", vec.sub(F.col("xs"), F.col("xd"))), mlp)
    return _gather(j.select("dst", (m if act is None else F.transform(m, act)).alias("m")), nodes, _width(mlp), "max")


def pna(nodes, edges, pre: Matrix, post: Matrix, aggregators: Sequence[str], scalers: Sequence[str], avg: dict[str, float], independent_scalers: bool = False) -> DataFrame:
    """Several aggregates of pre([x_i, x_j]) in one group-by, each scaled by degree; scalers compound unless independent."""
    width = _width(pre)
    j = _ends(edges, nodes)
    m = j.select("dst", vec.linear(F.concat("xd", "xs"), pre).alias("m"))
    c = [F.get("m", F.lit(i)) for i in range(width)]
    build = {
        "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max,
        "var": lambda v: F.avg(v * v) - F.avg(v) * F.avg(v),
        "std": lambda v: F.sqrt(F.greatest(F.avg(v * v) - F.avg(v) * F.avg(v), F.lit(0.0)) + F.lit(1e-5)),
    }
    agg = m.groupBy(F.col("dst").alias("id")).agg(F.array(*[build[a](v) for a in aggregators for v in c]).alias("o"), F.count(F.lit(1)).alias("deg"))
    empty = [math.sqrt(1e-5) if a == "std" else 0.0 for a in aggregators for _ in range(width)]
    t = nodes.join(agg, "id", "left").select("id", "x", F.coalesce("o", vec.vector(empty)).alias("o"), F.greatest(F.coalesce("deg", F.lit(1)), F.lit(1)).alias("deg"))
    log = F.log(F.col("deg") + 1)
    factor = {
        "identity": F.lit(1.0), "amplification": log / avg["log"], "attenuation": F.lit(avg["log"]) / log,
        "linear": F.col("deg") / avg["lin"], "inverse_linear": F.lit(avg["lin"]) / F.col("deg"),
    }
    outs, f = [], F.lit(1.0)
    for s in scalers:
        f = factor[s] if independent_scalers else f * factor[s]
        outs.append(vec.scale(F.col("o"), f))
    return t.select("id", vec.linear(F.concat("x", *outs), post).alias("x"))


def rgcn(nodes, edges, weights: dict[str, Matrix], root: Matrix | None = None, bias=None, rel: str = "edge_type") -> DataFrame:
    """Sum over relations of (sum of neighbours) W_r (+ x root): one group-by of (dst, relation) for all relations."""
    width_in, width = len(next(iter(weights.values()))), _width(next(iter(weights.values())))
    j = edges.select("src", "dst", F.col(rel).alias("r")).filter(F.col("r").isin(list(weights))).join(nodes.select(F.col("id").alias("src"), "x"), "src")
    h = j.groupBy("dst", "r").agg(vec.reduce_vectors("x", width_in, "sum").alias("x"))
    m = None
    for name, w in weights.items():
        m = F.when(F.col("r") == name, vec.linear(F.col("x"), w)) if m is None else m.when(F.col("r") == name, vec.linear(F.col("x"), w))
    out = _gather(h.select("dst", m.alias("m")), nodes, width)
    if root is not None:
        out = S.axpy(out, dense(nodes, root), 1.0, 1.0)
    return _plus(out, bias)


def basis_weights(bases: Sequence[Matrix], att: Matrix) -> list[list[list[float]]]:
    """W_r = sum over b of att[r][b] * bases[b]."""
    return [[[sum(a[b] * bases[b][i][j] for b in range(len(bases))) for j in range(len(bases[0][0]))] for i in range(len(bases[0]))] for a in att]


def compgcn(nodes, edges_in, edges_out, rel_emb: dict[str, Sequence[float]], loop_emb, w_in: Matrix, w_out: Matrix, w_loop: Matrix, op: str = "sub", fixed_orientation: bool = False) -> DataFrame:
    """Mean of in, out and loop parts; a message composes a node and its relation (`sub` or `mult`).  Features are gathered at dst unless fixed_orientation."""
    width = _width(w_in)
    combine = vec.sub if op == "sub" else vec.mul
    emb = None
    for name, v in rel_emb.items():
        emb = F.when(F.col("edge_type") == name, vec.vector(v)) if emb is None else emb.when(F.col("edge_type") == name, vec.vector(v))

    def part(edges: DataFrame, w: Matrix) -> DataFrame:
        at = "src" if fixed_orientation else "dst"
        j = edges.select("src", "dst", "edge_type").filter(F.col("edge_type").isin(list(rel_emb))).join(nodes.select(F.col("id").alias(at), "x"), at)
        # The map is linear: messages are summed first, then mapped once a node.
        summed = _gather(j.select("dst", combine(F.col("x"), emb).alias("m")), nodes, len(w))
        return dense(summed, w)

    loop = nodes.select("id", vec.linear(combine(F.col("x"), vec.vector(loop_emb)), w_loop).alias("x"))
    both = S.axpy(part(edges_in, w_in), part(edges_out, w_out), 1.0, 1.0)
    return S.axpy(both, loop, 1 / 3, 1 / 3)


def semantic_attention(parts: dict[str, DataFrame], proj: Matrix, bias, query: Sequence[float]) -> DataFrame:
    """Parts (id, x) of several metapaths, weighed by the softmax of the mean over nodes of query . tanh(x proj + bias)."""
    both = None
    for name, p in parts.items():
        t = p.select(F.lit(name).alias("path"), "id", "x")
        both = t if both is None else both.unionByName(t)
    both = cut(both)
    score = vec.dot(F.transform(vec.linear(F.col("x"), proj, bias), F.tanh), vec.vector(query))
    w = both.groupBy("path").agg(F.avg(score).alias("w"))  # one row a metapath
    total = w.withColumn("e", F.exp(F.col("w") - F.max("w").over(Window.partitionBy())))
    beta = total.withColumn("beta", F.col("e") / F.sum("e").over(Window.partitionBy())).select("path", "beta")
    j = both.join(F.broadcast(beta), "path")
    width = len(proj)
    return j.select("id", vec.scale(F.col("x"), F.col("beta")).alias("x")).groupBy("id").agg(vec.reduce_vectors("x", width, "sum").alias("x"))


def han(nodes, paths: dict[str, DataFrame], weight: dict[str, Matrix], att: dict[str, Matrix], proj: Matrix, bias, query) -> DataFrame:
    """GAT along each metapath, then semantic attention."""
    return semantic_attention({p: gat(nodes, e, weight[p], att[p]) for p, e in paths.items()}, proj, bias, query)


def hpn(nodes, paths: dict[str, DataFrame], weight: dict[str, Matrix], k: int, alpha: float, proj: Matrix, bias, query) -> DataFrame:
    """APPNP along each metapath, then semantic attention."""
    return semantic_attention({p: appnp(nodes, e, weight[p], k, alpha) for p, e in paths.items()}, proj, bias, query)


def hgt(nodes, edges, k_lin: Matrix, q_lin: Matrix, v_lin: Matrix, a_rel: dict[str, Matrix], m_rel: dict[str, Matrix], p_rel: dict[str, float], a_lin: Matrix, skip: float) -> DataFrame:
    """Typed attention of one head: softmax within (dst, relation) of (k A_r . q) p_r / sqrt(d), values v M_r, summed over relations, gated skip."""
    width = _width(v_lin)
    own = nodes.select("id", *[vec.linear(F.col("x"), m).alias(n) for n, m in (("k", k_lin), ("q", q_lin), ("v", v_lin))])
    s = own.select(F.col("id").alias("src"), "k", "v")
    j = edges.select("src", "dst", "edge_type").filter(F.col("edge_type").isin(list(a_rel))).join(s, "src").join(own.select(F.col("id").alias("dst"), "q"), "dst")
    score, value = None, None
    for r in a_rel:
        sc = vec.dot(vec.linear(F.col("k"), a_rel[r]), F.col("q")) * F.lit(p_rel[r] / math.sqrt(width))
        va = vec.linear(F.col("v"), m_rel[r])
        hit = F.col("edge_type") == r
        score, value = (F.when(hit, sc), F.when(hit, va)) if score is None else (score.when(hit, sc), value.when(hit, va))
    j = edge_softmax(j.select("dst", "edge_type", score.alias("a0"), value.alias("v")), ["a0"], by=("dst", "edge_type"))
    out = dense(_attended(j, nodes, 1, width, True, "v"), a_lin)
    alpha = 1 / (1 + math.exp(-skip))
    return S.axpy(out, nodes, alpha, 1 - alpha)


def simple_hgn(nodes, edges, weight: Matrix, att_src, att_dst, edge_score: dict[str, float], slope: float = 0.2, res: DataFrame | None = None, beta: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Attention with a term a relation; ((id, x), (src, dst, edge_type, alpha)).  `res` (src, dst, edge_type, alpha) is mixed in by beta."""
    width = _width(weight)
    term = None
    for r, v in edge_score.items():
        term = F.when(F.col("edge_type") == r, v) if term is None else term.when(F.col("edge_type") == r, v)
    j = _ends(edges.filter(F.col("edge_type").isin(list(edge_score))), dense(nodes, weight), "edge_type")
    score = vec.leaky_relu(vec.dot(F.col("xs"), vec.vector(att_src)) + vec.dot(F.col("xd"), vec.vector(att_dst)) + term, slope)
    j = edge_softmax(j.withColumn("a0", score).drop("xd"), ["a0"])
    if res is not None:
        j = j.join(res, ["src", "dst", "edge_type"]).withColumn("a0", F.col("a0") * (1 - beta) + F.col("alpha") * beta).drop("alpha")
    return _attended(j, nodes, 1, width, True), j.select("src", "dst", "edge_type", F.col("a0").alias("alpha"))


def iehgcn(nodes, relations: dict[str, DataFrame], w_self: Matrix, w_rel: dict[str, Matrix], q: Matrix, k: Matrix, al: Sequence[float], ar: Sequence[float]) -> DataFrame:
    """Self and relation parts weighed per node by the softmax of ELU(al . (part k) + ar . (self q))."""
    own = dense(nodes, w_self)
    hr = own.select("id", vec.dot(vec.linear(F.col("x"), q), vec.vector(ar)).alias("hr"))
    parts = own.select("id", "x", F.lit("").alias("part"))
    for r, e in relations.items():
        parts = parts.unionByName(gcn(nodes, e, w_rel[r]).withColumn("part", F.lit(r)))
    parts = cut(parts.join(hr, "id").withColumn("e", vec.elu(vec.dot(vec.linear(F.col("x"), k), vec.vector(al)) + F.col("hr"))))
    j = edge_softmax(parts.withColumnRenamed("id", "dst").select("dst", "x", F.col("e").alias("a0")), ["a0"], eps=0.0)
    return _attended(j, nodes, 1, _width(w_self), True, "x")


def rohe_gat(nodes, edges, weight: Matrix, top: int, slope: float = 0.2) -> DataFrame:
    """Attention purification: scores LeakyReLU(x_src . x_dst) * w, only the `top` of each dst (ties by src) keep weight."""
    j = _ends(edges, dense(nodes, weight), "w")
    j = j.select("src", "dst", "xs", (vec.leaky_relu(vec.dot(F.col("xs"), F.col("xd")), slope) * F.col("w")).alias("a0"))
    r = F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("a0"), "src"))
    j = j.withColumn("r", r).filter(F.col("r") <= top).drop("r", "src")
    return _attended(edge_softmax(j, ["a0"]), nodes, 1, _width(weight), True)


def hypergraph(nodes, members: DataFrame, weight: Matrix, bias=None) -> DataFrame:
    """Two stages over (id, edge_id): nodes sum into hyperedges, hyperedges back into nodes."""
    width = _width(weight)
    h = members.join(dense(nodes, weight), "id").groupBy("edge_id").agg(vec.reduce_vectors("x", width, "sum").alias("m"))
    back = members.join(h, "edge_id").select(F.col("id").alias("dst"), "m")
    return _plus(_gather(back, nodes, width), bias)


def heat(nodes, edges, emb: Matrix, att: Sequence[float], upd: Matrix, attrs: list[str], n_attr: int, slope: float = 0.2) -> DataFrame:
    """Edge-feature attention in its sparse form: softmax over out-edges of a source, values from [edge attrs, neighbour].

    `attrs`: numeric edge columns, the first n_attr of them are also part of the values.
    """
    f = F.array(*[F.col(a).cast("double") for a in attrs])
    j = _ends(edges.select("src", "dst", f.alias("f")), dense(nodes, emb), "f")
    score = vec.leaky_relu(vec.dot(F.concat("xs", "xd", "f"), vec.vector(att)), slope)
    value = F.transform(vec.linear(F.concat(F.slice("f", 1, n_attr), F.col("xd")), upd), lambda v: vec.leaky_relu(v, slope))
    j = edge_softmax(j.select(F.col("src").alias("dst"), score.alias("a0"), value.alias("v")), ["a0"], eps=0.0)
    return _attended(j, nodes, 1, _width(upd), True, "v")


def gmm(nodes, edges, weight: Matrix, mu: Matrix, sigma: Matrix, pseudo: list[str]) -> DataFrame:
    """Gaussian kernels over pseudo-coordinates (edge columns) weigh the kernels' maps, which are summed."""
    kernels = len(mu)
    width = _width(weight) // kernels
    p = [F.tanh(F.col(c).cast("double")) for c in pseudo]
    g = [F.exp(sum((F.lit(-0.5) * F.pow(v - F.lit(m), F.lit(2.0)) * F.lit(s * s) for v, m, s in zip(p, mu[k], sigma[k])), F.lit(0.0))) for k in range(kernels)]
    j = edges.select("src", "dst", F.array(*g).alias("g")).join(dense(nodes, weight).select(F.col("id").alias("src"), "x"), "src")
    m = F.array(*[sum((F.get("x", F.lit(k * width + i)) * F.get("g", F.lit(k)) for k in range(kernels)), F.lit(0.0)) for i in range(width)])
    return _gather(j.select("dst", m.alias("m")), nodes, width)


def fixed_point(step: Callable[[DataFrame], DataFrame], start: DataFrame, threshold: float, most: int) -> tuple[DataFrame, float]:
    """Iterate until the Frobenius norm of the change is below the threshold (one number a round reaches the driver)."""
    z, diff = cut(start), math.inf
    for _ in range(most):
        new = cut(step(z))
        j = new.join(z.withColumnRenamed("x", "o"), "id")
        d = vec.sub(F.col("x"), F.col("o"))
        diff = math.sqrt(j.agg(F.sum(vec.dot(d, d))).first()[0] or 0.0)
        z = new
        if diff < threshold:
            break
    return z, diff


def mgnni(nodes, edges, factor: Matrix, gamma: float, m: int, threshold: float, most: int) -> DataFrame:
    """Implicit layer Z = gamma A^m Z g(F) + X, g(F) = F'F / (|F'F| + 1e-12)."""
    n = len(factor[0])
    ff = [[sum(factor[r][i] * factor[r][j] for r in range(len(factor))) for j in range(n)] for i in range(n)]
    size = math.sqrt(sum(v * v for row in ff for v in row)) + 1e-12
    g = [[gamma * v / size for v in row] for row in ff]

    def step(z: DataFrame) -> DataFrame:
        out = dense(z, g)
        for _ in range(m):
            out = S.gspmm(edges, out, n)
        return S.axpy(out, nodes, 1.0, 1.0)

    return fixed_point(step, nodes.select("id", vec.zeros(n).alias("x")), threshold, most)[0]


def magcl(nodes, edges, weight: Matrix, k: int, bias=None) -> DataFrame:
    """k half-sums of the same A x: out_1 = A x, out_n = (out_(n-1) + A x) / 2 - which is A x itself, computed once."""
    d = degree(edges, "src").select("id", "deg")
    e = edges.select("src", "dst", "w").join(d.select(F.col("id").alias("src"), F.col("deg").alias("a")), "src").join(d.select(F.col("id").alias("dst"), F.col("deg").alias("b")), "dst", "left")
    e = e.select("src", "dst", (F.col("w") * N.power(F.col("a"), -0.5) * N.power(F.coalesce("b", F.lit(0)), -0.5)).alias("w"))
    return _plus(S.gspmm(e, dense(nodes, weight), _width(weight)), bias)


def hid(nodes, origin, edges, width: int, alpha: float, beta: float, gamma: float, sigma: float = 1.0) -> DataFrame:
    """alpha x0 + (1 - alpha - beta) x + beta A x + beta gamma A g, g the gaussian gradient."""
    g = cut(S.gaussian_gradient(edges, nodes, width, sigma))
    diffused = S.axpy(S.gspmm(edges, nodes, width), S.gspmm(edges, g, width), beta, beta * gamma)
    return S.axpy(S.axpy(origin, nodes, alpha, 1 - alpha - beta), diffused, 1.0, 1.0)


def dhn(nodes, edges, width: int, lin1: Matrix, lin2: Matrix) -> DataFrame:
    """Two-level mean: neighbours with the mean of theirs, mapped, averaged and joined to the node."""
    m = S.gspmm(edges, nodes, width, "mean", weighted=False)
    j = nodes.join(m.withColumnRenamed("x", "m"), "id").select("id", vec.linear(F.concat("x", "m"), lin1).alias("x"))
    got = S.gspmm(edges, j, _width(lin1), "mean", weighted=False)
    return nodes.join(got.withColumnRenamed("x", "m"), "id").select("id", vec.linear(F.concat("x", "m"), lin2).alias("x"))


def dna(nodes, history: list[DataFrame], edges, width: int) -> DataFrame:
    """Attention of x_i (last layer) over the layers of x_j with the restricted softmax, then a normalised sum.

    nodes are not needed beyond their ids; history holds tables (id, x), oldest first.
    """
    stack = history[0].select("id", F.array("x").alias("h"))
    for t in history[1:]:
        stack = stack.join(t, "id").select("id", F.concat("h", F.array("x")).alias("h"))
    own = stack.select(F.col("id").alias("dst"), F.element_at("h", -1).alias("q"))
    j = edges.select("src", "dst", "w").join(stack.select(F.col("id").alias("src"), "h"), "src").join(own, "dst")
    j = j.withColumn("s", F.transform("h", lambda k: vec.dot(k, F.col("q")) / math.sqrt(width)))
    j = j.withColumn("top", F.greatest(F.array_max("s"), F.lit(0.0)))
    j = j.withColumn("e", F.transform("s", lambda v: F.exp(v - F.col("top"))))
    total = vec.total(F.col("e")) + F.exp(-F.col("top"))
    j = j.withColumn("a", vec.scale(F.col("e"), F.lit(1.0) / total))
    m = F.aggregate(F.arrays_zip("a", "h"), vec.zeros(width), lambda acc, z: vec.add(acc, vec.scale(z["h"], z["a"])))
    return _gather(j.select("dst", vec.scale(m, F.col("w")).alias("m")), nodes, width)


def coed(nodes, edges, w_out: Matrix, w_in: Matrix, own: Matrix | None = None) -> DataFrame:
    """Two directional sums with weights of their own: edges (src, dst, w_out, w_in) as of `fuzzy_laplacian`."""
    fwd = edges.select("src", "dst", F.col("w_out").alias("w"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w_in").alias("w"))
    out = S.axpy(S.gspmm(fwd, dense(nodes, w_out), _width(w_out)), S.gspmm(back, dense(nodes, w_in), _width(w_in)), 1.0, 1.0)
    return out if own is None else S.axpy(out, dense(nodes, own), 1.0, 1.0)


def jumping_knowledge(layers: list[DataFrame], mode: str = "cat") -> DataFrame:
    """Layers (id, x) joined by id: concatenated (`cat`) or the largest of each component (`max`)."""
    out = layers[0].select("id", "x")
    for t in layers[1:]:
        j = out.join(t.select("id", F.col("x").alias("y")), "id")
        out = j.select("id", (F.concat("x", "y") if mode == "cat" else F.zip_with("x", "y", lambda p, q: F.greatest(p, q))).alias("x"))
    return out


def pruned_edges(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Edges whose message |w| * max |x_src| is at least the threshold: the filter of the pruned layers."""
    top = nodes.select(F.col("id").alias("src"), F.array_max(F.transform("x", F.abs)).alias("m"))
    return edges.join(top, "src").filter(F.abs("w") * F.col("m") >= threshold).drop("m")


def pruned_gatv2(nodes, edges, weight: Matrix, att_src: Matrix, att_dst: Matrix, threshold: float, slope: float = 0.2) -> DataFrame:
    """gatv2 over the edges whose message (by the mapped source, with weight 1) reaches the threshold."""
    ones = edges.select("src", "dst", F.lit(1.0).alias("w"))
    return gatv2(nodes, pruned_edges(ones, dense(nodes, weight), threshold), weight, att_src, att_dst, slope=slope)


def pruned_gcnii(nodes, start, edges, weight: Matrix, alpha: float, beta: float, threshold: float) -> DataFrame:
    """gcnii over the edges whose message reaches the threshold."""
    return gcnii(nodes, start, pruned_edges(edges, nodes, threshold), weight, alpha, beta)


def pruned_sage(nodes, edges, neigh: Matrix, own: Matrix, threshold: float) -> DataFrame:
    """Mean aggregation over the edges whose message reaches the threshold."""
    return sage(nodes, pruned_edges(edges, nodes, threshold), neigh, own)


def metapath_gcn(nodes, edges, weight: Matrix, bias: Sequence[float], slope: float = 0.25) -> DataFrame:
    """PReLU(A (x W) + b) over the (normalised) edges of a metapath."""
    return _act(_plus(S.gspmm(edges, dense(nodes, weight), _width(weight)), bias), lambda v: vec.leaky_relu(v, slope))


def lorentz_mean(edges: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Weighted sum of hyperboloid points, scaled back to the sheet: s / sqrt(|<s, s>|) with <,> = -x0 y0 + the rest."""
    s = S.gspmm(edges, nodes, width)
    form = vec.dot(F.col("x"), F.col("x")) - F.lit(2.0) * F.get("x", F.lit(0)) * F.get("x", F.lit(0))
    size = F.sqrt(F.greatest(F.abs(form), F.lit(1e-8)))
    return s.select("id", vec.scale(F.col("x"), F.lit(1.0) / size).alias("x"))


def centrality_encoding(nodes, edges, z_in: Matrix, z_out: Matrix) -> DataFrame:
    """x + z_in[min(in-degree, last)] + z_out[min(out-degree, last)]."""
    universe = nodes.select("id")
    di, do = degree(edges, "dst", universe).withColumnRenamed("deg", "di"), degree(edges, "src", universe).withColumnRenamed("deg", "do")
    j = nodes.join(di, "id").join(do, "id")
    look = lambda z, d: F.get(F.array(*[vec.vector(v) for v in z]), F.least(F.col(d), F.lit(len(z) - 1)).cast("int"))
    return j.select("id", vec.add(vec.add(F.col("x"), look(z_in, "di")), look(z_out, "do")).alias("x"))


def spatial_encoding(tree: DataFrame, b: Sequence[float]) -> DataFrame:
    """(source, id, value): b[min(nodes on the shortest path, last) - 1] of `shortest_paths`."""
    at = F.least(F.col("dist") + 1, F.lit(len(b))) - 1
    return tree.select("source", "id", F.get(vec.vector(b), at.cast("int")).alias("value"))


def edge_encoding(paths: DataFrame, edges: DataFrame, weight: Matrix) -> DataFrame:
    """(source, id, value): mean over a shortest path's edges of edge vector . weight[position].

    paths: rows of `with_paths`; edges (src, dst, x).
    """
    steps = paths.filter("dist > 0").select("source", "id", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("p", "src"), "path")
    steps = steps.withColumn("dst", F.get("path", F.col("p") + 1)).drop("path")
    look = F.get(F.array(*[vec.vector(v) for v in weight]), F.least(F.col("p"), F.lit(len(weight) - 1)))
    return steps.join(edges, ["src", "dst"]).groupBy("source", "id").agg(F.avg(vec.dot(F.col("x"), look)).alias("value"))


def graph_attention(nodes, bias: DataFrame, q: Matrix, k: Matrix, v: Matrix) -> DataFrame:
    """Attention over the pairs of `bias` (src, dst, b) - the pair table within graphs: softmax of q_dst . k_src / sqrt(d) + b."""
    width = _width(v)
    own = nodes.select("id", *[vec.linear(F.col("x"), m).alias(n) for n, m in (("q", q), ("k", k), ("v", v))])
    j = bias.join(own.select(F.col("id").alias("src"), "k", "v"), "src").join(own.select(F.col("id").alias("dst"), "q"), "dst")
    score = vec.dot(F.col("q"), F.col("k")) / math.sqrt(_width(q)) + F.col("b")
    return _attended(edge_softmax(j.select("dst", "v", score.alias("a0")), ["a0"]), nodes, 1, width, True, "v")


def linear_attention(nodes, q: Matrix, k: Matrix, v: Matrix) -> DataFrame:
    """All-pairs attention in linear time: (v_i n + q_i (K'V)) / (n + q_i . sum k), q and k scaled by their overall norms.

    K'V, sum k, n and the norms are one aggregate of bounded size, broadcast back.
    """
    d, e = _width(q), _width(v)
    own = nodes.select("id", *[vec.linear(F.col("x"), m).alias(n) for n, m in (("q", q), ("k", k), ("v", v))])
    g = lambda c, i: F.get(c, F.lit(i))
    stats = own.agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.sum(vec.dot(F.col("q"), F.col("q")))).alias("nq"), F.sqrt(F.sum(vec.dot(F.col("k"), F.col("k")))).alias("nk"),
        vec.reduce_vectors("k", d, "sum").alias("sk"), *[F.array(*[F.sum(g("k", i) * g("v", j)) for i in range(d)]).alias(f"kv{j}") for j in range(e)],
    )
    j = own.crossJoin(F.broadcast(stats))  # one row
    scale = F.lit(1.0) / (F.col("nq") * F.col("nk"))
    low = vec.dot(F.col("q"), F.col("sk")) * scale + F.col("n")
    out = F.array(*[(vec.dot(F.col("q"), F.col(f"kv{i}")) * scale + g("v", i) * F.col("n")) / low for i in range(e)])
    return j.select("id", out.alias("x"))


def nearest_codes(nodes, codebook: Matrix) -> DataFrame:
    """(id, code): vector quantisation by a given codebook."""
    from weftgraph.operators.features import nearest_code

    return nodes.select("id", nearest_code(F.col("x"), codebook).alias("code"))
