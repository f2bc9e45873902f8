"""Forward passes of whole models: compositions of the layers with supplied weights.

Training (losses' gradients, optimisers) is no part of this engine; scores that an objective
is made of are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.core.session import cut
from weftgraph.functions import vec
from weftgraph.nn import layers as L
from weftgraph.operators import features as X
from weftgraph.operators import norm as N
from weftgraph.operators import pool as P
from weftgraph.operators import spmm as S

Layer = Callable[[DataFrame], DataFrame]


def stack(nodes: DataFrame, layers: Sequence[Layer], act: L.Act | None = vec.relu) -> DataFrame:
    """Layers in turn, `act` between them; lineage is cut after each, since each starts with a shuffle of the last."""
    for i, layer in enumerate(layers):
        nodes = layer(nodes)
        if i + 1 < len(layers):
            nodes = cut(L._act(nodes, act))
    return nodes


def sequence(nodes: DataFrame, steps: Sequence[Layer]) -> DataFrame:
    """Layers, maps and activations in turn, lineage cut between them."""
    for i, step in enumerate(steps):
        nodes = step(nodes)
        if i + 1 < len(steps):
            nodes = cut(nodes)
    return nodes


def weighed(nodes: DataFrame, a: Layer, b: Layer, share: float) -> DataFrame:
    """share * a(x) + (1 - share) * b(x)."""
    return S.axpy(a(nodes), b(nodes), share, 1 - share)


def unit_rows(nodes: DataFrame) -> DataFrame:
    """Each vector over its norm; zeros stay."""
    n = vec.norm(F.col("x"))
    return nodes.select("id", vec.scale(F.col("x"), F.coalesce(1 / F.nullif(n, F.lit(0.0)), F.lit(0.0))).alias("x"))


def gcn(nodes, edges, weights: Sequence[L.Matrix], norm: str = "both") -> DataFrame:
    return stack(nodes, [lambda x, w=w: L.gcn(x, edges, w, norm=norm) for w in weights])


def gat(nodes, edges, weights: Sequence[L.Matrix], atts: Sequence[L.Matrix], heads: Sequence[int]) -> DataFrame:
    return stack(nodes, [lambda x, w=w, a=a, h=h: L.gat(x, edges, w, a, h) for w, a, h in zip(weights, atts, heads)], vec.elu)


def sage(nodes, edges, neigh: Sequence[L.Matrix], own: Sequence[L.Matrix]) -> DataFrame:
    return stack(nodes, [lambda x, a=a, b=b: L.sage(x, edges, a, b) for a, b in zip(neigh, own)])


def sage_sampled(nodes, hops: Sequence[DataFrame], neigh: Sequence[L.Matrix], own: Sequence[L.Matrix]) -> DataFrame:
    """One sampled edge table (src, dst) a layer, outermost first."""
    return stack(nodes, [lambda x, e=e, a=a, b=b: L.sage(x, e, a, b) for e, a, b in zip(hops, neigh, own)])


def mlp(nodes, weights: Sequence[L.Matrix], biases: Sequence[Sequence[float]] | None = None) -> DataFrame:
    for i, w in enumerate(weights):
        nodes = L.dense(nodes, w, biases[i] if biases else None, vec.relu if i + 1 < len(weights) else None)
    return nodes


def gin_graphs(nodes, edges, batch: DataFrame, width: int, mlps: Sequence[Sequence[L.Matrix]], head: Sequence[L.Matrix]) -> DataFrame:
    """Graph-level: GIN layers, sum over each graph's nodes, perceptron.  batch is (id, graph_id)."""
    x = stack(nodes, [lambda x, m=m: L.gin(x, edges, width, 0.0, m) for m in mlps])
    return mlp(P.global_pool(x.join(batch, "id"), width, "sum").withColumnRenamed("graph_id", "id"), head)


def sgc(nodes, edges, weight: L.Matrix, k: int) -> DataFrame:
    return L.sgc(nodes, N.gcn_norm(edges), weight, k)


def sign(nodes, edges, width: int, k: int, branches: Sequence[L.Matrix], head: L.Matrix) -> DataFrame:
    """Precomputed x, Ax, .., A^k x, each through its map and ReLU, concatenated, mapped."""
    parts = [nodes, *X.sign(edges, nodes, width, k)]
    return L.dense(L.jumping_knowledge([L.dense(p, w, None, vec.relu) for p, w in zip(parts, branches)]), head)


def jknet(nodes, edges, weights: Sequence[L.Matrix], head: L.Matrix, mode: str = "cat") -> DataFrame:
    hidden = []
    for w in weights:
        nodes = cut(L._act(L.gcn(nodes, edges, w), vec.relu))
        hidden.append(nodes)
    return L.dense(L.jumping_knowledge(hidden, mode), head)


def vgae(nodes, edges, shared: L.Matrix, mean: L.Matrix, pairs: DataFrame) -> DataFrame:
    """(src, dst, score): links decoded from the mean embedding."""
    z = gcn(nodes, edges, [shared, mean])
    return X.link_scores(pairs, z)


def dgi_scores(nodes, corrupted: DataFrame, edges, weight: L.Matrix, bilinear: L.Matrix) -> DataFrame:
    """(id, real, fake): discriminator scores against the mean summary."""
    width = len(weight[0])
    h, c = cut(L._act(L.gcn(nodes, edges, weight), vec.relu)), L._act(L.gcn(corrupted, edges, weight), vec.relu)
    s = h.agg(vec.reduce_vectors("x", width, "mean").alias("m")).select(F.transform("m", vec.sigmoid).alias("m"))
    s = s.select(vec.linear(F.col("m"), bilinear).alias("s"))
    j = h.join(c.withColumnRenamed("x", "y"), "id").crossJoin(F.broadcast(s))  # one row
    return j.select("id", vec.dot(F.col("x"), F.col("s")).alias("real"), vec.dot(F.col("y"), F.col("s")).alias("fake"))


def ggd_embedding(nodes, edges, weight: L.Matrix, k: int = 5) -> DataFrame:
    """h + A^k h of one graph convolution."""
    h = cut(L.gcn(nodes, edges, weight))
    a = N.gcn_norm(edges)
    return S.axpy(h, S.iterate(h, lambda x, _: S.gspmm(a, x, len(weight[0])), k), 1.0, 1.0)


def skipgram_loss(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, loss): -log sigmoid of the product, of walk pairs (positives) - the summand of the objective."""
    s = X.link_scores(pairs, nodes, activate=False)
    return s.select("src", "dst", vec.softplus(-F.col("score")).alias("loss"))


def seal_readout(nodes, edges, batch: DataFrame, weights: Sequence[L.Matrix], k: int, head: L.Matrix) -> DataFrame:
    """(id, x): GCN layers concatenated, the k nodes of largest last channel a sub-graph, flattened, mapped."""
    hidden = []
    for w in weights:
        nodes = cut(nodes.select("id", "x"))
        nodes = L._act(L.gcn(nodes, edges, w), F.tanh)
        hidden.append(nodes)
    cat = L.jumping_knowledge(hidden).join(batch, "id")
    width = sum(len(w[0]) for w in weights)
    return L.dense(P.sort_pool(cat, width, k).withColumnRenamed("graph_id", "id"), head)


def edge_posterior(counts: DataFrame, labels: DataFrame, rounds: int) -> DataFrame:
    """(src, dst, q): EM of a block model from repeated observations (src, dst, seen, tries), pairs that were observed.

    True-positive rate a, false-positive rate b and the edge rate of each pair of classes are
    re-estimated in turn; only those few numbers leave the cluster.
    """
    ls, ld = labels.select(F.col("id").alias("src"), F.col("y").alias("cu")), labels.select(F.col("id").alias("dst"), F.col("y").alias("cv"))
    t = cut(counts.join(ls, "src").join(ld, "dst").withColumn("q", F.col("seen") / F.col("tries")))
    for _ in range(rounds):
        ab = t.agg((F.sum(F.col("q") * F.col("seen")) / F.sum(F.col("q") * F.col("tries"))).alias("a"),
                   (F.sum((1 - F.col("q")) * F.col("seen")) / F.sum((1 - F.col("q")) * F.col("tries"))).alias("b"))
        w = t.join(t.groupBy("cu", "cv").agg(F.avg("q").alias("o")), ["cu", "cv"])
        w = w.crossJoin(F.broadcast(ab))  # one row
        up = F.col("o") * F.pow("a", F.col("seen")) * F.pow(1 - F.col("a"), F.col("tries") - F.col("seen"))
        low = (1 - F.col("o")) * F.pow("b", F.col("seen")) * F.pow(1 - F.col("b"), F.col("tries") - F.col("seen"))
        t = cut(w.select("src", "dst", "cu", "cv", "seen", "tries", F.coalesce(up / F.nullif(up + low, F.lit(0.0)), F.col("q")).alias("q")))
    return t.select("src", "dst", "q")
