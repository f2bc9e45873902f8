"""Feature transforms, nearest-neighbour graphs, pruning and metrics on node tables (id, x)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.core.session import collect_bounded, cut
from weftgraph.functions import vec
from weftgraph.operators import norm as N
from weftgraph.operators import spmm as S
from weftgraph.operators.product import product


def normalize_features(nodes: DataFrame, x: str = "x") -> DataFrame:
    """x minus the smallest component of the table, over max(row sum, 1)."""
    low = nodes.agg(F.min(F.array_min(x)).alias("__low"))  # one row
    shifted = F.transform(F.col(x), lambda v: v - F.col("__low"))
    n = nodes.crossJoin(F.broadcast(low)).withColumn(x, shifted)
    return n.withColumn(x, vec.scale(F.col(x), F.lit(1.0) / F.greatest(vec.total(F.col(x)), F.lit(1.0)))).drop("__low")


def sign(edges: DataFrame, nodes: DataFrame, width: int, k: int) -> list[DataFrame]:
    """[x1 .. xk], x_i = (D^-1/2 A D^-1/2)^i x with degrees by src; isolated nodes get 0."""
    a, out, cur = N.gcn_norm(edges, "src"), [], nodes
    for _ in range(k):
        cur = S.gspmm(a, cur, width)
        out.append(cur)
    return out


def column_moments(nodes: DataFrame, width: int, x: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """Mean and population standard deviation of each component (2 x width numbers)."""
    c = [F.get(x, F.lit(i)) for i in range(width)]
    r = nodes.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(c)], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(c)]).first()
    pick = lambda p: np.array([r[f"{p}{i}"] or 0.0 for i in range(width)])
    return pick("m"), pick("s")


def standardize(nodes: DataFrame, width: int, with_mean: bool = False, clip: float | None = None, fit_on: DataFrame | None = None, x: str = "x") -> DataFrame:
    """(x [- mean]) / std per component (std 0 counts as 1), fitted on `fit_on` if given, clipped at +-clip."""
    mean, std = column_moments(nodes if fit_on is None else fit_on, width, x)
    std[std == 0] = 1.0
    out = F.col(x)
    if with_mean:
        out = vec.sub(out, vec.vector(mean))
    out = F.zip_with(out, vec.vector(std), lambda a, b: a / b)
    if clip is not None:
        out = F.transform(out, lambda v: F.greatest(F.least(v, F.lit(clip)), F.lit(-clip)))
    return nodes.withColumn(x, out)


def normalize_signs(nodes: DataFrame, x: str = "x") -> DataFrame:
    """Positive components over their sum, negative ones over the sum of their magnitudes (0 counts as 1)."""
    pos = F.aggregate(F.col(x), F.lit(0.0), lambda s, v: s + F.greatest(v, F.lit(0.0)))
    neg = F.aggregate(F.col(x), F.lit(0.0), lambda s, v: s + F.greatest(-v, F.lit(0.0)))
    one = lambda c: F.when(c == 0, 1.0).otherwise(c)
    n = nodes.withColumns({"__p": one(pos), "__n": one(neg)})
    return n.withColumn(x, F.transform(F.col(x), lambda v: F.when(v >= 0, v / F.col("__p")).otherwise(v / F.col("__n")))).drop("__p", "__n")


def _gram(width: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((width, width))
        for batch in parts:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            g += x.T @ x
        yield pa.RecordBatch.from_pydict({"p": np.arange(width * width, dtype=np.int32), "g": g.ravel()})

    return run


def svd_reduce(nodes: DataFrame, width: int, out_width: int, x: str = "x") -> DataFrame:
    """U S of the truncated singular value decomposition, only where it narrows x.

    The Gram matrix (one of width x width a task, then sums) is decomposed on the driver; each row
    is projected on its eigenvectors.  The sign of a component is that of its largest loading.
    """
    if out_width >= width:
        return nodes
    sums = nodes.select(F.col(x).cast("array<double>").alias("x")).filter(F.size("x") == width).mapInArrow(_gram(width), "p int, g double")
    g = np.zeros(width * width)
    for r in collect_bounded(sums.groupBy("p").agg(F.sum("g").alias("g")), width * width, "Gram matrix"):
        g[r["p"]] = r["g"]
    _, v = np.linalg.eigh(g.reshape(width, width))
    v = v[:, ::-1][:, :out_width]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(out_width)])
    return nodes.withColumn(x, vec.linear(F.col(x), v.tolist()))


def _knn_block(k: int, metric: str, include_self: bool):
    """For applyInPandas: the items and queries of one block -> the k best items of each query."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_q = pdf["__q"].to_numpy()
        items, q = pdf[~is_q], pdf[is_q]
        out = []
        if len(items) and len(q):
            y, other = np.stack(items["x"].to_list()), items["id"].to_numpy()
            half = (y * y).sum(1)
            for a in range(0, len(q), step := max(1, 2_000_000 // len(items))):
                x, ids = np.stack(q["x"].iloc[a : a + step].to_list()), q["id"].to_numpy()[a : a + step]
                dot, own = x @ y.T, (x * x).sum(1)[:, None]
                # Equal vectors must tie, whatever the order a product was summed in.
                value = np.round(-dot / np.sqrt(own * half) if metric == "cosine" else own + half - 2 * dot, 12)
                if not include_self:
                    value[ids[:, None] == other] = np.inf
                best = min(k, len(other)) - 1
                row, col = np.nonzero((value <= np.partition(value, best, 1)[:, best : best + 1]) & np.isfinite(value))
                v, o = value[row, col], other[col]
                order = np.lexsort((o, v, row))
                row, v, o = row[order], v[order], o[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                out.append(pd.DataFrame({"id": ids[row[keep]], "other": o[keep], "value": v[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "other": [], "value": []})

    return run


def knn_blocked(nodes: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", batch: str | None = None, include_self: bool = False, block: int = 16_384) -> DataFrame:
    """(id, other, rank, value): exact k nearest `nodes` of each row of `queries` (id, x[, batch]).

    The stated queries meet the items block by block: items get a hash block of about `block`
    rows, queries a part of a quarter of that, and each pair of both (with each batch, if given) is
    one matrix product that keeps its k best before they are merged.  metric: `cosine` (largest
    first) or `euclidean` (squared distance, smallest first); ties by other's id.  Rows without
    id or vector are left out, as are zero vectors for `cosine`.
    """
    some = F.col("id").isNotNull() & F.col("x").isNotNull()
    if metric == "cosine":
        some = some & F.exists("x", lambda v: v != 0)
    keys = [batch] if batch else []
    nodes, queries = nodes.filter(some).select(*keys, "id", "x"), queries.filter(some).select(*keys, "id", "x")
    count = lambda d, size: max(1, -(-d.count() // size))
    blocks, parts = count(nodes, block), count(queries, block // 4)
    place = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = nodes.select("*", place(blocks, 1).alias("__b"), copies(parts).alias("__p"), F.lit(False).alias("__q")).unionByName(
        queries.select("*", place(parts, 2).alias("__p"), copies(blocks).alias("__b"), F.lit(True).alias("__q"))
    )
    of = f", {batch} {dict(nodes.dtypes)[batch]}" if batch else ""
    score = _knn_block(k, metric, include_self)
    if batch:
        inner = score
        score = lambda pdf: inner(pdf).assign(**{batch: pdf[batch].iloc[0]})
    best = both.groupBy(*keys, "__b", "__p").applyInPandas(score, "id bigint, other bigint, value double" + of)
    rank = F.row_number().over(Window.partitionBy(*keys, "id").orderBy("value", "other"))
    value = -F.col("value") if metric == "cosine" else F.col("value")
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select(*keys, "id", "other", "rank", value.alias("value"))


def edge_features(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, f): f = [x_src - x_dst, x_dst]."""
    e = edges.select("src", "dst").join(nodes.select(F.col("id").alias("src"), F.col("x").alias("xs")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("x").alias("xd")), "dst")
    return e.select("src", "dst", F.concat(vec.sub(F.col("xs"), F.col("xd")), F.col("xd")).alias("f"))


def link_scores(pairs: DataFrame, nodes: DataFrame, activate: bool = True) -> DataFrame:
    """(src, dst, score): inner products of candidate pairs, through the logistic function if asked."""
    e = pairs.select("src", "dst").join(nodes.select(F.col("id").alias("src"), F.col("x").alias("xs")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("x").alias("xd")), "dst")
    d = vec.dot(F.col("xs"), F.col("xd"))
    return e.select("src", "dst", (vec.sigmoid(d) if activate else d).alias("score"))


def top_edges(edges: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The k in-edges of each dst whose sources score highest (ties by src)."""
    j = edges.join(scores.select(F.col("id").alias("src"), "score"), "src")
    r = F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("score"), "src"))
    return j.withColumn("__r", r).filter(F.col("__r") <= k).drop("__r")


def top_per_row(values: DataFrame, row: str, col: str, value: str, k: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(row).orderBy(F.desc(value), col))
    return values.withColumn("__r", r).filter(F.col("__r") <= k).drop("__r")


def f1(pred: DataFrame) -> DataFrame:
    """One row (micro, macro) for (y, y_hat): per-class counts by one aggregate each side."""
    c = F.array(F.struct(F.col("y").alias("c"), (F.col("y") == F.col("y_hat")).cast("int").alias("tp"), F.lit(0).alias("p"), F.lit(1).alias("t")),
                F.struct(F.col("y_hat").alias("c"), F.lit(0).alias("tp"), F.lit(1).alias("p"), F.lit(0).alias("t")))
    per = pred.select(F.explode(c).alias("e")).groupBy("e.c").agg(F.sum("e.tp").alias("tp"), F.sum("e.p").alias("p"), F.sum("e.t").alias("t"))
    both = F.col("p") + F.col("t")
    return per.agg((2 * F.sum("tp") / F.sum(both)).alias("micro"), F.avg(2 * F.col("tp") / both).alias("macro"))


def prune_small_rows(nodes: DataFrame, width: int, threshold: float, x: str = "x") -> DataFrame:
    """Rows with norm / width below the threshold become zeros; adds `kept`."""
    keep = vec.norm(F.col(x)) / F.lit(width) >= F.lit(threshold)
    return nodes.withColumn("kept", keep).withColumn(x, F.when(F.col("kept"), F.col(x)).otherwise(vec.zeros(width)))


def prune_largest_rows(nodes: DataFrame, width: int, share: float, x: str = "x") -> DataFrame:
    """The floor(n * share) rows of LARGEST norm become zeros (ties by id); adds `kept`.

    The last to go is found by dense ids over a range partition of (norm, id); no task sorts more.
    """
    from weftgraph.operators.segment import with_dense_ids

    n = nodes.count()
    ranked = with_dense_ids(nodes.withColumn("__k", F.struct((-vec.norm(F.col(x))).alias("n"), F.col("id").alias("i"))), "__k", "__p")
    j = ranked.withColumn("kept", F.col("__p") >= F.lit(int(n * share))).drop("__k", "__p")
    return j.withColumn(x, F.when(F.col("kept"), F.col(x)).otherwise(vec.zeros(width)))


def prune_entries(nodes: DataFrame, threshold: float, relative: bool = False, x: str = "x") -> DataFrame:
    """Components below the threshold in magnitude become 0; relative: below min(threshold, 0.999 max |x|) of the table."""
    if not relative:
        return nodes.withColumn(x, F.transform(F.col(x), lambda v: F.when(F.abs(v) < threshold, 0.0).otherwise(v)))
    top = nodes.agg(F.max(F.array_max(F.transform(F.col(x), F.abs))).alias("__top"))  # one row
    n = nodes.crossJoin(F.broadcast(top))
    return n.withColumn(x, F.transform(F.col(x), lambda v: F.when(F.abs(v) < F.least(F.lit(threshold), 0.999 * F.col("__top")), 0.0).otherwise(v))).drop("__top")


def degree_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, new): ranks by in-degree, highest first, ties by id."""
    from weftgraph.operators.segment import degree, with_dense_ids

    d = degree(edges, "dst", nodes).select("id", F.struct((-F.col("deg")).alias("d"), F.col("id").alias("i")).alias("k"))
    return with_dense_ids(d, "k", "new").select("id", "new")


def class_preference(edges: DataFrame, labels: DataFrame, max_classes: int = 1_000) -> DataFrame:
    """(cu, cv, mean, dev): per class of source, mean and sample deviation over its nodes of the share of neighbours in each class."""
    ls, ld = labels.select(F.col("id").alias("src"), F.col("y").alias("cu")), labels.select(F.col("id").alias("dst"), F.col("y").alias("cv"))
    per = edges.select("src", "dst").join(ls, "src").join(ld, "dst").groupBy("src", "cu", "cv").agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("src", "cu").agg(F.sum("n").alias("t"))
    classes = collect_bounded(labels.select("y").filter("y is not null").distinct(), max_classes, "classes")
    every = F.explode(F.array(*[F.lit(r["y"]) for r in classes]).cast("array<bigint>"))
    grid = total.withColumn("cv", every).join(per.select("src", "cv", "n"), ["src", "cv"], "left")
    share = F.coalesce(F.col("n"), F.lit(0)) / F.col("t")
    return grid.groupBy("cu", "cv").agg(F.avg(share).alias("mean"), F.stddev_samp(share).alias("dev"))


def class_means(nodes: DataFrame, width: int) -> DataFrame:
    """(y, x): mean vector of each class."""
    return nodes.groupBy("y").agg(vec.reduce_vectors("x", width, "mean").alias("x"))


def tfidf(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, term, tf, weight): term counts times ln(N / df), over all documents with text."""
    some = docs.filter(F.col(text).isNotNull())
    n = some.agg(F.count(F.lit(1)).alias("n"))
    words = some.select("doc_id", F.explode(F.split(F.lower(text), "[^a-z]+")).alias("term")).filter("term <> ''")
    tf = words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    j = tf.join(df, "term").crossJoin(F.broadcast(n))  # one row
    return j.select("doc_id", "term", "tf", (F.col("tf") * F.log(F.col("n") / F.col("df"))).alias("weight"))


def target_matrix(edges: DataFrame) -> DataFrame:
    """(src, dst, value): (P + P^2) / 2 = P (I + P) / 2 of the row-normalised adjacency P."""
    p = S.transition([edges])
    one = p.select("dst").distinct().select(F.col("dst").alias("src"), "dst", F.lit(1.0).alias("p"))
    with_one = p.unionByName(one).groupBy("src", "dst").agg(F.sum("p").alias("p"))
    return product(p, cut(with_one)).select("src", "dst", (F.col("p") / 2).alias("value"))


def kmeans(nodes: DataFrame, width: int, k: int, rounds: int, x: str = "x") -> tuple[DataFrame, np.ndarray]:
    """((id, code), centres): Lloyd rounds from the k rows of smallest id hash; k x width numbers reach the driver a round."""
    start = collect_bounded(nodes.select(F.col(x).alias("x")).orderBy(F.xxhash64("id"), "id").limit(k), k, "centres")
    c = np.array([r["x"] for r in start], float)
    for _ in range(rounds):
        codes = nodes.select(nearest_code(F.col(x), c).alias("code"), F.col(x).alias("x"))
        for r in collect_bounded(codes.groupBy("code").agg(vec.reduce_vectors("x", width, "mean").alias("x")), k, "centres"):
            c[r["code"]] = r["x"]
    return nodes.select("id", nearest_code(F.col(x), c).alias("code")), c


def nearest_code(x: Column, centres: np.ndarray) -> Column:
    """The number of the nearest of a few literal centres (the smallest of equals)."""
    d = [F.struct(vec.dot(vec.sub(x, vec.vector(c)), vec.sub(x, vec.vector(c))).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
    return F.array_min(F.array(*d))["i"]


def homophily(edges: DataFrame, labels: DataFrame, method: str = "edge", batch: DataFrame | None = None) -> DataFrame:
    """([graph_id,] value).  `edge`: share of edges within a class; `node`: mean over nodes 0..max dst of the share of
    in-edges from the own class (0 without in-edges; with `batch` over the nodes of a graph); `edge_insensitive`: sum over
    classes of max(h_c - p_c, 0) / (C - 1), h_c by class of dst.  `batch` is (id, graph_id), graphs by dst."""
    ls, ld = labels.select(F.col("id").alias("src"), F.col("y").alias("ys")), labels.select(F.col("id").alias("dst"), F.col("y").alias("yd"))
    e = edges.select("src", "dst").join(ls, "src").join(ld, "dst").withColumn("same", (F.col("ys") == F.col("yd")).cast("double"))
    g = ["graph_id"] if batch is not None else []
    if g:
        e = e.join(batch.select(F.col("id").alias("dst"), "graph_id"), "dst")
    if method == "edge":
        return e.groupBy(*g).agg(F.avg("same").alias("value"))
    if method == "node":
        per = e.groupBy(*g, "dst").agg(F.avg("same").alias("h"))
        if g:
            n = batch.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
            return n.join(per.groupBy("graph_id").agg(F.sum("h").alias("s")), "graph_id", "left").select("graph_id", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("value"))
        return per.agg((F.sum("h") / (F.max("dst") + 1)).alias("value"))
    nodes = labels if not g else labels.join(batch, "id")
    size = nodes.groupBy(*g, "y").agg(F.count(F.lit(1)).alias("n"))
    total = size.groupBy(*g).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("c"))
    h = e.groupBy(*g, F.col("yd").alias("y")).agg(F.avg("same").alias("h"))
    j = size.join(total, g) if g else size.crossJoin(F.broadcast(total))  # one row
    j = j.join(h, [*g, "y"], "left")
    part = F.greatest(F.coalesce("h", F.lit(0.0)) - F.col("n") / F.col("t"), F.lit(0.0))
    return j.groupBy(*g).agg((F.sum(part) / F.nullif(F.max("c") - 1, F.lit(0))).alias("value"))
