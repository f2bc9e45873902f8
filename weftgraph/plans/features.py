"""Queries of feature transforms, pooling, nearest neighbours, typed graphs and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.core.session import read
from weftgraph.functions import vec
from weftgraph.operators import features as X
from weftgraph.operators import hetero as H
from weftgraph.operators import pool as P
from weftgraph.plans import views as V
from weftgraph.plans.registry import Registry
from weftgraph.plans.sampling import every
from weftgraph.plans.structure import _chain

R = Registry()
Spark = SparkSession
LONG = "unnest(range(1, {n})) AS k, unnest({x}) AS value"


def unrolled(select: str, x: str, width: int = 4, keys: str = "id") -> str:
    """SQL: a query with a list column to (keys, k, value)."""
    return f"SELECT {keys}, k, {V.r('value')} AS value FROM (SELECT {keys}, unnest(range(1, {width + 1})) AS k, unnest({x}) AS value FROM ({select}))"


# --- transforms ---------------------------------------------------------------------


@R.query(
    "normalize_features",
    V.ctes("x", more=("m AS (SELECT min(list_min(x)) AS m FROM x)", "s AS (SELECT id, list_transform(x, lambda c: c - m) AS x FROM x, m)"))
    + unrolled("SELECT id, list_transform(x, lambda c: c / greatest(list_sum(x), 1)) AS x FROM s", "x"),
)
def normalize_features(spark: Spark, d: str) -> DataFrame:
    return V.long(X.normalize_features(V.features(spark, d)))


_SIGN = "SELECT b.id, b.k, coalesce(p.value, 0) AS v FROM xl b LEFT JOIN (SELECT e.dst AS id, s.k, sum(e.w * s.v) AS value FROM gn e JOIN {p} s ON s.id = e.src GROUP BY e.dst, s.k) p ON p.id = b.id AND p.k = b.k"


@R.query("sign_propagation", V.ctes("gn", "xl", more=(_chain(_SIGN, 2, "SELECT id, k, v FROM xl"),)) + " UNION ALL ".join(f"SELECT {i} AS hop, id, k, {V.r('v')} AS value FROM z{i}" for i in (1, 2)))
def sign_propagation(spark: Spark, d: str) -> DataFrame:
    one, two = X.sign(V.edges(spark, d), V.features(spark, d), V.WIDTH, 2)
    return V.long(one).withColumn("hop", F.lit(1)).unionByName(V.long(two).withColumn("hop", F.lit(2)))


@R.query("standardize", V.ctes("xl", more=("m AS (SELECT k, avg(v) AS m, stddev_pop(v) AS s FROM xl GROUP BY k)",)) + f"SELECT id, xl.k, {V.r('greatest(least((v - m) / s, 2), -2)')} AS value FROM xl JOIN m ON m.k = xl.k")
def standardize(spark: Spark, d: str) -> DataFrame:
    return V.long(X.standardize(V.features(spark, d), V.WIDTH, with_mean=True, clip=2.0))


@R.query(
    "standardize_on_train",
    V.ctes("xl", more=("tr AS (SELECT DISTINCT id FROM graph_nodes WHERE train_idx)", "m AS (SELECT k, stddev_pop(v) AS s FROM xl WHERE id IN (SELECT id FROM tr) GROUP BY k)"))
    + f"SELECT id, xl.k, {V.r('v / s')} AS value FROM xl JOIN m ON m.k = xl.k",
)
def standardize_on_train(spark: Spark, d: str) -> DataFrame:
    x = V.features(spark, d)
    train = x.join(read(spark, d, "graph_nodes").filter("train_idx").select("id").distinct(), "id", "left_semi")
    return V.long(X.standardize(x, V.WIDTH, fit_on=train))


@R.query(
    "normalize_signs",
    V.ctes("xl", more=("s AS (SELECT id, sum(greatest(v, 0)) AS p, sum(greatest(-v, 0)) AS n FROM xl GROUP BY id)",))
    + f"SELECT xl.id, k, {V.r('CASE WHEN v >= 0 THEN v / CASE WHEN p = 0 THEN 1 ELSE p END ELSE v / CASE WHEN n = 0 THEN 1 ELSE n END END')} AS value FROM xl JOIN s ON s.id = xl.id",
)
def normalize_signs(spark: Spark, d: str) -> DataFrame:
    return V.long(X.normalize_signs(V.features(spark, d)))


@R.query("svd_reduce")
def svd_reduce(spark: Spark, d: str) -> DataFrame:
    return V.long(X.svd_reduce(V.vectors(spark, d), V.DIMS, 8))


@R.query(
    "knn_cosine_embeddings",
    "SELECT id, other, rank, round(c, 6) AS value FROM (SELECT a.vec_id AS id, b.vec_id AS other, array_cosine_similarity(a.v, b.v) AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY array_cosine_similarity(a.v, b.v) DESC, b.vec_id) AS rank "
    "FROM (SELECT vec_id, embedding::DOUBLE[64] AS v FROM embeddings WHERE vec_id % 20 = 0) a, (SELECT vec_id, embedding::DOUBLE[64] AS v FROM embeddings) b WHERE a.vec_id <> b.vec_id) WHERE rank <= 5",
)
def knn_cosine_embeddings(spark: Spark, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    out = X.knn_blocked(e, e.filter("id % 20 = 0"), 5)
    return out.select("id", "other", F.col("rank").cast("bigint").alias("rank"), F.round("value", 6).alias("value"))


@R.query(
    "knn_euclidean_by_label",
    "SELECT label, id, other, rank FROM (SELECT a.label, a.vec_id AS id, b.vec_id AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY array_distance(a.v, b.v), b.vec_id) AS rank "
    "FROM (SELECT vec_id, label, embedding::DOUBLE[64] AS v FROM embeddings WHERE vec_id % 20 = 0) a JOIN (SELECT vec_id, label, embedding::DOUBLE[64] AS v FROM embeddings) b ON b.label = a.label) WHERE rank <= 4",
)
def knn_euclidean_by_label(spark: Spark, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("x"))
    out = X.knn_blocked(e, e.filter("id % 20 = 0"), 4, "euclidean", "label", include_self=True)
    return out.select("label", "id", "other", F.col("rank").cast("bigint").alias("rank"))


@R.query("edge_features", V.ctes("e", "x") + unrolled("SELECT e.src, e.dst, list_concat(list_transform(list_zip(a.x, b.x), lambda z: z[1] - z[2]), b.x) AS x FROM (SELECT DISTINCT src, dst FROM e) e JOIN x a ON a.id = e.src JOIN x b ON b.id = e.dst", "x", 8, "src, dst"))
def edge_features(spark: Spark, d: str) -> DataFrame:
    return V.long(X.edge_features(V.edges(spark, d).select("src", "dst").distinct(), V.features(spark, d)), "f", ("src", "dst"))


@R.query("link_scores", V.ctes("e", "x") + f"SELECT e.src, e.dst, {V.r('1 / (1 + exp(-list_dot_product(a.x, b.x)))')} AS score FROM (SELECT DISTINCT src, dst FROM e) e JOIN x a ON a.id = e.src JOIN x b ON b.id = e.dst")
def link_scores(spark: Spark, d: str) -> DataFrame:
    return X.link_scores(V.edges(spark, d).select("src", "dst").distinct(), V.features(spark, d)).withColumn("score", V.real("score"))


@R.query(
    "top_edges",
    V.ctes("e", "x") + "SELECT src, dst FROM (SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.dst ORDER BY x.x[1] DESC, e.src) AS r FROM (SELECT DISTINCT src, dst FROM e) e JOIN x ON x.id = e.src) WHERE r <= 3",
)
def top_edges(spark: Spark, d: str) -> DataFrame:
    scores = V.features(spark, d).select("id", F.get("x", F.lit(0)).alias("score"))
    return X.top_edges(V.edges(spark, d).select("src", "dst").distinct(), scores, 3).select("src", "dst")


@R.query("top_per_row", V.ctes("e") + "SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM (SELECT src, dst, sum(w) AS w FROM e GROUP BY src, dst)) WHERE r <= 5")
def top_per_row(spark: Spark, d: str) -> DataFrame:
    from weftgraph.operators.edges import coalesce

    return X.top_per_row(coalesce(V.edges(spark, d)), "src", "dst", "w", 5).select("src", "dst", "w")


_F1 = "p AS (SELECT y, graph_id AS h FROM graph_nodes WHERE y >= 0 AND graph_id IS NOT NULL), c AS (SELECT c, sum(tp) AS tp, sum(p) AS p, sum(t) AS t FROM (SELECT y AS c, (y = h)::INT AS tp, 0 AS p, 1 AS t FROM p UNION ALL SELECT h, 0, 1, 0 FROM p) GROUP BY c)"


@R.query("f1_scores", f"WITH {_F1} SELECT {V.r('2 * sum(tp) / sum(p + t)')} AS micro, {V.r('avg(2 * tp / (p + t))')} AS macro FROM c")
def f1_scores(spark: Spark, d: str) -> DataFrame:
    p = read(spark, d, "graph_nodes").filter("y >= 0 and graph_id is not null").select("y", F.col("graph_id").alias("y_hat"))
    return X.f1(p).select(V.real("micro").alias("micro"), V.real("macro").alias("macro"))


@R.query("prune_small_rows", V.ctes("x") + unrolled("SELECT id, CASE WHEN sqrt(list_dot_product(x, x)) / 4 >= 0.5 THEN x ELSE [0.0, 0.0, 0.0, 0.0] END AS x FROM x", "x"))
def prune_small_rows(spark: Spark, d: str) -> DataFrame:
    return V.long(X.prune_small_rows(V.features(spark, d), V.WIDTH, 0.5))


@R.query(
    "prune_largest_rows",
    V.ctes("x", more=("q AS (SELECT id, x, row_number() OVER (ORDER BY list_dot_product(x, x) DESC, id) AS r, count(*) OVER () AS n FROM x)",))
    + unrolled("SELECT id, CASE WHEN r > floor(n * 0.1) THEN x ELSE [0.0, 0.0, 0.0, 0.0] END AS x FROM q", "x"),
)
def prune_largest_rows(spark: Spark, d: str) -> DataFrame:
    return V.long(X.prune_largest_rows(V.features(spark, d), V.WIDTH, 0.1))


@R.query("prune_entries", V.ctes("xl") + f"SELECT id, k, {V.r('CASE WHEN abs(v) < 0.7 THEN 0 ELSE v END')} AS value FROM xl")
def prune_entries(spark: Spark, d: str) -> DataFrame:
    return V.long(X.prune_entries(V.features(spark, d), 0.7))


@R.query("prune_entries_relative", V.ctes("xl") + f"SELECT id, k, {V.r('CASE WHEN abs(v) < least(0.4, 0.999 * (SELECT max(abs(v)) FROM xl)) THEN 0 ELSE v END')} AS value FROM xl")
def prune_entries_relative(spark: Spark, d: str) -> DataFrame:
    return V.long(X.prune_entries(V.features(spark, d), 0.4, relative=True))


@R.query("degree_order", V.ctes("e", "n") + "SELECT id, row_number() OVER (ORDER BY c DESC, id) - 1 AS new FROM (SELECT n.id, count(e.src) AS c FROM n LEFT JOIN e ON e.dst = n.id GROUP BY n.id)")
def degree_order(spark: Spark, d: str) -> DataFrame:
    return X.degree_order(V.edges(spark, d), V.nodes(spark, d))


@R.query(
    "class_preference",
    V.ctes("e", "y", more=(
        "p AS (SELECT e.src, a.y AS cu, b.y AS cv, count(*) AS n FROM e JOIN y a ON a.id = e.src JOIN y b ON b.id = e.dst GROUP BY ALL)",
        "s AS (SELECT src, cu, sum(n) AS t FROM p GROUP BY ALL)", "c AS (SELECT DISTINCT y AS cv FROM y)",
        "q AS (SELECT s.cu, c.cv, coalesce(p.n, 0) / s.t AS share FROM s CROSS JOIN c LEFT JOIN p ON p.src = s.src AND p.cv = c.cv)",
    )) + f"SELECT cu, cv, {V.r('avg(share)')} AS mean, {V.r('stddev_samp(share)')} AS dev FROM q GROUP BY ALL",
)
def class_preference(spark: Spark, d: str) -> DataFrame:
    c = X.class_preference(V.edges(spark, d), V.labels(spark, d))
    return c.select("cu", "cv", V.real("mean").alias("mean"), V.real("dev").alias("dev"))


@R.query("class_means", V.ctes("xl", "y") + f"SELECT y AS id, k, {V.r('avg(v)')} AS value FROM xl JOIN y ON y.id = xl.id GROUP BY ALL")
def class_means(spark: Spark, d: str) -> DataFrame:
    return V.long(X.class_means(V.features(spark, d).join(V.labels(spark, d), "id"), V.WIDTH).withColumnRenamed("y", "id"))


@R.query(
    "tfidf",
    "WITH t AS (SELECT doc_id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents WHERE text IS NOT NULL) WHERE w <> '' GROUP BY ALL), "
    "f AS (SELECT term, count(*) AS df FROM t GROUP BY term) "
    f"SELECT doc_id, t.term, tf, {V.r('tf * ln((SELECT count(*) FROM documents WHERE text IS NOT NULL) / df)')} AS weight FROM t JOIN f ON f.term = t.term",
)
def tfidf(spark: Spark, d: str) -> DataFrame:
    return X.tfidf(read(spark, d, "documents")).withColumn("weight", V.real("weight"))


@R.query(
    "target_matrix",
    V.ctes("e", more=("p AS (SELECT a.src, a.dst, sum(w / s) AS p FROM e a JOIN (SELECT src, sum(w) AS s FROM e GROUP BY src) q ON q.src = a.src GROUP BY ALL)",))
    + f"SELECT src, dst, {V.r('sum(p) / 2')} AS value FROM (SELECT * FROM p UNION ALL SELECT a.src, b.dst, sum(a.p * b.p) FROM p a JOIN p b ON b.src = a.dst GROUP BY ALL) GROUP BY ALL",
)
def target_matrix(spark: Spark, d: str) -> DataFrame:
    return X.target_matrix(every(spark, d)).withColumn("value", V.real_many("value"))


@R.query("kmeans_codes")
def kmeans_codes(spark: Spark, d: str) -> DataFrame:
    from weftgraph.core.session import cut

    return X.kmeans(cut(V.features(spark, d)), V.WIDTH, 8, 5)[0]


# --- pooling ------------------------------------------------------------------------

_XG = "xg AS (SELECT x.id, g.graph_id, x.x FROM x JOIN g ON g.id = x.id)"
_XGL = "xgl AS (SELECT id, graph_id, unnest(range(1, 5)) AS k, unnest(x) AS v FROM xg)"


def pooled(spark: Spark, d: str) -> DataFrame:
    return V.features(spark, d).join(V.graphs(spark, d), "id")


for _how, _agg in (("sum", "sum(v)"), ("mean", "avg(v)"), ("max", "max(v)"), ("min", "min(v)")):

    def _pool(spark: Spark, d: str, how: str = _how) -> DataFrame:
        return V.long(P.global_pool(pooled(spark, d), V.WIDTH, how), keys=("graph_id",))

    R.query(f"pool_{_how}", V.ctes("x", "g", more=(_XG, _XGL)) + f"SELECT graph_id, k, {V.r(_agg)} AS value FROM xgl GROUP BY ALL")(_pool)


@R.query(
    "pool_sort",
    V.ctes("x", "g", more=(_XG, "s AS (SELECT graph_id, x, row_number() OVER (PARTITION BY graph_id ORDER BY x[4] DESC, id) AS r FROM xg)", "f AS (SELECT graph_id, flatten(list(x ORDER BY r)) AS x FROM s WHERE r <= 3 GROUP BY graph_id)"))
    + unrolled("SELECT graph_id, list_resize(x, 12, 0.0) AS x FROM f", "x", 12, "graph_id"),
)
def pool_sort(spark: Spark, d: str) -> DataFrame:
    return V.long(P.sort_pool(pooled(spark, d), V.WIDTH, 3), keys=("graph_id",))


@R.query(
    "dense_batch",
    V.ctes("x", "g", more=(_XG, "s AS (SELECT graph_id, x, row_number() OVER (PARTITION BY graph_id ORDER BY id) - 1 AS slot FROM xg)", "l AS (SELECT DISTINCT graph_id, unnest(range(300)) AS slot FROM xg)"))
    + f"SELECT l.graph_id, l.slot, s.x IS NOT NULL AS mask, {V.r('coalesce(s.x[1], -1)')} AS first FROM l LEFT JOIN s ON s.graph_id = l.graph_id AND s.slot = l.slot",
)
def dense_batch(spark: Spark, d: str) -> DataFrame:
    """At least the 300 slots of the SQL; where a graph has more nodes, where the SQL drops them, one for each."""
    b = P.dense_batch(pooled(spark, d), V.WIDTH, 300, fill=-1.0)
    return b.select("graph_id", F.col("slot").cast("bigint").alias("slot"), "mask", V.real(F.get("x", F.lit(0))).alias("first"))


@R.query(
    "pool_moments",
    V.ctes("x", "g", more=(_XG, _XGL)) + " UNION ALL ".join(f"SELECT graph_id, k + {4 * i} AS k, {V.r(a)} AS value FROM xgl GROUP BY graph_id, k" for i, a in enumerate(("avg(v)", "min(v)", "max(v)", "stddev_pop(v)"))),
)
def pool_moments(spark: Spark, d: str) -> DataFrame:
    return V.long(P.moments(pooled(spark, d), V.WIDTH), keys=("graph_id",))


@R.query(
    "pool_attention",
    V.ctes("x", "g", more=(_XG, "m AS (SELECT graph_id, max(x[1]) AS t FROM xg GROUP BY 1)", "s AS (SELECT xg.graph_id, t, sum(exp(x[1] - t)) + 1e-16 AS s FROM xg JOIN m ON m.graph_id = xg.graph_id GROUP BY ALL)",
        "l AS (SELECT xg.graph_id, exp(x[1] - t) / s AS a, unnest(range(1, 5)) AS k, unnest(x) AS v FROM xg JOIN s ON s.graph_id = xg.graph_id)")) + f"SELECT graph_id, k, {V.r('sum(a * v)')} AS value FROM l GROUP BY ALL",
)
def pool_attention(spark: Spark, d: str) -> DataFrame:
    n = pooled(spark, d).withColumn("score", F.get("x", F.lit(0)))
    return V.long(P.attention_pool(n, V.WIDTH, "score"), keys=("graph_id",))


# --- typed graphs -------------------------------------------------------------------

_TN = "tn AS (SELECT src_type AS node_type, src AS id FROM a UNION SELECT dst_type, dst FROM a)"


def typed_nodes(spark: Spark, d: str) -> DataFrame:
    e = V.alircd_edges(spark, d)
    s, t = e.select(F.col("src_type").alias("node_type"), F.col("src").alias("id")), e.select(F.col("dst_type").alias("node_type"), F.col("dst").alias("id"))
    return s.unionByName(t).distinct()


_HM = "hm AS (SELECT node_type, id, row_number() OVER (ORDER BY node_type, id) - 1 AS new FROM tn)"


@R.query("hetero_to_homogeneous", V.ctes("a", more=(_TN, _HM)) + "SELECT s.new AS src, d.new AS dst, edge_type FROM a JOIN hm s ON s.node_type = src_type AND s.id = src JOIN hm d ON d.node_type = dst_type AND d.id = dst")
def hetero_to_homogeneous(spark: Spark, d: str) -> DataFrame:
    return H.to_homogeneous(typed_nodes(spark, d), V.alircd_edges(spark, d))[1]


_HL = "hl AS (SELECT node_type, new AS id, row_number() OVER (PARTITION BY node_type ORDER BY new) - 1 AS local FROM hm)"


@R.query(
    "hetero_from_homogeneous",
    V.ctes("a", more=(_TN, _HM, _HL, "he AS (SELECT s.new AS src, d.new AS dst, edge_type FROM a JOIN hm s ON s.node_type = src_type AND s.id = src JOIN hm d ON d.node_type = dst_type AND d.id = dst)"))
    + "SELECT s.node_type AS src_type, edge_type, d.node_type AS dst_type, s.local AS src, d.local AS dst FROM he JOIN hl s ON s.id = he.src JOIN hl d ON d.id = he.dst",
)
def hetero_from_homogeneous(spark: Spark, d: str) -> DataFrame:
    m, e = H.to_homogeneous(typed_nodes(spark, d), V.alircd_edges(spark, d))
    return H.to_heterogeneous(m.select(F.col("new").alias("id"), "node_type"), e)[1]


@R.query("hetero_offsets", V.ctes("a", more=(_TN,)) + "SELECT node_type, n, CAST(sum(n) OVER (ORDER BY node_type) - n AS BIGINT) AS offset FROM (SELECT node_type, count(*) AS n FROM tn GROUP BY 1)")
def hetero_offsets(spark: Spark, d: str) -> DataFrame:
    return H.node_offsets(typed_nodes(spark, d)).select("node_type", "n", F.col("offset").cast("bigint").alias("offset"))


@R.query("hetero_typed_degree", V.ctes("a") + "SELECT edge_type, dst, count(*) AS deg FROM a GROUP BY ALL")
def hetero_typed_degree(spark: Spark, d: str) -> DataFrame:
    return H.typed_degree(V.alircd_edges(spark, d))


@R.query("hetero_metadata", V.ctes("a") + "SELECT DISTINCT src_type, edge_type, dst_type FROM a")
def hetero_metadata(spark: Spark, d: str) -> DataFrame:
    return H.metadata(V.alircd_edges(spark, d))


@R.query("hetero_rename", V.ctes("a") + "SELECT CASE WHEN src_type = 'f' THEN 'seller' ELSE src_type END AS src_type, count(*) AS n FROM a GROUP BY 1")
def hetero_rename(spark: Spark, d: str) -> DataFrame:
    return H.rename_type(V.alircd_edges(spark, d), "src_type", "f", "seller").groupBy("src_type").agg(F.count(F.lit(1)).alias("n"))


@R.query("hetero_collect", "SELECT 'customer' AS node_type, c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier")
def hetero_collect(spark: Spark, d: str) -> DataFrame:
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return H.collect_attr({"customer": c, "supplier": s, "part": p}, "nation")


def _order_chain(spark: Spark, d: str) -> list[DataFrame]:
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return [o, li]


@R.query("metapath_distinct", "SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def metapath_distinct(spark: Spark, d: str) -> DataFrame:
    return H.metapath(_order_chain(spark, d))


@R.query("metapath_counts", "SELECT o_custkey AS src, l_suppkey AS dst, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def metapath_counts(spark: Spark, d: str) -> DataFrame:
    return H.metapath(_order_chain(spark, d), weighted=True)


@R.query(
    "group_relations",
    V.ctes("t", "xl") + f"SELECT id, k, {V.r('avg(v)')} AS value FROM (SELECT t.dst AS id, edge_type, k, sum(w * v) AS v FROM t JOIN xl ON xl.id = t.src GROUP BY ALL) GROUP BY id, k",
)
def group_relations(spark: Spark, d: str) -> DataFrame:
    t, x = V.typed(spark, d), V.features(spark, d).withColumnRenamed("id", "src")
    parts = t.join(x, "src").groupBy(F.col("dst").alias("id"), "edge_type").agg(F.array(*[F.sum(F.col("w") * F.get("x", F.lit(i))) for i in range(V.WIDTH)]).alias("x"))
    names = ["cites", "links", "similar", "follows"]
    return V.long(H.group_relations([parts.filter(F.col("edge_type") == n).select("id", "x") for n in names], V.WIDTH, "mean"))


# --- batches of graphs --------------------------------------------------------------

_BG = (
    "bn AS (SELECT graph_id, id FROM g)", "be AS (SELECT a.graph_id, e.src, e.dst FROM e JOIN g a ON a.id = e.src JOIN g b ON b.id = e.dst AND b.graph_id = a.graph_id)",
    "bm AS (SELECT graph_id, id, row_number() OVER (ORDER BY graph_id, id) - 1 AS new FROM bn)",
)


def _batch(spark: Spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    g = V.graphs(spark, d)
    e = V.edges(spark, d).join(g.withColumnRenamed("id", "src"), "src").join(g.withColumnRenamed("id", "dst"), ["dst", "graph_id"])
    return H.collate(g, e.select("graph_id", "src", "dst"))


@R.query("batch_collate", V.ctes("e", "g", more=_BG) + "SELECT be.graph_id, s.new AS src, d.new AS dst FROM be JOIN bm s ON s.graph_id = be.graph_id AND s.id = be.src JOIN bm d ON d.graph_id = be.graph_id AND d.id = be.dst")
def batch_collate(spark: Spark, d: str) -> DataFrame:
    return _batch(spark, d)[1]


@R.query("batch_pointers", V.ctes("e", "g", more=_BG) + "SELECT graph_id, min(new) AS ptr, count(*) AS n FROM bm GROUP BY 1")
def batch_pointers(spark: Spark, d: str) -> DataFrame:
    return _batch(spark, d)[2]


@R.query(
    "batch_separate",
    V.ctes("e", "g", more=(*_BG, "bl AS (SELECT graph_id, id, row_number() OVER (PARTITION BY graph_id ORDER BY id) - 1 AS l FROM bn)"))
    + "SELECT be.graph_id, s.l AS src, d.l AS dst FROM be JOIN bl s ON s.graph_id = be.graph_id AND s.id = be.src JOIN bl d ON d.graph_id = be.graph_id AND d.id = be.dst",
)
def batch_separate(spark: Spark, d: str) -> DataFrame:
    m, e, ptr = _batch(spark, d)
    return H.separate(m, e, ptr)[1]


@R.query("gather_attributes", V.ctes("y", "n") + "SELECT id, y FROM y WHERE id IN (SELECT id FROM n)")
def gather_attributes(spark: Spark, d: str) -> DataFrame:
    return H.gather(V.labels(spark, d), V.nodes(spark, d))
