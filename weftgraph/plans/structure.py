"""Queries of segment reductions, edge algebra, norms and sparse products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.core.session import read
from weftgraph.functions import vec
from weftgraph.operators import edges as E
from weftgraph.operators import norm as N
from weftgraph.operators import segment as G
from weftgraph.operators import spmm as S
from weftgraph.plans import views as V
from weftgraph.plans.registry import Registry

R = Registry()
Spark = SparkSession


# --- flagship -----------------------------------------------------------------------


def part_supp(spark: Spark, d: str) -> DataFrame:
    """Bipartite graph part -> supplier, w = quantity; parts and suppliers in one id space."""
    li = read(spark, d, "lineitem").filter("l_partkey is not null and l_suppkey is not null")
    return li.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("w"))


@R.query(
    "spmm_sym_norm",
    """
    WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, sum(l_quantity) AS w FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY ALL),
    s AS (SELECT src, sum(w) AS d FROM e GROUP BY src), t AS (SELECT dst, sum(w) AS d FROM e GROUP BY dst)
    SELECT e.dst, round(sum(e.w * s.d ** -0.5 * t.d ** -0.5 * p.p_retailprice), 6) AS value
    FROM e JOIN s ON s.src = e.src JOIN t ON t.dst = e.dst JOIN part p ON p.p_partkey = e.src GROUP BY e.dst
    """,
)
def spmm_sym_norm(spark: Spark, d: str) -> DataFrame:
    e = E.coalesce(part_supp(spark, d))
    s = e.groupBy("src").agg(F.sum("w").alias("ds"))
    t = e.groupBy("dst").agg(F.sum("w").alias("dt"))
    w = F.col("w") * N.power(F.col("ds"), -0.5) * N.power(F.col("dt"), -0.5)
    e = e.join(s, "src").join(t, "dst").select("src", "dst", w.alias("w"))
    price = read(spark, d, "part").select(F.col("p_partkey").alias("src"), F.col("p_retailprice").alias("p"))
    return e.join(price, "src").groupBy("dst").agg(F.round(F.sum(F.col("w") * F.col("p")), 6).alias("value"))


# --- segments -----------------------------------------------------------------------


def _segment(name: str, how: str, agg: str) -> None:
    @R.query(name, V.ctes("e", "n") + f"SELECT n.id, {V.r('coalesce(s.v, 0)')} AS value FROM n LEFT JOIN (SELECT dst, {agg} AS v FROM e GROUP BY dst) s ON s.dst = n.id")
    def query(spark: Spark, d: str) -> DataFrame:
        universe = V.nodes(spark, d).withColumnRenamed("id", "dst")
        out = G.segment_reduce(V.edges(spark, d), "dst", "w", how, universe)
        return out.select(F.col("dst").alias("id"), V.real(F.col("value").cast("double")).alias("value"))


for _n, _h, _a in (("sum", "sum", "sum(w)"), ("mean", "mean", "avg(w)"), ("max", "max", "max(w)"), ("min", "min", "min(w)")):
    _segment(f"segment_{_n}", _h, _a)


@R.query("segment_mul", V.ctes("e") + f"SELECT dst AS id, {V.r('product(1 + w / 1000000)')} AS value FROM e GROUP BY dst")
def segment_mul(spark: Spark, d: str) -> DataFrame:
    e = V.edges(spark, d).withColumn("w", 1 + F.col("w") / 1_000_000)
    return G.segment_reduce(e, "dst", "w", "mul").select(F.col("dst").alias("id"), V.real("value").alias("value"))


@R.query(
    "segment_div",
    """WITH l AS (SELECT l_orderkey AS id, l_linenumber * 1000000000000 + l_partkey * 1000 + CAST(round(l_tax * 100) AS BIGINT) AS pos, 1 + l_tax AS v FROM lineitem),
    f AS (SELECT id, arg_min(v, pos) AS first, product(v) AS p FROM l GROUP BY id)
    SELECT id, round(first / (p / first), 6) AS value FROM f""",
)
def segment_div(spark: Spark, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber").cast("bigint") * 1_000_000_000_000 + F.col("l_partkey") * 1000 + F.round(F.col("l_tax") * 100).cast("bigint")).alias("pos"), (1 + F.col("l_tax")).alias("v"))
    return G.segment_div(li, "id", "v", "pos").select("id", F.round("value", 6).alias("value"))


@R.query("segment_max_arg", V.ctes("e") + "SELECT dst AS id, max(w) AS value, min(src) FILTER (w = m) AS arg FROM (SELECT *, max(w) OVER (PARTITION BY dst) AS m FROM e) GROUP BY dst")
def segment_max_arg(spark: Spark, d: str) -> DataFrame:
    return G.segment_arg(V.edges(spark, d), "dst", "w", "src").withColumnRenamed("dst", "id")


@R.query(
    "segment_softmax",
    V.ctes("e") + f"SELECT src, dst, w, {V.r('exp(w - max(w) OVER p) / (sum(exp(w - m)) OVER p + 1e-16)')} AS alpha "
    "FROM (SELECT *, max(w) OVER (PARTITION BY dst) AS m FROM e) WINDOW p AS (PARTITION BY dst)",
)
def segment_softmax(spark: Spark, d: str) -> DataFrame:
    return G.segment_softmax(V.edges(spark, d), "dst", "w").select("src", "dst", "w", V.real("alpha").alias("alpha"))


@R.query(
    "segment_restricted_softmax",
    V.ctes("e", more=("m AS (SELECT dst, greatest(max(w - 10), 0) AS t FROM e GROUP BY dst)", "s AS (SELECT e.dst, t, sum(exp(w - 10 - t)) + exp(0 - t) AS s FROM e JOIN m ON m.dst = e.dst GROUP BY e.dst, t)"))
    + f"SELECT e.src, e.dst, w, {V.r('exp(w - 10 - t) / s')} AS alpha FROM e JOIN s ON s.dst = e.dst",
)
def segment_restricted_softmax(spark: Spark, d: str) -> DataFrame:
    e = V.edges(spark, d).withColumn("v", F.col("w") - 10)
    return G.restricted_softmax(e, "dst", "v").select("src", "dst", "w", V.real("alpha").alias("alpha"))


@R.query(
    "segment_masked_softmax",
    V.ctes("e", more=("m AS (SELECT dst, max(w) FILTER (src > dst) AS t FROM e GROUP BY dst)", "s AS (SELECT e.dst, t, sum(CASE WHEN src > e.dst THEN exp(w - t) ELSE 0 END) AS s FROM e JOIN m ON m.dst = e.dst GROUP BY e.dst, t)"))
    + f"SELECT e.src, e.dst, w, {V.r('CASE WHEN t IS NULL THEN w WHEN src > e.dst THEN exp(w - t) / s ELSE 0 END')} AS alpha FROM e JOIN s ON s.dst = e.dst",
)
def segment_masked_softmax(spark: Spark, d: str) -> DataFrame:
    e = V.edges(spark, d).withColumn("mask", F.col("src") > F.col("dst"))
    return G.masked_softmax(e, "dst", "w", "mask").select("src", "dst", "w", V.real("alpha").alias("alpha"))


for _side in ("src", "dst"):

    def _degree(spark: Spark, d: str, side: str = _side) -> DataFrame:
        return G.degree(V.edges(spark, d), side, V.nodes(spark, d))

    R.query(
        "degree_out" if _side == "src" else "degree_in",
        V.ctes("e", "n") + f"SELECT n.id, coalesce(c, 0) AS deg FROM n LEFT JOIN (SELECT {_side} AS id, count(*) AS c FROM e GROUP BY 1) s ON s.id = n.id",
    )(_degree)


@R.query("unique_inverse_counts", "SELECT w AS value, dense_rank() OVER (ORDER BY w) - 1 AS inverse, count(*) AS count FROM graph_edges WHERE NOT isnan(w) GROUP BY w")
def unique_inverse_counts(spark: Spark, d: str) -> DataFrame:
    return G.unique(V_raw(spark, d).select(F.col("w").alias("value")), "value").select("value", "inverse", "count")


def V_raw(spark: Spark, d: str) -> DataFrame:
    return read(spark, d, "graph_edges").filter(F.col("w").isNotNull() & ~F.isnan("w"))


@R.query("bincount", "SELECT y AS batch, graph_id AS code, count(*) AS n FROM graph_nodes GROUP BY ALL")
def bincount(spark: Spark, d: str) -> DataFrame:
    return G.bincount(read(spark, d, "graph_nodes").select(F.col("y").alias("batch"), F.col("graph_id").alias("code")), "batch", "code")


_PTR = V.ctes("e", "n", more=("c AS (SELECT n.id, count(e.src) AS n FROM n LEFT JOIN e ON e.src = n.id GROUP BY n.id)",))


@R.query("csr_ind2ptr", _PTR + "SELECT id, CAST(sum(n) OVER (ORDER BY id) - n AS BIGINT) AS ptr, n FROM c")
def csr_ind2ptr(spark: Spark, d: str) -> DataFrame:
    return G.ind2ptr(V.edges(spark, d), "src", V.nodes(spark, d)).select("id", "ptr", "n")


@R.query("csr_ptr2ind", _PTR + ", p AS (SELECT id, CAST(sum(n) OVER (ORDER BY id) - n AS BIGINT) AS ptr, n FROM c) SELECT id, unnest(range(ptr, ptr + n)) AS pos FROM p WHERE n > 0")
def csr_ptr2ind(spark: Spark, d: str) -> DataFrame:
    return G.ptr2ind(G.ind2ptr(V.edges(spark, d), "src", V.nodes(spark, d)))


@R.query(
    "csr_lists",
    V.ctes("e", more=("q AS (SELECT src AS id, dst, (row_number() OVER (PARTITION BY src ORDER BY dst) - 1) // 1000 AS part FROM (SELECT DISTINCT src, dst FROM e))",))
    + "SELECT id, part, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM q GROUP BY ALL",
)
def csr_lists(spark: Spark, d: str) -> DataFrame:
    """Neighbour lists of at most 1,000 ids a row."""
    return E.csr(V.edges(spark, d), 1000).select("id", "part", F.array_join("neighbours", ",").alias("neighbours"))


@R.query("repeat_interleave", "SELECT id FROM (SELECT l_orderkey AS id, unnest(range(l_linenumber)) FROM lineitem)")
def repeat_interleave(spark: Spark, d: str) -> DataFrame:
    return G.repeat_interleave(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber"), "id", "l_linenumber")


# --- edges --------------------------------------------------------------------------

for _how, _agg in (("add", "sum(w)"), ("mean", "avg(w)"), ("min", "min(w)"), ("max", "max(w)"), ("mul", "product(w)")):

    def _coalesce(spark: Spark, d: str, how: str = _how) -> DataFrame:
        return E.coalesce(V.edges(spark, d), how).select("src", "dst", V.real("w").alias("w"))

    R.query(f"edges_coalesce_{_how}", V.ctes("e") + f"SELECT src, dst, {V.r(_agg)} AS w FROM e GROUP BY src, dst")(_coalesce)


@R.query("edges_sort", V.ctes("e") + "SELECT src, dst, w FROM e ORDER BY dst, src")
def edges_sort(spark: Spark, d: str) -> DataFrame:
    return E.sort_edges(V.edges(spark, d), by_row=False)


@R.query("edges_contains_self_loops", V.ctes("e") + "SELECT coalesce(bool_or(src = dst), false) AS value FROM e")
def edges_contains_self_loops(spark: Spark, d: str) -> DataFrame:
    return E.contains_self_loops(V.edges(spark, d))


@R.query("edges_remove_self_loops", V.ctes("e") + "SELECT * FROM e WHERE src <> dst")
def edges_remove_self_loops(spark: Spark, d: str) -> DataFrame:
    return E.remove_self_loops(V.edges(spark, d))


@R.query("edges_add_self_loops", V.ctes("e", "n") + "SELECT * FROM e UNION ALL SELECT id, id, 2.0::DOUBLE FROM n UNION ALL SELECT id, id, 2.0::DOUBLE FROM n")
def edges_add_self_loops(spark: Spark, d: str) -> DataFrame:
    return E.add_self_loops(V.edges(spark, d), V.nodes(spark, d), 2.0, 2)


@R.query("edges_add_remaining_self_loops", V.ctes("e", "n") + "SELECT * FROM e WHERE src <> dst UNION ALL SELECT id, id, 1.0::DOUBLE FROM n")
def edges_add_remaining_self_loops(spark: Spark, d: str) -> DataFrame:
    return E.add_remaining_self_loops(V.edges(spark, d), V.nodes(spark, d))


@R.query("edges_to_undirected", V.ctes("e") + f"SELECT src, dst, {V.r('sum(w)')} AS w FROM (SELECT * FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY src, dst")
def edges_to_undirected(spark: Spark, d: str) -> DataFrame:
    return E.to_undirected(V.edges(spark, d)).select("src", "dst", V.real("w").alias("w"))


@R.query(
    "edges_is_undirected",
    V.ctes("e", more=("u AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e)",))
    + "SELECT 'raw' AS graph, (SELECT count(*) FROM (SELECT * FROM e EXCEPT ALL SELECT dst, src, w FROM e)) = 0 AS value "
    "UNION ALL SELECT 'doubled', (SELECT count(*) FROM (SELECT * FROM u EXCEPT ALL SELECT dst, src, w FROM u)) = 0",
)
def edges_is_undirected(spark: Spark, d: str) -> DataFrame:
    e = V.edges(spark, d)
    a = E.is_undirected(e).select(F.lit("raw").alias("graph"), "value")
    return a.unionByName(E.is_undirected(E.to_undirected(e)).select(F.lit("doubled").alias("graph"), "value"))


@R.query("edges_is_coalesced", V.ctes("e") + "SELECT max(n) <= 1 AS value FROM (SELECT count(*) AS n FROM e GROUP BY src, dst)")
def edges_is_coalesced(spark: Spark, d: str) -> DataFrame:
    return E.is_coalesced(V.edges(spark, d))


@R.query("edges_isolated_nodes", V.ctes("e", "n") + "SELECT id FROM n WHERE id NOT IN (SELECT dst FROM e)")
def edges_isolated_nodes(spark: Spark, d: str) -> DataFrame:
    return E.isolated_nodes(V.edges(spark, d), V.nodes(spark, d))


@R.query("edges_num_nodes", V.ctes("e") + "SELECT max(greatest(src, dst)) + 1 AS n FROM e")
def edges_num_nodes(spark: Spark, d: str) -> DataFrame:
    return E.num_nodes(V.edges(spark, d))


@R.query("edges_num_nodes_by_type", V.ctes("a") + "SELECT t AS node_type, max(i) + 1 AS n FROM (SELECT src_type AS t, src AS i FROM a UNION ALL SELECT dst_type, dst FROM a) GROUP BY t")
def edges_num_nodes_by_type(spark: Spark, d: str) -> DataFrame:
    return E.num_nodes_by_type(V.alircd_edges(spark, d), "src_type", "dst_type")


@R.query("mask_from_index", V.ctes("n", "y") + "SELECT id, id IN (SELECT id FROM y) AS mask FROM n")
def mask_from_index(spark: Spark, d: str) -> DataFrame:
    return E.index_to_mask(V.labels(spark, d), V.nodes(spark, d))


@R.query("index_from_mask", V.ctes("n", "y") + "SELECT id FROM n WHERE id IN (SELECT id FROM y)")
def index_from_mask(spark: Spark, d: str) -> DataFrame:
    return E.mask_to_index(E.index_to_mask(V.labels(spark, d), V.nodes(spark, d)))


@R.query("edges_to_adjacency", V.ctes("e") + "SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst")
def edges_to_adjacency(spark: Spark, d: str) -> DataFrame:
    return E.to_adjacency(V.edges(spark, d))


@R.query("edges_dense_adjacency", V.ctes("e", "g") + f"SELECT graph_id, src, dst, {V.r('sum(w)')} AS value FROM e JOIN g ON g.id = e.dst GROUP BY ALL")
def edges_dense_adjacency(spark: Spark, d: str) -> DataFrame:
    e = V.edges(spark, d).join(V.graphs(spark, d).withColumnRenamed("id", "dst"), "dst")
    return E.dense_adjacency(e, "graph_id").withColumn("value", V.real("value"))


@R.query("edges_upper_triangle", V.ctes("e") + "SELECT * FROM e WHERE src <= dst")
def edges_upper_triangle(spark: Spark, d: str) -> DataFrame:
    return E.upper_triangle(V.edges(spark, d))


@R.query("edges_transpose", V.ctes("e") + "SELECT dst AS src, src AS dst, w FROM e")
def edges_transpose(spark: Spark, d: str) -> DataFrame:
    return E.transpose(V.edges(spark, d)).select("src", "dst", "w")


_EDGE_N = 1 << 21


@R.query(
    "edges_number_round_trip",
    V.ctes("e") + f"SELECT DISTINCT src, dst, src * {_EDGE_N} + dst AS bipartite, src * {_EDGE_N - 1} + dst - CASE WHEN src < dst THEN 1 ELSE 0 END AS directed, true AS same FROM e WHERE src <> dst",
)
def edges_number_round_trip(spark: Spark, d: str) -> DataFrame:
    e = V.edges(spark, d).filter("src <> dst").select("src", "dst").distinct()
    s, t = F.col("src"), F.col("dst")
    e = e.select("src", "dst", E.edge_number(s, t, _EDGE_N).alias("bipartite"), E.edge_number(s, t, _EDGE_N, "directed").alias("directed"))
    s1, d1 = E.edge_of_number(F.col("bipartite"), _EDGE_N)
    s2, d2 = E.edge_of_number(F.col("directed"), _EDGE_N, "directed")
    return e.withColumn("same", (s1 == s) & (d1 == t) & (s2 == s) & (d2 == t))


@R.query("edges_homophily_edge", V.ctes("e", "y") + f"SELECT {V.r('avg(CASE WHEN a.y = b.y THEN 1.0 ELSE 0.0 END)')} AS value FROM e JOIN y a ON a.id = e.src JOIN y b ON b.id = e.dst")
def edges_homophily_edge(spark: Spark, d: str) -> DataFrame:
    from weftgraph.operators.features import homophily

    return homophily(V.edges(spark, d), V.labels(spark, d)).select(V.real("value").alias("value"))


@R.query(
    "edges_homophily_node",
    V.ctes("e", "y", "g", more=("h AS (SELECT g.graph_id, e.dst, avg(CASE WHEN a.y = b.y THEN 1.0 ELSE 0.0 END) AS h FROM e JOIN y a ON a.id = e.src JOIN y b ON b.id = e.dst JOIN g ON g.id = e.dst GROUP BY ALL)",))
    + f"SELECT n.graph_id, {V.r('coalesce(s, 0) / n')} AS value FROM (SELECT graph_id, count(*) AS n FROM g GROUP BY 1) n LEFT JOIN (SELECT graph_id, sum(h) AS s FROM h GROUP BY 1) q ON q.graph_id = n.graph_id",
)
def edges_homophily_node(spark: Spark, d: str) -> DataFrame:
    from weftgraph.operators.features import homophily

    return homophily(V.edges(spark, d), V.labels(spark, d), "node", V.graphs(spark, d)).select("graph_id", V.real("value").alias("value"))


@R.query(
    "edges_homophily_insensitive",
    V.ctes("e", "y", more=(
        "h AS (SELECT b.y, avg(CASE WHEN a.y = b.y THEN 1.0 ELSE 0.0 END) AS h FROM e JOIN y a ON a.id = e.src JOIN y b ON b.id = e.dst GROUP BY b.y)",
        "p AS (SELECT y, count(*) AS n, (SELECT count(*) FROM y) AS t FROM y GROUP BY y)",
    )) + f"SELECT {V.r('sum(greatest(coalesce(h, 0) - n / t, 0)) / (count(*) - 1)')} AS value FROM p LEFT JOIN h ON h.y = p.y",
)
def edges_homophily_insensitive(spark: Spark, d: str) -> DataFrame:
    from weftgraph.operators.features import homophily

    return homophily(V.edges(spark, d), V.labels(spark, d), "edge_insensitive").select(V.real("value").alias("value"))


# --- norms --------------------------------------------------------------------------


def _rounded(e: DataFrame) -> DataFrame:
    return e.select("src", "dst", V.real("w").alias("w"))


@R.query("norm_gcn", V.ctes("gn") + f"SELECT src, dst, {V.r('w')} AS w FROM gn")
def norm_gcn(spark: Spark, d: str) -> DataFrame:
    return _rounded(N.gcn_norm(V.edges(spark, d)))


@R.query(
    "norm_a_hat",
    V.ctes("e", "n", more=("l AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM e UNION ALL SELECT id, id, 1.0 FROM n) GROUP BY src, dst)", "dl AS (SELECT src AS id, sum(w) AS d FROM l GROUP BY src)"))
    + f"SELECT src, dst, {V.r('a.d ** -0.5 * w * coalesce(b.d ** -0.5, 0)')} AS w FROM l JOIN dl a ON a.id = src LEFT JOIN dl b ON b.id = dst",
)
def norm_a_hat(spark: Spark, d: str) -> DataFrame:
    return _rounded(N.a_norm_hat(V.edges(spark, d), V.nodes(spark, d)))


@R.query(
    "norm_gcn_loops",
    V.ctes("e", "n", more=("l AS (SELECT * FROM e WHERE src <> dst UNION ALL SELECT id, id, 1.0 FROM n)", "dl AS (SELECT dst AS id, sum(w) AS d FROM l GROUP BY dst)"))
    + f"SELECT src, dst, {V.r('coalesce(a.d ** -0.5, 0) * w * b.d ** -0.5')} AS w FROM l LEFT JOIN dl a ON a.id = src JOIN dl b ON b.id = dst",
)
def norm_gcn_loops(spark: Spark, d: str) -> DataFrame:
    return _rounded(N.gcn_norm_loops(V.edges(spark, d), V.nodes(spark, d)))


@R.query(
    "norm_diag",
    V.ctes("e", "n", more=("l AS (SELECT src, dst, 1.0::DOUBLE AS w FROM e WHERE src <> dst UNION ALL SELECT id, id, 0.5 FROM n)", "dl AS (SELECT src AS id, sum(w) AS d FROM l GROUP BY src)"))
    + f"SELECT src, dst, {V.r('a.d ** -0.5 * w * coalesce(b.d ** -0.5, 0)')} AS w FROM l JOIN dl a ON a.id = src LEFT JOIN dl b ON b.id = dst",
)
def norm_diag(spark: Spark, d: str) -> DataFrame:
    return _rounded(N.diag_norm(V.edges(spark, d), V.nodes(spark, d), 0.5))


@R.query("norm_side", V.ctes("e") + f"SELECT e.src, e.dst, {V.r('w / d')} AS w FROM e JOIN (SELECT dst, sum(w) AS d FROM e GROUP BY dst) s ON s.dst = e.dst")
def norm_side(spark: Spark, d: str) -> DataFrame:
    return _rounded(N.side_norm(V.edges(spark, d)))


_L = "l AS (SELECT * FROM e WHERE src <> dst), dl AS (SELECT src AS id, sum(w) AS d FROM l GROUP BY src)"
for _kind, _off, _diag in (
    (None, "-w", "coalesce(dl.d, 0)"),
    ("sym", "-(a.d ** -0.5 * w * coalesce(b.d ** -0.5, 0))", "1.0"),
    ("rw", "-(w / a.d)", "1.0"),
):

    def _laplacian(spark: Spark, d: str, kind: str | None = _kind) -> DataFrame:
        return _rounded(N.laplacian(V.edges(spark, d), V.nodes(spark, d), kind))

    R.query(
        f"laplacian_{_kind or 'plain'}",
        V.ctes("e", "n", more=(_L,)) + f"SELECT src, dst, {V.r(_off)} AS w FROM l JOIN dl a ON a.id = src LEFT JOIN dl b ON b.id = dst "
        f"UNION ALL SELECT n.id, n.id, {V.r(_diag)} FROM n LEFT JOIN dl ON dl.id = n.id",
    )(_laplacian)


@R.query(
    "laplacian_scaled",
    V.ctes("e", "n", more=(_L, "s AS (SELECT src, dst, -(a.d ** -0.5 * w * coalesce(b.d ** -0.5, 0)) AS w FROM l JOIN dl a ON a.id = src LEFT JOIN dl b ON b.id = dst UNION ALL SELECT id, id, 1.0 FROM n UNION ALL SELECT id, id, -1.0 FROM n)"))
    + f"SELECT src, dst, {V.r('sum(w)')} AS w FROM s GROUP BY src, dst",
)
def laplacian_scaled(spark: Spark, d: str) -> DataFrame:
    return _rounded(N.scaled_laplacian(V.edges(spark, d), V.nodes(spark, d)))


@R.query(
    "laplacian_fuzzy",
    V.ctes("e", more=("f AS (SELECT src, dst, cos(w) ** 2 AS o, sin(w) ** 2 AS i FROM e)", "s AS (SELECT src, sum(o) AS so, sum(i) AS si FROM f GROUP BY src)", "t AS (SELECT dst, sum(o) AS d_o, sum(i) AS d_i FROM f GROUP BY dst)"))
    + f"SELECT f.src, f.dst, {V.r('o * so ** -0.5 * d_o ** -0.5')} AS w_out, {V.r('i * si ** -0.5 * d_i ** -0.5')} AS w_in FROM f JOIN s ON s.src = f.src JOIN t ON t.dst = f.dst",
)
def laplacian_fuzzy(spark: Spark, d: str) -> DataFrame:
    f = N.fuzzy_laplacian(V.edges(spark, d).withColumnRenamed("w", "theta"))
    return f.select("src", "dst", V.real("w_out").alias("w_out"), V.real("w_in").alias("w_in"))


for _side in ("src", "dst"):

    def _diag_mul(spark: Spark, d: str, side: str = _side) -> DataFrame:
        f = V.labels(spark, d).select("id", (F.col("y") + 0.5).alias("f"))
        return _rounded(N.scale_by_node(V.edges(spark, d), f, side))

    R.query(
        "diag_times_sparse" if _side == "src" else "sparse_times_diag",
        V.ctes("e", "y") + f"SELECT src, dst, {V.r('w * coalesce(y.y + 0.5, 0)')} AS w FROM e LEFT JOIN y ON y.id = e.{_side}",
    )(_diag_mul)


# --- products -----------------------------------------------------------------------

for _how, _sql in (("sum", "sum(e.w * s.v)"), ("mean", "avg(e.w * s.v)"), ("max", "max(e.w * s.v)"), ("min", "min(e.w * s.v)")):

    def _gspmm(spark: Spark, d: str, how: str = _how) -> DataFrame:
        return V.long(S.gspmm(V.edges(spark, d), V.features(spark, d), V.WIDTH, how))

    R.query(f"gspmm_{_how}", V.ctes("e", "xl") + f"SELECT id, k, {V.r('value')} AS value FROM ({V.product(how=_sql)})")(_gspmm)


@R.query(
    "gspmm_max_arg",
    V.ctes("e", "y", more=("m AS (SELECT e.dst AS id, e.src, e.w * (y.y + 1) AS v FROM e JOIN y ON y.id = e.src)",))
    + f"SELECT id, {V.r('max(v)')} AS value, min(src) FILTER (v = top) AS arg FROM (SELECT *, max(v) OVER (PARTITION BY id) AS top FROM m) GROUP BY id",
)
def gspmm_max_arg(spark: Spark, d: str) -> DataFrame:
    y = V.labels(spark, d).select("id", (F.col("y") + 1).cast("double").alias("value"))
    return S.gspmm_max_arg(V.edges(spark, d), y).select("id", V.real("value").alias("value"), "arg")


@R.query(
    "bspmm",
    V.ctes("e", "xl") + f"SELECT e.dst AS id, h.h AS head, s.k, {V.r('sum(e.w * (h.h + 1) * s.v)')} AS value FROM e JOIN xl s ON s.id = e.src CROSS JOIN (SELECT unnest([0, 1]) AS h) h GROUP BY ALL",
)
def bspmm(spark: Spark, d: str) -> DataFrame:
    heads = F.explode(F.array(F.lit(0), F.lit(1)))
    e = V.edges(spark, d).withColumn("head", heads).withColumn("w", F.col("w") * (F.col("head") + 1))
    x = V.features(spark, d).select("id", F.posexplode("x").alias("k", "value")).withColumn("k", (F.col("k") + 1).cast("bigint")).withColumn("head", heads)
    return S.bspmm(e, x).withColumn("value", V.real("value"))


for _how, _sql in (("sum", "sum(s.v)"), ("mean", "avg(s.v)"), ("max", "max(s.v)")):

    def _propagate(spark: Spark, d: str, how: str = _how) -> DataFrame:
        return V.long(S.propagate(V.features(spark, d), V.edges(spark, d), V.WIDTH, None, how))

    R.query(f"propagate_{_how}", V.ctes("e", "xl") + f"SELECT id, k, {V.r('value')} AS value FROM ({V.product(how=_sql)})")(_propagate)


@R.query(
    "propagate_custom",
    V.ctes("e", "xl", more=("p AS (SELECT e.dst AS id, s.k, sum(tanh(s.v - t.v) * e.w) AS value FROM e JOIN xl s ON s.id = e.src JOIN xl t ON t.id = e.dst AND t.k = s.k GROUP BY e.dst, s.k)",))
    + f"SELECT u.id, u.k, {V.r('greatest(coalesce(p.value, 0), 0)')} AS value FROM xl u LEFT JOIN p ON p.id = u.id AND p.k = u.k",
)
def propagate_custom(spark: Spark, d: str) -> DataFrame:
    out = S.propagate(
        V.features(spark, d), V.edges(spark, d), V.WIDTH,
        message=lambda s, t: vec.scale(F.transform(vec.sub(s, t), F.tanh), F.col("w")),
        update=lambda x: F.transform(x, vec.relu), need_dst=True,
    )
    return V.long(out)


def _chain(step_sql: str, rounds: int, first: str) -> str:
    """CTEs z0 .. z_rounds; `step_sql` uses {p} for the one before."""
    out = [f"z0 AS ({first})"]
    for i in range(1, rounds + 1):
        out.append(f"z{i} AS ({step_sql.format(p=f'z{i - 1}')})")
    return ", ".join(out)


def _step(old: float, new: float, base: str = "z0", edge: str = "gn") -> str:
    return (
        f"SELECT b.id, b.k, {new!r} * coalesce(p.value, 0) + {old!r} * b.v AS v FROM {base} b LEFT JOIN (SELECT e.dst AS id, s.k, sum(e.w * s.v) AS value "
        f"FROM {edge} e JOIN {{p}} s ON s.id = e.src GROUP BY e.dst, s.k) p ON p.id = b.id AND p.k = b.k"
    )


@R.query("propagate_personalised", V.ctes("gn", "xl", more=(_chain(_step(0.1, 0.9), 4, "SELECT id, k, v FROM xl"),)) + f"SELECT id, k, {V.r('v')} AS value FROM z4")
def propagate_personalised(spark: Spark, d: str) -> DataFrame:
    return V.long(S.power_filter(N.gcn_norm(V.edges(spark, d)), V.features(spark, d), V.WIDTH, 4, 0.1, 0.9))


def _filter_sql(start_new: float, start_old: float, gain: float, alpha: float) -> str:
    first = _step(start_old, start_new, "xl").format(p="xl")
    return V.ctes("gn", "xl", more=(_chain(_step(alpha, gain), 3, first),)) + f"SELECT id, k, {V.r('v')} AS value FROM z3"


_C1 = 1 + 0.3 * 0.5 - 0.3
_C2 = 0.3 * 0.5 + 1


@R.query("filter_low_pass", _filter_sql((1 - 0.5) / _C1, 0.5 / _C1, (1 - 2 * 0.3 + 0.5 * 0.3) / _C1, 0.3))
def filter_low_pass(spark: Spark, d: str) -> DataFrame:
    return V.long(S.low_pass(N.gcn_norm(V.edges(spark, d)), V.features(spark, d), V.WIDTH, 3, 0.3, 0.5))


@R.query("filter_high_pass", _filter_sql(-0.5 / _C2, 1.5 / _C2, (0.3 * 0.5 + 1 - 0.3) / _C2, 0.3))
def filter_high_pass(spark: Spark, d: str) -> DataFrame:
    return V.long(S.high_pass(N.gcn_norm(V.edges(spark, d)), V.features(spark, d), V.WIDTH, 3, 0.3, 0.5))


@R.query(
    "diffusion_ppr",
    V.ctes("gn", more=(
        "s AS (SELECT node_id AS id FROM anchor_nodes WHERE scope = 'graph' AND node_id IS NOT NULL)",
        "z0 AS (SELECT DISTINCT id AS source, id, 1.0::DOUBLE AS v FROM s)",
        *[f"z{i} AS (SELECT source, e.dst AS id, sum(z.v * e.w) AS v FROM z{i - 1} z JOIN gn e ON e.src = z.id GROUP BY ALL)" for i in (1, 2, 3)],
    )) + f"SELECT source, id, {V.r('sum(c * v)')} AS value FROM (" + " UNION ALL ".join(f"SELECT source, id, {0.2 * 0.8**i!r} AS c, v FROM z{i}" for i in range(4)) + ") GROUP BY ALL",
)
def diffusion_ppr(spark: Spark, d: str) -> DataFrame:
    seeds = read(spark, d, "anchor_nodes").filter("scope = 'graph' and node_id is not null").select(F.col("node_id").alias("id")).distinct()
    return S.pagerank_diffusion(N.gcn_norm(V.edges(spark, d)), seeds, 0.2, 3).withColumn("value", V.real("value"))


@R.query(
    "spectral_energy",
    V.ctes("e", "n", "x", more=(_L, "s AS (SELECT src, dst, -(a.d ** -0.5 * w * coalesce(b.d ** -0.5, 0)) AS w FROM l JOIN dl a ON a.id = src LEFT JOIN dl b ON b.id = dst UNION ALL SELECT id, id, 1.0 FROM n)"))
    + f"SELECT {V.r('(SELECT sum(s.w * list_dot_product(a.x, b.x)) FROM s JOIN x a ON a.id = s.src JOIN x b ON b.id = s.dst) / (SELECT sum(list_dot_product(x, x)) FROM x)')} AS value",
)
def spectral_energy(spark: Spark, d: str) -> DataFrame:
    lap = N.laplacian(V.edges(spark, d), V.nodes(spark, d), "sym")
    return S.spectral_energy(lap, V.features(spark, d)).select(V.real("value").alias("value"))


@R.query(
    "gaussian_gradient",
    V.ctes("e", "x", "xl", more=("d AS (SELECT e.src, e.dst, exp(-(list_dot_product(a.x, a.x) + list_dot_product(b.x, b.x) - 2 * list_dot_product(a.x, b.x)) / 18) AS c FROM e JOIN x a ON a.id = e.src JOIN x b ON b.id = e.dst)",
        "p AS (SELECT d.dst AS id, s.k, sum(c * (s.v - t.v)) AS value FROM d JOIN xl s ON s.id = d.src JOIN xl t ON t.id = d.dst AND t.k = s.k GROUP BY d.dst, s.k)"))
    + f"SELECT u.id, u.k, {V.r('coalesce(p.value, 0)')} AS value FROM xl u LEFT JOIN p ON p.id = u.id AND p.k = u.k",
)
def gaussian_gradient(spark: Spark, d: str) -> DataFrame:
    return V.long(S.gaussian_gradient(V.edges(spark, d), V.features(spark, d), V.WIDTH, 3.0))


@R.query(
    "transition_probabilities",
    V.ctes("t", more=(
        "p AS (SELECT a.src, a.dst, sum(a.w / s.s) AS p FROM t a JOIN (SELECT src, sum(w) AS s FROM t WHERE edge_type = 'cites' GROUP BY src) s ON s.src = a.src WHERE edge_type = 'cites' GROUP BY ALL)",
        "q AS (SELECT a.src, a.dst, sum(a.w / s.s) AS p FROM t a JOIN (SELECT src, sum(w) AS s FROM t WHERE edge_type = 'links' GROUP BY src) s ON s.src = a.src WHERE edge_type = 'links' GROUP BY ALL)",
    )) + f"SELECT p.src, q.dst, {V.r('sum(p.p * q.p)')} AS p FROM p JOIN q ON q.src = p.dst GROUP BY ALL",
)
def transition_probabilities(spark: Spark, d: str) -> DataFrame:
    t = V.typed(spark, d)
    return S.transition([t.filter("edge_type = 'cites'"), t.filter("edge_type = 'links'")]).withColumn("p", V.real_many("p"))
