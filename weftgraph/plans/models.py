"""Queries of whole models' forward passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import vec
from weftgraph.nn import layers as L
from weftgraph.nn import models as M
from weftgraph.plans import views as V
from weftgraph.plans.layers import A4, B4, BIAS, ENDS, LAYERS, W42, W44, W44B, W84, _CNT, attend, dot, each, gathered, h_ends, leaky, listed, out, out_long, zipped
from weftgraph.plans.layers import R as LAYER_QUERIES
from weftgraph.plans.registry import Registry
from weftgraph.plans.structure import _chain, _step

R = Registry()
Spark = SparkSession


def _gcn(src: str, weight, width: int = 4) -> str:
    """SQL: (id, k, v) of one graph convolution of a table (id, x)."""
    return gathered(f"SELECT e.dst, list_transform({V.lin('q.x', weight)}, lambda c: c * e.w * cs.c ** -0.5 * cd.c ** -0.5) AS m FROM e JOIN {src} q ON q.id = e.src JOIN cs ON cs.id = e.src JOIN cd ON cd.id = e.dst", width=width)


# --- models that are a sequence of layers ----------------------------------------------

_ACTS = {"relu": (vec.relu, "greatest(value, 0)"), "elu": (vec.elu, "CASE WHEN value > 0 THEN value ELSE exp(value) - 1 END"), "tanh": (F.tanh, "tanh(value)")}
_DENSE = V.ctes("x") + out(f"SELECT id, {zipped(V.lin('x', W44B), V.lst(BIAS), 'z[1] + z[2]')} AS x FROM x")

#: Layers, activations and dense maps of each model, first to last; a pair is the mean of two branches.
SEQUENCES = {
    "agnn": ("dense", "relu", "layer_agnn", "layer_agnn", "dense"),
    "appnp": ("dense", "relu", "layer_appnp"),
    "chebnet": ("layer_cheb", "relu", "layer_cheb"),
    "coed": ("layer_coed", "relu", "layer_coed", "dense"),
    "compgcn": ("layer_compgcn", "tanh", "layer_compgcn"),
    "dgcnn": ("layer_edge_conv", "layer_edge_conv", "dense"),
    "dna": ("dense", "relu", "layer_dna", "dense"),
    "fagcn": ("dense", "relu", "layer_fagcn", "layer_fagcn", "dense"),
    "film": ("layer_film", "relu", "layer_film"),
    "fusedgat": ("layer_gat", "elu", "layer_gat"),
    "gaan": ("layer_gaan", "relu", "layer_gaan"),
    "gatv2": ("layer_gatv2", "elu", "layer_gatv2"),
    "gcnii": ("dense", "relu", "layer_gcnii", "relu", "dense"),
    "gmm": ("layer_gmm", "relu", "layer_gmm"),
    "gnn_unifews": ("layer_gcn_pruned", "relu", "layer_gcn_pruned"),
    "gprgnn": ("dense", "relu", "dense", "layer_gpr"),
    "han": ("layer_han", "dense"),
    "hardgat": ("layer_hard_gat", "elu", "layer_hard_gat"),
    "hcha": ("layer_hypergraph", "relu", "layer_hypergraph"),
    "heat": ("layer_heat", "relu", "layer_heat"),
    "hgt": ("dense", "relu", "layer_hgt", "layer_hgt", "dense"),
    "hid_net": ("dense", "relu", "layer_hid", "dense"),
    "hpn": ("layer_hpn", "dense"),
    "iehgcn": ("layer_iehgcn", "relu", "layer_iehgcn", "dense"),
    "magcl": ("layer_magcl", "relu", "layer_magcl"),
    "mixhop": ("layer_mixhop", "relu", "layer_mixhop", "dense"),
    "pna": ("layer_pna", "relu", "layer_pna", "dense"),
    "rgcn": ("layer_rgcn", "relu", "layer_rgcn"),
    "rohehan": ("layer_rohe_gat", "elu", "dense"),
    "sage": ("layer_sage_mean", "relu", "layer_sage_mean"),
    "sage_pool": ("layer_sage_pool", "relu", "layer_sage_pool"),
    "sgformer": ("dense", "relu", ("layer_linear_attention", "layer_gcn"), "dense"),
    "simplehgn": ("layer_simple_hgn", "elu", "layer_simple_hgn", "unit"),
}


def _over(sql: str, inner: str | None) -> str:
    """SQL of a layer over the result (id, k, value) of another, unrounded."""
    sql = sql.replace(V.r("v"), "v")
    return sql if inner is None else sql.replace(V.CTE["x"], f"x AS MATERIALIZED (SELECT id, list(value ORDER BY k) AS x FROM ({inner}) GROUP BY id)")


def sequence_sql(steps) -> str:
    sql = None
    for s in steps:
        if isinstance(s, tuple):
            a, b = (_over(LAYER_QUERIES.sql[n], sql) for n in s)
            sql = f"SELECT a.id, a.k, 0.5 * a.value + 0.5 * b.value AS value FROM ({a}) a JOIN ({b}) b ON b.id = a.id AND b.k = a.k"
        elif s in _ACTS:
            sql = f"SELECT id, k, {_ACTS[s][1]} AS value FROM ({sql})"
        elif s == "unit":
            sql = f"SELECT id, k, coalesce(value / nullif(sqrt(sum(value * value) OVER (PARTITION BY id)), 0), 0) AS value FROM ({sql})"
        else:
            sql = _over(_DENSE if s == "dense" else LAYER_QUERIES.sql[s], sql)
    return f"SELECT id, k, {V.r('value')} AS value FROM ({sql})"


def _step_of(s, edges: DataFrame, typed: DataFrame) -> M.Layer:
    if isinstance(s, tuple):
        a, b = (_step_of(n, edges, typed) for n in s)
        return lambda x: M.weighed(x, a, b, 0.5)
    if s in _ACTS:
        return lambda x: x.select("id", F.transform("x", _ACTS[s][0]).alias("x"))
    if s == "unit":
        return M.unit_rows
    if s == "dense":
        return lambda x: L.dense(x, W44B, BIAS)
    f, is_typed = LAYERS[s]
    return lambda x: f(x, typed if is_typed else edges)


for _name, _steps in SEQUENCES.items():

    def _sequence(spark: Spark, d: str, steps=_steps) -> DataFrame:
        e, t = V.edges(spark, d), V.typed(spark, d)
        return V.long(M.sequence(V.features(spark, d), [_step_of(s, e, t) for s in steps]))

    R.query(f"model_{_name}", sequence_sql(_steps))(_sequence)

# --- others ---------------------------------------------------------------------------

_RELU = "greatest(c, 0)"
_H1 = f"h1 AS (SELECT id, {each('x', _RELU)} AS x FROM ({listed(_gcn('x', W44))}))"


@R.query("model_gcn", V.ctes("e", "x", more=(_CNT, _H1)) + out(listed(_gcn("h1", W44B))))
def model_gcn(spark: Spark, d: str) -> DataFrame:
    return V.long(M.gcn(V.features(spark, d), V.edges(spark, d), [W44, W44B]))


@R.query("model_mlp", V.ctes("x") + out(f"SELECT id, {zipped(V.lin(each(zipped(V.lin('x', W44), V.lst(BIAS), 'z[1] + z[2]'), _RELU), W44B), V.lst(A4), 'z[1] + z[2]')} AS x FROM x"))
def model_mlp(spark: Spark, d: str) -> DataFrame:
    return V.long(M.mlp(V.features(spark, d), [W44, W44B], [BIAS, A4]))


@R.query("model_jknet", V.ctes("e", "x", more=(_CNT, _H1, f"h2 AS (SELECT id, {each('x', _RELU)} AS x FROM ({listed(_gcn('h1', W44B))}))")) + out(f"SELECT h1.id, {V.lin('list_concat(h1.x, h2.x)', W84)} AS x FROM h1 JOIN h2 ON h2.id = h1.id"))
def model_jknet(spark: Spark, d: str) -> DataFrame:
    return V.long(M.jknet(V.features(spark, d), V.edges(spark, d), [W44, W44B], W84))


@R.query(
    "model_vgae",
    V.ctes("e", "x", more=(_CNT, _H1, f"zz AS ({listed(_gcn('h1', W42, 2))})"))
    + f"SELECT p.src, p.dst, {V.r('1 / (1 + exp(-list_dot_product(a.x, b.x)))')} AS score FROM (SELECT DISTINCT src, dst FROM e) p JOIN zz a ON a.id = p.src JOIN zz b ON b.id = p.dst",
)
def model_vgae(spark: Spark, d: str) -> DataFrame:
    e = V.edges(spark, d)
    return M.vgae(V.features(spark, d), e, W44, W42, e.select("src", "dst").distinct()).withColumn("score", V.real("score"))


_SIGN1 = f"s1 AS ({listed('SELECT b.id, b.k, coalesce(p.value, 0) AS v FROM xl b LEFT JOIN (SELECT e.dst AS id, s.k, sum(e.w * s.v) AS value FROM gn e JOIN xl s ON s.id = e.src GROUP BY e.dst, s.k) p ON p.id = b.id AND p.k = b.k')})"


@R.query("model_sign", V.ctes("gn", "x", "xl", more=(_SIGN1,)) + out(f"SELECT x.id, {V.lin('list_concat(' + each(V.lin('x.x', W44), _RELU) + ', ' + each(V.lin('s1.x', W44B), _RELU) + ')', W84)} AS x FROM x JOIN s1 ON s1.id = x.id"))
def model_sign(spark: Spark, d: str) -> DataFrame:
    return V.long(M.sign(V.features(spark, d), V.edges(spark, d), 4, 1, [W44, W44B], W84))


_GING = f"gi AS (SELECT id, list(v ORDER BY k) AS x FROM (SELECT p.id, p.k, p.v + xl.v AS v FROM ({gathered('SELECT e.dst, x.x AS m FROM e JOIN x ON x.id = e.src')}) p JOIN xl ON xl.id = p.id AND xl.k = p.k) GROUP BY id)"


@R.query(
    "model_gin_graphs",
    V.ctes("e", "x", "xl", "g", more=(_GING, f"go AS (SELECT gi.id, g.graph_id, unnest(range(1, 5)) AS k, unnest({V.lin('gi.x', W44)}) AS v FROM gi JOIN g ON g.id = gi.id)",
        "gp AS (SELECT graph_id AS id, list(v ORDER BY k) AS x FROM (SELECT graph_id, k, sum(v) AS v FROM go GROUP BY ALL) GROUP BY 1)")) + out(f"SELECT id, {V.lin(each(V.lin('x', W44), _RELU), W42)} AS x FROM gp", 2),
)
def model_gin_graphs(spark: Spark, d: str) -> DataFrame:
    return V.long(M.gin_graphs(V.features(spark, d), V.edges(spark, d), V.graphs(spark, d), 4, [[W44]], [W44, W42]))


@R.query("model_skipgram_loss", V.ctes("e", "x") + f"SELECT p.src, p.dst, {V.r('ln(1 + exp(-abs(s))) + greatest(-s, 0)')} AS loss FROM (SELECT q.src, q.dst, list_dot_product(a.x, b.x) AS s FROM (SELECT DISTINCT src, dst FROM e) q JOIN x a ON a.id = q.src JOIN x b ON b.id = q.dst) p")
def model_skipgram_loss(spark: Spark, d: str) -> DataFrame:
    return M.skipgram_loss(V.edges(spark, d).select("src", "dst").distinct(), V.features(spark, d)).withColumn("loss", V.real("loss"))


_GAT2 = V.ctes("e", "x", more=(ENDS, h_ends(W44B), *attend("g1", f"SELECT dst, {leaky(dot('xs', A4) + ' + ' + dot('xd', B4))} AS s, xs AS m FROM eh"))) + out_long(gathered("FROM g1"))
_GAT1 = f"SELECT id, k, {_ACTS['elu'][1]} AS value FROM ({_over(LAYER_QUERIES.sql['layer_gat'], None)})"


@R.query("model_gat", f"SELECT id, k, {V.r('value')} AS value FROM ({_over(_GAT2, _GAT1)})")
def model_gat(spark: Spark, d: str) -> DataFrame:
    return V.long(M.gat(V.features(spark, d), V.edges(spark, d), [W44, W44B], [[A4, B4], [A4 + B4]], [2, 1]))


@R.query("model_sgc", V.ctes("gn", "x", more=(_chain(_step(0.0, 1.0), 2, f"SELECT id, unnest(range(1, 5)) AS k, unnest({V.lin('x', W44)}) AS v FROM x"),)) + f"SELECT id, k, {V.r('v')} AS value FROM z2")
def model_sgc(spark: Spark, d: str) -> DataFrame:
    return V.long(M.sgc(V.features(spark, d), V.edges(spark, d), W44, 2))


_DGI = (
    _CNT, _H1, f"rx AS (SELECT id, list_reverse(x) AS x FROM x)", f"h2 AS (SELECT id, {each('x', _RELU)} AS x FROM ({listed(_gcn('rx', W44))}))",
    "me AS (SELECT list(1 / (1 + exp(-m)) ORDER BY k) AS x FROM (SELECT k, avg(v) AS m FROM (SELECT unnest(range(1, 5)) AS k, unnest(x) AS v FROM h1) GROUP BY k))",
    f"su AS (SELECT {V.lin('x', W44B)} AS s FROM me)",
)


@R.query("model_dgi_scores", V.ctes("e", "x", more=_DGI) + f"SELECT h1.id, {V.r('list_dot_product(h1.x, su.s)')} AS real, {V.r('list_dot_product(h2.x, su.s)')} AS fake FROM h1 JOIN h2 ON h2.id = h1.id, su")
def model_dgi_scores(spark: Spark, d: str) -> DataFrame:
    """Corruption: each vector reversed."""
    x = V.features(spark, d)
    s = M.dgi_scores(x, x.select("id", F.reverse("x").alias("x")), V.edges(spark, d), W44, W44B)
    return s.select("id", V.real("real").alias("real"), V.real("fake").alias("fake"))


_EP = [
    "c AS (SELECT src, dst, sum(matched::INT) AS seen, count(*) AS tries FROM graph_matches WHERE src IS NOT NULL AND dst IS NOT NULL AND matched IS NOT NULL GROUP BY ALL)",
    "p0 AS (SELECT c.*, a.y AS cu, b.y AS cv, seen / tries AS q FROM c JOIN y a ON a.id = c.src JOIN y b ON b.id = c.dst)",
]
for _i in range(3):
    _UP, _LOW = "o * a ** seen * (1 - a) ** (tries - seen)", "(1 - o) * b ** seen * (1 - b) ** (tries - seen)"
    _EP += [
        f"ab{_i} AS (SELECT sum(q * seen) / sum(q * tries) AS a, sum((1 - q) * seen) / sum((1 - q) * tries) AS b FROM p{_i})",
        f"o{_i} AS (SELECT cu, cv, avg(q) AS o FROM p{_i} GROUP BY ALL)",
        f"p{_i + 1} AS (SELECT src, dst, seen, tries, p.cu, p.cv, coalesce(({_UP}) / nullif(({_UP}) + ({_LOW}), 0), q) AS q FROM p{_i} p JOIN o{_i} r ON r.cu = p.cu AND r.cv = p.cv, ab{_i})",
    ]


@R.query("model_edge_posterior", V.ctes("y", more=tuple(_EP)) + f"SELECT src, dst, {V.r('q')} AS q FROM p3")
def model_edge_posterior(spark: Spark, d: str) -> DataFrame:
    """Repeated matches as observations of a link."""
    from weftgraph.core.session import read

    m = read(spark, d, "graph_matches").filter("src is not null and dst is not null and matched is not null")
    c = m.groupBy("src", "dst").agg(F.sum(F.col("matched").cast("int")).alias("seen"), F.count(F.lit(1)).alias("tries"))
    return M.edge_posterior(c, V.labels(spark, d), 3).withColumn("q", V.real("q"))
