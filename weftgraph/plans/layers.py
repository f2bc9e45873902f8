"""Queries of the convolution layers' forward passes, with weights from a rule."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import vec
from weftgraph.nn import layers as L
from weftgraph.operators import norm as N
from weftgraph.operators import spmm as S
from weftgraph.plans import views as V
from weftgraph.plans.registry import Registry
from weftgraph.plans.sampling import _BFS, _tree, every
from weftgraph.plans.structure import _chain, _step

R = Registry()
Spark = SparkSession

M = V.matrix
W44, W44B, W42, W24 = M(4, 4), M(4, 4, 2, 3, 9), M(4, 2), M(2, 4)
W84, W88 = M(8, 4), M(8, 8)
A4, B4 = [0.3, -0.2, 0.1, 0.4], [0.1, 0.2, -0.3, 0.2]
BIAS = [0.1, -0.1, 0.2, 0.0]
RELS = ["cites", "links", "similar", "follows"]
E_ = "e"


def leaky(x: str, slope: float = 0.2) -> str:
    return f"(CASE WHEN ({x}) >= 0 THEN ({x}) ELSE ({x}) * {slope!r} END)"


def each(x: str, f: str) -> str:
    """SQL: f of every component c of the list x."""
    return f"list_transform({x}, lambda c: {f})"


def zipped(x: str, y: str, f: str) -> str:
    """SQL: f of every pair z[1], z[2] of two lists."""
    return f"list_transform(list_zip({x}, {y}), lambda z: {f})"


def dot(x: str, w) -> str:
    return f"list_dot_product({x}, {V.lst(w)})"


def gathered(msg: str, how: str = "sum(v)", width: int = 4, fill: str = "0.0") -> str:
    """SQL: messages (dst, m) reduced by dst over all of x, as (id, k, v)."""
    return (
        f"SELECT u.id, u.k, coalesce(p.v, {fill}) AS v FROM (SELECT id, unnest(range(1, {width + 1})) AS k FROM x) u LEFT JOIN (SELECT dst AS id, k, {how} AS v "
        f"FROM (SELECT dst, unnest(range(1, {width + 1})) AS k, unnest(m) AS v FROM ({msg})) GROUP BY ALL) p ON p.id = u.id AND p.k = u.k"
    )


def listed(long: str) -> str:
    return f"SELECT id, list(v ORDER BY k) AS x FROM ({long}) GROUP BY id"


def out(select: str, width: int = 4) -> str:
    """SQL: (id, x) to what queries return."""
    return f"SELECT id, k, {V.r('v')} AS value FROM (SELECT id, unnest(range(1, {width + 1})) AS k, unnest(x) AS v FROM ({select}))"


def out_long(select: str) -> str:
    return f"SELECT id, k, {V.r('v')} AS value FROM ({select})"


def attend(name: str, scored: str, eps: str = "1e-16", by: str = "dst") -> list[str]:
    """CTEs: scored (dst, s, m) -> `name` (dst, m) with m weighed by the softmax of s within dst."""
    on = " AND ".join(f"q.{c} = t.{c}" for c in by.split(", "))
    return [
        f"{name}_s AS ({scored})",
        f"{name}_t AS (SELECT {by}, max(s) AS t FROM {name}_s GROUP BY {by})",
        f"{name}_z AS (SELECT {', '.join('q.' + c for c in by.split(', '))}, any_value(t.t) AS t, sum(exp(q.s - t.t)) + {eps} AS z FROM {name}_s q JOIN {name}_t t ON {on} GROUP BY {', '.join('q.' + c for c in by.split(', '))})",
        f"{name} AS (SELECT q.dst, list_transform(q.m, lambda c: c * exp(q.s - t.t) / t.z) AS m FROM {name}_s q JOIN {name}_z t ON {on})",
    ]


ENDS = "en AS (SELECT e.src, e.dst, e.w, a.x AS xs, b.x AS xd FROM e JOIN x a ON a.id = e.src JOIN x b ON b.id = e.dst)"


def h_ends(weight, name: str = "eh") -> str:
    return f"{name} AS (SELECT src, dst, w, {V.lin('xs', weight)} AS xs, {V.lin('xd', weight)} AS xd FROM en)"


def data(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    return V.features(spark, d), V.edges(spark, d)


#: Layers as functions of (nodes, edges or typed edges), for whole models: name -> (function, typed).
LAYERS: dict = {}


def layer(name: str, sql: str | None = None, width: int = 4):
    """Register a layer: a function of (nodes, edges) that returns (id, x)."""

    def add(f):
        LAYERS[name] = f, False
        R.query(name, sql)(lambda spark, d: V.long(f(*data(spark, d))))
        return f

    return add


_CNT = "cs AS (SELECT src AS id, count(*) AS c FROM e GROUP BY 1), cd AS (SELECT dst AS id, count(*) AS c FROM e GROUP BY 1)"


@layer("layer_gcn", V.ctes("e", "x", more=(_CNT,)) + out_long(gathered(f"SELECT e.dst, list_transform({V.lin('x.x', W44)}, lambda c: c * e.w * cs.c ** -0.5 * cd.c ** -0.5) AS m FROM e JOIN x ON x.id = e.src JOIN cs ON cs.id = e.src JOIN cd ON cd.id = e.dst")))
def layer_gcn(x, e):
    return L.gcn(x, e, W44)


_G1 = attend("g1", f"SELECT dst, {leaky(dot('xs[1:2]', A4[:2]) + ' + ' + dot('xd[1:2]', A4[2:]))} AS s, xs[1:2] AS m FROM eh")
_G2 = attend("g2", f"SELECT dst, {leaky(dot('xs[3:4]', B4[:2]) + ' + ' + dot('xd[3:4]', B4[2:]))} AS s, xs[3:4] AS m FROM eh")


@layer("layer_gat", V.ctes("e", "x", more=(ENDS, h_ends(W44), *_G1, *_G2)) + f"SELECT id, k, {V.r('v')} AS value FROM ({gathered('FROM g1', width=2)}) UNION ALL SELECT id, k + 2, {V.r('v')} FROM ({gathered('FROM g2', width=2)})")
def layer_gat(x, e):
    return L.gat(x, e, W44, [A4, B4], heads=2)


_V2 = attend("g1", f"SELECT dst, ({dot(each('xs', leaky('c')), A4)} + {dot(each('xd', leaky('c')), B4)}) / 4 AS s, xs AS m FROM eh")


@layer("layer_gatv2", V.ctes("e", "x", more=(ENDS, h_ends(W44), *_V2)) + out_long(gathered("FROM g1")))
def layer_gatv2(x, e):
    return L.gatv2(x, e, W44, [A4], [B4])


_PN = math.sqrt(sum(v * v for v in A4))
_HG = (
    f"sy AS (SELECT id, x, abs({dot('x', A4)}) / {_PN!r} AS y FROM x)",
    "hk AS (SELECT src, dst FROM (SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.dst ORDER BY sy.y DESC, e.src) AS r FROM (SELECT DISTINCT src, dst FROM e) e JOIN sy ON sy.id = e.src) WHERE r <= 4)",
    f"gx AS (SELECT id, {V.lin(each('x', 'c / (1 + exp(-y))'), W44)} AS x FROM sy)",
    *attend("g1", f"SELECT hk.dst, {leaky(dot('a.x', A4) + ' + ' + dot('b.x', B4))} AS s, a.x AS m FROM hk JOIN gx a ON a.id = hk.src JOIN gx b ON b.id = hk.dst"),
)


@layer("layer_hard_gat", V.ctes("e", "x", more=_HG) + out_long(gathered("FROM g1")))
def layer_hard_gat(x, e):
    return L.hard_gat(x, e.select("src", "dst").distinct(), A4, 4, W44, A4, B4)


_L1 = each(V.lin("x", W44), leaky("c", 0.1))
_GA = (
    f"gl AS (SELECT id, x, {_L1} AS l, {V.lin('x', W42)} AS mx FROM x)",
    "gj AS (SELECT e.dst, a.l AS ls, a.mx AS ms, b.l AS ld FROM e JOIN gl a ON a.id = e.src JOIN gl b ON b.id = e.dst)",
    *attend("g1", f"SELECT dst, {leaky(dot('ls[1:2]', A4[:2]) + ' + ' + dot('ld[1:2]', B4[:2]), 0.1)} AS s, ls[1:2] AS m FROM gj"),
    *attend("g2", f"SELECT dst, {leaky(dot('ls[3:4]', A4[2:]) + ' + ' + dot('ld[3:4]', B4[2:]), 0.1)} AS s, ls[3:4] AS m FROM gj"),
    f"ga AS ({listed(gathered('FROM g1', width=2))})", f"gb AS ({listed(gathered('FROM g2', width=2))})",
    f"gc AS ({listed(gathered('SELECT dst, ms AS m FROM gj', 'max(v)', 2))})", f"gd AS ({listed(gathered('SELECT dst, ls AS m FROM gj', 'avg(v)', 4))})",
    f"gg AS (SELECT x.id, x.x, ga.x AS a, gb.x AS b, {each(V.lin('list_concat(list_concat(x.x, gc.x), gd.x)', M(10, 2)), '1 / (1 + exp(-c))')} AS g FROM x JOIN ga ON ga.id = x.id JOIN gb ON gb.id = x.id JOIN gc ON gc.id = x.id JOIN gd ON gd.id = x.id)",
)


@layer("layer_gaan", V.ctes("e", "x", more=_GA) + out(f"SELECT id, {V.lin('list_concat(list_concat(x, ' + each('a', 'c * g[1]') + '), ' + each('b', 'c * g[2]') + ')', W84)} AS x FROM gg"))
def layer_gaan(x, e):
    return L.gaan(x, e, W44, W42, [A4[:2], A4[2:]], [B4[:2], B4[2:]], M(10, 2), W84, 2)


_AG = attend("g1", "SELECT dst, 1.5 * coalesce(list_dot_product(xs, xd) / nullif(sqrt(list_dot_product(xs, xs)) * sqrt(list_dot_product(xd, xd)), 0), 0) AS s, xs AS m FROM en")


@layer("layer_agnn", V.ctes("e", "x", more=(ENDS, *_AG)) + out_long(gathered("FROM g1")))
def layer_agnn(x, e):
    return L.agnn(x, e, 1.5, 4)


def _plus_own(long: str, weight) -> str:
    return f"SELECT p.id, p.k, p.v + o.v AS v FROM ({long}) p JOIN (SELECT id, unnest(range(1, 5)) AS k, unnest({V.lin('x', weight)}) AS v FROM x) o ON o.id = p.id AND o.k = p.k"


@layer("layer_sage_mean", V.ctes("e", "x") + out_long(_plus_own(gathered(f"SELECT e.dst, {V.lin('x.x', W44)} AS m FROM e JOIN x ON x.id = e.src", "avg(v)"), W44B)))
def layer_sage_mean(x, e):
    return L.sage(x, e, W44, W44B)


_PM = each(V.lin("x.x", W44), "greatest(c, 0)")
_PL = f"pl AS ({listed(gathered('SELECT e.dst, ' + _PM + ' AS m FROM e JOIN x ON x.id = e.src', 'max(v)'))})"


@layer("layer_sage_pool", V.ctes("e", "x", more=(_PL,)) + out_long(_plus_own(f"SELECT id, unnest(range(1, 5)) AS k, unnest({V.lin('x', W44B)}) AS v FROM pl", W44B)))
def layer_sage_pool(x, e):
    return L.sage(x, e, W44B, W44B, "pool", W44)


_SG = ("l AS (SELECT src, dst, 1.0 AS w FROM e UNION ALL SELECT id, id, 1.0 FROM x)", "dl AS (SELECT src AS id, sum(w) AS d FROM l GROUP BY src)",
       "ln AS (SELECT src, dst, a.d ** -0.5 * w * coalesce(b.d ** -0.5, 0) AS w FROM l JOIN dl a ON a.id = src LEFT JOIN dl b ON b.id = dst)")


@layer("layer_sage_gcn", V.ctes("e", "x", more=_SG) + out_long(gathered(f"SELECT l.dst, list_transform({V.lin('x.x', W44)}, lambda c: c * l.w) AS m FROM ln l JOIN x ON x.id = l.src")))
def layer_sage_gcn(x, e):
    return L.sage(x, e, W44, aggr="gcn")


_GI = f"gi AS (SELECT id, list(v ORDER BY k) AS x FROM (SELECT p.id, p.k, p.v + 1.1 * xl.v AS v FROM ({gathered('SELECT e.dst, x.x AS m FROM e JOIN x ON x.id = e.src')}) p JOIN xl ON xl.id = p.id AND xl.k = p.k) GROUP BY id)"


@layer("layer_gin", V.ctes("e", "x", "xl", more=(_GI,)) + out(f"SELECT id, {V.lin(each(V.lin('x', W44), 'greatest(c, 0)'), W44B)} AS x FROM gi"))
def layer_gin(x, e):
    return L.gin(x, e, 4, 0.1, [W44, W44B])


def _hl(weight) -> str:
    return f"SELECT id, unnest(range(1, 5)) AS k, unnest({V.lin('x', weight)}) AS v FROM x"


@layer("layer_sgc", V.ctes("gn", "x", more=(_chain(_step(0.0, 1.0), 2, _hl(W44)),)) + out_long("SELECT * FROM z2"))
def layer_sgc(x, e):
    return L.sgc(x, N.gcn_norm(e), W44, 2)


@layer("layer_appnp", V.ctes("gn", "x", more=(_chain(_step(0.2, 0.8), 3, _hl(W44)),)) + out_long("SELECT * FROM z3"))
def layer_appnp(x, e):
    return L.appnp(x, N.gcn_norm(e), W44, 3, 0.2)


_CH = (
    "l AS (SELECT e.* FROM e JOIN x a ON a.id = e.src JOIN x b ON b.id = e.dst WHERE e.src <> e.dst)", "dl AS (SELECT src AS id, sum(w) AS d FROM l GROUP BY src)",
    "cl AS (SELECT src, dst, -(a.d ** -0.5 * w * coalesce(b.d ** -0.5, 0)) AS w FROM l JOIN dl a ON a.id = src LEFT JOIN dl b ON b.id = dst)",
    f"t1 AS ({listed(gathered('SELECT cl.dst, list_transform(x.x, lambda c: c * cl.w) AS m FROM cl JOIN x ON x.id = cl.src'))})",
    f"q2 AS ({listed(gathered('SELECT cl.dst, list_transform(t1.x, lambda c: c * cl.w) AS m FROM cl JOIN t1 ON t1.id = cl.src'))})",
    f"t2 AS (SELECT q2.id, {zipped('q2.x', 'x.x', '2 * z[1] - z[2]')} AS x FROM q2 JOIN x ON x.id = q2.id)",
)


@layer("layer_cheb", V.ctes("e", "x", more=_CH) + out(f"SELECT x.id, {zipped(zipped(V.lin('x.x', W44), V.lin('t1.x', W44B), 'z[1] + z[2]'), V.lin('t2.x', W44), 'z[1] + z[2]')} AS x FROM x JOIN t1 ON t1.id = x.id JOIN t2 ON t2.id = x.id"))
def layer_cheb(x, e):
    ids = x.select("id")
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return L.cheb(x, e, [W44, W44B, W44], 4)


_PX = f"px AS ({listed(gathered('SELECT gn.dst, list_transform(x.x, lambda c: c * gn.w) AS m FROM gn JOIN x ON x.id = gn.src'))})"


@layer("layer_gcnii", V.ctes("gn", "x", more=(_PX, f"r AS (SELECT x.id, {zipped('px.x', 'x.x', '0.9 * z[1] + 0.1 * z[2]')} AS x FROM x JOIN px ON px.id = x.id)")) + out(f"SELECT id, {zipped('x', V.lin('x', W44), '0.6 * z[1] + 0.4 * z[2]')} AS x FROM r"))
def layer_gcnii(x, e):
    return L.gcnii(x, x, N.gcn_norm(e), W44, 0.1, 0.4)


@layer("layer_gcnii_variant", V.ctes("gn", "x", more=(_PX, f"r AS (SELECT x.id, {each('px.x', '0.9 * c')} AS p, {each('x.x', '0.1 * c')} AS q FROM x JOIN px ON px.id = x.id)"))
       + out(f"SELECT id, {zipped(zipped('p', V.lin('p', W44), '0.6 * z[1] + 0.4 * z[2]'), zipped('q', V.lin('q', W44B), '0.6 * z[1] + 0.4 * z[2]'), 'z[1] + z[2]')} AS x FROM r"))
def layer_gcnii_variant(x, e):
    return L.gcnii(x, x, N.gcn_norm(e), W44, 0.1, 0.4, W44B)


_GP = L.gpr_weights(3, 0.2)


@layer("layer_gpr", V.ctes("gn", "x", "xl", more=(_chain(_step(0.0, 1.0), 3, "SELECT id, k, v FROM xl"),)) + out_long("SELECT id, k, sum(v) AS v FROM (" + " UNION ALL ".join(f"SELECT id, k, {g!r} * v AS v FROM z{i}" for i, g in enumerate(_GP)) + ") GROUP BY id, k"))
def layer_gpr(x, e):
    return L.gpr(x, N.gcn_norm(e), _GP, 4)


_MH = ("md AS (SELECT dst AS id, count(*) AS c FROM e GROUP BY dst)", "mn AS (SELECT e.src, e.dst, e.w * coalesce(a.c ** -0.5, 0) * b.c ** -0.5 AS w FROM e LEFT JOIN md a ON a.id = e.src JOIN md b ON b.id = e.dst)",
       f"m1 AS ({listed(gathered('SELECT mn.dst, list_transform(x.x, lambda c: c * mn.w) AS m FROM mn JOIN x ON x.id = mn.src'))})")


@layer("layer_mixhop", V.ctes("e", "x", more=_MH) + out(f"SELECT x.id, list_concat({V.lin('x.x', W42)}, {V.lin('m1.x', W42)}) AS x FROM x JOIN m1 ON m1.id = x.id"))
def layer_mixhop(x, e):
    return L.mixhop(x, e, {0: W42, 1: W42}, 4)


@layer("layer_fagcn", V.ctes("e", "x", more=(ENDS,)) + out_long(gathered(f"SELECT dst, list_transform(xs, lambda c: c * tanh({dot('xs', A4)} + {dot('xd', B4)}) * w) AS m FROM en")))
def layer_fagcn(x, e):
    return L.fagcn(x, e, A4, B4, 4)


W48 = M(4, 8)
_FO = f"fo AS (SELECT id, {each(zipped(zipped(V.lin('x', W48) + '[5:8]', V.lin('x', W44), 'z[1] * z[2]'), V.lin('x', W48) + '[1:4]', 'z[1] + z[2]'), 'greatest(c, 0)')} AS x FROM x)"
_FM = f"SELECT dst, {each(zipped(zipped(V.lin('xs', W48) + '[5:8]', V.lin('xd', W44B), 'z[1] * z[2]'), V.lin('xs', W48) + '[1:4]', 'z[1] + z[2]'), 'greatest(c, 0)')} AS m FROM en"


@layer("layer_film", V.ctes("e", "x", more=(ENDS, _FO)) + out_long(f"SELECT p.id, p.k, p.v + o.v AS v FROM ({gathered(_FM)}) p JOIN (SELECT id, unnest(range(1, 5)) AS k, unnest(x) AS v FROM fo) o ON o.id = p.id AND o.k = p.k"))
def layer_film(x, e):
    return L.film(x, e, W44, W48, W44B, W48)


@layer("layer_edge_conv", V.ctes("e", "x", more=(ENDS,)) + out_long(gathered(f"SELECT dst, {each(V.lin('list_concat(xd, ' + zipped('xs', 'xd', 'z[1] - z[2]') + ')', W84), 'greatest(c, 0)')} AS m FROM en", "max(v)")))
def layer_edge_conv(x, e):
    return L.edge_conv(x, e, W84)


_PNA = (
    ENDS, f"pm AS (SELECT dst, unnest(range(1, 3)) AS k, unnest({V.lin('list_concat(xd, xs)', M(8, 2))}) AS v FROM en)",
    "pa AS (SELECT dst AS id, k, avg(v) AS a1, max(v) AS a2, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0) + 1e-5) AS a3, count(*) AS deg FROM pm GROUP BY ALL)",
    "pb AS (SELECT id, deg, list_concat(list_concat(list(a1 ORDER BY k), list(a2 ORDER BY k)), list(a3 ORDER BY k)) AS o FROM pa GROUP BY ALL)",
    f"pc AS (SELECT x.id, x.x, coalesce(o, {V.lst([0.0] * 4 + [math.sqrt(1e-5)] * 2)}) AS o, coalesce(deg, 1) AS deg FROM x LEFT JOIN pb ON pb.id = x.id)",
    "pd AS (SELECT id, x, o, list_transform(o, lambda c: c * ln(deg + 1) / 2.0) AS o2, list_transform(o, lambda c: c * ln(deg + 1) / 2.0 * 2.0 / ln(deg + 1)) AS o3 FROM pc)",
)


@layer("layer_pna", V.ctes("e", "x", more=_PNA) + out(f"SELECT id, {V.lin('list_concat(list_concat(list_concat(x, o), o2), o3)', M(22, 4))} AS x FROM pd"))
def layer_pna(x, e):
    return L.pna(x, e, M(8, 2), M(22, 4), ["mean", "max", "std"], ["identity", "amplification", "attenuation"], {"log": 2.0, "lin": 5.0})


def typed_layer(name: str, sql: str | None = None):
    def add(f):
        LAYERS[name] = f, True
        R.query(name, sql)(lambda spark, d: V.long(f(V.features(spark, d), V.typed(spark, d))))
        return f

    return add


_RW = {r: M(4, 4, 3 + i, 5, 7) for i, r in enumerate(RELS)}


def by_rel(f, column: str = "edge_type") -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{r}' THEN {f(r)}" for r in RELS) + " END"


@typed_layer("layer_rgcn", V.ctes("t", "x") + out_long(_plus_own(gathered(f"SELECT t.dst, {by_rel(lambda r: V.lin('x.x', _RW[r]))} AS m FROM t JOIN x ON x.id = t.src WHERE edge_type IN {tuple(RELS)}"), W44)))
def layer_rgcn(x, t):
    return L.rgcn(x, t, _RW, W44)


_RE = {r: [0.1 * (i + j) for j in range(4)] for i, r in enumerate(RELS)}
_CI = f"SELECT t.dst, {V.lin(zipped('x.x', by_rel(lambda r: V.lst(_RE[r])), 'z[1] - z[2]'), W44)} AS m FROM t JOIN x ON x.id = t.dst WHERE edge_type IN {tuple(RELS)}"
_CO = f"SELECT t.dst, {V.lin(zipped('x.x', by_rel(lambda r: V.lst(_RE[r])), 'z[1] - z[2]'), W44B)} AS m FROM (SELECT dst AS src, src AS dst, edge_type FROM t) t JOIN x ON x.id = t.dst WHERE edge_type IN {tuple(RELS)}"


@typed_layer("layer_compgcn", V.ctes("t", "x") + out_long(
    f"SELECT a.id, a.k, (a.v + b.v + c.v) / 3 AS v FROM ({gathered(_CI)}) a JOIN ({gathered(_CO)}) b ON b.id = a.id AND b.k = a.k "
    f"JOIN (SELECT id, unnest(range(1, 5)) AS k, unnest({V.lin(zipped('x', V.lst(A4), 'z[1] - z[2]'), W44)}) AS v FROM x) c ON c.id = a.id AND c.k = a.k"))  # fmt: skip
def layer_compgcn(x, t):
    back = t.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type")
    return L.compgcn(x, t, back, _RE, A4, W44, W44B, W44)


def _semantic(parts: dict[str, str]) -> list[str]:
    """CTEs `sem` (id, k, v): long parts weighed by semantic attention."""
    both = " UNION ALL ".join(f"SELECT '{p}' AS path, * FROM ({listed(q)})" for p, q in parts.items())
    score = dot(each(zipped(V.lin("x", W44), V.lst(BIAS), "z[1] + z[2]"), "tanh(c)"), B4)
    return [
        f"sb AS ({both})", f"sw AS (SELECT path, avg({score}) AS w FROM sb GROUP BY path)", "sz AS (SELECT path, exp(w - (SELECT max(w) FROM sw)) AS q FROM sw)",
        "sem AS (SELECT id, k, sum(q / (SELECT sum(q) FROM sz) * v) AS v FROM (SELECT sb.id, sz.q, unnest(range(1, 5)) AS k, unnest(sb.x) AS v FROM sb JOIN sz ON sz.path = sb.path) GROUP BY id, k)",
    ]


def _rel_ends(rel: str, name: str) -> str:
    return f"{name} AS (SELECT t.src, t.dst, t.w, a.x AS xs, b.x AS xd FROM t JOIN x a ON a.id = t.src JOIN x b ON b.id = t.dst WHERE edge_type = '{rel}')"


def _gat_rel(rel: str, name: str) -> list[str]:
    score = leaky(f"{dot(V.lin('xs', W44), A4)} + {dot(V.lin('xd', W44), B4)}")
    return [_rel_ends(rel, f"{name}e"), *attend(name, f"SELECT dst, {score} AS s, {V.lin('xs', W44)} AS m FROM {name}e")]


_TWO = ("cites", "links")


@typed_layer("layer_han", V.ctes("t", "x", more=(*_gat_rel("cites", "ha"), *_gat_rel("links", "hb"), *_semantic({"cites": gathered("FROM ha"), "links": gathered("FROM hb")}))) + out_long("SELECT * FROM sem"))
def layer_han(x, t):
    paths = {r: t.filter(F.col("edge_type") == r) for r in _TWO}
    return L.han(x, paths, {r: W44 for r in _TWO}, {r: [A4 + B4] for r in _TWO}, W44, BIAS, B4)


def _rel_norm(rel: str, name: str) -> list[str]:
    return [f"{name}d AS (SELECT src AS id, sum(w) AS d FROM t WHERE edge_type = '{rel}' GROUP BY src)",
            f"{name} AS (SELECT t.src, t.dst, a.d ** -0.5 * t.w * coalesce(b.d ** -0.5, 0) AS w FROM t JOIN {name}d a ON a.id = t.src LEFT JOIN {name}d b ON b.id = t.dst WHERE edge_type = '{rel}')"]


def _ppr(name: str, edge: str) -> list[str]:
    out_, step = [f"{name}0 AS ({_hl(W44)})"], _step(0.2, 0.8, f"{name}0", edge)
    for i in (1, 2):
        out_.append(f"{name}{i} AS ({step.format(p=f'{name}{i - 1}')})")
    return out_


@typed_layer("layer_hpn", V.ctes("t", "x", more=(*_rel_norm("cites", "na"), *_rel_norm("links", "nc"), *_ppr("pa", "na"), *_ppr("pb", "nc"), *_semantic({"cites": "SELECT * FROM pa2", "links": "SELECT * FROM pb2"}))) + out_long("SELECT * FROM sem"))
def layer_hpn(x, t):
    paths = {r: N.gcn_norm(t.filter(F.col("edge_type") == r)) for r in _TWO}
    return L.hpn(x, paths, {r: W44 for r in _TWO}, 2, 0.2, W44, BIAS, B4)


_PR = {r: 0.5 + 0.25 * i for i, r in enumerate(RELS)}
_KR = {r: f"list_dot_product({V.lin(V.lin('xs', W44), _RW[r])}, {V.lin('xd', W44B)}) * {_PR[r] / 2!r}" for r in RELS}
_HT = [
    "te AS (SELECT t.dst, t.edge_type, a.x AS xs, b.x AS xd FROM t JOIN x a ON a.id = t.src JOIN x b ON b.id = t.dst)",
    *attend("hq", f"SELECT dst, edge_type, {by_rel(_KR.get)} AS s, {V.lin(V.lin('xs', M(4, 4, 1, 2, 5)), W44B)} AS m FROM te", by="dst, edge_type"),
    f"ho AS ({listed(gathered('FROM hq'))})",
]
_AL = 1 / (1 + math.exp(-0.3))


@typed_layer("layer_hgt", V.ctes("t", "x", more=tuple(_HT)) + out(f"SELECT x.id, {zipped(V.lin('ho.x', W44), 'x.x', f'{_AL!r} * z[1] + {1 - _AL!r} * z[2]')} AS x FROM x JOIN ho ON ho.id = x.id"))
def layer_hgt(x, t):
    return L.hgt(x, t, W44, W44B, M(4, 4, 1, 2, 5), _RW, {r: W44B for r in RELS}, _PR, W44, 0.3)


_SH = attend("sh", f"SELECT dst, {leaky(dot(V.lin('xs', W44), A4) + ' + ' + dot(V.lin('xd', W44), B4) + ' + ' + by_rel(lambda r: repr(_PR[r])))} AS s, {V.lin('xs', W44)} AS m FROM te")


@typed_layer("layer_simple_hgn", V.ctes("t", "x", more=(_HT[0], *_SH)) + out_long(gathered("FROM sh")))
def layer_simple_hgn(x, t):
    return L.simple_hgn(x, t, W44, A4, B4, _PR)[0]


def _gcn_rel(rel: str, weight) -> str:
    cnt = f"(SELECT src AS id, count(*) AS c FROM t WHERE edge_type = '{rel}' GROUP BY 1) cs ON cs.id = t.src JOIN (SELECT dst AS id, count(*) AS c FROM t WHERE edge_type = '{rel}' GROUP BY 1) cd ON cd.id = t.dst"
    return gathered(f"SELECT t.dst, list_transform({V.lin('x.x', weight)}, lambda c: c * t.w * cs.c ** -0.5 * cd.c ** -0.5) AS m FROM t JOIN x ON x.id = t.src JOIN {cnt} WHERE t.edge_type = '{rel}'")


_IE = [
    f"iw AS (SELECT id, {V.lin('x', W44)} AS x FROM x)", f"ih AS (SELECT id, {dot(V.lin('x', W44B), B4)} AS h FROM iw)",
    f"ip AS (SELECT id, x FROM iw UNION ALL {listed(_gcn_rel('cites', _RW['cites']))} UNION ALL {listed(_gcn_rel('links', _RW['links']))})",
    f"iq AS (SELECT ip.id, ip.x, {dot(V.lin('ip.x', W44), A4)} + ih.h AS s FROM ip JOIN ih ON ih.id = ip.id)",
    *attend("ig", "SELECT id AS dst, CASE WHEN s > 0 THEN s ELSE exp(s) - 1 END AS s, x AS m FROM iq", eps="0"),
]


@typed_layer("layer_iehgcn", V.ctes("t", "x", more=tuple(_IE)) + out_long(gathered("FROM ig")))
def layer_iehgcn(x, t):
    return L.iehgcn(x, {r: t.filter(F.col("edge_type") == r) for r in _TWO}, W44, _RW, W44B, W44, A4, B4)


_RH = (
    ENDS, h_ends(W44),
    f"rs AS (SELECT src, dst, xs, {leaky('list_dot_product(xs, xd)')} * w AS s FROM eh)",
    "rk AS (SELECT dst, s, xs AS m FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY s DESC, src) AS r FROM rs) WHERE r <= 3)",
    *attend("rg", "SELECT dst, s, m FROM rk"),
)


@layer("layer_rohe_gat", V.ctes("e", "x", more=_RH) + out_long(gathered("FROM rg")))
def layer_rohe_gat(x, e):
    return L.rohe_gat(x, e, W44, 3)


@layer("layer_hypergraph", V.ctes("e", "x", more=("mb AS (SELECT DISTINCT src AS id, dst AS edge_id FROM e WHERE src IN (SELECT id FROM x))",
    f"hy AS (SELECT edge_id, list(v ORDER BY k) AS m FROM (SELECT edge_id, k, sum(v) AS v FROM (SELECT edge_id, unnest(range(1, 5)) AS k, unnest({V.lin('x.x', W44)}) AS v FROM mb JOIN x ON x.id = mb.id) GROUP BY ALL) GROUP BY edge_id)"))
    + out_long(gathered("SELECT mb.id AS dst, hy.m FROM mb JOIN hy ON hy.edge_id = mb.edge_id")))
def layer_hypergraph(x, e):
    members = e.select(F.col("src").alias("id"), F.col("dst").alias("edge_id")).distinct()
    return L.hypergraph(x, members, W44)


_HE_A = [0.2, -0.1, 0.3, 0.1, 0.1, 0.2, -0.2, 0.1, 0.05]
_HE = (ENDS, h_ends(W44), *attend("hg", f"SELECT src AS dst, {leaky(dot('list_append(list_concat(xs, xd), w)', _HE_A))} AS s, {each(V.lin('list_concat([w], xd)', M(5, 4)), leaky('c'))} AS m FROM eh", eps="0"))


@layer("layer_heat", V.ctes("e", "x", more=_HE) + out_long(gathered("FROM hg")))
def layer_heat(x, e):
    return L.heat(x, e, W44, _HE_A, M(5, 4), ["w"], 1)


_GM = ", ".join(f"exp(-0.5 * (tanh(e.w) - {m!r}) ** 2 * {s * s!r})" for m, s in ((0.5, 1.0), (0.9, 2.0)))
_W48B = M(4, 8, 2, 3, 9)


@layer("layer_gmm", V.ctes("e", "x") + out_long(gathered(f"SELECT e.dst, list_transform(list_zip({V.lin('x.x', _W48B)}[1:4], {V.lin('x.x', _W48B)}[5:8]), lambda z: z[1] * q[1] + z[2] * q[2]) AS m FROM (SELECT *, [{_GM}] AS q FROM e) e JOIN x ON x.id = e.src")))
def layer_gmm(x, e):
    return L.gmm(x, e, _W48B, [[0.5], [0.9]], [[1.0], [2.0]], ["w"])


@layer("layer_mgnni")
def layer_mgnni(x, e):
    return L.mgnni(x, N.gcn_norm(e), W44, 0.5, 1, 1e-3, 6)


_MC = "ms AS (SELECT src AS id, count(*) AS c FROM e GROUP BY src)"


@layer("layer_magcl", V.ctes("e", "x", more=(_MC,)) + out_long(gathered(f"SELECT e.dst, list_transform({V.lin('x.x', W44)}, lambda c: c * e.w * a.c ** -0.5 * coalesce(b.c ** -0.5, 0)) AS m FROM e JOIN x ON x.id = e.src JOIN ms a ON a.id = e.src LEFT JOIN ms b ON b.id = e.dst")))
def layer_magcl(x, e):
    return L.magcl(x, e, W44, 3)


_HI = (
    ENDS, "hd AS (SELECT dst, " + zipped("xs", "xd", "z[1] - z[2]") + " AS df FROM en)",
    f"hg AS ({listed(gathered('SELECT dst, list_transform(df, lambda c: c * exp(-list_dot_product(df, df) / 18)) AS m FROM hd'))})",
    "hs AS (SELECT x.id, " + zipped("x.x", "hg.x", "0.3 * z[1] + 0.3 * 0.5 * z[2]") + " AS x FROM x JOIN hg ON hg.id = x.id)",
)


@layer("layer_hid", V.ctes("gn", "x", "xl", more=_HI) + out_long(f"SELECT p.id, p.k, p.v + 0.1 * xl.v + 0.6 * xl.v AS v FROM ({gathered('SELECT gn.dst, list_transform(hs.x, lambda c: c * gn.w) AS m FROM gn JOIN hs ON hs.id = gn.src')}) p JOIN xl ON xl.id = p.id AND xl.k = p.k"))
def layer_hid(x, e):
    # the gradient runs on the raw edges, the diffusion on the normalised ones
    g = S.gaussian_gradient(e, x, 4, 3.0)
    mixed = S.axpy(x, g, 0.3, 0.15)
    return S.axpy(S.gspmm(N.gcn_norm(e), mixed, 4), x, 1.0, 0.7)


_DH = (f"d1 AS ({listed(gathered('SELECT e.dst, x.x AS m FROM e JOIN x ON x.id = e.src', 'avg(v)'))})", f"d2 AS (SELECT x.id, {V.lin('list_concat(x.x, d1.x)', W84)} AS x FROM x JOIN d1 ON d1.id = x.id)",
       f"d3 AS ({listed(gathered('SELECT e.dst, d2.x AS m FROM e JOIN d2 ON d2.id = e.src', 'avg(v)'))})")


@layer("layer_dhn", V.ctes("e", "x", more=_DH) + out(f"SELECT x.id, {V.lin('list_concat(x.x, d3.x)', W84)} AS x FROM x JOIN d3 ON d3.id = x.id"))
def layer_dhn(x, e):
    return L.dhn(x, e, 4, W84, W84)


_DN = (
    f"h2 AS (SELECT id, {V.lin('x', W44)} AS x FROM x)",
    "dj AS (SELECT gn.dst, gn.w, a.x AS k1, b.x AS k2, list_dot_product(a.x, q.x) / 2 AS s1, list_dot_product(b.x, q.x) / 2 AS s2 FROM gn JOIN x a ON a.id = gn.src JOIN h2 b ON b.id = gn.src JOIN h2 q ON q.id = gn.dst)",
    "dt AS (SELECT *, greatest(s1, s2, 0) AS t FROM dj)", "dz AS (SELECT *, exp(s1 - t) + exp(s2 - t) + exp(-t) AS z FROM dt)",
)


@layer("layer_dna", V.ctes("gn", "x", more=_DN) + out_long(gathered("SELECT dst, " + zipped("k1", "k2", "(z[1] * exp(dz.s1 - dz.t) + z[2] * exp(dz.s2 - dz.t)) / dz.z * dz.w") + " AS m FROM dz")))
def layer_dna(x, e):
    return L.dna(x, [x, L.dense(x, W44)], N.gcn_norm(e), 4)


_FZ = ("f AS (SELECT src, dst, cos(w) ** 2 AS o, sin(w) ** 2 AS i FROM e)", "s AS (SELECT src, sum(o) AS so, sum(i) AS si FROM f GROUP BY src)", "q AS (SELECT dst, sum(o) AS d_o, sum(i) AS d_i FROM f GROUP BY dst)",
       "fw AS (SELECT f.src, f.dst, o * so ** -0.5 * d_o ** -0.5 AS wo, i * si ** -0.5 * d_i ** -0.5 AS wi FROM f JOIN s ON s.src = f.src JOIN q ON q.dst = f.dst)")


@layer("layer_coed", V.ctes("e", "x", more=_FZ) + out_long(gathered(f"SELECT fw.dst, list_transform({V.lin('x.x', W44)}, lambda c: c * fw.wo) AS m FROM fw JOIN x ON x.id = fw.src UNION ALL SELECT fw.src, list_transform({V.lin('x.x', W44B)}, lambda c: c * fw.wi) FROM fw JOIN x ON x.id = fw.dst")))
def layer_coed(x, e):
    return L.coed(x, N.fuzzy_laplacian(e.withColumnRenamed("w", "theta")), W44, W44B)


@layer("layer_jumping_max", V.ctes("x") + out(f"SELECT id, {zipped('x', V.lin('x', W44), 'greatest(z[1], z[2])')} AS x FROM x"))
def layer_jumping_max(x, e):
    return L.jumping_knowledge([x, L.dense(x, W44)], "max")


@layer("layer_jumping_cat", V.ctes("x") + out(f"SELECT id, list_concat(x, {V.lin('x', W44)}) AS x FROM x", 8))
def layer_jumping_cat(x, e):
    return L.jumping_knowledge([x, L.dense(x, W44)])


@layer("layer_gcn_pruned", V.ctes("gn", "x", more=(f"hx AS (SELECT id, {V.lin('x', W44)} AS x FROM x)",)) + out_long(gathered(f"SELECT gn.dst, list_transform(hx.x, lambda c: c * gn.w) AS m FROM gn JOIN hx ON hx.id = gn.src WHERE abs(gn.w) * list_max({each('hx.x', 'abs(c)')}) >= 0.05")))
def layer_gcn_pruned(x, e):
    h = L.dense(x, W44)
    return S.gspmm(L.pruned_edges(N.gcn_norm(e), h, 0.05), h, 4)


_TOP = "list_max(list_transform({x}, lambda c: abs(c)))"
_P2 = attend("g1", f"SELECT dst, ({dot(each('xs', leaky('c')), A4)} + {dot(each('xd', leaky('c')), B4)}) / 4 AS s, xs AS m FROM eh WHERE {_TOP.format(x='xs')} >= 0.05")


@layer("layer_gatv2_pruned", V.ctes("e", "x", more=(ENDS, h_ends(W44), *_P2)) + out_long(gathered("FROM g1")))
def layer_gatv2_pruned(x, e):
    return L.pruned_gatv2(x, e, W44, [A4], [B4], 0.05)


_PP = f"px AS ({listed(gathered('SELECT gn.dst, list_transform(x.x, lambda c: c * gn.w) AS m FROM gn JOIN x ON x.id = gn.src WHERE abs(gn.w) * ' + _TOP.format(x='x.x') + ' >= 0.05'))})"


@layer("layer_gcnii_pruned", V.ctes("gn", "x", more=(_PP, f"r AS (SELECT x.id, {zipped('px.x', 'x.x', '0.9 * z[1] + 0.1 * z[2]')} AS x FROM x JOIN px ON px.id = x.id)")) + out(f"SELECT id, {zipped('x', V.lin('x', W44), '0.6 * z[1] + 0.4 * z[2]')} AS x FROM r"))
def layer_gcnii_pruned(x, e):
    return L.pruned_gcnii(x, x, N.gcn_norm(e), W44, 0.1, 0.4, 0.05)


@layer("layer_sage_pruned", V.ctes("e", "x") + out_long(_plus_own(gathered(f"SELECT e.dst, {V.lin('x.x', W44)} AS m FROM e JOIN x ON x.id = e.src WHERE abs(e.w) * {_TOP.format(x='x.x')} >= 0.05", "avg(v)"), W44B)))
def layer_sage_pruned(x, e):
    return L.pruned_sage(x, e, W44, W44B, 0.05)


_MG = f"mg AS ({listed(gathered('SELECT gn.dst, list_transform(' + V.lin('x.x', W44) + ', lambda c: c * gn.w) AS m FROM gn JOIN x ON x.id = gn.src'))})"


@layer("layer_metapath_gcn", V.ctes("gn", "x", more=(_MG,)) + out(f"SELECT id, {each(zipped('x', V.lst(BIAS), 'z[1] + z[2]'), leaky('c', 0.25))} AS x FROM mg"))
def layer_metapath_gcn(x, e):
    return L.metapath_gcn(x, N.gcn_norm(e), W44, BIAS)


# --- at full width ---------------------------------------------------------------------

W64, W64B = M(64, 64), M(64, 64, 2, 3, 9)
_V64 = "x AS (SELECT id, x FROM v)"


def wide(name: str, sql: str):
    """A layer over the vectors of 64 components themselves."""

    def add(f):
        R.query(name, sql.replace(V.CTE["x"], _V64).replace("range(1, 5)", "range(1, 65)"))(lambda spark, d: V.long(f(V.vectors(spark, d), V.edges(spark, d))))
        return f

    return add


@wide("layer_gcn_64", V.ctes("e", "x", more=(_CNT, f"hx AS MATERIALIZED (SELECT id, {V.lin('x', W64)} AS x FROM x)")) + out_long(gathered("SELECT e.dst, list_transform(x.x, lambda c: c * e.w * cs.c ** -0.5 * cd.c ** -0.5) AS m FROM e JOIN hx x ON x.id = e.src JOIN cs ON cs.id = e.src JOIN cd ON cd.id = e.dst", width=64)))
def layer_gcn_64(x, e):
    return L.gcn(x, e, W64)


@wide("layer_sage_64", V.ctes("e", "x", more=(f"hx AS MATERIALIZED (SELECT id, {V.lin('x', W64)} AS x FROM x)", f"ox AS MATERIALIZED (SELECT id, {V.lin('x', W64B)} AS x FROM x)"))
      + out_long(f"SELECT p.id, p.k, p.v + o.v AS v FROM ({gathered('SELECT e.dst, x.x AS m FROM e JOIN hx x ON x.id = e.src', 'avg(v)', 64)}) p JOIN (SELECT id, unnest(range(1, 65)) AS k, unnest(x) AS v FROM ox) o ON o.id = p.id AND o.k = p.k"))
def layer_sage_64(x, e):
    return L.sage(x, e, W64, W64B)


_A64, _B64 = [((3 * i) % 7 - 3) / 40 for i in range(64)], [((5 * i) % 9 - 4) / 40 for i in range(64)]
_G64 = attend("g1", f"SELECT dst, {leaky(dot('xs', _A64) + ' + ' + dot('xd', _B64))} AS s, xs AS m FROM eh")


@wide("layer_gat_64", V.ctes("e", "x", more=(f"hx AS MATERIALIZED (SELECT id, {V.lin('x', W64)} AS x FROM x)", "eh AS MATERIALIZED (SELECT e.dst, a.x AS xs, b.x AS xd FROM e JOIN hx a ON a.id = e.src JOIN hx b ON b.id = e.dst)", *_G64)) + out_long(gathered("FROM g1", width=64)))
def layer_gat_64(x, e):
    return L.gat(x, e, W64, [_A64 + _B64])


_LO = f"lo AS ({listed(gathered('SELECT e.dst, list_transform(x.x, lambda c: c * e.w) AS m FROM e JOIN x ON x.id = e.src'))})"


@layer("layer_lorentz_mean", V.ctes("e", "x", more=(_LO,)) + out(f"SELECT id, {each('x', 'c / sqrt(greatest(abs(list_dot_product(x, x) - 2 * x[1] * x[1]), 1e-8))')} AS x FROM lo"))
def layer_lorentz_mean(x, e):
    return L.lorentz_mean(e, x, 4)


_ZI, _ZO = M(6, 4), M(6, 4, 2, 3, 9)
_LOOK = lambda z, d: f"[{', '.join(V.lst(r) for r in z)}][least({d}, {len(z) - 1}) + 1]"


@layer("layer_centrality_encoding", V.ctes("e", "x", more=(_CNT,)) + out(f"SELECT x.id, {zipped(zipped('x.x', _LOOK(_ZI, 'coalesce(cd.c, 0)'), 'z[1] + z[2]'), _LOOK(_ZO, 'coalesce(cs.c, 0)'), 'z[1] + z[2]')} AS x FROM x LEFT JOIN cd ON cd.id = x.id LEFT JOIN cs ON cs.id = x.id"))
def layer_centrality_encoding(x, e):
    return L.centrality_encoding(x, e, _ZI, _ZO)


@R.query("layer_spatial_encoding", V.ctes("e", more=_BFS) + "SELECT source, id, [0.5, 0.4, 0.3][least(dist + 1, 3)] + 0.0::DOUBLE AS value FROM b")
def layer_spatial_encoding(spark: Spark, d: str) -> DataFrame:
    return L.spatial_encoding(_tree(spark, d), [0.5, 0.4, 0.3])


@R.query("layer_edge_encoding")
def layer_edge_encoding(spark: Spark, d: str) -> DataFrame:
    from weftgraph.operators.edges import coalesce
    from weftgraph.operators.traverse import with_paths

    e = coalesce(every(spark, d)).select("src", "dst", F.array(F.col("w"), F.lit(1.0)).alias("x"))
    return L.edge_encoding(with_paths(_tree(spark, d), 3), e, [[0.5, 0.1], [0.3, 0.1], [0.1, 0.1]]).withColumn("value", V.real("value"))


_GT = (
    "gp AS (SELECT DISTINCT e.src, e.dst FROM e JOIN g a ON a.id = e.src JOIN g b ON b.id = e.dst AND b.graph_id = a.graph_id)",
    *attend("ga", f"SELECT gp.dst, list_dot_product({V.lin('b.x', W44)}, {V.lin('a.x', W44B)}) / 2 + 0.1 AS s, {V.lin('a.x', W44)} AS m FROM gp JOIN x a ON a.id = gp.src JOIN x b ON b.id = gp.dst"),
)


@R.query("layer_graph_attention", V.ctes("e", "x", "g", more=_GT) + out_long(gathered("FROM ga")))
def layer_graph_attention(spark: Spark, d: str) -> DataFrame:
    g = V.graphs(spark, d)
    e = V.edges(spark, d).join(g.withColumnRenamed("id", "src"), "src").join(g.withColumnRenamed("id", "dst"), ["dst", "graph_id"])
    return V.long(L.graph_attention(V.features(spark, d), e.select("src", "dst").distinct().withColumn("b", F.lit(0.1)), W44, W44B, W44))


_LA = (
    f"qa AS (SELECT id, {V.lin('x', W42)} AS q, {V.lin('x', W42)} AS k, {V.lin('x', W44)} AS v FROM x)",
    "st AS (SELECT count(*) AS n, sqrt(sum(list_dot_product(q, q))) * sqrt(sum(list_dot_product(k, k))) AS nn, sum(k[1]) AS s1, sum(k[2]) AS s2, "
    + ", ".join(f"sum(k[{i}] * v[{j}]) AS k{i}v{j}" for i in (1, 2) for j in (1, 2, 3, 4)) + " FROM qa)",
)


@layer("layer_linear_attention", V.ctes("x", more=_LA) + out("SELECT id, [" + ", ".join(f"((q[1] * k1v{j} + q[2] * k2v{j}) / nn + v[{j}] * n) / ((q[1] * s1 + q[2] * s2) / nn + n)" for j in (1, 2, 3, 4)) + "] AS x FROM qa, st"))
def layer_linear_attention(x, e):
    return L.linear_attention(x, W42, W42, W44)


@layer("layer_dense_relu", V.ctes("x") + out(f"SELECT id, {each(zipped(V.lin('x', W44), V.lst(BIAS), 'z[1] + z[2]'), 'greatest(c, 0)')} AS x FROM x"))
def layer_dense_relu(x, e):
    return L.dense(x, W44, BIAS, vec.relu)


_CB = M(5, 4, 2, 3, 9)
_DIST = ", ".join(f"list_sum({each(zipped('x', V.lst(c), 'z[1] - z[2]'), 'c * c')})" for c in _CB)


@R.query("layer_nearest_codes", V.ctes("x") + f"SELECT id, list_position(ds, list_min(ds)) - 1 AS code FROM (SELECT id, [{_DIST}] AS ds FROM x)")
def layer_nearest_codes(spark: Spark, d: str) -> DataFrame:
    return L.nearest_codes(V.features(spark, d), _CB)
