"""Graph views over the test tables, as DataFrames and as the SQL they equal.

`WITH + n, e, ...`: common table expressions that queries' SQL starts with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.core.session import read
from weftgraph.functions import vec
from weftgraph.operators import edges as E

DIMS = 64
#: A fixed 64 x 4 map, from a rule: every component of x takes part.
PROJECT = [[((7 * i + 3 * j) % 11 - 5) / 10 for j in range(4)] for i in range(DIMS)]
WIDTH = 4
NUDGE = 3.7e-8


def matrix(rows: int, cols: int, a: int = 3, b: int = 5, m: int = 7) -> list[list[float]]:
    """A small weight matrix from a rule."""
    return [[((a * i + b * j + 1) % m - m // 2) / 10 for j in range(cols)] for i in range(rows)]


# --- DataFrames ---------------------------------------------------------------------


def edges(spark: SparkSession, d: str) -> DataFrame:
    return E.clean(read(spark, d, "graph_edges"))


def typed(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, w, edge_type) with a type."""
    e = read(spark, d, "graph_edges").filter("src is not null and dst is not null and edge_type is not null")
    return e.filter(F.col("w").isNotNull() & ~F.isnan("w")).select("src", "dst", "w", "edge_type")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "graph_nodes").select("id")
    shared = read(spark, d, "anchor_nodes").filter("scope = 'graph'").select(F.col("node_id").alias("id"))
    return own.unionByName(shared).filter("id is not null").distinct()


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, x): the 64 components of each id with a usable vector."""
    x = F.col("x")
    good = (F.size(x) == DIMS) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    return read(spark, d, "graph_nodes").filter("id is not null and x is not null").filter(good).groupBy("id").agg(F.min("x").alias("x"))


def features(spark: SparkSession, d: str) -> DataFrame:
    """(id, x): the vectors through PROJECT."""
    return vectors(spark, d).select("id", vec.linear(F.col("x"), PROJECT).alias("x"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "graph_nodes").filter("id is not null and y >= 0").groupBy("id").agg(F.max("y").alias("y"))


def graphs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "graph_nodes").filter("id is not null and graph_id is not null").groupBy("id").agg(F.min("graph_id").alias("graph_id"))


def alircd_edges(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "alircd_edges").filter("source_id is not null and dest_id is not null")
    return e.select(F.col("source_id").alias("src"), F.col("dest_id").alias("dst"), F.col("source_type").alias("src_type"), F.col("dest_type").alias("dst_type"), "edge_type")


def real(c: Column | str) -> Column:
    """A DOUBLE as it is compared: rounded to 6 digits, without a negative zero.

    Engines differ in rounding exact halves (averages of short decimals often are some), so
    values are nudged off them first, alike in the SQL of `r`.
    """
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(NUDGE), 6) + F.lit(0.0)


def real_many(c: str) -> Column:
    """As `real`, for very many rows: below a million in size by multiples, without a decimal for each value."""
    x = F.col(c) + F.lit(NUDGE)
    return F.when(F.abs(x) < 1e6, F.rint(x * 1e6) / F.lit(1e6)).otherwise(F.round(x, 6)) + F.lit(0.0)


def long(df: DataFrame, x: str = "x", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys..., k, value): vectors with one row a component, k from 1."""
    return df.select(*keys, F.posexplode(x).alias("k", "value")).select(*keys, (F.col("k") + 1).cast("bigint").alias("k"), real("value").alias("value"))


# --- SQL ----------------------------------------------------------------------------


def r(expr: str) -> str:
    return f"(round(({expr}) + {NUDGE!r}, 6) + 0.0)"


def lst(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]"


def lin(x: str, weight) -> str:
    """SQL of x @ weight."""
    return "[" + ", ".join(f"list_dot_product({x}, {lst(c)})" for c in zip(*weight)) + "]"


CTE = {
    "e": "e AS (SELECT src, dst, w FROM graph_edges WHERE src IS NOT NULL AND dst IS NOT NULL AND w IS NOT NULL AND NOT isnan(w))",
    "t": "t AS (SELECT src, dst, w, edge_type FROM graph_edges WHERE src IS NOT NULL AND dst IS NOT NULL AND edge_type IS NOT NULL AND w IS NOT NULL AND NOT isnan(w))",
    "n": "n AS (SELECT id FROM graph_nodes WHERE id IS NOT NULL UNION SELECT node_id FROM anchor_nodes WHERE scope = 'graph' AND node_id IS NOT NULL)",
    "v": "v AS (SELECT id, min(x) AS x FROM graph_nodes WHERE id IS NOT NULL AND len(x) = 64 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 "
    "AND len(list_filter(x, lambda c: c <> 0)) > 0 GROUP BY id)",
    "x": f"x AS (SELECT id, {lin('x', PROJECT)} AS x FROM v)",
    "xl": "xl AS (SELECT id, unnest(range(1, 5)) AS k, unnest(x) AS v FROM x)",
    "y": "y AS (SELECT id, max(y) AS y FROM graph_nodes WHERE id IS NOT NULL AND y >= 0 GROUP BY id)",
    "g": "g AS (SELECT id, min(graph_id) AS graph_id FROM graph_nodes WHERE id IS NOT NULL AND graph_id IS NOT NULL GROUP BY id)",
    "a": "a AS (SELECT source_id AS src, dest_id AS dst, source_type AS src_type, dest_type AS dst_type, edge_type FROM alircd_edges WHERE source_id IS NOT NULL AND dest_id IS NOT NULL)",
    "deg_src": "deg_src AS (SELECT src AS id, sum(w) AS d FROM e GROUP BY src)",
    "gn": "gn AS (SELECT e.src, e.dst, coalesce(a.d ** -0.5, 0) * e.w * coalesce(b.d ** -0.5, 0) AS w FROM e LEFT JOIN deg_src a ON a.id = e.src LEFT JOIN deg_src b ON b.id = e.dst)",
}
_NEEDS = {"x": ["v"], "xl": ["x"], "gn": ["deg_src"], "deg_src": ["e"]}


def ctes(*names: str, more: tuple[str, ...] = ()) -> str:
    """`WITH ...` of the named expressions and what they need, then `more`."""
    seen: list[str] = []

    def need(n: str) -> None:
        for m in _NEEDS.get(n, []):
            need(m)
        if n not in seen:
            seen.append(n)

    for n in names:
        need(n)
    return "WITH RECURSIVE " + ", ".join([CTE[n] for n in seen] + list(more)) + " "


def product(edge: str = "e", how: str = "sum(e.w * s.v)", fill: str = "0.0", src: str = "xl", universe: str = "x") -> str:
    """(id, k, value) of a sparse product with a long-form table, zero-filled over `universe`."""
    return (
        f"SELECT u.id, u.k, coalesce(p.value, {fill}) AS value FROM (SELECT id, unnest(range(1, 5)) AS k FROM {universe}) u LEFT JOIN "
        f"(SELECT e.dst AS id, s.k, {how} AS value FROM {edge} e JOIN {src} s ON s.id = e.src GROUP BY e.dst, s.k) p ON p.id = u.id AND p.k = u.k"
    )
