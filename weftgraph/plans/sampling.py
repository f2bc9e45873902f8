"""Queries of traversal, seeded sampling and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.core.session import cut, read
from weftgraph.operators import sample as P
from weftgraph.operators import split as L
from weftgraph.operators import traverse as T
from weftgraph.plans import views as V
from weftgraph.plans.registry import Registry

R = Registry()
Spark = SparkSession


def key(seed: int, *cols: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)}))"


def uni(seed: int, *cols: str) -> str:
    return f"(CAST('0x' || substr({key(seed, *cols)}, 1, 13) AS BIGINT)::DOUBLE / {float(2**52)!r})"


# --- traversal ----------------------------------------------------------------------

_S = "s AS (SELECT DISTINCT node_id AS id FROM anchor_nodes WHERE scope = 'graph' AND node_id IS NOT NULL)"


def anchors(spark: Spark, d: str) -> DataFrame:
    return read(spark, d, "anchor_nodes").filter("scope = 'graph' and node_id is not null").select(F.col("node_id").alias("id")).distinct()


def every(spark: Spark, d: str) -> DataFrame:
    return V.edges(spark, d).select("src", "dst", "w")


_SIM = "m AS (SELECT DISTINCT src, dst FROM e)"


for _rev in (False, True):
    _h, _t = ("src", "dst") if _rev else ("dst", "src")

    def _khop(spark: Spark, d: str, rev: bool = _rev) -> DataFrame:
        return T.k_hop_nodes(every(spark, d), anchors(spark, d), 2, rev)

    R.query(
        "khop_nodes_out" if _rev else "khop_nodes",
        V.ctes("e", more=(_SIM, _S, f"h AS (SELECT id, 0 AS hop FROM s UNION SELECT m.{_t}, h.hop + 1 FROM h JOIN m ON m.{_h} = h.id WHERE h.hop < 2)"))
        + "SELECT id, min(hop) AS hop FROM h GROUP BY id",
    )(_khop)


_KHOP = (_SIM, _S, "h AS (SELECT id, 0 AS hop FROM s UNION SELECT m.src, h.hop + 1 FROM h JOIN m ON m.dst = h.id WHERE h.hop < 2)",
         "k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT DISTINCT id FROM h))")


@R.query("khop_subgraph", V.ctes("e", more=_KHOP) + "SELECT a.n AS src, b.n AS dst, w FROM e JOIN k a ON a.id = e.src JOIN k b ON b.id = e.dst")
def khop_subgraph(spark: Spark, d: str) -> DataFrame:
    return T.k_hop_subgraph(every(spark, d), anchors(spark, d), 2)[1].select("src", "dst", "w")


@R.query("khop_edge_mask", V.ctes("e", more=_KHOP) + "SELECT src, dst, w, src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) AS mask FROM e")
def khop_edge_mask(spark: Spark, d: str) -> DataFrame:
    return T.k_hop_subgraph(every(spark, d), anchors(spark, d), 2)[2].select("src", "dst", "w", "mask")


_BFS = (
    "f AS (SELECT DISTINCT src, dst FROM e)",
    _S,
    "h AS (SELECT id AS source, id, 0 AS dist FROM s UNION SELECT h.source, f.dst, h.dist + 1 FROM h JOIN f ON f.src = h.id WHERE h.dist < 3)",
    "b AS (SELECT source, id, min(dist) AS dist FROM h GROUP BY ALL)",
    "p AS (SELECT b.source, b.id, b.dist, min(a.id) AS parent FROM b LEFT JOIN f ON f.dst = b.id LEFT JOIN b a ON a.source = b.source AND a.id = f.src AND a.dist = b.dist - 1 GROUP BY ALL)",
)


def _tree(spark: Spark, d: str) -> DataFrame:
    return T.shortest_paths(every(spark, d), anchors(spark, d).withColumnRenamed("id", "source"), 3)


@R.query("shortest_path_distance", V.ctes("e", more=_BFS) + "SELECT source, id, dist, parent FROM p")
def shortest_path_distance(spark: Spark, d: str) -> DataFrame:
    return _tree(spark, d)


@R.query(
    "shortest_path_nodes",
    V.ctes("e", more=(*_BFS, "q AS (SELECT source, id, dist, CAST(id AS VARCHAR) AS path FROM p WHERE dist = 0 UNION ALL SELECT p.source, p.id, p.dist, q.path || ',' || p.id FROM q JOIN p ON p.source = q.source AND p.parent = q.id AND p.dist = q.dist + 1)"))
    + "SELECT source, id, path FROM q",
)
def shortest_path_nodes(spark: Spark, d: str) -> DataFrame:
    return T.with_paths(_tree(spark, d), 3).select("source", "id", F.array_join("path", ",").alias("path"))


@R.query("bfs_tree_order", V.ctes("e", more=_BFS) + "SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY dist, id) - 1 AS pos FROM b")
def bfs_tree_order(spark: Spark, d: str) -> DataFrame:
    return T.bfs_order(_tree(spark, d)).select("source", "id", F.col("pos").cast("bigint").alias("pos"))


@R.query(
    "shortest_path_batched",
    V.ctes("e", "g", more=(
        "f AS (SELECT DISTINCT g.graph_id, e.src, e.dst FROM e JOIN g ON g.id = e.src JOIN g g2 ON g2.id = e.dst AND g2.graph_id = g.graph_id)",
        "s AS (SELECT graph_id, min(id) AS source FROM g GROUP BY graph_id)",
        "h AS (SELECT graph_id, source, source AS id, 0 AS dist FROM s UNION SELECT h.graph_id, h.source, f.dst, h.dist + 1 FROM h JOIN f ON f.graph_id = h.graph_id AND f.src = h.id WHERE h.dist < 3)",
    )) + "SELECT graph_id, source, id, min(dist) AS dist FROM h GROUP BY ALL",
)
def shortest_path_batched(spark: Spark, d: str) -> DataFrame:
    g = V.graphs(spark, d)
    e = V.edges(spark, d).join(g.withColumnRenamed("id", "src"), "src").join(g.withColumnRenamed("id", "dst"), ["dst", "graph_id"])
    starts = g.groupBy("graph_id").agg(F.min("id").alias("source"))
    return T.shortest_paths(e, starts, 3, ["graph_id"]).select("graph_id", "source", "id", "dist")


_PAIRS = "pr AS (SELECT DISTINCT src, dst FROM graph_matches WHERE matched IS NULL AND src IS NOT NULL AND dst IS NOT NULL)"


def pairs(spark: Spark, d: str) -> DataFrame:
    return read(spark, d, "graph_matches").filter("matched is null and src is not null and dst is not null").select("src", "dst").distinct()


@R.query(
    "simple_paths",
    V.ctes("e", more=(_SIM, _PAIRS, "w AS (SELECT src, dst, src AS here, [src] AS path FROM pr UNION ALL SELECT w.src, w.dst, m.dst, list_append(w.path, m.dst) FROM w JOIN m ON m.src = w.here WHERE w.here <> w.dst AND len(w.path) < 4 AND NOT list_contains(w.path, m.dst))"))
    + "SELECT src, dst, array_to_string(path, ',') AS path FROM w WHERE here = dst",
)
def simple_paths(spark: Spark, d: str) -> DataFrame:
    return T.simple_paths(every(spark, d), pairs(spark, d), 4).select("src", "dst", F.array_join("path", ",").alias("path"))


@R.query("enclosing_subgraph_labels")
def enclosing_subgraph_labels(spark: Spark, d: str) -> DataFrame:
    p = pairs(spark, d).filter("src <> dst").select(F.concat_ws("-", "src", "dst").alias("pair_id"), F.col("src").alias("a"), F.col("dst").alias("b"))
    return T.enclosing_subgraphs(every(spark, d), p, 1)[0]


_UND = "u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst)"


@R.query("triangles", V.ctes("e", more=(_UND,)) + "SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON y.a = x.b JOIN u z ON z.a = x.a AND z.b = y.b")
def triangles(spark: Spark, d: str) -> DataFrame:
    return T.triangles(every(spark, d))


@R.query(
    "cycle_counts",
    V.ctes("e", more=("u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst)", "d AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u)"))
    + "SELECT (SELECT count(*) FROM u x JOIN u y ON y.a = x.b JOIN u z ON z.a = x.a AND z.b = y.b) AS c3, "
    "(SELECT CAST(coalesce(sum(n * (n - 1) / 2), 0) / 2 AS BIGINT) FROM (SELECT x.b AS p, y.b AS q, count(*) AS n FROM d x JOIN d y ON y.a = x.a AND x.b < y.b GROUP BY ALL)) AS c4",
)
def cycle_counts(spark: Spark, d: str) -> DataFrame:
    return T.cycle_counts(every(spark, d))


@R.query("induced_subgraph", V.ctes("e", "y") + "SELECT * FROM e WHERE src IN (SELECT id FROM y) AND dst IN (SELECT id FROM y)")
def induced_subgraph(spark: Spark, d: str) -> DataFrame:
    return T.induced(V.edges(spark, d), V.labels(spark, d)).select("src", "dst", "w")


# --- sampling -----------------------------------------------------------------------

_D = "d AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS eid FROM (SELECT DISTINCT src, dst FROM e))"


def numbered(spark: Spark, d: str) -> DataFrame:
    return P.with_edge_ids(V.edges(spark, d).select("src", "dst").distinct(), ["src", "dst"])


def _rank(part: str, seed: int, *cols: str) -> str:
    return f"row_number() OVER (PARTITION BY {part} ORDER BY {key(seed, *cols)}, eid)"


@R.query("sample_neighbours", V.ctes("e", "n", more=(_D,)) + f"SELECT src, dst, eid FROM (SELECT d.*, {_rank('dst', 5, 'eid')} AS r FROM d JOIN n ON n.id = d.dst) WHERE r <= 5")
def sample_neighbours(spark: Spark, d: str) -> DataFrame:
    return P.sample_neighbours(numbered(spark, d), V.nodes(spark, d), 5, 5).select("src", "dst", "eid")


_B = (
    _D,
    "b0 AS (SELECT (row_number() OVER (ORDER BY id) - 1) // 64 AS batch_id, id FROM n)",
    f"e1 AS (SELECT * FROM (SELECT b.batch_id, d.src, d.dst, d.eid, 1 AS hop, {_rank('b.batch_id, d.dst', 12, 'b.batch_id', 'eid')} AS r FROM b0 b JOIN d ON d.dst = b.id) WHERE r <= 5)",
    "b1 AS (SELECT DISTINCT batch_id, src AS id FROM e1 EXCEPT SELECT batch_id, id FROM b0)",
    f"e2 AS (SELECT * FROM (SELECT b.batch_id, d.src, d.dst, d.eid, 2 AS hop, {_rank('b.batch_id, d.dst', 13, 'b.batch_id', 'eid')} AS r FROM b1 b JOIN d ON d.dst = b.id) WHERE r <= 3)",
    "b2 AS (SELECT DISTINCT batch_id, src AS id FROM e2 EXCEPT (SELECT batch_id, id FROM b0 UNION SELECT batch_id, id FROM b1))",
)


def _batched(spark: Spark, d: str, directed: bool = True) -> tuple[DataFrame, DataFrame]:
    return P.neighbour_batches(numbered(spark, d), P.batches(V.nodes(spark, d), 64), [5, 3], 11, directed)


@R.query("neighbour_batches_edges", V.ctes("e", "n", more=_B) + "SELECT batch_id, src, dst, eid, hop FROM e1 UNION ALL SELECT batch_id, src, dst, eid, hop FROM e2")
def neighbour_batches_edges(spark: Spark, d: str) -> DataFrame:
    return _batched(spark, d)[1]


@R.query("neighbour_batches_nodes", V.ctes("e", "n", more=_B) + "SELECT batch_id, id, 0 AS hop FROM b0 UNION ALL SELECT batch_id, id, 1 FROM b1 UNION ALL SELECT batch_id, id, 2 FROM b2")
def neighbour_batches_nodes(spark: Spark, d: str) -> DataFrame:
    return _batched(spark, d)[0]


@R.query(
    "neighbour_batches_induced",
    V.ctes("e", "n", more=(*_B, "bn AS (SELECT batch_id, id FROM b0 UNION SELECT * FROM b1 UNION SELECT * FROM b2)")) + "SELECT a.batch_id, d.src, d.dst, d.eid FROM d JOIN bn a ON a.id = d.src JOIN bn b ON b.id = d.dst AND b.batch_id = a.batch_id",
)
def neighbour_batches_induced(spark: Spark, d: str) -> DataFrame:
    return _batched(spark, d, False)[1].select("batch_id", "src", "dst", "eid")


def _two_hops(seeds: str, size: int, f1: int, f2: int, seed: int) -> tuple[str, ...]:
    return (
        _D, f"b0 AS (SELECT (row_number() OVER (ORDER BY id) - 1) // {size} AS batch_id, id FROM ({seeds}))",
        f"e1 AS (SELECT * FROM (SELECT b.batch_id, d.src, d.dst, d.eid, 1 AS hop, {_rank('b.batch_id, d.dst', seed + 1, 'b.batch_id', 'eid')} AS r FROM b0 b JOIN d ON d.dst = b.id) WHERE r <= {f1})",
        "b1 AS (SELECT DISTINCT batch_id, src AS id FROM e1 EXCEPT SELECT batch_id, id FROM b0)",
        f"e2 AS (SELECT * FROM (SELECT b.batch_id, d.src, d.dst, d.eid, 2 AS hop, {_rank('b.batch_id, d.dst', seed + 2, 'b.batch_id', 'eid')} AS r FROM b1 b JOIN d ON d.dst = b.id) WHERE r <= {f2})",
    )


_TRAIN = "SELECT DISTINCT id FROM graph_nodes WHERE train_idx AND id IS NOT NULL"


@R.query("neighbour_batches_train", V.ctes("e", more=_two_hops(_TRAIN, 1024, 25, 10, 17)) + "SELECT batch_id, src, dst, eid, hop FROM e1 UNION ALL SELECT batch_id, src, dst, eid, hop FROM e2")
def neighbour_batches_train(spark: Spark, d: str) -> DataFrame:
    """The sampling of one training epoch: fan-out 25 and 10, batches of 1,024 training nodes."""
    seeds = read(spark, d, "graph_nodes").filter("train_idx and id is not null").select("id").distinct()
    return P.neighbour_batches(numbered(spark, d), P.batches(seeds, 1024), [25, 10], 17)[1]


@R.query("neighbour_batches_full", V.ctes("e", "n", more=(_D, "b0 AS (SELECT (row_number() OVER (ORDER BY id) - 1) // 1024 AS batch_id, id FROM n)")) + "SELECT b.batch_id, d.src, d.dst, d.eid, 1 AS hop FROM b0 b JOIN d ON d.dst = b.id")
def neighbour_batches_full(spark: Spark, d: str) -> DataFrame:
    """All in-neighbours of all nodes, in batches of 1,024."""
    return P.neighbour_batches(numbered(spark, d), P.batches(V.nodes(spark, d), 1024), [-1], 17)[1]


_A = "ad AS (SELECT *, row_number() OVER (ORDER BY rel, src, dst) - 1 AS eid FROM (SELECT DISTINCT edge_type AS rel, src, dst FROM a))"


@R.query("sample_neighbours_typed", V.ctes("a", more=(_A,)) + f"SELECT rel, src, dst, eid FROM (SELECT *, {_rank('dst, rel', 3, 'eid')} AS r FROM ad) WHERE r <= 4")
def sample_neighbours_typed(spark: Spark, d: str) -> DataFrame:
    e = V.alircd_edges(spark, d).select(F.col("edge_type").alias("rel"), "src", "dst").distinct()
    e = P.with_edge_ids(e, ["rel", "src", "dst"])
    return P.sample_neighbours(e, e.select(F.col("dst").alias("id")).distinct(), 4, 3).select("rel", "src", "dst", "eid")


@R.query("batches_shuffled", V.ctes("n") + f"SELECT (row_number() OVER (ORDER BY {key(9, 'id')}, id) - 1) // 50 AS batch_id, id FROM n")
def batches_shuffled(spark: Spark, d: str) -> DataFrame:
    return P.batches(V.nodes(spark, d), 50, 9)


_NB = ("nb AS MATERIALIZED (SELECT src AS id, dst AS t, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos FROM (SELECT DISTINCT src, dst FROM e))", "dg AS MATERIALIZED (SELECT id, count(*) AS deg FROM nb GROUP BY id)")


def _walk(steps: int, seed: int, restart: float = 0.0) -> list[str]:
    out = ["w0 AS MATERIALIZED (SELECT id AS walk_id, id, id AS start FROM n)"]
    for s in range(1, steps + 1):
        at = f"CASE WHEN {uni(seed + 7919, 'w.walk_id', str(s))} < {restart!r} THEN w.start ELSE w.id END" if restart else "w.id"
        out.append(
            f"w{s} AS MATERIALIZED (SELECT w.walk_id, coalesce(nb.t, w.id) AS id, w.start FROM (SELECT w.walk_id, {at} AS id, w.start FROM w{s - 1} w) w LEFT JOIN dg ON dg.id = w.id "
            f"LEFT JOIN nb ON nb.id = w.id AND nb.pos = CAST(floor({uni(seed, 'w.walk_id', str(s))} * dg.deg) AS BIGINT))"
        )
    return out


def _steps(n: int) -> str:
    return " UNION ALL ".join(f"SELECT walk_id, {s} AS step, id FROM w{s}" for s in range(n + 1))


def _starts(spark: Spark, d: str) -> DataFrame:
    return V.nodes(spark, d).select(F.col("id").alias("walk_id"), "id")


@R.query("random_walks", V.ctes("e", "n", more=(*_NB, *_walk(4, 21))) + _steps(4))
def random_walks(spark: Spark, d: str) -> DataFrame:
    return P.random_walks(V.edges(spark, d), _starts(spark, d), 4, 21)


@R.query("random_walks_restart", V.ctes("e", "n", more=(*_NB, *_walk(3, 22, 0.3))) + _steps(3))
def random_walks_restart(spark: Spark, d: str) -> DataFrame:
    return P.random_walks(V.edges(spark, d), _starts(spark, d), 3, 22, 0.3)


@R.query(
    "walk_windows",
    V.ctes("e", "n", more=(*_NB, *_walk(4, 21), f"st AS MATERIALIZED ({_steps(4)})"))
    + "SELECT a.walk_id, a.step AS pos, a.id || ',' || b.id || ',' || c.id AS window FROM st a JOIN st b ON b.walk_id = a.walk_id AND b.step = a.step + 1 JOIN st c ON c.walk_id = a.walk_id AND c.step = a.step + 2",
)
def walk_windows(spark: Spark, d: str) -> DataFrame:
    return P.walk_windows(random_walks(spark, d), 3).select("walk_id", "pos", F.array_join("window", ",").alias("window"))


_N2V = (
    *_NB, *_walk(1, 31),
    "c AS (SELECT src, dst, sum(w) AS w FROM e GROUP BY src, dst)",
    "tr AS (SELECT a.src AS prev, a.dst AS cur, b.dst AS nxt, b.w * CASE WHEN b.dst = a.src THEN 2.0 WHEN k.src IS NOT NULL THEN 1.0 ELSE 0.25 END AS m FROM (SELECT c.* FROM c JOIN (SELECT DISTINCT w0.id AS prev, w1.id AS cur FROM w0 JOIN w1 ON w1.walk_id = w0.walk_id) s ON s.prev = c.src AND s.cur = c.dst) a JOIN c b ON b.src = a.dst LEFT JOIN c k ON k.src = a.src AND k.dst = b.dst)",
)


@R.query("node2vec_probabilities", V.ctes("e", "n", more=_N2V) + f"SELECT prev, cur, nxt, {V.r('m / sum(m) OVER (PARTITION BY prev, cur)')} AS prob FROM tr")
def node2vec_probabilities(spark: Spark, d: str) -> DataFrame:
    """Of the states in which each node's walk is after its first step."""
    e = every(spark, d)
    step = lambda s, c: first.filter(F.col("step") == s).select("walk_id", F.col("id").alias(c))
    first = P.random_walks(e, _starts(spark, d), 1, 31)
    return P.node2vec_probabilities(e, 0.5, 4.0, step(0, "prev").join(step(1, "cur"), "walk_id")).withColumn("prob", V.real_many("prob"))


@R.query("node2vec_walks")
def node2vec_walks(spark: Spark, d: str) -> DataFrame:
    return P.node2vec_walks(every(spark, d), _starts(spark, d), 4, 0.5, 4.0, 31)


_MP = (
    "rn AS (SELECT rel, src AS id, dst AS t, row_number() OVER (PARTITION BY rel, src ORDER BY dst) - 1 AS pos FROM (SELECT DISTINCT edge_type AS rel, src, dst FROM a))",
    "rd AS (SELECT rel, id, count(*) AS deg FROM rn GROUP BY ALL)",
    "w0 AS (SELECT DISTINCT src AS walk_id, src AS id FROM a WHERE src_type = 'f')",
    *[
        f"w{s} AS (SELECT w.walk_id, rn.t AS id FROM w{s - 1} w JOIN rd ON rd.id = w.id AND rd.rel = '{rel}' JOIN rn ON rn.id = w.id AND rn.rel = '{rel}' "
        f"AND rn.pos = CAST(floor({uni(41, 'w.walk_id', str(s))} * rd.deg) AS BIGINT))"
        for s, rel in ((1, "B"), (2, "B_1"), (3, "B"))
    ],
)


@R.query("metapath_walks", V.ctes("a", more=_MP) + _steps(3))
def metapath_walks(spark: Spark, d: str) -> DataFrame:
    e = V.alircd_edges(spark, d)
    starts = e.filter("src_type = 'f'").select(F.col("src").alias("walk_id"), F.col("src").alias("id")).distinct()
    return P.metapath_walks(e.select("src", "dst", F.col("edge_type").alias("rel")), starts, ["B", "B_1"], 3, 41)


_NEG = (
    "m AS (SELECT max(greatest(src, dst)) + 1 AS n FROM e)",
    f"c AS (SELECT j, CAST(floor({uni(51, "'s'", "j")} * n) AS BIGINT) AS src, CAST(floor({uni(51, "'d'", "j")} * n) AS BIGINT) AS dst FROM m, (SELECT unnest(range(6000)) AS j))",
)


@R.query(
    "negative_edges",
    V.ctes("e", more=_NEG) + "SELECT src, dst FROM (SELECT src, dst, min(j) AS j FROM c WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = c.src AND e.dst = c.dst) GROUP BY ALL ORDER BY j LIMIT 2000)",
)
def negative_edges(spark: Spark, d: str) -> DataFrame:
    e = V.edges(spark, d)
    n = e.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1
    return P.negative_edges(e, 2000, n, n, 51)


@R.query("drop_edges", V.ctes("e") + f"SELECT * FROM e WHERE {uni(61, 'src', 'dst')} >= 0.3")
def drop_edges(spark: Spark, d: str) -> DataFrame:
    return P.keep_edges(V.edges(spark, d), 0.3, 61, ["src", "dst"])


@R.query("drop_features", V.ctes("xl") + f"SELECT id, k, {V.r(f'CASE WHEN {uni(62, "(k - 1)")} >= 0.5 THEN v ELSE 0 END')} AS value FROM xl")
def drop_features(spark: Spark, d: str) -> DataFrame:
    return V.long(P.drop_features(V.features(spark, d), V.WIDTH, 0.5, 62))


@R.query("saint_node_sample", V.ctes("e", more=(_D, f"z AS (SELECT DISTINCT src AS id FROM (SELECT src FROM d ORDER BY {key(71, 'eid')}, eid LIMIT 300))")) + "SELECT src, dst, eid FROM d WHERE src IN (SELECT id FROM z) AND dst IN (SELECT id FROM z)")
def saint_node_sample(spark: Spark, d: str) -> DataFrame:
    return P.saint_node_sample(numbered(spark, d), 300, 71)[1].select("src", "dst", "eid")


@R.query(
    "saint_walk_sample",
    V.ctes("e", more=("n AS (SELECT DISTINCT node_id AS id FROM anchor_nodes WHERE scope = 'graph')", *_NB, *_walk(2, 72), f"z AS (SELECT DISTINCT id FROM ({_steps(2)}))"))
    + "SELECT src, dst, w FROM e WHERE src IN (SELECT id FROM z) AND dst IN (SELECT id FROM z)",
)
def saint_walk_sample(spark: Spark, d: str) -> DataFrame:
    roots = anchors(spark, d).select(F.col("id").alias("walk_id"), "id")
    return P.saint_walk_sample(V.edges(spark, d), roots, 2, 72)[1].select("src", "dst", "w")


@R.query(
    "weighted_sample",
    V.ctes("e", more=(_D, "q AS (SELECT d.src, d.dst, sum(e.w) AS w FROM d JOIN e ON e.src = d.src AND e.dst = d.dst GROUP BY ALL)"))
    + f"SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY -ln({uni(73, 'src', 'dst')} + {2.0**-53!r}) / w, dst) AS r FROM q) WHERE r <= 3",
)
def weighted_sample(spark: Spark, d: str) -> DataFrame:
    from weftgraph.operators.edges import coalesce

    return P.weighted_sample(coalesce(V.edges(spark, d)), ["src"], "dst", "w", 3, 73).select("src", "dst")


@R.query("block_model")
def block_model(spark: Spark, d: str) -> DataFrame:
    """Blocks of the sizes of the label classes, denser inside."""
    sizes = [r["n"] for r in V.labels(spark, d).groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy("y").collect()]  # one row a class
    return P.block_model(spark, sizes, [[0.05 if i == j else 0.005 for j in range(len(sizes))] for i in range(len(sizes))], 81)


_LB = f"lb AS (SELECT src, dst, 1 AS label, (row_number() OVER (ORDER BY {key(57, 'src', 'dst')}, src, dst) - 1) // 256 AS batch_id FROM d)"


@R.query("link_batches", V.ctes("e", more=(_D, _LB)) + "SELECT batch_id, src, dst, label FROM lb")
def link_batches(spark: Spark, d: str) -> DataFrame:
    return P.link_batches(V.edges(spark, d).select("src", "dst"), 256, 57)[0]


@R.query(
    "link_batches_neighbours",
    V.ctes("e", more=(_D, _LB, "b0 AS (SELECT DISTINCT batch_id, id FROM (SELECT batch_id, src AS id FROM lb UNION ALL SELECT batch_id, dst FROM lb))",
        f"e1 AS (SELECT * FROM (SELECT b.batch_id, d.src, d.dst, d.eid, {_rank('b.batch_id, d.dst', 59, 'b.batch_id', 'eid')} AS r FROM b0 b JOIN d ON d.dst = b.id) WHERE r <= 4)"))
    + "SELECT batch_id, src, dst, eid FROM e1",
)
def link_batches_neighbours(spark: Spark, d: str) -> DataFrame:
    seeds = P.link_batches(V.edges(spark, d).select("src", "dst"), 256, 57)[1]
    return P.neighbour_batches(numbered(spark, d), seeds, [4], 58)[1].select("batch_id", "src", "dst", "eid")


@R.query(
    "drop_walked_edges",
    V.ctes("e", more=("n AS (SELECT DISTINCT node_id AS id FROM anchor_nodes WHERE scope = 'graph')", *_NB, *_walk(2, 74), f"st AS ({_steps(2)})"))
    + "SELECT src, dst, w FROM e WHERE NOT EXISTS (SELECT 1 FROM st a JOIN st b ON b.walk_id = a.walk_id AND b.step = a.step + 1 WHERE a.id = e.src AND b.id = e.dst)",
)
def drop_walked_edges(spark: Spark, d: str) -> DataFrame:
    roots = anchors(spark, d).select(F.col("id").alias("walk_id"), "id")
    return P.drop_walked(V.edges(spark, d), roots, 2, 74).select("src", "dst", "w")


# --- splits -------------------------------------------------------------------------

_Y = f"r AS (SELECT id, y, row_number() OVER (ORDER BY {key(91, 'id')}, id) - 1 AS pos, count(*) OVER () AS n FROM y)"


@R.query("split_random", V.ctes("y", more=(_Y,)) + "SELECT id, CASE WHEN pos < floor(n * 0.6 + 1e-9) THEN 'train' WHEN pos < floor(n * 0.8 + 1e-9) THEN 'val' ELSE 'test' END AS part FROM r")
def split_random(spark: Spark, d: str) -> DataFrame:
    return L.random_split(V.labels(spark, d), {"train": 0.6, "val": 0.2, "test": 0.2}, 91)


@R.query("split_masks", V.ctes("y", more=(_Y,)) + "SELECT id, pos < floor(n * 0.6 + 1e-9) AS train_mask, pos >= floor(n * 0.6 + 1e-9) AND pos < floor(n * 0.8 + 1e-9) AS val_mask, pos >= floor(n * 0.8 + 1e-9) AS test_mask FROM r")
def split_masks(spark: Spark, d: str) -> DataFrame:
    return L.masks(split_random(spark, d), ["train", "val", "test"])


@R.query("split_few_shot", V.ctes("y") + f"SELECT id, y, CASE WHEN r <= 10 THEN 'train' ELSE 'test' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {key(92, 'id')}, id) AS r FROM y) WHERE r <= 40")
def split_few_shot(spark: Spark, d: str) -> DataFrame:
    return L.per_class_split(V.labels(spark, d), 10, 30, 92)


@R.query("split_stratified", V.ctes("y") + f"SELECT id, y, CASE WHEN r < floor(n * 0.5) THEN 'train' ELSE 'test' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {key(93, 'id')}, id) - 1 AS r, count(*) OVER (PARTITION BY y) AS n FROM y)")
def split_stratified(spark: Spark, d: str) -> DataFrame:
    return L.stratified_split(V.labels(spark, d), 0.5, 93)


_LS = f"ls AS (SELECT src, dst, row_number() OVER (ORDER BY {key(94, 'src', 'dst')}, src, dst) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT src, dst FROM e WHERE src <= dst))"
_PART = "CASE WHEN pos < n - floor(n * 0.1) - floor(n * 0.2) THEN 'train' WHEN pos < n - floor(n * 0.2) THEN 'val' ELSE 'test' END"


@R.query("split_links_labels", V.ctes("e", more=(_LS,)) + f"SELECT {_PART} AS part, src, dst, 1 AS label FROM ls")
def split_links_labels(spark: Spark, d: str) -> DataFrame:
    parts = L.link_split(V.edges(spark, d), 0.1, 0.2, 94, undirected=True)
    out = None
    for p in ("train", "val", "test"):
        t = parts[f"{p}_label"].withColumn("part", F.lit(p))
        out = t if out is None else out.unionByName(t)
    return out


@R.query(
    "split_links_messages",
    V.ctes("e", more=(_LS, f"q AS (SELECT src, dst, {_PART} AS part FROM ls)", "mm AS (SELECT src, dst, part FROM q UNION ALL SELECT dst, src, part FROM q WHERE src <> dst)"))
    + "SELECT 'train' AS part, src, dst FROM mm WHERE part = 'train' UNION ALL SELECT 'val', src, dst FROM mm WHERE part = 'train' UNION ALL SELECT 'test', src, dst FROM mm WHERE part <> 'test'",
)
def split_links_messages(spark: Spark, d: str) -> DataFrame:
    parts = L.link_split(V.edges(spark, d), 0.1, 0.2, 94, undirected=True)
    out = None
    for p in ("train", "val", "test"):
        t = parts[p].withColumn("part", F.lit(p))
        out = t if out is None else out.unionByName(t)
    return out


@R.query("split_links_negatives")
def split_links_negatives(spark: Spark, d: str) -> DataFrame:
    e = V.edges(spark, d)
    n = e.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1
    parts = L.link_split(e, 0.1, 0.2, 95, neg_ratio=1.0, n_nodes=n, disjoint=0.3)
    out = None
    for p in ("train", "val", "test"):
        t = parts[f"{p}_label"].withColumn("part", F.lit(p))
        out = t if out is None else out.unionByName(t)
    return out
