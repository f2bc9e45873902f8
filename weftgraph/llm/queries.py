"""Queries of the problems on training data, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.core.session import cut, read
from weftgraph.llm import cooccur, groups, mixing, neighbours, quota, subjects, tokens
from weftgraph.plans.registry import Registry

R = Registry()


@R.query(
    "p1_found",
    """
    WITH RECURSIVE n AS (SELECT DISTINCT id FROM graph_nodes WHERE id IS NOT NULL),
    e AS (SELECT src AS a, dst AS b FROM graph_matches WHERE matched AND src IS NOT NULL AND dst IS NOT NULL AND src <> dst
          UNION SELECT dst, src FROM graph_matches WHERE matched AND src IS NOT NULL AND dst IS NOT NULL AND src <> dst),
    reach(id, other) AS (SELECT a, b FROM e UNION SELECT r.id, e.b FROM reach r JOIN e ON r.other = e.a)
    SELECT n.id, least(n.id, coalesce(min(r.other), n.id)) AS group_id FROM n LEFT JOIN reach r ON n.id = r.id GROUP BY n.id
    """,
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    matches = read(spark, d, "graph_matches").filter("matched")
    return groups.group_matches(read(spark, d, "graph_nodes"), matches)


def _pairs(spark: SparkSession, d: str, **options) -> DataFrame:
    authors = cooccur.cooccurrence(read(spark, d, "paper_author"), "paper_id", "author_id", **options)
    items = cooccur.cooccurrence(read(spark, d, "alircd_edges").filter("edge_type = 'B'"), "source_id", "dest_id", **options)
    return authors.withColumn("basket_table", F.lit("paper_author")).unionByName(items.withColumn("basket_table", F.lit("alircd_edges")))


def _cooccur_sql(select: str) -> str:
    one = """
    SELECT '{t}' AS basket_table, p.*, a.n AS n_a, b.n AS n_b, (SELECT count(DISTINCT k) FROM m_{t}) AS n FROM (
      SELECT x.i AS item_a, y.i AS item_b, count(*) AS n_ab FROM m_{t} x JOIN m_{t} y ON x.k = y.k AND x.i < y.i GROUP BY ALL) p
    JOIN s_{t} a ON a.i = item_a JOIN s_{t} b ON b.i = item_b
    """
    return f"""
    WITH m_paper_author AS (SELECT DISTINCT paper_id AS k, author_id AS i FROM paper_author WHERE paper_id IS NOT NULL AND author_id IS NOT NULL),
    m_alircd_edges AS (SELECT DISTINCT source_id AS k, dest_id AS i FROM alircd_edges WHERE edge_type = 'B' AND source_id IS NOT NULL AND dest_id IS NOT NULL),
    s_paper_author AS (SELECT i, count(*) AS n FROM m_paper_author GROUP BY i), s_alircd_edges AS (SELECT i, count(*) AS n FROM m_alircd_edges GROUP BY i),
    p AS ({one.format(t="paper_author")} UNION ALL {one.format(t="alircd_edges")})
    SELECT {select} FROM p WHERE n_ab >= 5 AND n_ab * n >= 3 * n_a * n_b
    """


@R.query("p6_found", _cooccur_sql("basket_table, item_a, item_b"))
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("basket_table", "item_a", "item_b")


_SCORES = _cooccur_sql("basket_table, item_a, item_b, n_ab, n_a, n_b, n, round(n_ab * n / (n_a * n_b), 6) AS lift")


@R.query("p6_scores", _SCORES)
def p6_scores(spark: SparkSession, d: str, **options) -> DataFrame:
    return _pairs(spark, d, **options).select("basket_table", "item_a", "item_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"))


@R.query("p6_scores_in_chunks", _SCORES)
def p6_scores_in_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The same with baskets of more than 8 items in chunk-pair products."""
    return p6_scores(spark, d, block=8)


@R.query(
    "p7_found",
    """
    WITH p AS (SELECT DISTINCT id, y FROM graph_nodes WHERE train_idx AND y >= 0 AND id IS NOT NULL),
    n AS (SELECT count(DISTINCT id) AS n FROM p)
    SELECT target_set, y FROM sample_targets t, n WHERE
      (SELECT count(*) FROM p WHERE p.y = t.y) < greatest(min_count, target_share * sample_frac * n) - 0.000001
    """,
)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = quota.sample_quotas(read(spark, d, "graph_nodes"), read(spark, d, "sample_targets"))
    return report.filter("not met").select("target_set", "y")


@R.query("p7_sample")
def p7_sample(spark: SparkSession, d: str) -> DataFrame:
    return quota.sample_quotas(read(spark, d, "graph_nodes"), read(spark, d, "sample_targets"))[0]


@R.query("p8_ids")
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(read(spark, d, "documents"), ["doc_id"])


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, d, "documents")
    sizes = cut(tokens.count_tokens(docs, ["doc_id", "source"]))
    return mixing.mix_sources(sizes, read(spark, d, "mix_targets"))


@R.query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].filter("not met").select("mix_name", "source")


@R.query("p9_selection")
def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix and how often each is used."""
    return _mix(spark, d)[0]


@R.query("p9_report")
def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


_VECTORS = (("graph_nodes", "id", "x"), ("alircd_nodes", "node_id", "node_embeds"))
_UNIT_SQL = """
    u_{t} AS (SELECT {i} AS id, min({v}::DOUBLE[])::DOUBLE[64] AS v FROM {t} WHERE {i} IS NOT NULL AND len({v}) = 64
      AND len(list_filter({v}, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter({v}, lambda c: c <> 0)) > 0 GROUP BY {i}),
    r_{t} AS (SELECT a.id, b.id AS other, array_cosine_similarity(a.v, b.v) AS cos FROM u_{t} a JOIN u_{t} b ON a.id <> b.id{on}),
    k_{t} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, other) AS r FROM r_{t}) WHERE r <= {k})
"""


def _unit_sql(k: int, on: str = "") -> str:
    return "WITH " + ", ".join(_UNIT_SQL.format(t=t, i=i, v=v, k=k, on=on) for t, i, v in _VECTORS)


@R.query(
    "p4_found",
    _unit_sql(3)
    + " UNION ALL ".join(
        f"SELECT DISTINCT '{t}' AS vec_table, least(id, other) AS id_a, greatest(id, other) AS id_b FROM k_{t} WHERE cos >= 0.9" for t, _, _ in _VECTORS
    ),
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = (
        neighbours.close_pairs(neighbours.nearest(read(spark, d, t), i, v, k=3, min_cos=0.9)).select(F.lit(t).alias("vec_table"), "id_a", "id_b")
        for t, i, v in _VECTORS
    )
    return a.unionByName(b)


@R.query("p4_knn")
def p4_knn(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar of every vector whose id is divisible by 20, among all vectors."""
    a, b = (
        neighbours.nearest(read(spark, d, t), i, v, k=10, queries=F.col("id") % 20 == 0).select(F.lit(t).alias("vec_table"), "id", "other", F.round("cos", 6).alias("cos"))
        for t, i, v in _VECTORS
    )
    return a.unionByName(b)


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_areas(read(spark, d, "documents"), read(spark, d, "subject_seeds"), read(spark, d, "subjects"))


@R.query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


@R.query("p10_composition")
def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """How many documents and how much prose of the corpus each subject has."""
    return _subjects(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("part"), 6).alias("mean_part"))
