"""Queries of the readers: a table is written in the format of a family of data sets and read again.

The SQL is that of the table itself, so a reader that loses or changes a row shows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.core.session import checkpoint_dir, cut
from weftgraph.operators.segment import with_dense_ids
from weftgraph.plans import views as V
from weftgraph.plans.registry import Registry
from weftgraph.sources import datasets
from weftgraph.sources import readers as S

R = Registry()
Spark = SparkSession


def folder(spark: Spark) -> str:
    return f"{checkpoint_dir(spark)}/source-{uuid.uuid4().hex}"


def put(df: DataFrame, at: str, *parts, sep: str = " ") -> str:
    """Lines of the parts (columns; arrays give all their values), as text files of the folder `at`."""
    df.select(F.concat_ws(sep, *[F.transform(p, lambda v: v.cast("string")) if isinstance(p, Column) else F.col(p).cast("string") for p in parts])).write.text(at)
    return at


@R.query("source_edge_list", V.ctes("e") + f"SELECT src, dst, {V.r('w')} AS w FROM e")
def source_edge_list(spark: Spark, d: str) -> DataFrame:
    at = put(V.edges(spark, d), folder(spark), "src", "dst", "w")
    return S.edge_list(spark, at).withColumn("w", V.real("w"))


@R.query("source_embeddings_text", V.ctes("xl") + f"SELECT id, k, {V.r('v')} AS value FROM xl")
def source_embeddings_text(spark: Spark, d: str) -> DataFrame:
    at = put(V.features(spark, d), folder(spark), "id", F.col("x"))
    return V.long(S.embeddings_text(spark, at))


@R.query("source_text_array", V.ctes("x") + f"SELECT n AS id, unnest(range(1, 5)) AS k, unnest(list_transform(x, lambda c: {V.r('c')})) AS value FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS n, x FROM x)")
def source_text_array(spark: Spark, d: str) -> DataFrame:
    at = put(V.features(spark, d).orderBy("id"), folder(spark), F.col("x"), sep=", ")
    return V.long(S.text_array(spark, at).withColumnRenamed("line_no", "id"))


@R.query("source_labels_tsv", V.ctes("y") + "SELECT id, CAST(y AS VARCHAR) AS label FROM y")
def source_labels_tsv(spark: Spark, d: str) -> DataFrame:
    return S.labels_tsv(spark, put(V.labels(spark, d), folder(spark), "id", "y", sep="\t"))


@R.query("source_csv", V.ctes("t") + f"SELECT src, dst, edge_type, {V.r('w')} AS w FROM t")
def source_csv(spark: Spark, d: str) -> DataFrame:
    """Quoted and escaped fields are left to the writer and the reader."""
    at = folder(spark)
    S.write_edges(V.typed(spark, d), at, "csv", by="dst", parts=8)
    back = spark.read.schema("src bigint, dst bigint, w double, edge_type string").option("header", True).csv(at)
    return back.select("src", "dst", "edge_type", V.real("w").alias("w"))


@R.query("source_orc", V.ctes("t") + f"SELECT src, dst, edge_type, {V.r('w')} AS w FROM t")
def source_orc(spark: Spark, d: str) -> DataFrame:
    at = folder(spark)
    S.write_edges(V.typed(spark, d), at, "orc", by="src", parts=8)
    return spark.read.orc(at).select("src", "dst", "edge_type", V.real("w").alias("w"))


_TRIPLE = "SELECT '<' || src_type || '/' || src || '>' AS subject, '<' || edge_type || '>' AS predicate, '<' || dst_type || '/' || dst || '>' AS object FROM a WHERE edge_type IS NOT NULL AND src_type IS NOT NULL AND dst_type IS NOT NULL"


def _triples(spark: Spark, d: str) -> DataFrame:
    e = V.alircd_edges(spark, d).na.drop()
    name = lambda t, i: F.concat(F.lit("<"), t, F.lit("/"), i, F.lit(">"))
    lines = e.select(F.concat_ws(" ", name("src_type", "src"), F.concat(F.lit("<"), "edge_type", F.lit(">")), name("dst_type", "dst"), F.lit(".")))
    at = folder(spark)
    lines.write.text(at)
    return S.ntriples(spark, at)


@R.query("source_ntriples", V.ctes("a", more=(f"tr AS ({_TRIPLE})",)) + "SELECT * FROM tr")
def source_ntriples(spark: Spark, d: str) -> DataFrame:
    return _triples(spark, d)


@R.query(
    "source_ntriples_graph",
    V.ctes("a", more=(
        f"tr AS ({_TRIPLE})", "nm AS (SELECT subject AS name FROM tr UNION SELECT object FROM tr)", "ni AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM nm)",
        "ed AS (SELECT a.id AS src, b.id AS dst, predicate AS edge_type FROM tr JOIN ni a ON a.name = subject JOIN ni b ON b.name = object)",
    )) + "SELECT * FROM ed UNION ALL SELECT dst, src, 'rev_' || edge_type FROM ed",
)
def source_ntriples_graph(spark: Spark, d: str) -> DataFrame:
    return S.ntriples_graph(cut(_triples(spark, d))).edges


_HGB = ("ty AS (SELECT id, min(t) AS t FROM (SELECT src AS id, src_type AS t FROM a UNION ALL SELECT dst, dst_type FROM a) WHERE t IS NOT NULL GROUP BY id)",)


@R.query(
    "source_hgb",
    V.ctes("a", more=_HGB) + "SELECT s.t AS src_type, a.edge_type, d.t AS dst_type, a.src, a.dst FROM a JOIN ty s ON s.id = a.src JOIN ty d ON d.id = a.dst WHERE a.edge_type IS NOT NULL",
)
def source_hgb(spark: Spark, d: str) -> DataFrame:
    e = V.alircd_edges(spark, d)
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("src_type").alias("t")), F.struct(F.col("dst").alias("id"), F.col("dst_type").alias("t")))).alias("n"))
    nodes = ends.select("n.*").filter("t is not null").groupBy("id").agg(F.min("t").alias("t"))
    at = folder(spark)
    put(nodes.withColumn("name", F.concat(F.lit("n"), "id")), f"{at}/node.dat", "id", "name", "t", sep="\t")
    put(e.filter("edge_type is not null").withColumn("w", F.lit(1.0)), f"{at}/link.dat", "src", "dst", "edge_type", "w", sep="\t")
    out = None
    for (s, r, t), edges in S.hgb(spark, at).edges.items():
        part = edges.select(F.lit(s).alias("src_type"), F.lit(r).alias("edge_type"), F.lit(t).alias("dst_type"), "src", "dst")
        out = part if out is None else out.unionByName(part)
    return out


@R.query(
    "source_tu_family",
    V.ctes("e", "g", more=(
        "gi AS (SELECT graph_id, row_number() OVER (ORDER BY graph_id) - 1 AS gn FROM (SELECT DISTINCT graph_id FROM g))",
        "ni AS (SELECT g.id, gi.gn, row_number() OVER (ORDER BY gn, id) - 1 AS n FROM g JOIN gi ON gi.graph_id = g.graph_id)",
    )) + "SELECT DISTINCT a.gn AS graph_id, a.n AS src, b.n AS dst FROM e JOIN ni a ON a.id = e.src JOIN ni b ON b.id = e.dst AND b.gn = a.gn WHERE a.n <> b.n",
)
def source_tu_family(spark: Spark, d: str) -> DataFrame:
    g = V.graphs(spark, d)
    number = with_dense_ids(g.select("graph_id").distinct(), "graph_id", "gn")
    nodes = cut(with_dense_ids(g.join(number, "graph_id").select("id", "gn", F.struct("gn", "id").alias("k")), "k", "n").select("id", "gn", "n"))
    e = V.edges(spark, d).join(nodes.select(F.col("id").alias("src"), "gn", F.col("n").alias("s")), "src").join(nodes.select(F.col("id").alias("dst"), "gn", F.col("n").alias("t")), ["dst", "gn"])
    at = folder(spark)
    put(nodes.orderBy("n").select(F.col("gn") + 1), f"{at}/T_graph_indicator.txt", "(gn + 1)")
    put(e.select((F.col("s") + 1).alias("s"), (F.col("t") + 1).alias("t")), f"{at}/T_A.txt", "s", "t", sep=", ")
    put(nodes.groupBy("gn").agg(F.count(F.lit(1)).alias("y")).orderBy("gn"), f"{at}/T_graph_labels.txt", "y")
    return S.tu_family(spark, at, "T")[1]


@R.query("source_geom_gcn_nodes", V.ctes("x", "y") + f"SELECT x.id, unnest(range(1, 5)) AS k, unnest(list_transform(x.x, lambda c: {V.r('c')})) AS value, y FROM x JOIN y ON y.id = x.id")
def source_geom_gcn_nodes(spark: Spark, d: str) -> DataFrame:
    return V.long(_geom(spark, d).nodes, keys=("id", "y")).select("id", "k", "value", "y")


@R.query("source_geom_gcn_edges", V.ctes("e") + "SELECT DISTINCT src, dst FROM e")
def source_geom_gcn_edges(spark: Spark, d: str) -> DataFrame:
    return _geom(spark, d).edges


def _geom(spark: Spark, d: str):
    """The graph as the files of that family, whose first lines are headers."""
    at = folder(spark)
    nodes = V.features(spark, d).join(V.labels(spark, d), "id").withColumn("v", F.array_join(F.transform("x", lambda c: c.cast("string")), ","))
    head = spark.createDataFrame([("node_id", "feature", "label")], "id string, v string, y string")
    put(head.unionByName(nodes.select(F.col("id").cast("string"), "v", F.col("y").cast("string"))), f"{at}/out1_node_feature_label.txt", "id", "v", "y", sep="\t")
    put(spark.createDataFrame([("node_id", "node_id")], "src string, dst string").unionByName(V.edges(spark, d).select(F.col("src").cast("string"), F.col("dst").cast("string"))), f"{at}/out1_graph_edges.txt", "src", "dst", sep="\t")
    return datasets.load(spark, "cornell", at)


@R.query("source_movielens", V.ctes("e") + f"SELECT src - 1 AS src, dst - 1 AS dst, {V.r('w')} AS w FROM e")
def source_movielens(spark: Spark, d: str) -> DataFrame:
    """Edges as ratings under typed headers."""
    at = folder(spark)
    e = V.edges(spark, d)
    write = lambda df, part: df.write.option("sep", "\t").option("header", True).csv(f"{at}/ml-100k.{part}")
    write(e.select(F.col("src").alias("user_id:token"), F.col("dst").alias("item_id:token"), F.col("w").alias("rating:float")), "inter")
    write(e.select(F.col("src").alias("user_id:token")).distinct(), "user")
    write(e.select(F.col("dst").alias("item_id:token")).distinct(), "item")
    return datasets.load(spark, "ml-100k", at).edge_table("rates").withColumn("w", V.real("w"))


@R.query("source_polblogs", V.ctes("y") + "SELECT row_number() OVER (ORDER BY id) - 1 AS id, y FROM y")
def source_polblogs(spark: Spark, d: str) -> DataFrame:
    """Classes by line."""
    at = folder(spark)
    put(V.labels(spark, d).orderBy("id"), f"{at}/labels.tsv", "y")
    put(V.edges(spark, d), f"{at}/adjacency.tsv", "src", "dst", sep="\t")
    return datasets.load(spark, "polblogs", at).nodes
