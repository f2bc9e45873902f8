"""Readers of the file formats that graph data sets come in, and writers.

Text and JSON are read by Spark in parallel.  Binary archives (npz) are read on the driver,
since the format itself is one in-memory object.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.core.graph import Graph, HeteroGraph
from weftgraph.core.session import collect_bounded
from weftgraph.operators.edges import coalesce, remove_self_loops, to_undirected
from weftgraph.operators.segment import with_dense_ids

MAX_KINDS = 10_000  # labels, types or relations of a data set; more raise an error


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there; any other trouble is an error."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value), line_no 0-based over a file (or its parts in name order).

    Lines are read in parallel and ordered by file, start of the block they were read in, and
    place in it; no task numbers more than its partition.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "value")
    return with_dense_ids(lines.withColumn("k", F.struct("f", "b", "i")), "k", "line_no").select("line_no", "value")


def text_array(spark: SparkSession, path: str, sep: str = r"[,\s]+", kind: str = "double") -> DataFrame:
    """(line_no, x): one array a line, fields split by `sep`; a field that is no number is null."""
    parts = F.split(F.trim("value"), sep)
    return numbered_lines(spark, path).select("line_no", F.transform(parts, lambda p: p.try_cast(kind)).alias("x"))


def edge_list(spark: SparkSession, path: str, sep: str = r"[,\s]+", comment: str = "#") -> DataFrame:
    """(src, dst[, w null]) from `src dst [w]` lines; comment and short lines are skipped."""
    p = F.split(F.trim("value"), sep)
    lines = spark.read.text(path).filter(~F.col("value").startswith(comment) & (F.size(p) >= 2))
    e = lines.select(F.get(p, F.lit(0)).try_cast("bigint").alias("src"), F.get(p, F.lit(1)).try_cast("bigint").alias("dst"), F.get(p, F.lit(2)).try_cast("double").alias("w"))
    return e.filter("src is not null and dst is not null")


def embeddings_text(spark: SparkSession, path: str) -> DataFrame:
    """(id, x) from lines `id v1 v2 ...`; a header line of two fields is skipped."""
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(F.size(p) > 2)
    return lines.select(F.get(p, F.lit(0)).try_cast("bigint").alias("id"), F.transform(F.slice(p, 2, F.size(p) - 1), lambda v: v.try_cast("double")).alias("x")).filter("id is not null")


def one_hot(values: DataFrame, key: str, label: str, out: str) -> DataFrame:
    """Labels (few) as indicator arrays in the order of their values."""
    kinds = sorted(r[0] for r in collect_bounded(values.select(label).filter(F.col(label).isNotNull()).distinct(), MAX_KINDS, "labels"))
    return values.withColumn(out, F.array(*[(F.col(label) == k).cast("double") for k in kinds]))


def tu_family(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes (graph_id, id[, label, x]), edges (graph_id, src, dst), graphs (graph_id, y)) of the `NAME_A.txt` family.

    Node numbers are 1-based lines; ids come out 0-based, without loops and repeated edges.
    """
    at = lambda part: f"{folder}/{name}_{part}.txt"
    nodes = text_array(spark, at("graph_indicator"), kind="bigint").select(F.col("line_no").alias("id"), (F.get("x", F.lit(0)) - 1).alias("graph_id"))
    for part, column in (("node_labels", "label"), ("node_attributes", "x")):
        if not exists(spark, at(part)):
            continue
        t = text_array(spark, at(part))
        value: Column = F.get("x", F.lit(0)).cast("bigint") if column == "label" else F.col("x")
        nodes = nodes.join(t.select(F.col("line_no").alias("id"), value.alias(column)), "id", "left")
    e = edge_list(spark, at("A")).select((F.col("src") - 1).alias("src"), (F.col("dst") - 1).alias("dst")).filter("src <> dst").distinct()
    e = e.join(nodes.select(F.col("id").alias("src"), "graph_id"), "src").select("graph_id", "src", "dst")
    graphs = text_array(spark, at("graph_labels"), kind="bigint").select(F.col("line_no").alias("graph_id"), F.get("x", F.lit(0)).alias("y"))
    return nodes, e, graphs


def hgb(spark: SparkSession, folder: str) -> HeteroGraph:
    """node.dat (id, name, type[, features]), link.dat (src, dst, type, w), info JSON optional; tab-separated."""
    n = F.split("value", "\t")
    nodes = spark.read.text(f"{folder}/node.dat").select(
        F.get(n, F.lit(0)).try_cast("bigint").alias("id"), F.get(n, F.lit(2)).alias("t"),
        F.transform(F.split(F.coalesce(F.get(n, F.lit(3)), F.lit("")), ","), lambda v: v.try_cast("double")).alias("x"),
    )
    p = F.split("value", "\t")
    links = spark.read.text(f"{folder}/link.dat").select(
        F.get(p, F.lit(0)).try_cast("bigint").alias("src"), F.get(p, F.lit(1)).try_cast("bigint").alias("dst"), F.get(p, F.lit(2)).alias("r"), F.get(p, F.lit(3)).try_cast("double").alias("w")
    )
    typed = links.join(nodes.select(F.col("id").alias("src"), F.col("t").alias("st")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("t").alias("dt")), "dst")
    types = [r[0] for r in collect_bounded(nodes.select("t").distinct(), MAX_KINDS, "node types")]
    rels = [tuple(r) for r in collect_bounded(typed.select("st", "r", "dt").distinct(), MAX_KINDS, "relations")]
    edges = {(s, r, d): typed.filter((F.col("st") == s) & (F.col("r") == r) & (F.col("dt") == d)).select("src", "dst", "w") for s, r, d in rels}
    return HeteroGraph({t: nodes.filter(F.col("t") == t).select("id", "x") for t in types}, edges)


def labels_tsv(spark: SparkSession, path: str, id_at: int = 0, label_at: int = -1, sep: str = "\t") -> DataFrame:
    p = F.split("value", sep)
    return spark.read.text(path).select(F.get(p, F.lit(id_at)).try_cast("bigint").alias("id"), F.element_at(p, label_at if label_at < 0 else label_at + 1).alias("label")).filter("id is not null")


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, object) of RDF N-Triples; lines of another form are skipped."""
    pattern = r'^(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(.+?)\s*\.\s*$'
    lines = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return lines.select(*[F.regexp_extract("value", pattern, i + 1).alias(c) for i, c in enumerate(("subject", "predicate", "object"))])


def ntriples_graph(triples: DataFrame) -> Graph:
    """Entities with dense ids, edges (src, dst, edge_type) and their reverse relations."""
    names = triples.select(F.col("subject").alias("name")).unionByName(triples.select(F.col("object").alias("name"))).distinct()
    nodes = with_dense_ids(names, "name", "id")
    s, o = nodes.select(F.col("name").alias("subject"), F.col("id").alias("src")), nodes.select(F.col("name").alias("object"), F.col("id").alias("dst"))
    e = triples.join(s, "subject").join(o, "object").select("src", "dst", F.col("predicate").alias("edge_type"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat(F.lit("rev_"), "edge_type").alias("edge_type"))
    return Graph(nodes, e.unionByName(back))


def adjacency_json(spark: SparkSession, path: str, features: str = "features", labels: str = "labels", links: str = "links") -> Graph:
    """One JSON object with per-node arrays and adjacency lists."""
    j = spark.read.option("multiLine", True).json(path)
    nodes = j.select(F.posexplode(F.arrays_zip(features, labels)).alias("id", "z")).select(F.col("id").cast("bigint"), F.col(f"z.{features}").cast("array<double>").alias("x"), F.col(f"z.{labels}").cast("bigint").alias("y"))
    e = j.select(F.posexplode(links).alias("src", "to")).select("src", F.explode("to").alias("dst")).select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))
    return Graph(nodes, e)


def csr_npz(spark: SparkSession, path: str, binary: bool = True, undirected: bool = True) -> Graph:
    """adj_indptr, adj_indices[, adj_data], attr_* or node features, labels of one npz archive, read on the driver."""
    z = np.load(path, allow_pickle=False)
    ptr, idx = z["adj_indptr"], z["adj_indices"]
    src = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    w = np.ones(len(idx)) if binary or "adj_data" not in z else z["adj_data"].astype(float)
    e = spark.createDataFrame(_arrow(src=src.astype(np.int64), dst=idx.astype(np.int64), w=w))
    e = remove_self_loops(e)
    if undirected:
        e = to_undirected(e, "max")
    n = len(ptr) - 1
    columns = {"id": np.arange(n, dtype=np.int64)}
    if "labels" in z:
        columns["y"] = z["labels"].astype(np.int64)
    nodes = spark.createDataFrame(_arrow(**columns))
    if "attr_indptr" in z:
        ap, ai, ad = z["attr_indptr"], z["attr_indices"], z["attr_data"]
        long = spark.createDataFrame(_arrow(id=np.repeat(np.arange(n), np.diff(ap)).astype(np.int64), k=ai.astype(np.int64), value=ad.astype(float)))
        nodes = nodes.join(long.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("x_sparse")), "id", "left")
    return Graph(nodes, coalesce(e, "max"))


def _arrow(**columns: np.ndarray):
    import pyarrow as pa

    return pa.table({k: pa.array(v) for k, v in columns.items()})


def write_edges(edges: DataFrame, path: str, fmt: str = "parquet", by: str | None = None, parts: int = 64) -> None:
    """Parquet, ORC, CSV or JSON; `by` (src or dst) hash-partitions and sorts, the layout of a CSR or CSC."""
    if by:
        edges = edges.repartition(parts, by).sortWithinPartitions(by)
    w = edges.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))


def write_bucketed(edges: DataFrame, table: str, by: str, buckets: int = 64) -> None:
    """A bucketed, sorted catalog table: joins on `by` with equally bucketed tables need no shuffle."""
    edges.write.mode("overwrite").bucketBy(buckets, by).sortBy(by).saveAsTable(table)


#: Which reader reads which public data sets.
CONNECTORS = {
    "text arrays": ("text_array", ["ShapeNet point clouds", "ACM text", "IMDB text"]),
    "edge lists": ("edge_list", ["CA-GrQc", "Airports", "PolBlogs", "WebKB", "WikipediaNetwork", "Actor", "ML"]),
    "TU family": ("tu_family", ["MUTAG", "PROTEINS", "ENZYMES and others of the family"]),
    "HGB": ("hgb", ["ACM, DBLP, IMDB, Freebase of the benchmark"]),
    "RDF N-Triples": ("ntriples", ["AIFB", "MUTAG (RDF)", "BGS", "AM"]),
    "adjacency JSON": ("adjacency_json", ["WikiCS", "PPI", "Flickr", "Yelp"]),
    "CSR npz": ("csr_npz", ["Amazon", "Coauthor", "Reddit", "DeezerEurope", "FacebookPagePage", "BlogCatalog"]),
    "AliRCD text": ("parse_records", ["AliRCD session files, with rejects"]),
    "labels TSV": ("labels_tsv", ["AMiner", "Bail", "Credit"]),
    "embeddings text": ("embeddings_text", ["walk embeddings"]),
}
