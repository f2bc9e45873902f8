"""Registered queries against their SQL in DuckDB, on the smallest data."""

import glob
import os
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"

#: One or two of each module; the driver runs them all.
NAMES = [
    "spmm_sym_norm", "segment_mean", "segment_restricted_softmax", "csr_ind2ptr", "edges_is_undirected", "edges_homophily_node", "norm_gcn_loops", "laplacian_scaled",
    "gspmm_max_arg", "bspmm", "filter_low_pass", "diffusion_ppr", "khop_subgraph", "shortest_path_nodes", "triangles", "neighbour_batches_induced", "random_walks_restart",
    "node2vec_probabilities", "metapath_walks", "negative_edges", "saint_walk_sample", "split_stratified", "split_links_messages", "normalize_features", "standardize_on_train",
    "knn_cosine_embeddings", "tfidf", "pool_sort", "hetero_from_homogeneous", "metapath_counts", "batch_separate", "layer_gat", "layer_pna", "layer_hgt", "layer_cheb", "layer_dna",
    "stream_sessions", "p2_found", "p3_found", "p3_nodes", "p5_found", "p5_profile",
]


def norm(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return tuple(map(norm, x)) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, DATA)
    got = Counter(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    r = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == Counter(tuple(norm(row[i]) for i in at) for row in r.fetchall())


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_sql_text(spark):
    from weftgraph.plans.sql import register

    register(spark, DATA, ["graph_nodes", "nation"])
    got = spark.sql("SELECT e.dst, sum(e.w) AS s FROM g_edges e JOIN g_labels y ON y.id = e.src GROUP BY e.dst")
    assert got.count() > 0 and spark.sql("SELECT count(*) FROM nation").first()[0] == 25
