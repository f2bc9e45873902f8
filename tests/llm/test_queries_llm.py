"""The SQL of this package's queries, on the smallest data."""

import os

import pytest

from tests.test_queries import DATA, duck, norm  # noqa: F401


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["p1_found", "p4_found", "p6_scores", "p7_found"])
def test_matches_sql(spark, duck, name):  # noqa: F811
    from collections import Counter

    from weftgraph.llm.queries import R

    df = R.queries[name](spark, DATA)
    r = duck.execute(R.sql[name])
    names = [d[0] for d in r.description]
    got = Counter(tuple(norm(x[c]) for c in sorted(names)) for x in df.collect())
    assert got == Counter(tuple(norm(row[names.index(c)]) for c in sorted(names)) for row in r.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_one_row_a_document(spark):
    from weftgraph.llm.queries import R

    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    ids = R.queries["p8_ids"](spark, DATA)
    assert ids.count() == n and ids.select("doc_id").distinct().count() == n
    found = R.queries["p10_found"](spark, DATA)
    assert found.count() == found.distinct().count()
