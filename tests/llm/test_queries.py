"""The queries of the subpackage run on the smallest tables; the one with SQL agrees with it."""

import os

import duckdb
import pytest

from loomgraph.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_leaks_equal_sql(spark, data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    want = sorted(c.execute(queries.SQL["p9_found"]).fetchall())
    assert sorted((r["doc_id"], r["item_id"]) for r in queries.p9_found(spark, data).collect()) == want
