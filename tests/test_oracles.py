"""Every query that has SQL gives the same rows as that SQL, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomgraph.plans import derived, general, graph_queries, retrieval

CORE = {n: q for p in (general, graph_queries, retrieval, derived) for n, q in p.QUERIES.items()}
SQL = {n: s for p in (general, graph_queries, retrieval, derived) for n, s in p.SQL.items()}


def plain(v):
    if v is None:
        return "-"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def connection(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    df = CORE[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = connection(data).execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_entry(spark, data):
    assert entry.entry(spark).columns == ["episode_id", "entity_id", "edge_id", "owner", "confidence"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
