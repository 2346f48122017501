"""Every query of the catalogue against DuckDB on the smallest tables."""

import os
import re

import duckdb
import pytest

from millrace import queries as q

#: SQL whose rows come in an order.
ORDERED = re.compile(r"ORDER BY [\w, ]+$")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in q.TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(q.QUERIES))
def test_against_sql(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = [repr([r[n] for n in names]) for r in df.collect()]
    found = duck.sql(q.ORACLE_SQL[name])
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    want = [repr([r[k] for k in at]) for r in found.fetchall()]
    if ORDERED.search(q.ORACLE_SQL[name]):
        assert got == want
    assert sorted(got) == sorted(want)


def test_every_query_has_sql():
    assert set(q.QUERIES) == set(q.ORACLE_SQL)


def test_entry_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(q.QUERIES) <= set(e.queries())
