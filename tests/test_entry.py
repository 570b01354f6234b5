"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from distloom import queries as library

DATA = os.environ.get("DISTLOOM_TESTDATA", "/root/testdata/sf0.001")
TABLES = ("part", "lineitem", "pages", "documents")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([r[i] for i in order]) for r in data)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", library.queries())
def test_query(spark, name):
    got = library.queries()[name](spark, DATA)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    expected = con.execute(library.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(got.columns)
    found = rows(got.columns, got.collect())
    assert found == rows(columns, expected.fetchall())
    assert found or "error" in name
