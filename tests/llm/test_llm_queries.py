"""The queries that SQL can express against it in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest
from filmspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(queries.ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    plain = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert plain(df.select(*columns).collect()) == plain(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
