"""Every query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from filmspark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(rows):
    return sorted(tuple((v is not None, repr(round(v, 9)) if isinstance(v, float) else str(v)) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert got
    if name in catalog.ORACLES:
        cursor = duck.execute(catalog.ORACLES[name])
        names = [x[0] for x in cursor.description]
        assert sorted(names) == columns
        want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
        assert plain(got) == plain(want)


def test_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
