"""Every query of the catalog against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from hushlake.plans import catalog, catalog_forms, catalog_requests  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return repr(round(float(x), 6))
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLES:
        # no SQL for these: a second run gives the same
        assert got == sorted(tuple(plain(r[c]) for c in columns) for r in catalog.QUERIES[name](spark, sf).collect())
        return
    cursor = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
