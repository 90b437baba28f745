"""Every query with an oracle against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from skein.plans import catalog, reports, retrieving, structure  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return con


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in catalog.ORACLES:
        assert len(rows) > 0
        return
    want = tables.sql(catalog.ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    place = [want.columns.index(c) for c in names]
    assert sorted(tuple(shown(r[c]) for c in names) for r in rows) == sorted(tuple(shown(r[p]) for p in place) for r in want.fetchall())
