"""The corpus operators' queries against their DuckDB SQL."""

import duckdb
import pytest

from skein.llm import queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, name, size):
    data = f"/root/testdata/{size}"
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from read_parquet('{data}/{table}.parquet')")
    df = queries.QUERIES[name](spark, data)
    want = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in df.columns]

    def shown(value):
        return repr(round(value, 6)) if isinstance(value, float) else str(value)

    assert sorted(tuple(map(shown, r)) for r in df.collect()) == sorted(tuple(shown(r[p]) for p in place) for r in want.fetchall())
