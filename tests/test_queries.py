import os

import duckdb
import pytest

from tessera.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(float(f"{r[i]:.10g}")) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(queries()))
def test_matches_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    r = duck.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(r.columns)
    assert rows(df.columns, df.collect()) == rows(r.columns, r.fetchall())
