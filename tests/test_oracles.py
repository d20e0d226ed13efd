"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from abundara.plans import queries as Q
from abundara.sources.tables import TABLES


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    return str(v)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    df = Q.QUERIES[name](spark, sf_dir)
    got = df.collect()
    want = duck.execute(Q.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    rows = lambda rs, cols: sorted(str(tuple(cell(r[cols.index(c)]) for c in order)) for r in rs)
    assert rows(got, df.columns) == rows(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, sf_dir, name):
    assert Q.QUERIES[name](spark, sf_dir).count() > 0


def test_entry():
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
