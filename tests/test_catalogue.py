"""Every registered graph query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from graphloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, small, sql, name):
    df = catalogue.queries()[name](spark, small)
    result = sql.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted(repr(tuple(map(plain, r))) for r in result.fetchall())
    assert sorted(df.columns) == sorted(names)
    got = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
    assert got == want
