"""Every catalogue query against its SQL."""

import duckdb
import pytest

from tarnwerk.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    values = frame[cols].astype(object).where(frame[cols].notna(), None)
    return cols, sorted(tuple(repr(v) for v in r) for r in values.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, small, name):
    got, want = rows(catalogue.QUERIES[name](spark, small).toPandas()), rows(duck.sql(catalogue.ORACLE_SQL[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_same_names():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
