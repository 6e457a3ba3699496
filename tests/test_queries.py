"""Every registered query against its SQL, and the entry point's contract."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from codeloom.plans import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def _rows(df):
    def plain(v):
        if v is None or v is pd.NA or isinstance(v, float) and v != v:
            return None
        v = v.item() if hasattr(v, "item") else v
        return int(v) if isinstance(v, float) and v.is_integer() else v  # whole numbers beside nulls

    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = own.QUERIES[name](spark, sf).toPandas(), duck.sql(own.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
