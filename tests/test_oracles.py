"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from siteweave.plans.fixtures import TABLES

DIR = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith(("op", "pipeline"))}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(cursor_rows):
    return sorted((tuple(map(plain, r)) for r in cursor_rows), key=lambda r: tuple("" if x is None else repr(x) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = rows(df.select(*[f"`{c}`" for c in cols]).collect())
    r = duck.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = rows([[x[names.index(c)] for c in cols] for x in r.fetchall()])
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
