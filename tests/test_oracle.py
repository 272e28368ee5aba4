"""Every query with SQL gives DuckDB's rows over the smallest tables."""

import math

import duckdb
import pytest

from sitegrain import catalog
from sitegrain.plans.dialect import TABLES

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF)
    theirs = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours.columns, map(tuple, ours.collect())) == _rows(theirs.columns, theirs.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
