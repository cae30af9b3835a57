"""Every registered relational query with a twin gives DuckDB's rows on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from sparrowsql.plans import suite
from sparrowsql.sources.tables import TABLES

TWINS = suite.oracle_sql()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    return value


@pytest.mark.parametrize("name", sorted(suite.queries()))
def test_query(spark, duck, sf, name):
    df = suite.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name in TWINS:
        found = duck.execute(TWINS[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        place = [names.index(c) for c in columns]
        assert got == sorted(repr([plain(r[i]) for i in place]) for r in found.fetchall())
    else:
        assert got


def test_plans_push_filters_and_prune_columns(spark, sf):
    plan = suite.queries()["scan_range"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThanOrEqual(o_orderkey,100), LessThan(o_orderkey,300)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
