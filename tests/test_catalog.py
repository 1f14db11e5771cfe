"""Every registered query runs and equals its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from ledgerlens.catalog import load_catalog
from tools import check

QUERIES, ORACLE = load_catalog()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in check.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_oracle_has_its_query():
    assert set(ORACLE) <= set(QUERIES)
    assert len(ORACLE) > 0.9 * len(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = check.ordered(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLE[name])
    want = check.ordered([d[0] for d in cur.description], cur.fetchall())
    assert check.compare(got, want) == "ok"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_the_entry_registers_the_whole_catalogue():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
