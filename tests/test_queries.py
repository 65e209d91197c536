"""Every query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, _plain
from signpost.queries import QUERIES
from tests.conftest import plan_of


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, db, name):
    df = queries()[name](spark, sf)
    plan = plan_of(df)
    names = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
    rel = db.sql(oracle_sql()[name])
    at = [rel.columns.index(c) for c in names]
    assert sorted(rel.columns) == names
    want = sorted(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    assert got == want
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # no embedding is computed twice in one row
    assert plan.count("md5(cast(lambda") <= 1


def test_entry(spark):
    assert entry(spark).count() > 0
