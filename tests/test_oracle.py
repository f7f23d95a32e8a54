"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, duck, name):
    found = entry_module.queries()[name](spark, SF_DIR)
    rows = sorted(repr([r[c] for c in sorted(found.columns)]) for r in found.collect())
    assert rows
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return
    expected = duck.sql(sql)
    names = list(expected.columns)
    assert sorted(names) == sorted(found.columns)
    order = [names.index(c) for c in sorted(names)]
    assert rows == sorted(repr([r[i] for i in order]) for r in expected.fetchall())
