import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = sorted(entry.catalog.QUERIES)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CORE)
def test_as_sql(spark, duck, name):
    got = entry.catalog.QUERIES[name](spark, SF)
    rows = got.collect()
    sql = entry.catalog.ORACLES.get(name)
    if sql is None:
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(repr(tuple(r[c] for c in want.columns)) for r in rows) == sorted(map(repr, want.fetchall()))
