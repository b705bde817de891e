import os

import duckdb
import pytest

import __spark_entry__ as entry
from corvine.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(want.columns) == columns
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(want.select(*columns).fetchall(), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 2 and set(entry.oracle_sql()) <= set(entry.queries())
