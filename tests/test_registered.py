"""Every registered query against its SQL on the smallest data set."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for file in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(file).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return connection


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8) + 0.0)
    return "NULL" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_same_result(spark, duck, name):
    frame = entry.queries()[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    rows = sorted([_value(r[c]) for c in columns] for r in frame.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted([_value(r[i]) for i in order] for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_every_query_without_sql_is_an_estimate():
    missing = set(entry.QUERIES) - set(entry.ORACLES)
    assert missing == {"latency_rollup_quantile"}
