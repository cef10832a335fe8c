"""Every named query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from rankspark.plans.oracle import ORACLE
from rankspark.plans.queries import QUERIES


@pytest.fixture(scope="module")
def sql(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def normal(frame):
    columns = sorted(frame.columns)
    rows = [
        tuple(None if v is None or v != v else (float(v) if isinstance(v, float) else v) for v in row)
        for row in frame[columns].itertuples(index=False)
    ]
    return columns, sorted(rows, key=repr)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= entry_point.queries().keys()
    assert ORACLE.keys() <= entry_point.oracle_sql().keys() <= entry_point.queries().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sql, sf_dir):
    assert normal(QUERIES[name](spark, sf_dir).toPandas()) == normal(sql.sql(ORACLE[name]).df())


def test_entry(spark):
    assert entry_point.entry(spark).count() == 10
