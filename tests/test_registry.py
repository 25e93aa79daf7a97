"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as spark_entry
from check import connect, difference

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
SQL = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(spark_entry.queries()))
def test_query(spark, duck, name):
    got = spark_entry.queries()[name](spark, SF_DIR).toPandas()
    assert len(got) > 0
    if name in SQL:
        assert difference(got, duck.sql(SQL[name]).df()) is None


def test_entry(spark):
    assert spark_entry.entry(spark).columns == ["run_id", "point_id", "cluster", "is_outlier"]
