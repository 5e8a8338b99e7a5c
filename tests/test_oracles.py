"""Every registered query against its SQL."""

import os

import pytest
from compare import connect, differences

from tabulens.registry import ORACLES, QUERIES

FOLDER = os.environ.get("TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, connection, name):
    assert differences(spark, connection, QUERIES[name], ORACLES[name], FOLDER) == []


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)


def test_comparison_notices_differences(spark, connection):
    def query(spark, folder):
        return spark.createDataFrame([(1, 2.0)], "a int, b double")

    def found(sql):
        return differences(spark, connection, query, sql, FOLDER)

    assert found("SELECT 2.0::DOUBLE AS b, 1 AS a") == []
    assert found("SELECT 2.5::DOUBLE AS b, 1 AS a")
    assert found("SELECT 2.0::DOUBLE AS c, 1 AS a")
    assert found("SELECT 2.0::DOUBLE AS b, 1 AS a WHERE 1 = 0")


def test_entry_runs(spark):
    import __spark_entry__ as entry

    frame = entry.entry(spark)
    assert frame.columns == ["label", "y"] and frame.count() == 3
