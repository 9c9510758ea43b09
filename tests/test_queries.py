"""Every registered query beside its DuckDB text, on the smallest tables."""

import pytest

import __spark_entry__
from tests.compare import compare, connect
from tidemark import scenarios

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(scenarios.queries()))
def test_query(spark, con, name):
    sql = scenarios.oracle_sql().get(name)
    run = scenarios.queries()[name]
    if sql is None:
        assert run(spark, SF).count() >= 0
    else:
        assert compare(spark, con, SF, run, sql) == ""


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
