"""All registered queries of the warehouse against their SQL on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from verification.compare import connect, differences, rows_of_spark, rows_of_sql
from verification.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert differences(rows_of_spark(QUERIES[name](spark, SF)), rows_of_sql(con, ORACLES[name])) == []


def test_entry(spark):
    assert entry.entry(spark).count() == 30
