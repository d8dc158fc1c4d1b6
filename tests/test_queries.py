"""Every registered query against its SQL on the smallest sample."""

import pytest

import __spark_entry__ as contract
from checks import compare, oracle
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"
SQL = oracle.sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries())


def test_sql_only_for_registered_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert compare.check(spark, duck, QUERIES[name], SQL[name], SF) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 6
