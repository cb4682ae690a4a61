"""Every registered query against its SQL at the smallest scale."""

import os

import pytest

import __spark_entry__ as contract
from check import compare, database

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, con, name):
    good, text = compare(spark, con, name, SF_DIR)
    assert good, text


def test_entry(spark):
    assert contract.entry(spark).count() > 0
