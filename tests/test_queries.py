"""Every query against its check SQL on the smallest tables."""

import pytest
from compare import compare, duck

import __spark_entry__ as E
from postaudit import catalog, oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_a_check():
    assert set(catalog.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, name, FOLDER) == ""


def test_entry(spark):
    assert E.entry(spark).count() > 0
