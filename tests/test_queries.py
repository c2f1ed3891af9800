"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from larder.plans import registry
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
SQL = {n: s for n, s in contract.oracle_sql().items() if n in registry.QUERIES}
QUERIES = {n: q for n, q in contract.queries().items() if n in registry.QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, con, name):
    assert name in SQL, "every query has reference SQL"
    assert compare(spark, con, QUERIES[name], SQL[name], FOLDER) is None


def test_entry_runs(spark):
    assert contract.entry(spark).limit(1).count() == 1
