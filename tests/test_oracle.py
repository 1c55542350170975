"""Every registered query against its SQL, and the driver contract."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as contract
from crawlq.plans import registry
from crawlq.plans.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(ORACLES) == set(registry.QUERIES)
    assert set(contract.queries()) >= set(registry.QUERIES) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    assert compare(registry.QUERIES[name](spark, SF_DIR), duck, ORACLES[name]) is None


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 50 and {r["reason"] for r in rows} >= {None, "require creditcard input form"}
