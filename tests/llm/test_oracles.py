"""Queries that SQL can express, side by side with a second engine."""

import pytest
from oracle_check import compare, connect

from crawlq.llm import registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(registry.QUERIES[name](spark, SF_DIR), connect(SF_DIR), registry.ORACLES[name]) is None
