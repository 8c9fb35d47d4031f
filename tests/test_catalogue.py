"""Every query of the core that has SQL, against DuckDB on sf0.001."""

import os

import pytest
from oracle import compare

from siderite.plans import catalogue

SF = os.environ.get("SIDERITE_TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, name):
    compare(spark, name, catalogue.queries()[name], catalogue.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() >= 0
