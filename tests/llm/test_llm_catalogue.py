"""Every query of the subpackage runs on sf0.001; those with SQL are compared with it."""

import os

import pytest
from oracle import compare

from siderite.llm import queries

SF = os.environ.get("SIDERITE_TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    if name in queries.oracle_sql():
        # 100 documents are too few for their shares to come out
        compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.01" if name == "p8_checks" else SF)
    else:
        assert queries.queries()[name](spark, SF).count() > 0
