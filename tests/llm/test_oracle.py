"""Queries of the subpackage against their SQL."""

import pytest

from quirefold.llm import queries
from tests.oracle import compare, tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    compare(spark, tables(SF), queries.QUERIES[name], queries.ORACLE[name], SF)
