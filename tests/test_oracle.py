"""Every registered query outside the training-data operators against its SQL."""

import pytest

from quirefold.plans import registry
from tests.oracle import compare, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    if name in registry.ORACLE:
        compare(spark, con, registry.QUERIES[name], registry.ORACLE[name], SF)
    else:
        assert registry.QUERIES[name](spark, SF).collect()  # tests of the operator hold its rows against other computations


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
