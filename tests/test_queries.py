"""Every registered query against its SQL on the smallest given tables."""

import os

import oracle
import pytest

import __spark_entry__ as entry_module
from setspan.plans import registry

SF = f"{oracle.TESTDATA}/sf0.001"
ROWS_ONLY = {"gsea_adaptive"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


def test_registry():
    assert set(registry.QUERIES) - set(registry.ORACLES) == ROWS_ONLY
    assert set(registry.QUERIES) <= set(entry_module.queries())
    assert set(registry.ORACLES) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    query = registry.QUERIES[name]
    if name in ROWS_ONLY:
        assert query(spark, SF).count() > 0
        return
    n, message = oracle.compare(spark, con, query, registry.ORACLES[name], SF)
    assert not message, message
