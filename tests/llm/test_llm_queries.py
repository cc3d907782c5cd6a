"""The registered queries against SQL, and their shape where SQL cannot express them."""

import os

import oracle
import pytest

from setspan.llm import queries

SF = f"{oracle.TESTDATA}/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = oracle.duck(SF)
    n, message = oracle.compare(spark, con, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert not message, message
    assert n > 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
