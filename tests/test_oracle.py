"""Every registered query against its DuckDB oracle SQL at sf0.01 (the correctness gate)."""

import pytest

from tests.conftest import SF01
from tests.oracle_compare import compare, duck
from threadscope.plans.oracle import ORACLE
from threadscope.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert not [k for k in QUERIES if "pipeline" in k or k.startswith("op")]


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    problems, _, _ = compare(spark, con, key, SF01)
    assert not problems, problems
