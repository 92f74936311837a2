"""Every registered query equals its DuckDB oracle on the smallest fixture."""

import os

import pytest

from lotwise.plans.oracle import oracle_sql
from lotwise.plans.registry import queries
from lotwise.plans.verify import compare

from conftest import SMALL

KEYS = sorted(queries())


def test_every_query_has_an_oracle():
    assert set(KEYS) == set(oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="fixture data missing")
@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, key):
    result = compare(queries()[key](spark, SMALL), oracle_sql()[key], SMALL)
    assert result["rows_match"], result
    assert result["schema_match"], result
    assert result["hash_match"] or result.get("close_match"), result
