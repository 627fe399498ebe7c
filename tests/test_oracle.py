"""Every registered query against its comparison SQL on the smallest tables."""

import pytest
from harness import compare, connect

from quantloom.plans.catalog import all_queries

QUERIES = all_queries()
HEAVY = {"recorded_replay", "linear_grid", "boosted_trees", "meta_labels", "surrogate_classifier", "permutation_control", "strategy_benchmark"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in HEAVY])
def test_query(spark, con, sf, name):
    result = compare(spark, con, QUERIES[name], sf)
    assert result.startswith(("ok", "rows-only")), result


def test_registry_is_complete():
    from __spark_entry__ import oracle_sql, queries
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) >= 190
