"""Every query with an SQL oracle, compared value by value."""

import harness
import pytest

from seasontide.plans import catalog
from seasontide.plans.registry import QUERIES

CHECKED = [name for name in catalog.queries() if QUERIES[name].sql]
# empty at the smallest scale: one day, or no place in debt
MAY_BE_EMPTY = {"grid_points", "unindexed_places"}


@pytest.mark.parametrize("name", CHECKED)
def test_matches_oracle(spark, oracle, sf, name):
    query = QUERIES[name]
    message = harness.compare(spark, oracle, query.run, query.sql, sf)
    if name in MAY_BE_EMPTY and message == "no rows":
        message = ""
    assert not message


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
