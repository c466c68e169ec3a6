"""Every query against its SQL on the smallest sample."""

import pytest
from conftest import SMALL
from parity import actual, connect, expected

from __spark_entry__ import entry, oracle_sql, queries
from drillsight.catalog.queries import all_queries

NAMES = sorted(oracle_sql())


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_its_sql():
    """All of the library's own; of the training-data operators those that SQL can express."""
    assert set(all_queries()) <= set(NAMES) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_same_result(spark, con, name):
    got = actual(queries()[name](spark, SMALL))
    want = expected(con, oracle_sql()[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"department", "emails_sent", "total_clicks", "click_rate"}
