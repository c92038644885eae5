"""Every registered query equals its SQL twin on the smallest tables."""

import os

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from timepoint.bindings import registry
from timepoint.session import scratch_space

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no supplied tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry()[0]))
def test_query_equals_sql(spark, con, name):
    with scratch_space(spark):
        df = registry()[0][name](spark, FOLDER)
        assert compare(df, con, registry()[1][name]) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_registry_is_complete():
    own, oracles = registry()
    assert own.keys() == oracles.keys()
    assert own.items() <= queries().items() and oracles.items() <= oracle_sql().items()


def test_entry_gives_rows(spark):
    df = entry(spark)
    assert df.count() == 3
    assert {"time", "on_time_perc", "optimistic_on_time_perc", "pessimistic_on_time_perc"} <= set(df.columns)
