"""Queries that SQL can express equal their SQL twins, and all are registered."""

import os
import sys

import pytest

import __spark_entry__ as entry
from timepoint.llm.queries import ORACLES, QUERIES

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare, connect  # noqa: E402


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name, folder):
    assert compare(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) == []


def test_all_are_registered():
    assert QUERIES.keys() < entry.queries().keys() and "pipeline" in entry.queries()
    assert ORACLES.items() <= entry.oracle_sql().items() and "pipeline" not in entry.oracle_sql()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
