"""The driver's entry points, and every query outside the optional subpackage against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from corpuskiln.plans import registry


def test_entry_has_rows_of_a_stable_schema(spark):
    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema and first.count() > 0


def test_all_queries_are_registered():
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(same_as_sql, name):
    same_as_sql(registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.columns and df.count() >= 0
