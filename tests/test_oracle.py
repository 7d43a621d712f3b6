"""Every registered query against its SQL, on Spark and DuckDB."""

from __future__ import annotations

import __spark_entry__ as contract
import compare
import pytest

from dirstats.testbed import oracle, registry

QUERIES = registry.all_queries()
SQL = oracle.statements()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert compare.differences(QUERIES[name](spark, sf_dir), duck, SQL[name]) == []


def test_comparison_notices_a_wrong_value(spark, sf_dir, duck):
    df = QUERIES["sum_01_total"](spark, sf_dir)
    wrong = SQL["sum_01_total"].replace("count(*) AS total", "count(*) + 1 AS total")
    assert wrong != SQL["sum_01_total"]
    assert compare.differences(df, duck, wrong)


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
