"""Every query against its SQL on tables where a third of the rows share one key."""

from __future__ import annotations

import compare
import duckdb
import pytest

from dirstats.testbed import oracle, registry

QUERIES = registry.all_queries()
SQL = oracle.statements()
SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed_dir(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    con = duckdb.connect()
    for table in compare.TABLES:
        hot = (
            "* REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 7 ELSE l_partkey END AS l_partkey, "
            "CASE WHEN l_orderkey % 3 = 0 THEN 3 ELSE l_suppkey END AS l_suppkey, "
            "CASE WHEN l_orderkey % 6 = 0 THEN 40 ELSE l_quantity END AS l_quantity)"
        )
        columns = hot if table == "lineitem" else "*"
        con.execute(
            f"COPY (SELECT {columns} FROM '{SOURCE}/{table}.parquet') "
            f"TO '{folder}/{table}.parquet' (FORMAT parquet)"
        )
    return folder


@pytest.fixture(scope="module")
def skewed_duck(skewed_dir):
    return compare.connect(skewed_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql_on_skewed_tables(spark, skewed_dir, skewed_duck, name):
    assert compare.differences(QUERIES[name](spark, skewed_dir), skewed_duck, SQL[name]) == []
