"""Side-by-side run of one registered query on Spark and DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem".split()
TYPE_OF = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _sort_key(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when columns, types and values agree; rows compare as a multiset."""
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    relation = con.sql(sql)
    sql_types = {n: str(t) for n, t in zip(relation.columns, relation.types, strict=True)}
    if set(spark_types) != set(sql_types):
        return [f"columns {sorted(spark_types)} != {sorted(sql_types)}"]
    problems = [
        f"type of {n}: {t} != {sql_types[n]}"
        for n, t in spark_types.items()
        if TYPE_OF.get(t, t) != sql_types[n]
    ]
    names = sorted(spark_types)
    ours = sorted((tuple(r[n] for n in names) for r in df.collect()), key=_sort_key)
    position = [relation.columns.index(n) for n in names]
    theirs = sorted((tuple(r[i] for i in position) for r in relation.fetchall()), key=_sort_key)
    if len(ours) != len(theirs):
        return [*problems, f"rows {len(ours)} != {len(theirs)}"]
    for a, b in zip(ours, theirs, strict=True):
        if a != b and not all(_same(x, y) for x, y in zip(a, b, strict=True)):
            return [*problems, f"{dict(zip(names, a, strict=True))} != {b}"]
    return problems


def _same(x: object, y: object) -> bool:
    if isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y):
        return True
    return x == y
