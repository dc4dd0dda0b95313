"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from cartlore.fixtures import BASE_TABLES

DUCK_TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "float": "FLOAT",
    "boolean": "BOOLEAN",
}


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def duck_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found = con.execute(sql)
    columns = [(d[0], str(d[1])) for d in found.description]
    return columns, found.fetchall()


def assert_same(df, sf_dir: str, sql: str) -> None:
    columns, expected = duck_rows(sf_dir, sql)
    names = sorted(df.columns)
    assert names == sorted(n for n, _ in columns)
    types = dict(columns)
    assert {n: DUCK_TYPES.get(t, t) for n, t in df.dtypes} == types
    order = [[n for n, _ in columns].index(n) for n in names]
    actual = Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())
    wanted = Counter(tuple(_plain(r[i]) for i in order) for r in expected)
    assert actual == wanted
