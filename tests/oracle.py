"""Comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def plain(value, inside=False):
    """Single numbers to nine digits; those inside of lists and structures as they are."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, (float, decimal.Decimal)):
        return float(value) if inside else float(f"{float(value):.9g}") or 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v, True) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v, True)) for k, v in value.items())
    return value


def rows_of(columns, rows):
    places = [list(columns).index(c) for c in sorted(columns)]
    return sorted(repr(tuple(plain(r[i]) for i in places)) for r in rows)


def assert_same(spark, query, sql, sf=SMALL):
    engine = duckdb.connect()
    engine.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        engine.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    df = query(spark, sf)
    expected = engine.sql(sql)
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(expected.columns, expected.fetchall())
