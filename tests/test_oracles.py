"""Every registered query that has SQL equals DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "~"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)):
            return f"{x:.6f}"
        return str(x)

    return sorted(tuple(value(r[i]) for i in order) for r in rows), [names[i] for i in order]


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_equals_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    mine, names = plain([tuple(r) for r in df.collect()], df.columns)
    got = duck.execute(SQL[name])
    theirs, other = plain(got.fetchall(), [c[0] for c in got.description])
    assert names == other
    assert mine == theirs


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs_without_sql(spark, small, name):
    QUERIES[name](spark, small).count()


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark, small):
    df = entry.entry(spark)
    assert df.columns == ["chunk_id", "source_file", "status", "score", "snippet"] and df.count() == 5
