"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import os

import duckdb
import pytest

from quirework import oracles, queries


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir)
    want = duck.execute(oracles.SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(found.columns) == sorted(names)
    assert rows_of(found.columns, found.collect()) == rows_of(names, want.fetchall())


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(oracles.SQL)


def test_entry_is_lazy_and_has_columns(spark, sf_dir):
    import __spark_entry__

    assert {"query_id", "id", "rank"} <= set(__spark_entry__.entry(spark).columns)


def test_scans_read_few_columns(spark, sf_dir):
    """Column pruning and pushed filters reach the scan."""
    plan = queries.metadata_filtered_points(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(source)" in plan
    assert "text" not in plan.split("ReadSchema:")[1]
