"""Operators on small fixtures against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quirework.operators import documents as D
from quirework.operators.ordering import numbered


@pytest.fixture
def scattered(spark):
    """Eight partitions stay eight: nothing is coalesced."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("n", "most"), [(1000, 100), (1001, 7), (99, 100), (250, 249)])
def test_stride_sample_takes_evenly_spread_positions(scattered, n, most):
    keys = random.Random(5).sample(range(10**6), n)
    rows = scattered.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    got = sorted(r.k for r in D.stride_sample(rows, ["k"], most).collect())
    want = sorted(keys) if n <= most else [sorted(keys)[i * n // most] for i in range(most)]
    assert got == want


def test_numbered_counts_from_zero_with_nulls_where_asked(scattered):
    rows = scattered.createDataFrame([(x,) for x in ["b", None, "a", "é", "Z"]], "s string")
    assert {r.s: r.position for r in numbered(rows, [F.col("s").asc_nulls_last()]).collect()} == {"Z": 0, "a": 1, "b": 2, "é": 3, None: 4}
    assert numbered(rows.limit(0), [F.col("s")]).count() == 0
