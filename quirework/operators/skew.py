"""Joins of rows with what was summed up of them by key, when a key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.session import stored

#: A key with more rows than this, and more than one in HOT_SHARE of all rows, is joined by broadcast.
HOT_ROWS, HOT_SHARE = 1000, 50_000
#: Keys that are broadcast to wide rows.
FEW_KEYS = 50_000


def join_back(rows: DataFrame, summed: DataFrame, key: str, times: str = "times_") -> DataFrame:
    """``rows`` joined with ``summed`` on ``key``, without a task that gets all rows of a frequent key.

    ``summed`` has a row a key and how many rows have it (``times``, which is dropped).
    Keys with more than HOT_ROWS rows and more than one in HOT_SHARE of all are HOT_SHARE
    at most, so they are broadcast; the others are joined by a shuffle. Rows whose key
    is null or isn't in ``summed`` are dropped.
    """
    summed = stored(summed, "summed")
    total = summed.agg(F.sum(times)).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot, cold = summed.filter(F.col(times) > limit).drop(times), summed.filter(F.col(times) <= limit).drop(times)
    rare = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rare.join(cold, key).unionByName(rows.join(F.broadcast(hot), key))


def chosen(rows: DataFrame, keys: DataFrame, on: list[str], n: int, without: bool = False) -> DataFrame:
    """The wide ``rows`` whose key is among the ``n`` ``keys`` (or isn't: ``without``).

    Few keys are broadcast, so that the rows stay where they are; many meet the rows in a
    shuffle, hashed on their side, so that the rows aren't sorted and nothing is spilled.
    """
    keys = keys.select(*on)
    return rows.join(F.broadcast(keys) if n <= FEW_KEYS else keys.hint("shuffle_hash"), on, "left_anti" if without else "left_semi")
