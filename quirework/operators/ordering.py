"""Positions and running totals in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.session import stored


def numbered(rows: DataFrame, order: list[Column], position: str = "position", before: dict[str, Column] | None = None, highest: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with their position from 0 in ``order``.

    ``before`` names sums over all earlier rows, ``highest`` maxima over these and the row
    itself. Rows are dealt to ranges and written once, so that positions within a range
    and the sizes of the ranges before it are those of the same rows. Rows that are equal
    in ``order`` share a range and are numbered in no stated order.
    """
    before, highest = before or {}, highest or {}
    own = {f"before_{n}_": c for n, c in enumerate(before.values())} | {f"highest_{n}_": c for n, c in enumerate(highest.values())}
    ranged = stored(rows.withColumns(own).repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranged")
    totals = [F.sum(c) if c.startswith("before_") else F.max(c) for c in own]
    sizes = sorted(tuple(r) for r in ranged.groupBy("range_").agg(F.count("*"), *totals).collect())  # a row a partition
    starts: dict[int, list] = {}
    now = [0, *(0 if c.startswith("before_") else None for c in own)]
    for part, *here in sizes:
        starts[part] = list(now)
        now = [_joined(c, a, b) for c, a, b in zip(["before_", *own], now, here)]
    rank = Window.partitionBy("range_").orderBy(*order)
    sofar = rank.rowsBetween(Window.unboundedPreceding, -1)
    upto = rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def start(n: int, kind: str) -> Column:
        pairs = [F.lit(x) for part, values in starts.items() if values[n] is not None for x in (part, values[n])]
        return (F.create_map(*pairs)[F.col("range_")] if pairs else F.lit(None)).cast(kind)

    made = {position: F.row_number().over(rank) - 1 + start(0, "long")}
    for n, name in enumerate(before):
        made[name] = F.coalesce(F.sum(f"before_{n}_").over(sofar), F.lit(0)) + start(n + 1, "long")
    for n, name in enumerate(highest):
        made[name] = F.greatest(F.max(f"highest_{n}_").over(upto), start(len(before) + n + 1, "long"))
    return ranged.withColumns(made).drop("range_", *own)


def _joined(kind: str, a: int | None, b: int | None) -> int | None:
    if kind.startswith("before_"):
        return (a or 0) + (b or 0)
    return b if a is None else a if b is None else max(a, b)
