"""Greedy packing of ordered chunks into episodes, for groups of any size.

An episode takes chunks in order and ends before the one that would carry it past the
limit, so where one starts depends on where the one before did: a fold over the group. It
is made parallel by two observations. From every chunk the start of the next episode is
known at once from running totals (a range lookup); and what a block of chunks does to the
episode that is open at its border depends only on that episode's running total, piecewise
constant in it. So a block becomes a short table of pieces: the successors are doubled
within the block, and of the paths only their last starts remain. Tables of neighbouring
blocks compose, 256 at a time, up a tree; the open episodes then travel down it. No task
sees more than a block of rows or 256 tables.

Null and empty texts have size 0; a group without chunks has no episode.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.operators.ordering import numbered
from quirework.session import stored

BLOCK_ROWS, FAN = 50_000, 256
NEVER = np.iinfo(np.int64).max
TABLE = "uppers array<long>, totals array<long>, places array<long>, zero long, zero_total long, zero_place long"


class Step(NamedTuple):
    """What chunks do to an open episode: the one open after them, by the running total at which it began.

    Below ``uppers[i]`` (and not below the one before) it began at total ``totals[i]``, place
    ``places[i]``; from the last upper on the episode goes on. One that is still empty
    began at ``zero`` and has an answer of its own (place -1: it goes on); ``zero`` is None if
    nothing that came before matters.
    """

    uppers: np.ndarray
    totals: np.ndarray
    places: np.ndarray
    zero: int | None
    zero_total: int
    zero_place: int

    def after(self, total: int, place: int) -> tuple[int, int]:
        if self.zero is not None and total == self.zero:
            return (self.zero_total, self.zero_place) if self.zero_place >= 0 else (total, place)
        i = int(np.searchsorted(self.uppers, total, side="right"))
        return (int(self.totals[i]), int(self.places[i])) if i < len(self.uppers) else (total, place)

    def then(self, later: Step) -> Step:
        ends = [later.after(int(t), int(p)) for t, p in zip(self.totals, self.places)]
        uppers = self.uppers
        if len(uppers) == 0 or uppers[-1] != NEVER:  # where this one lets the episode go on
            rest = np.searchsorted(later.uppers, uppers[-1], side="right") if len(uppers) else 0
            uppers = np.concatenate((uppers, later.uppers[rest:]))
            ends += list(zip(later.totals[rest:].tolist(), later.places[rest:].tolist()))
        zero_total, zero_place = self.zero_total, self.zero_place
        if self.zero is not None:
            zero_total, zero_place = later.after(*((zero_total, zero_place) if zero_place >= 0 else (self.zero, -1)))
        return _short(uppers, np.array([t for t, _ in ends], np.int64), np.array([p for _, p in ends], np.int64), self.zero, zero_total, zero_place)


def _short(uppers: np.ndarray, totals: np.ndarray, places: np.ndarray, zero: int | None, zero_total: int, zero_place: int) -> Step:
    """Neighbouring pieces with one answer as one."""
    last = np.flatnonzero(np.append(places[1:] != places[:-1], True)) if len(places) else np.zeros(0, np.int64)
    return Step(uppers[last], totals[last], places[last], zero, zero_total, zero_place)


class _Segment:
    """Consecutive chunks of one group: total before each, and after it."""

    def __init__(self, before: np.ndarray, after: np.ndarray, limit: int):
        self.before, self.after, self.limit, self.n = before, after, limit, len(before)

    def breaks(self, totals: np.ndarray) -> np.ndarray:
        """Where the next episode starts, for episodes that began at ``totals``; ``n``: beyond these chunks."""
        first = np.searchsorted(self.after, totals + self.limit, side="right")
        inside = first < self.n
        empty = self.before[np.minimum(first, self.n - 1)] <= totals  # the first chunk with content always fits
        return np.minimum(first + (inside & empty), self.n)

    def last_starts(self) -> np.ndarray:
        """From each chunk, were it a start: the last start among these chunks, by doubling the successors."""
        hop = self.breaks(self.before)
        last = np.where(hop < self.n, hop, np.arange(self.n))  # the last start is its own successor
        while not np.array_equal(further := last[last], last):
            last = further
        return last

    def starts(self, first: int) -> np.ndarray:
        """All starts on the path from ``first``."""
        hop, found = self.breaks(self.before), []
        while first < self.n:
            found.append(first)
            first = int(hop[first])
        return np.array(found, np.int64)


def _segments(table: pa.Table, limit: int) -> tuple[pa.Table, np.ndarray, bool, list[tuple[int, _Segment]]]:
    """The block's rows in order, their places, whether its first group goes on from the block before, and its groups' segments."""
    table = table.sort_by("place")
    groups, place = table.column("group").to_pylist(), table.column("place").to_numpy()
    marks = int(table.column("mark").to_pylist()[0])
    goes_on = bool(marks) and len(groups) > 1 and groups[0] == groups[1]
    table, groups, place = table.slice(marks), groups[marks:], place[marks:]
    before = table.column("total").to_numpy()
    after = before + table.column("bytes").to_numpy()
    cuts = [0, *(i for i in range(1, len(groups)) if groups[i] != groups[i - 1]), len(groups)]
    return table, place, goes_on, [(a, _Segment(before[a:b], after[a:b], limit)) for a, b in zip(cuts, cuts[1:])]


def _block_step(limit: int) -> Callable[[pa.Table], pa.Table]:
    def step(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        _, place, goes_on, segments = _segments(table, limit)
        a, s = segments[-1]
        last = s.last_starts()
        if len(segments) > 1 or not goes_on:
            made = Step(np.array([NEVER]), s.before[last[:1]], place[a + last[:1]], None, 0, -1)
        else:
            # an episode that began at total x ends before chunk j if after[j - 1] <= x + limit < after[j]
            empty = int(s.breaks(s.before[:1])[0])
            zero = (int(s.before[last[empty]]), int(place[last[empty]])) if empty < s.n else (0, -1)
            made = _short(s.after - limit, s.before[last], place[last], int(s.before[0]), *zero)
        return _as_table([(block, made)])

    return step


def _as_table(steps: list[tuple[int, Step]]) -> pa.Table:
    names = ["block", "uppers", "totals", "places", "zero", "zero_total", "zero_place"]
    columns = list(zip(*[(b, s.uppers.tolist(), s.totals.tolist(), s.places.tolist(), s.zero, s.zero_total, s.zero_place) for b, s in steps]))
    lists = pa.list_(pa.int64())
    return pa.table({n: pa.array(c, lists if n in ("uppers", "totals", "places") else pa.int64()) for n, c in zip(names, columns)})


def _steps(table: pa.Table) -> list[tuple[int, Step]]:
    rows = table.sort_by("block").to_pylist()
    return [(r["block"], Step(*(np.array(r[n], np.int64) for n in ("uppers", "totals", "places")), r["zero"], r["zero_total"], r["zero_place"])) for r in rows]


def _composed(fan: int) -> Callable[[pa.Table], pa.Table]:
    def compose(table: pa.Table) -> pa.Table:
        steps = _steps(table)
        whole = steps[0][1]
        for _, s in steps[1:]:
            whole = whole.then(s)
        return _as_table([(steps[0][0] // fan, whole)])

    return compose


def _entries(table: pa.Table) -> pa.Table:
    """The episode that is open at the border of each of some consecutive blocks; the first one's is given."""
    open_ = (table.column("open_total")[0].as_py(), table.column("open_place")[0].as_py())
    out = []
    for block, s in _steps(table):
        out.append((block, *open_))
        open_ = s.after(*open_)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("block", "open_total", "open_place"), zip(*out))})


def _open_episodes(steps: DataFrame, blocks: int, fan: int) -> DataFrame:
    """(block, open_total, open_place) from the blocks' tables: up a tree of compositions, then down."""
    levels, n = [stored(steps, "steps")], blocks
    while n > fan:
        levels.append(stored(levels[-1].groupBy(F.floor(F.col("block") / fan).alias("node")).applyInArrow(_composed(fan), f"block long, {TABLE}"), "steps"))
        n = -(-n // fan)
    entries = levels[-1].select(F.lit(0).cast("long").alias("node")).limit(1).withColumns({"open_total": F.lit(0).cast("long"), "open_place": F.lit(-1).cast("long")})
    for level in reversed(levels):
        children = level.withColumn("node", F.floor(F.col("block") / fan).cast("long")).join(entries, "node")
        found = children.groupBy("node").applyInArrow(_entries, "block long, open_total long, open_place long")
        entries = stored(found.withColumnRenamed("block", "node"), "entries")
    return entries.withColumnRenamed("node", "block")


def episode_starts(chunks: DataFrame, by: str, order: list[str], text: str, limit: int = 12_000, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """(by, *order, bytes, place, start): each chunk's place in the order of all, and the place of its episode's first chunk.

    ``order`` should tell the chunks of a group apart; equal ones are taken in no stated order.
    """
    names = [F.col(c).alias(f"order_{n}_") for n, c in enumerate(order)]
    rows = chunks.select(F.col(by).alias("group"), *names, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    keys = [f"order_{n}_" for n in range(len(order))]
    placed = stored(numbered(rows, [F.col("group"), *map(F.col, keys)], "place", before={"total": F.col("bytes")}), "placed")
    count = placed.count()
    block = F.floor(F.col("place") / block_rows).cast("long")
    # the last row of a block is also sent on to the next, to tell whether its group goes on there
    borders = placed.filter(F.col("place") % block_rows == block_rows - 1).select("*", (block + 1).alias("block"), F.lit(True).alias("mark"))
    blocked = placed.select("*", block.alias("block"), F.lit(False).alias("mark")).unionByName(borders.filter((F.col("place") < count - 1)))
    steps = blocked.select("block", "group", "place", "total", "bytes", "mark").groupBy("block").applyInArrow(_block_step(limit), f"block long, {TABLE}")
    entries = _open_episodes(steps, max(1, -(-count // block_rows)), fan)

    def assigned(table: pa.Table) -> pa.Table:
        open_total, open_place = (table.column(c).to_pylist()[0] for c in ("open_total", "open_place"))
        table, place, goes_on, segments = _segments(table, limit)
        start = np.zeros(len(place), np.int64)
        for k, (a, s) in enumerate(segments):
            here = start[a : a + s.n]
            first = 0
            if k == 0 and goes_on:
                first = int(s.breaks(np.array([open_total]))[0])
                here[:first] = open_place
            found = s.starts(first)
            here[first:] = np.repeat(place[a + found], np.diff(np.append(found, s.n)))
        return table.select(["group", *keys, "bytes", "place"]).append_column("start", pa.array(start))

    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    schema = ", ".join(f"{n} {kinds[n]}" for n in ("group", *keys, "bytes", "place")) + ", start long"
    made = blocked.join(entries, "block").groupBy("block").applyInArrow(assigned, schema)
    return made.select(F.col("group").alias(by), *[F.col(k).alias(c) for k, c in zip(keys, order)], "bytes", "place", "start")


def pack_episodes(chunks: DataFrame, by: str, order: list[str], text: str, limit: int = 12_000, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """(by, episode, chunks, bytes): the episodes of each group, counted from 0.

    An episode holds chunks of at most ``limit`` bytes together; one that is larger has an
    episode of its own, but for empty ones before it.
    """
    rows = episode_starts(chunks, by, order, text, limit, block_rows, fan)
    made = rows.groupBy(F.col(by).alias("group"), "start").agg(F.count("*").alias("chunks"), F.sum("bytes").alias("bytes"))
    counted = stored(numbered(made, [F.col("group"), F.col("start")], "at"), "counted")
    # a group's first episode is the one whose neighbour before is another group's
    last = counted.select((F.col("at") + 1).alias("at"), F.col("group").alias("before"), F.lit(True).alias("some"))
    first = F.when(F.col("some").isNull() | ~F.col("group").eqNullSafe(F.col("before")), F.col("at"))
    heads = counted.join(last, "at", "left").withColumn("head", first).drop("before", "some")
    ordinal = numbered(heads, [F.col("at")], "again", highest={"from": F.col("head")})
    return ordinal.select(F.col("group").alias(by), (F.col("at") - F.col("from")).cast("int").alias("episode"), "chunks", "bytes")
