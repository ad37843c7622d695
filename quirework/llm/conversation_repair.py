"""Finds faults of conversations and repairs them by the cheapest edits.

A repaired conversation's role initials are ``(s?(ua)+)?``. Rows are kept (0), given the
role user or assistant (2) or deleted (3, as blank rows and duplicates must be), empty
rows of a user or an assistant are inserted (2), and a truncated row that stays costs 1.

The edits form a weighted automaton over four states (start, after s, after u, after a).
It is determinised lazily: the vector of what the rest costs from each state, less its
least entry, becomes a state of a deterministic automaton, and a table keeps the
transitions it has met. A scan over that table, from the last row to the first, gives
the cost; a trace back over it takes at each state the tight arc with the least initial,
so that of all cheapest edits those come out whose initials are ASCII-least.

Conversations are sorted by ranges of (conversation, turn, role, text), nulls first, so
that a long one is cut into pieces. Those that lie within one range are solved there.
The others are solved from a byte a row: their texts stay in pieces of bounded size, and
only the audit, which is one value a conversation anyway, meets in a task. SHA-256 runs
over the pieces in order, in bounded memory.

Null roles and texts are one space. Rows of equal turn go by role and text; exact repeats
are counted before anything is sorted. A null id is a conversation of its own, an empty
table gives no rows. Input columns besides the four (and ``copies``) are left aside.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm._shared import maybe_known, small_batches, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = float("inf")
#: Where an initial leads from start, after s, after u and after a; -1: nowhere.
NEXT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
#: The role to insert or to give in each state, and the state after it.
ROLE = ("user", "user", "assistant", "user")
THEN = (2, 2, 3, 2)
ENDS = (0, 3)
#: Symbols: the initial's class, 4 more if truncated; or a row that must go.
CLASSES, GONE = "sua", 8
SPACE, STOPS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Rows and characters of a piece at most, but for one row at least.
PIECE_ROWS, PIECE_CHARS = 2000, 1 << 20


class Automaton:
    """Cost vectors as states, made when met; two tables of transitions and of tight arcs."""

    def __init__(self):
        self.ids: dict[tuple[float, ...], int] = {}
        self.vectors: list[tuple[float, ...]] = []
        self.table: dict[tuple[int, int], tuple[int, float]] = {}
        self.arcs: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end, _ = self.state([0.0 if q in ENDS else FAR for q in range(4)])

    def state(self, costs: list[float]) -> tuple[int, float]:
        """The state of a vector of costs, after insertions, and what was taken off it."""
        for _ in range(3):
            costs = [min(c, INSERT + costs[THEN[q]]) for q, c in enumerate(costs)]
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.ids[vector], least

    @staticmethod
    def edits(symbol: int, q: int) -> list[tuple[str, float, int]]:
        """What can be done with a row in state ``q``: initial, cost, next state; by initial."""
        found = [("D", DELETE, q)]
        if symbol != GONE:
            kept = NEXT.get("sua-"[symbol % 4], (-1,) * 4)[q]
            stays = TRUNCATED * (symbol >= 4)
            found += [("K", KEEP + stays, kept)] if kept >= 0 else []
            found.append(("R", REROLE + stays, THEN[q]))
        return found

    def before(self, state: int, symbol: int) -> tuple[int, float]:
        """The state before a row, from that after it, and the cost to add."""
        if (state, symbol) not in self.table:
            after = self.vectors[state]
            self.table[state, symbol] = self.state([min(cost + after[to] for _, cost, to in self.edits(symbol, q)) for q in range(4)])
        return self.table[state, symbol]

    def tight(self, state: int, symbol: int, q: int) -> tuple[str, int]:
        """The edits at a row in state ``q``, insertions before it included, and the state after it; ``state`` is the vector after the row."""
        if (state, symbol, q) not in self.arcs:
            here, shift = self.before(state, symbol)
            now, after, done, at = self.vectors[here], self.vectors[state], "", q
            while (state, symbol, q) not in self.arcs:
                ways = {initial: to for initial, cost, to in self.edits(symbol, at) if now[at] + shift == cost + after[to]}
                if now[at] == INSERT + now[THEN[at]]:
                    ways["I"] = -1
                initial = min(ways)
                if initial == "I":
                    done, at = done + "I", THEN[at]
                else:
                    self.arcs[state, symbol, q] = done + initial, ways[initial]
        return self.arcs[state, symbol, q]

    def solve(self, symbols: bytes, runs: dict[int, int]) -> tuple[int, list[str]]:
        """The cost, and the edits at each row; a last entry has the insertions at the end. ``runs``: how often a row that must go is there, if not once."""
        state, total, states = self.end, 0.0, array("H", bytes(2 * len(symbols) + 2))
        states[len(symbols)] = state
        for i in range(len(symbols) - 1, -1, -1):
            times = runs.get(i, 1)
            if times > 1:
                total += DELETE * (times - 1)
            state, cost = self.before(state, symbols[i])
            total += cost
            states[i] = state
        out, q = [], 0
        for i, symbol in enumerate(symbols):
            done, q = self.tight(states[i + 1], symbol, q)
            out.append(done + "D" * (runs.get(i, 1) - 1))
        tail = ""
        while q not in ENDS:
            tail, q = tail + "I", THEN[q]
        return int(total + self.vectors[states[0]][0]), [*out, tail]


def messages(edits: list[str], rows: list[tuple[str, str]], q: int = 0) -> tuple[list[dict[str, str]], int]:
    """The repaired rows, and the state after them: ``edits`` as by :meth:`Automaton.solve`, ``rows`` of (role, text)."""
    out = []
    for i, todo in enumerate(edits):
        for edit in todo:
            if edit == "I" or edit == "R":
                out.append({"role": ROLE[q], "text": "" if edit == "I" else rows[i][1]})
                q = THEN[q]
            elif edit == "K":
                out.append({"role": rows[i][0], "text": rows[i][1]})
                q = NEXT[rows[i][0][:1]][q]
    return out, q


class _Piece:
    """Rows of one conversation that follow each other, and what is counted over them."""

    def __init__(self, conv, seq: int, head: bool):
        self.conv, self.seq, self.head = conv, seq, head
        self.rows: list[tuple[str, str]] = []
        self.symbols, self.runs, self.chars = bytearray(), {}, 0
        self.low = self.high = self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, later: bool) -> None:
        """Adds a row that is there ``copies`` times; ``later`` if an earlier turn has the same role and text."""
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        initial = role[:1]
        self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
        self.illegal += copies - 1  # an initial after itself
        self.first = initial if self.first is None else self.first
        self.last = initial
        said = text.rstrip(SPACE)
        if not said:
            self.blank += copies
        else:
            self.duplicate += copies - (not later)
            self.truncated += not later and not said.endswith(STOPS)
        gone = not said or later
        if not gone:
            kind = CLASSES.find(initial) if initial else -1
            self.symbols.append((kind if kind >= 0 else 3) + 4 * (not said.endswith(STOPS)))
            self.rows.append((role, text))
            self.chars += len(role) + len(text)
        rest = copies if gone else copies - 1
        if rest:
            if rest > 1:
                self.runs[len(self.symbols)] = rest
            self.symbols.append(GONE)
            self.rows.append(("", ""))  # what goes isn't needed any more

    def as_row(self, part: int, whole: bool) -> dict:
        return {
            "conv": self.conv, "part": part, "seq": self.seq, "whole": whole, "low": self.low, "high": self.high, "turns": self.turns,
            "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "first": self.first, "last": self.last,
            "cost": None, "audit": None, "symbols": None, "runs": None, "messages": None,
        }


MESSAGES = "array<struct<role string, text string>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def damage(conversations: DataFrame) -> DataFrame:
    """Breaks rows by the CRC-32 of ``conv_id:turn`` modulo 20 (nulls: one space).

    0 drops the row, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``, 3 repeats it, 4
    makes it the user's. ``copies`` says how often a row is there; 0 for a dropped one.
    """

    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    how = F.crc32(F.concat_ws(":", known("conv_id"), known("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), known("role").alias("role"), known("text").alias("text"), how.alias("how_"))
    text = F.when(F.col("how_") == 1, "").when(F.col("how_") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how_") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("how_") == 0, 0).when(F.col("how_") == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` with exact repeats counted, and ``later`` where an earlier turn of the conversation has the same role and text.

    Only a digest's count is gathered for all rows; rows whose digest may be there
    twice are summed up where they lie and joined with what is known of it.
    """
    said = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("n")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    keyed = rows.withColumn("key_", F.sha2(said.cast("binary"), 256))
    there = keyed.filter("copies > 0")
    again = stored(there.groupBy("key_").agg(F.count("*").alias("times_"), F.min("turn").alias("least_"), F.bool_or(F.col("turn").isNull()).alias("null_")).filter("times_ > 1").drop("times_"), "again")
    split = maybe_known(keyed, "key_", again)
    alone = split.filter(~F.col("known_") | (F.col("copies") == 0)).select("conv_id", "turn", "role", "text", "copies", F.lit(False).alias("later"))
    several = split.filter(F.col("known_") & (F.col("copies") > 0)).groupBy("conv_id", "turn", "role", "text", "key_").agg(F.sum("copies").alias("copies"))
    later = F.when(F.col("null_"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least_"))
    return alone.unionByName(several.join(again, "key_", "left").select("conv_id", "turn", "role", "text", "copies", F.coalesce(later, F.lit(False)).alias("later")))


class Repaired(NamedTuple):
    """``pieces``: of conversations, the whole ones solved; ``cut``: what is known of those in several pieces; ``parts``: their repaired rows in order of (part, seq)."""

    pieces: DataFrame
    cut: DataFrame
    parts: DataFrame


def _piece_schema(conv: str) -> str:
    return f"conv {conv}, part int, seq int, whole boolean, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, cost long, audit string, symbols binary, runs map<int, long>, messages {MESSAGES}"


def _arrow(rows: list[dict], names: list[str], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n)) for n in names], names)


PAIR = pa.struct([("role", pa.string()), ("text", pa.string())])
TYPES = {n: pa.int64() for n in ("low", "high", "turns", *COUNTS, "cost")} | {"part": pa.int32(), "seq": pa.int32(), "whole": pa.bool_(), "first": pa.string(), "last": pa.string(), "audit": pa.string(), "symbols": pa.binary(), "runs": pa.map_(pa.int32(), pa.int64()), "messages": pa.list_(PAIR)}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a sorted partition; all conversations but its first and last are whole, and solved at once if they are one piece."""
    automaton, part = Automaton(), TaskContext.get().partitionId()
    piece, started, kind, out, held = None, 0, None, [], 0

    def closed(ends: bool) -> dict:
        """The row of the piece; ``ends``: the conversation ends here and the next follows."""
        whole = ends and started > 1 and piece.head
        row = piece.as_row(part, whole)
        if whole:
            row["cost"], edits = automaton.solve(bytes(piece.symbols), piece.runs)
            row["audit"], row["messages"] = "".join(edits), messages(edits, piece.rows)[0]
        else:
            row |= {"symbols": bytes(piece.symbols), "runs": list(piece.runs.items()), "messages": [{"role": r, "text": t} for r, t in piece.rows]}
        return row

    def batch(rows: list[dict]) -> pa.RecordBatch:
        names = list(rows[0])
        return _arrow(rows, names, TYPES | {"conv": kind})

    for arrived in batches:
        kind = arrived.schema.field(0).type
        for conv, turn, role, text, copies, later in zip(*(c.to_pylist() for c in arrived.columns)):
            if piece is None or conv != piece.conv:
                if piece is not None:
                    out.append(closed(True))
                    held += piece.chars
                started += 1
                piece = _Piece(conv, 0 if piece is None else piece.seq + 1, True)
            elif len(piece.symbols) >= PIECE_ROWS or piece.chars >= PIECE_CHARS:
                out.append(closed(False))
                held += piece.chars
                piece = _Piece(conv, piece.seq + 1, False)
            if copies:
                piece.add(turn, role, text, copies, later)
            if held >= PIECE_CHARS or len(out) >= 5000:
                yield batch(out)
                out, held = [], 0
    if piece is not None:
        out.append(closed(False))
    if out:
        yield batch(out)


def _joined(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches(_solved(table))


def _solved(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Solves a conversation from its pieces' symbols: a row a piece with its edits and the state before it, and one more with its counts."""
    automaton = Automaton()
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    symbols, runs = bytearray(), {}
    for r in rows:
        runs |= {len(symbols) + i: n for i, n in r["runs"]}
        symbols += r["symbols"]
    cost, edits = automaton.solve(bytes(symbols), runs)
    at, q, total = 0, 0, {c: 0 for c in COUNTS}
    turns, low, high, last = 0, None, None, None
    names = ["conv", "part", "seq", "state", "edits", "gaps", *COUNTS, "cost", "audit"]
    types = TYPES | {"conv": table.schema.field("conv").type, "state": pa.int32(), "edits": pa.list_(pa.string()), "gaps": pa.int64()}
    blank = dict.fromkeys(names)
    for k, r in enumerate(rows):
        mine = edits[at : at + len(r["symbols"])] + ([edits[-1]] if k == len(rows) - 1 else [])
        yield _arrow([blank | {"conv": r["conv"], "part": r["part"], "seq": r["seq"], "state": q, "edits": mine}], names, types)
        for i, todo in enumerate(mine):
            for edit in todo:
                if edit in "IR":
                    q = THEN[q]
                elif edit == "K":
                    q = NEXT[CLASSES[r["symbols"][i] % 4]][q]
        at += len(r["symbols"])
        for c in COUNTS:
            total[c] += r[c]
        if r["first"] is not None:
            total["illegal"] += last is not None and last + r["first"] not in ("su", "ua", "au")
            last = r["last"]
        if r["low"] is not None:
            turns += r["turns"] - (r["low"] == high)
            low, high = r["low"] if low is None else low, r["high"]
    gaps = 0 if low is None else high - low + 1 - turns
    yield _arrow([blank | total | {"conv": rows[0]["conv"], "part": -1, "gaps": gaps, "cost": cost, "audit": "".join(edits)}], names, types)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            done, _ = messages(r["edits"], [(m["role"], m["text"]) for m in r["messages"]] + [("", "")], r["state"])
            yield _arrow([r | {"messages": done}], ["conv", "part", "seq", "messages"], TYPES | {"conv": batch.schema.field("conv").type})


def repair(rows: DataFrame) -> Repaired:
    """Repairs conversations of rows (conv_id, turn, role, text[, copies])."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    plain = small_batches(rows).select("conv_id", F.col("turn").cast("long").alias("turn"), *spaced, copies.alias("copies"))
    conv = rows.schema["conv_id"].dataType.simpleString()
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    ranged = _marked(plain).repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    pieces = stored(ranged.select("conv_id", "turn", "role", "text", "copies", "later").mapInArrow(_pieces, _piece_schema(conv)), "pieces")
    cut = pieces.filter("not whole")
    narrow = cut.select("conv", "part", "seq", "symbols", "runs", "low", "high", "turns", *COUNTS, "first", "last")
    kind = f"conv {conv}, part int, seq int, state int, edits array<string>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    solved = stored(narrow.groupBy("conv").applyInArrow(_joined, kind), "solved")
    steps = solved.filter("part >= 0").select("part", "seq", "state", "edits")
    parts = cut.select("conv", "part", "seq", "messages").join(steps, ["part", "seq"]).mapInArrow(_applied, f"conv {conv}, part int, seq int, messages {MESSAGES}")
    return Repaired(pieces.filter("whole"), solved.filter("part < 0").drop("part", "seq", "state", "edits"), parts)


def repaired_rows(found: Repaired) -> DataFrame:
    """(conv_id, place, role, text): the rows of the repaired conversations; ``place`` orders those of one."""
    every = found.pieces.select("conv", F.lit(0).alias("part"), F.lit(0).alias("seq"), "messages").unionByName(found.parts)
    each = every.select("conv", "part", "seq", F.posexplode("messages").alias("at", "m"))
    return each.select(F.col("conv").alias("conv_id"), F.struct("part", "seq", "at").alias("place"), "m.role", "m.text")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over sorted pieces, one after another."""
    now, digest, some, kind = None, None, False, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([digest.hexdigest()])], ["conv", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, lines in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now[0] != conv:
                if now is not None:
                    yield done()
                now, digest, some = (conv,), hashlib.sha256(), False
            for m in lines:
                digest.update(f"{'\n' if some else ''}{m['role']}:{m['text']}".encode())
                some = True
    if now is not None:
        yield done()


def repair_report(rows: DataFrame) -> DataFrame:
    """A row a conversation: gaps, faults, cost, audit and the digest of the repaired ``role:text`` lines."""
    found = repair(rows)
    gaps = F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    columns = [F.col("conv").alias("conv_id"), "gaps", *COUNTS, "cost", "audit", "repaired_sha256"]
    whole = found.pieces.withColumn("gaps", gaps).withColumn("repaired_sha256", F.sha2(text.cast("binary"), 256)).select(*columns)
    conv = rows.schema["conv_id"].dataType.simpleString()
    sorted_parts = found.parts.repartition("conv").sortWithinPartitions("conv", "part", "seq").select("conv", "messages")
    digests = sorted_parts.mapInArrow(_hashed, f"conv {conv}, repaired_sha256 string")
    cut = found.cut.alias("c").join(digests.alias("d"), F.col("c.conv").eqNullSafe(F.col("d.conv"))).select("c.*", "d.repaired_sha256").select(*columns)
    return whole.unionByName(cut)
