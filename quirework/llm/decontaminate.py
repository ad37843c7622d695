"""Benchmark decontamination with suffix arrays over shards of the training text.

Each task cuts its texts into shards of bounded size, builds a word-level suffix
array over each and binary-searches every benchmark suffix in it. A suffix that
reaches ``window`` words (or the whole item, if that is shorter) verbatim is a
match; matches on one diagonal join into the longest one. Nothing is shuffled.

The benchmark is a stated query set. It goes out in blocks of measured size, so
that a task holds one block and one shard at a time. A word that no item of the
block has ends every match, so stretches between such words that are shorter
than the shortest window get no entries in the array.

Null or empty texts have no words. Benchmark rows without words or with a null
item_id are no items; repeated item_ids are one item. Each row is searched by itself,
repeated or not, its text whole. Other columns pass through, except one of the result's
name, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm._shared import as_bytes, chunks, each_value, free_name, ranges, small_batches

#: Words are runs of digits, letters a-z (A-Z lower-cased) and anything beyond ASCII.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
RESULT = (
    "struct<n_words: bigint, n_hit: bigint, item_ids: array<string>,"
    " matches: array<struct<item_id: string, item_word: bigint, doc_word: bigint, n_words: bigint>>>"
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class TestBlock:
    """The suffixes of one block of benchmark items, cut to their windows."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.item_ids: list[str] = sorted({i for i, _ in items})
        number = {i: n for n, i in enumerate(self.item_ids)}
        found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item_id, text in sorted(items):
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            length = min(window, len(ids))
            for at in range(len(ids) - length + 1) if ids else ():
                found.setdefault(tuple(ids[at : at + length]), []).append((number[item_id], at))
        self.window = max(map(len, found), default=0)
        self.shortest = min(map(len, found), default=0)
        self.lengths = np.array([len(x) for x in found], np.int64)
        self.suffixes = np.zeros((len(found), self.window), np.int64)
        for row, key in enumerate(found):
            self.suffixes[row, : len(key)] = key
        #: Window k stands at the places first[k] .. first[k + 1] of (item, word).
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in found.values()]))).astype(np.int64)
        self.places = np.array([p for x in found.values() for p in x], np.int64).reshape(-1, 2)


def suffix_array(ids: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` ordered by the ``depth`` words from each on, by prefix doubling; 0 ends a stretch."""
    rank, size = ids.astype(np.int64), len(ids)
    reach = 1
    while True:
        key = (rank[starts] << 32) | rank[np.minimum(starts + reach, size - 1)]
        order = np.argsort(key, kind="stable")
        reach *= 2
        if reach >= depth:
            return starts[order]
        key = key[order]
        number = np.concatenate(([1], 1 + np.cumsum(key[1:] != key[:-1])))
        if number[-1] == len(starts):
            return starts[order]
        rank = np.zeros(size, np.int64)
        rank[starts[order]] = number


def bounds(ids: np.ndarray, array: np.ndarray, block: TestBlock, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search: the part of the suffix array that begins with each window."""
    columns = np.arange(block.window + 1)  # one more, where below and above differ even for the longest
    cut = columns[None, :] < block.lengths[rows, None]
    suffixes = np.pad(block.suffixes[rows], ((0, 0), (0, 1)))

    def search(filler: int) -> np.ndarray:
        wanted = np.where(cut, suffixes, filler)
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(array), np.int64)
        while (open_ := low < high).any():
            middle = np.minimum((low + high) // 2, len(array) - 1)
            there = ids[array[middle][:, None] + columns]
            differs = there != wanted
            at = differs.argmax(axis=1)
            line = np.arange(len(rows))
            less = differs[line, at] & (there[line, at] < wanted[line, at])
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        return low

    return search(-1), search(np.iinfo(np.int64).max)


def search_shard(texts: list[list[bytes]], block: TestBlock) -> list[tuple[np.ndarray, list[tuple]]]:
    """For each text: which words a match covers, and the longest matches."""
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    ids = np.zeros(int(starts[-1]) + block.window + 2, np.int64)
    for at, x in zip(starts[:-1].tolist(), texts):
        get = block.vocab.get
        ids[at : at + len(x)] = [get(w, 0) for w in x]
    covered = np.zeros(len(ids) + 1, np.int64)
    found: list[list[tuple]] = [[] for _ in texts]
    gaps = np.flatnonzero(ids == 0)
    known = np.flatnonzero(ids)
    after = np.searchsorted(gaps, known)
    run = gaps[after] - np.where(after > 0, gaps[after - 1], -1) - 1  # words between two gaps
    suffixes = known[run >= block.shortest]
    if len(suffixes) and len(block.lengths):
        array = suffix_array(ids, suffixes, block.window)
        here = np.zeros(len(block.vocab) + 1, bool)
        here[ids] = True
        here[0] = True
        rows = np.flatnonzero(here[block.suffixes].all(axis=1))
        low, high = bounds(ids, array, block, rows) if len(rows) else (rows, rows)
        window = np.repeat(rows, high - low)
        place = array[ranges(low, high - low)]
        np.add.at(covered, place, 1)
        np.add.at(covered, place + block.lengths[window], -1)
        # every place of the window in the items, then joined along diagonals
        times = block.first[window + 1] - block.first[window]
        item, word = block.places[ranges(block.first[window], times)].T
        place, length = np.repeat(place, times), np.repeat(block.lengths[window], times)
        doc = np.searchsorted(starts, place, side="right") - 1
        order = np.lexsort((place, place - word, item, doc))
        item, word, place, length, doc = (x[order] for x in (item, word, place, length, doc))
        if len(place):
            joins = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (np.diff(place - word) == 0) & (np.diff(place) == 1)
            head = np.flatnonzero(np.concatenate(([True], ~joins)))
            tail = np.concatenate((head[1:], [len(place)])) - 1
            for a, b in zip(head.tolist(), tail.tolist()):
                d = int(doc[a])
                n = int(place[b] + length[b] - place[a])
                found[d].append((block.item_ids[item[a]], int(word[a]), int(place[a] - starts[d]), n))
    hit = np.cumsum(covered) > 0
    return [(hit[a : a + n], m) for a, n, m in zip(starts[:-1].tolist(), sizes.tolist(), found)]


def _send_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> list[Broadcast]:
    """The benchmark as broadcasts of about ``block_bytes`` each, one in the driver at a time."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).dropna()
    size = rows.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    parts = max(1, -(-size // block_bytes))
    out = []
    for part in range(parts):
        mine = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part) if parts > 1 else rows
        out.append(spark.sparkContext.broadcast([(r.i, r.t.encode()) for r in mine.toLocalIterator()]))
    return out


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = 16 << 20,
    result_col: str = "contamination",
) -> DataFrame:
    """``docs`` with a struct: n_words, n_hit, item_ids (sorted) and the longest matches.

    Matches give the item, and the first word and number of words in item and document.
    """
    blocks = _send_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    kind = pa.struct(
        [
            ("n_words", pa.int64()),
            ("n_hit", pa.int64()),
            ("item_ids", pa.list_(pa.string())),
            (
                "matches",
                pa.list_(
                    pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])
                ),
            ),
        ]
    )

    @F.arrow_udf(RESULT)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = TestBlock(blocks[0].value, window) if len(blocks) == 1 else None
        for batch in batches:
            parts, hits, matches = list(chunks(batch)), [], []
            for items in [None] if ready else each_value(blocks):  # outermost, so that a block is made ready once a batch
                block, at = ready or TestBlock(items, window), 0
                for part in parts:
                    for hit, found in search_shard([words(x) for x in as_bytes(part)], block):
                        if at == len(hits):
                            hits.append(hit)
                            matches.append(found)
                        else:
                            hits[at] |= hit
                            matches[at] += found
                        at += 1
            if not blocks:
                hits = [np.zeros(len(words(x)), bool) for x in as_bytes(batch)]
                matches = [[] for _ in hits]
            rows = [
                {
                    "n_words": len(hit),
                    "n_hit": int(hit.sum()),
                    "item_ids": sorted({m[0] for m in found}),
                    "matches": [dict(zip(("item_id", "item_word", "doc_word", "n_words"), m)) for m in sorted(found)],
                }
                for hit, found in zip(hits, matches)
            ]
            yield pa.array(rows, kind)

    return small_batches(docs).withColumn(result_col, search(F.col(text_col).cast("string")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    name = free_name(docs, "contamination")
    found = find_contamination(docs, benchmark, text_col, result_col=name, **options)
    return found.filter(F.col(name)["n_hit"] == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
