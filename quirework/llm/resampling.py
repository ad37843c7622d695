"""Resamples documents towards a target collection by importance of hashed word runs.

A run is 1 to ``width`` consecutive words, joined by a space; its bucket is the CRC-32 of
its bytes modulo ``buckets``. A bucket's gain is the logarithm of how much likelier the
target is to use it, a document's weight the sum over its runs, and documents are drawn
without replacement by the highest weights plus Gumbel noise that a hash of the id gives.

Runs are found by a byte automaton on the UTF-8 buffers of Arrow: a table gives each byte
its class and lower case, differences of classes give the borders of words, and the
checksums of all words advance together, a byte a step.

Null and empty texts have no words and weight 0. A null id hashes like an empty string and
comes last among equal scores. Rows that repeat an id are documents of their own with equal
noise; rows equal in score and id take adjacent ranks in no stated order. Result columns
replace none of the caller's: only the id is carried along.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm._shared import CHUNK_BYTES, chunks, small_batches, stored
from quirework.operators.ordering import numbered

#: Bytes of a word that all words advance through together; the few longer words are finished one by one.
STEPS = 64
WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The lower case of each byte of a word (0: no part of one), and CRC-32's table from its polynomial."""
    lower = np.zeros(256, np.uint8)
    for b in WORD_BYTES:
        lower[b] = b
    for b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        lower[b] = b | 0x20
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, np.uint32(0xEDB88320) ^ (crc >> np.uint32(1)), crc >> np.uint32(1)).astype(np.uint32)
    return lower, crc


LOWER, CRC = _tables()
ALL_ONES, EIGHT = np.uint32(0xFFFFFFFF), np.uint32(8)


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return CRC[(state ^ byte) & np.uint32(255)] ^ (state >> EIGHT)


def _advanced(state: np.ndarray, low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The states after the words at ``starts``: one step for all that have a byte left, longest first."""
    order = np.argsort(-sizes, kind="stable")
    ordered, at, now = sizes[order], starts[order], state[order]
    most = int(ordered[0]) if len(ordered) else 0
    for j in range(min(most, STEPS)):
        m = int(np.searchsorted(-ordered, -j, side="left"))  # those longer than j
        now[:m] = _step(now[:m], low[at[:m] + j])
    for i in range(int(np.searchsorted(-ordered, -STEPS, side="left"))):
        rest = low[at[i] + STEPS : at[i] + ordered[i]].tobytes()
        now[i] = zlib.crc32(rest, int(now[i] ^ ALL_ONES)) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = now
    return out


def word_runs(data: np.ndarray, bounds: np.ndarray, width: int = 1, done: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents and checksums of all runs in a buffer, and each document's words.

    Document d has the bytes from ``bounds[d]`` to ``bounds[d + 1]``. Runs that lie within the
    first ``done`` words are left out (they were counted with the bytes before).
    """
    low = LOWER[data]
    inside = low != 0
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(bounds, starts, side="right") - 1
    words = np.bincount(doc[done:], minlength=len(bounds) - 1)
    found, sums = [], []
    state, last = np.full(len(starts), ALL_ONES, np.uint32), np.arange(len(starts))
    for k in range(width):
        if k:  # on to the next word, where it is the same document's
            keep = np.flatnonzero(last + 1 < len(starts))
            keep = keep[doc[last[keep]] == doc[last[keep] + 1]]
            last, state = last[keep] + 1, _step(state[keep], 0x20)
        state = _advanced(state, low, starts[last], (ends - starts)[last])
        fresh = last >= done
        found.append(doc[last[fresh]])
        sums.append(state[fresh] ^ ALL_ONES)
    return np.concatenate(found), np.concatenate(sums), words


def _windows(data: np.ndarray, width: int, limit: int) -> Iterator[tuple[np.ndarray, int]]:
    """A long text in pieces of about ``limit`` bytes that end between words, and how many words of each were in the one before."""
    start, stop, done = 0, 0, 0
    while stop < len(data):
        stop += limit
        while stop < len(data):  # on to the next byte that is in no word
            gap = np.flatnonzero(LOWER[data[stop : stop + limit]] == 0)
            if len(gap):
                stop += int(gap[0])
                break
            stop += limit
        piece = data[start:stop]
        yield piece, done
        inside = LOWER[piece] != 0
        heads = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        done = min(width - 1, len(heads))
        start = start + int(heads[-done]) if done else stop


def _runs(texts: pa.Array, width: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, documents, documents of runs, checksums, words of documents) of each piece of ``texts``."""
    texts = pc.fill_null(texts, "")
    offset_type = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    first = 0
    for part in chunks(texts, limit):
        _, offsets, values = part.buffers()
        bounds = np.frombuffer(offsets, offset_type)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        data = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values is not None else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        if len(part) == 1 and len(data) > 2 * limit:
            for piece, done in _windows(data, width, limit):
                yield first, 1, *word_runs(piece, np.array([0, len(piece)]), width, done)
        else:
            yield first, len(part), *word_runs(data, bounds, width)
        first += len(part)


def bucket_counts(docs: DataFrame, text_col: str = "text", width: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many runs of all texts fall into each bucket; a task sends a row a bucket at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, sums, _ in _runs(batch.column(0), width):
                total += np.bincount(sums % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": used.astype(np.int32), "n": total[used]})

    rows = small_batches(docs).select(F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(counts: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Each bucket's gain in thousandths; ``buckets`` rows of either side come to the driver, whatever the data."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for into, rows in ((s, counts), (t, target)):
        for r in rows.collect():
            into[r.bucket] = r.n
    all_s, all_t = s.sum() + buckets, t.sum() + buckets
    return np.array([math.floor(1000 * math.log((y + 1) * all_s / ((x + 1) * all_t))) for x, y in zip(s.tolist(), t.tolist())], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", width: int = 1) -> DataFrame:
    """(id, n_words, n_features, weight) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, runs, weight = (np.zeros(len(batch), np.int64) for _ in range(3))
            for first, n, doc, sums, counted in _runs(batch.column(1), width):
                here = slice(first, first + n)
                words[here] += counted
                runs[here] += np.bincount(doc, minlength=n)
                weight[here] += np.rint(np.bincount(doc, weights=gain[sums % np.uint32(len(gain))], minlength=n)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(runs), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(summed, f"id {kind}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def drawn(weights: DataFrame, percent: int = 10, least_words: int = 20, seed: str = "2024", id_col: str = "doc_id") -> DataFrame:
    """``weights`` with ``score`` and the ``rank`` (from 1) of the ``percent`` of documents with enough words that score highest.

    Ranks come from a sort by ranges: no task sees more than its range, and rows that are
    equal in score and id are dealt over ranges by their place in the stored table.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weights.withColumn("score", (F.col("weight") + noise).cast("long")), "weights")
    enough = scored.filter(F.col("n_words") >= least_words).withColumn("place_", F.monotonically_increasing_id())
    most = percent * enough.count() // 100
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("place_")]
    ranked = numbered(enough, order, "position_").withColumn("rank", F.when(F.col("position_") < most, F.col("position_") + 1)).drop("position_", "place_")
    return ranked.unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document; ``rank`` is null where it isn't drawn."""
    gain = gains(bucket_counts(docs, text_col, width, buckets), bucket_counts(target, text_col, width, buckets), buckets)
    return drawn(weighted(docs, gain, id_col, text_col, width), percent, least_words, seed, id_col)


def resampled_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The drawn documents, whole; all rows of a drawn id."""
    ids = resample(docs, target, id_col=id_col, **settings).filter("rank is not null").select(id_col)
    return docs.join(ids, id_col, "left_semi")
