"""Helpers that the operators share: shared storage, text batches, fold split."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quirework.session import scratch_path, shared_dir, stored  # noqa: F401

#: The C library's way to return freed memory, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Bytes of text that a task holds as Python objects at a time.
CHUNK_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch, at most; one row at least, however long.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: A key with more rows than this, and more than one in HOT_SHARE of all rows, is joined by broadcast.
HOT_ROWS, HOT_SHARE = 1000, 50_000


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is in the fold that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def maybe_known(rows: DataFrame, key: str, known: DataFrame, bits: int = 1 << 27) -> DataFrame:
    """``rows`` with ``known_``: false only where ``key`` isn't in ``known``, true where it is and seldom elsewhere.

    The keys' hashes set bits of a bitmap of at most ``bits`` bits (16 MB), whatever
    the number of keys; that bound is what allows its broadcast. Keys that share a bit
    with a known one are marked too, so a join must still decide.
    """

    def bit_of(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(bits))

    maps = known.select(bit_of(key).alias("bit_")).groupBy(F.bitmap_bucket_number("bit_").alias("bucket_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit_")).alias("map_"))
    at = F.bitmap_bit_position(bit_of(key))
    byte = F.conv(F.hex(F.substring("map_", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(maps), F.bitmap_bucket_number(bit_of(key)) == F.col("bucket_"), "left")
    return found.withColumn("known_", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("bucket_", "map_")


def only_known(rows: DataFrame, key: str, known: DataFrame, bits: int = 1 << 27) -> DataFrame:
    """``rows`` without most of those whose ``key`` isn't in ``known``, before a join shuffles them."""
    return maybe_known(rows, key, known, bits).filter("known_").drop("known_")


def join_counted(rows: DataFrame, counted: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``counted`` on ``key``, without a task that gets all rows of a frequent key.

    ``counted`` has a row a key and how many of the ``total`` rows have it (``times``, which
    is dropped). Keys with more than HOT_ROWS rows and more than one in HOT_SHARE of all are
    HOT_SHARE at most, so they are broadcast; the others are joined by a shuffle.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot, cold = counted.filter(F.col("times") > limit).drop("times"), counted.filter(F.col("times") <= limit).drop("times")
    rare = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rare.join(cold, key).unionByName(rows.join(F.broadcast(hot), key))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session sends texts to Python in batches of bounded size.

    Smaller limits that the session has stay.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        said = re.fullmatch(r"(\d+)b?", conf.get(f"spark.sql.execution.arrow.{name}"))  # other units are larger
        now = int(said[1]) if said else 0
        if not 0 < now <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Returns freed memory to the system: workers are reused, and would keep the most that any operator took."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Slices of whole texts, of about ``limit`` bytes each and one text at least; memory is given back after the last."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield texts.slice(start, stop - start)
        start = stop
    give_back()


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; empty for null."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [x or b"" for x in texts.cast(kind).to_pylist()]


def each_value(sent: list[Broadcast]) -> Iterator:
    """The values of broadcasts one after another; a worker drops each before it reads the next."""
    for one in sent:
        yield one.value
        if len(sent) > 1 and one._path is not None:
            one.__dict__.pop("_value", None)  # what Broadcast.value keeps; it is read again from the worker's disk


def collected_within(rows: DataFrame, content: str, most: int) -> list[Row]:
    """The rows (``content``, label, size) of a sample, as many as hold ``most`` units of size.

    Either label gets half of that, in order of a hash of the content, and one row at
    least. Sizes come to the driver first, contents only of the rows taken.
    """
    kept = stored(rows.withColumn("key", F.xxhash64(content)), "measured")
    taken = F.lit(False)
    for label in (0, 1):
        total, last = 0, None
        for r in kept.filter(F.col("label") == label).select("key", "size").orderBy("key").collect():  # narrow rows of a bounded sample
            total += r.size
            if last is not None and total > most // 2:
                break
            last = r.key
        if last is not None:
            taken = taken | ((F.col("label") == label) & (F.col("key") <= last))
    return sorted(kept.filter(taken).drop("key", "size").collect(), key=lambda r: (r.label, bytes(r[content])))


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective mixing of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers of all the ranges [start, start + count), one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total, dtype=np.int64) + shift


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of at most ``per_class`` documents of either label, and how many have it.

    Only rows outside the held-out fold count, and only ids whose labels agree. The
    sample is the lowest by hash of the id, the same on any partitioning; of rows that
    repeat an id the smallest text is taken.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other")).filter("label = other").drop("other")
    known = stored(known, "labels")
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = stored(chosen, "sample")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "id")  # 2 * per_class narrow rows at most
    return found.groupBy("id", "label").agg(F.min("text").alias("text")).select("text", "label"), totals
