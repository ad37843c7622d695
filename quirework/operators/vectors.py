"""Nearest vectors by inverted lists: a coarse quantizer, a folder a list, exact scores within the lists probed.

The quantizer is fitted on a bounded sample (the rows lowest by a hash of their id, so it
covers all of the table evenly); every row is then assigned to a list and written.
A search reads only the folders of lists that some query probes, and compares a query
with the points of its own lists; probing every list is the exact search. Half of the
lists find nine in ten of the ten nearest of vectors without any clusters, a few those of
clustered ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators.retrieval import _units, cosine
from quirework.plans.snapshots import Parts, Snapshot, commit, view


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return _units(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)) if len(vectors) else np.zeros((0, 0))


def fitted(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Centres of at most ``lists`` groups of unit vectors, by direction; each starts at the row farthest from those before."""
    if not len(sample):
        return sample
    centres, near = [sample[0]], sample @ sample[0]
    while len(centres) < min(lists, len(sample)) and near.min() < 1 - 1e-9:
        centres.append(sample[near.argmin()])
        near = np.maximum(near, sample @ centres[-1])
    found = np.array(centres)
    for _ in range(rounds):
        of = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, of, sample)
        some = np.bincount(of, minlength=len(found)) > 0
        found = np.where(some[:, None], _units(sums), found)
    return found


def nearest_lists(vector: Column, centres: np.ndarray, probes: int) -> Column:
    """The numbers of the ``probes`` lists whose centres are nearest, the nearest first."""
    most = min(probes, len(centres))

    @F.arrow_udf("array<int>")
    def lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            order = np.argsort(-(_matrix(batch) @ centres.T), axis=1, kind="stable")[:, :most].astype(np.int32) if len(batch) else np.zeros((0, most), np.int32)
            yield pa.ListArray.from_arrays(np.arange(0, order.size + 1, most, dtype=np.int32), order.ravel())

    return lists(vector)


def build_lists(spark: SparkSession, root: str, points: DataFrame, lists: int = 64, sample: int = 20_000) -> Snapshot:
    """Writes ``points`` (id, vector and more) in inverted lists; rows without an id or a vector are left out.

    ``sample`` bounds the rows that the quantizer is fitted on, on the driver.
    """
    rows = points.filter("vector is not null and id is not null").withColumn("vector", F.col("vector").cast("array<double>"))
    chosen = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()
    centres = fitted(_matrix(chosen.column(0)), lists)
    table = spark.createDataFrame([(n, [float(x) for x in c]) for n, c in enumerate(centres)], "list int, centre array<double>")

    def made(v) -> dict:
        if not len(centres):
            return {"lists": Parts(rows.withColumn("part_", F.lit("0"))), "centres": table}
        assigned = rows.withColumn("part_", nearest_lists(F.col("vector"), centres, 1)[0].cast("string"))
        return {"lists": Parts(assigned, gone=list(v.parts("lists"))), "centres": table}

    return commit(spark, root, made)


def search_lists(spark: SparkSession, root: str, queries: DataFrame, k: int = 10, probes: int = 32) -> DataFrame:
    """(query_id, id, score, rank): the k nearest points of the ``probes`` lists nearest to each query (query_id, vector)."""
    v = view(spark, root)
    centres = np.array([r.centre for r in v.table("centres").orderBy("list").collect()])  # as many as lists
    asked = queries.filter("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    if not len(centres):
        return cosine(v.table("lists").select("id", "vector"), asked, k)
    probed = asked.withColumn("scope", F.explode(nearest_lists(F.col("vector"), centres, probes).cast("array<string>")))
    wanted = {r.scope for r in probed.select("scope").distinct().collect()}  # as many as lists
    points = v.table("lists", only=wanted, tagged=True).select("id", "vector", F.col("part_").alias("scope"))
    return cosine(points, probed, k)
