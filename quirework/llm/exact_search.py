"""Exact top-k by integer inner product: a KD-tree per shard, searched best box first.

A vector's components become floor(scale * x). Tasks cut their candidates into shards and
build a tree over each: splits at the median of the widest dimension, and a tight box
around what every node holds. A box bounds the product with a query from above by the
corner that suits the query's signs. A query descends where the bound reaches its k-th
score so far, visits the leaves that are left in the order of their bounds, best first,
and stops at the first bound below its k-th score, which it carries from shard to shard.

Queries go out in blocks of bounded bytes, one block a pass. Each pass first searches a
fixed share of the candidates; the k-th scores of that round go along with the block in
the second, so that tasks there send back little more than what can still win, however
many tasks there are.

Rows with a null id take no part, nor do vectors that are null or hold null or non-finite
components. Vectors of unequal length have no product. Rows that repeat an id are all
candidates; as a query an id counts once, with its least vector. Rows of the query's own
id are no candidates. Components beyond a long saturate, sums beyond a long wrap.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm._shared import small_batches, stored
from quirework.session import scratch_path

#: Bytes of the queries that one pass broadcasts (at two bytes a component; four times as much where some need eight),
#: of a shard, and queries that a tree is searched for at a time.
BLOCK_BYTES, SHARD_BYTES, SLICE = 32 << 20, 4 << 20, 2048
LEAF_ROWS = 128
#: One in so many candidates is searched in the first round.
FIRST_ROUND = 16
NONE, LAST_ID = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
#: Sums up to these are exact in floats of 32 and 64 bits.
EXACT32, EXACT64 = 2.0**24, 2.0**53


class Node(NamedTuple):
    """Rows of the tree's order from ``start`` to ``stop``; ``left`` and ``right`` are 0 in a leaf."""

    start: int
    stop: int
    left: int
    right: int


class Tree:
    """A KD-tree over integer vectors; ``low`` and ``high`` are the nodes' boxes, ``first`` their least ids."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order, nodes, lows, highs = np.arange(len(ids)), [(0, len(ids), 0, 0)], [], []
        at = 0
        while at < len(nodes):  # nodes stand before their children
            start, stop, _, _ = nodes[at]
            mine = rows[order[start:stop]]
            low, high = mine.min(axis=0), mine.max(axis=0)
            lows.append(low)
            highs.append(high)
            if stop - start > leaf_rows and len(low) and (high > low).any():
                middle = (stop - start) // 2
                order[start:stop] = order[start:stop][np.argpartition(mine[:, np.argmax(high - low)], middle)]
                nodes[at] = (start, stop, len(nodes), len(nodes) + 1)
                nodes += [(start, start + middle, 0, 0), (start + middle, stop, 0, 0)]
            at += 1
        self.nodes = [Node(*n) for n in nodes]
        self.ids, self.rows = ids[order], rows[order]
        self.low, self.high = np.array(lows), np.array(highs)
        self.first = np.array([self.ids[n.start : n.stop].min() for n in self.nodes])
        self.leaves = np.array([i for i, n in enumerate(self.nodes) if not n.left])

    def corner(self) -> float:
        """No product with a query is larger than this times the query's length, nor is any partial sum."""
        return float(np.linalg.norm(np.maximum(np.abs(self.low[0]), np.abs(self.high[0])).astype(np.float64)))

    def as_type(self, kind: type) -> None:
        self.rows, self.low, self.high = (x.astype(kind) for x in (self.rows, self.low, self.high))


class Best:
    """The k best (score, id) of each query so far; ``floor`` is what a candidate has to beat besides."""

    def __init__(self, floor_score: np.ndarray, floor_id: np.ndarray, k: int):
        self.k, self.floor_score, self.floor_id = k, floor_score, floor_id
        self.score = np.full((len(floor_score), k), NONE, np.int64)
        self.id = np.full((len(floor_score), k), LAST_ID, np.int64)

    def bar(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score and id that a candidate of query ``q`` has to beat."""
        s, i, fs, fi = self.score[q, -1], self.id[q, -1], self.floor_score[q], self.floor_id[q]
        own = (s > fs) | ((s == fs) & (i < fi))
        return np.where(own, s, fs), np.where(own, i, fi)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        mine = np.unique(q)
        every = np.concatenate((np.repeat(mine, self.k), q))
        scores, names = np.concatenate((self.score[mine].ravel(), score)), np.concatenate((self.id[mine].ravel(), ids))
        order = np.lexsort((names, -scores, every))
        every, scores, names = every[order], scores[order], names[order]
        starts = np.searchsorted(every, mine)
        keep = (starts[:, None] + np.arange(self.k)).ravel()
        self.score[mine], self.id[mine] = scores[keep].reshape(-1, self.k), names[keep].reshape(-1, self.k)


def search(tree: Tree, names: np.ndarray, vectors: np.ndarray, best: Best, part: np.ndarray) -> None:
    """Improves ``best`` for the queries ``part`` (their ids in ``names``, their integers in ``vectors``) by a tree's candidates."""
    longest = float(np.linalg.norm(vectors.astype(np.float64), axis=1).max(initial=1)) * tree.corner()
    if longest >= EXACT64:  # beyond what floats hold: every candidate, in whole numbers
        scores = vectors.astype(np.int64) @ tree.rows.astype(np.int64).T
        _found(scores, tree.ids, names, best, part, np.arange(len(part)))
        return
    kind = np.float32 if longest < EXACT32 else np.float64
    if tree.rows.dtype != kind:
        tree.as_type(kind)
    vectors = vectors.astype(kind)
    up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
    bounds = np.full((len(part), len(tree.leaves)), -np.inf, np.float64)
    bar, bar_id = best.bar(part)
    leaf_of = {int(n): c for c, n in enumerate(tree.leaves)}
    alive = {0: np.arange(len(part))}
    for n, node in enumerate(tree.nodes):  # down the tree, where a box can still win
        q = alive.pop(n, None)
        if q is None:
            continue
        bound = up[q] @ tree.high[n] + down[q] @ tree.low[n]
        wins = (bound > bar[q]) | ((bound == bar[q]) & (tree.first[n] < bar_id[q]))
        if not wins.any():
            continue
        if node.left:
            alive[node.left] = alive[node.right] = q[wins]
        else:
            bounds[q[wins], leaf_of[n]] = bound[wins]
    order = np.argsort(-bounds, axis=1, kind="stable")
    taken, step = 0, 1
    while taken < order.shape[1]:  # the best leaves first, twice as many a round
        columns = order[:, taken : taken + step]
        bound = np.take_along_axis(bounds, columns, axis=1)
        bar, bar_id = best.bar(part)
        open_ = (bound > bar[:, None]) | ((bound == bar[:, None]) & (tree.first[tree.leaves[columns]] < bar_id[:, None]))
        if not (bound >= np.maximum(bar, NONE + 1)[:, None]).any():  # bounds only fall from here
            return
        q, c = np.nonzero(open_ & np.isfinite(bound))
        leaf = columns[q, c]
        by = np.argsort(leaf, kind="stable")
        q, leaf = q[by], leaf[by]
        cuts = np.flatnonzero(np.diff(leaf, prepend=-1)).tolist() + [len(leaf)]
        for a, b in zip(cuts, cuts[1:]):
            node = tree.nodes[tree.leaves[leaf[a]]]
            _found(vectors[q[a:b]] @ tree.rows[node.start : node.stop].T, tree.ids[node.start : node.stop], names, best, part, q[a:b])
        taken, step = taken + step, 2 * step


def _found(scores: np.ndarray, ids: np.ndarray, names: np.ndarray, best: Best, part: np.ndarray, q: np.ndarray) -> None:
    """Adds what beats the bar of the queries ``q`` of ``part``; a query's own id never does."""
    bar, bar_id = best.bar(part[q])
    line, col = np.nonzero(scores >= bar[:, None])
    s = scores[line, col].astype(np.int64)
    better = ((s > bar[line]) | (ids[col] < bar_id[line])) & (ids[col] != names[q[line]])
    line, col, s = line[better], col[better], s[better]
    best.add(part[q[line]], s, ids[col])


def _integers(vectors: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length among ``vectors``: the rows that have it, and floor(scale * x) of theirs as whole floats."""
    sizes = np.diff(np.asarray(vectors.offsets))
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, np.clip(flat[(starts[rows][:, None] + np.arange(size)).ravel()], float(NONE), 2.0**63 - 1024).reshape(len(rows), size)


def _nearest(sent: Broadcast, k: int, scale: int):
    """Searches a task's candidates (id, vector), shard by shard, for the queries sent."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        best = {size: Best(score, name, k) for size, (_, _, score, name) in block.items()}
        held: dict[int, list] = {size: [0, [], []] for size in block}

        def settle(size: int) -> None:
            names, vectors, _, _ = block[size]
            rows, ids, parts = held[size]
            held[size] = [0, [], []]
            if rows:
                tree = Tree(np.concatenate(ids), np.concatenate(parts))
                for a in range(0, len(names), SLICE):
                    search(tree, names[a : a + SLICE], vectors[a : a + SLICE].astype(np.float64), best[size], np.arange(a, min(a + SLICE, len(names))))

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for rows, integers in _integers(batch.column(1), scale):
                size = integers.shape[1]
                if size in held:
                    held[size][0] += len(rows)
                    held[size][1].append(ids[rows])
                    held[size][2].append(integers)
                    if held[size][0] * 8 * (size + 1) >= SHARD_BYTES:
                        settle(size)
        for size, (names, *_) in block.items():
            settle(size)
            q, c = np.nonzero(best[size].id != LAST_ID)
            for a in range(0, len(q), 1 << 16):
                at = q[a : a + (1 << 16)], c[a : a + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"query_id": names[at[0]], "id": best[size].id[at], "score": best[size].score[at]})

    return found


def _block(rows: pa.Table, scale: int, bars: dict[int, tuple[int, int]] | None = None) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: ids, integers (in 16 bits where they fit), and score and id to beat of each query."""
    out = {}
    ids, vectors = rows.column(0).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64), rows.column(1).combine_chunks()
    for at, integers in _integers(vectors, scale):
        small = integers.size and np.abs(integers).max() < 2**15
        bar = [(bars or {}).get(i, (NONE, LAST_ID)) for i in ids[at].tolist()]
        out[integers.shape[1]] = (ids[at], integers.astype(np.int16) if small else integers, np.array([b[0] for b in bar], np.int64), np.array([b[1] for b in bar], np.int64))
    return out


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` best candidates of every query, or all where they are fewer.

    Both tables have an integer id and an array of numbers. Ties go to the smaller id.
    """
    spark = candidates.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        odd = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
        return df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~odd).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))

    asked = stored(usable(queries).groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    rows = small_batches(usable(candidates))
    first = F.pmod(F.xxhash64("id"), F.lit(FIRST_ROUND)) == 0
    parts = max(1, -(-int(asked.agg(F.sum(F.size("vector") * 2 + 40)).first()[0] or 0) // block_bytes))
    kind, place = "query_id long, id long, score long", Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")

    def best_of(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)

    path = scratch_path(spark, "nearest")
    schema = spark.createDataFrame([], kind + ", rank int").schema
    spark.createDataFrame([], schema).write.parquet(path)
    for part in range(parts):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).toArrow()  # of ``block_bytes``, about
        if not block.num_rows:
            continue
        sent = spark.sparkContext.broadcast(_block(block, scale))
        near = stored(best_of(rows.filter(first).mapInArrow(_nearest(sent, k, scale), kind)), "round")
        bars = {r.query_id: (r.score, r.id) for r in near.filter(F.col("rank") == k).toLocalIterator()}  # a row a query of the block
        sent.unpersist()
        sent = spark.sparkContext.broadcast(_block(block, scale, bars))
        rest = rows.filter(~first).mapInArrow(_nearest(sent, k, scale), kind)
        best_of(near.drop("rank").unionByName(rest)).select(*schema.names).write.mode("append").parquet(path)
        sent.unpersist()
    return spark.read.schema(schema).parquet(path).select("query_id", "rank", "id", "score")
