"""Near-duplicate detection: one-permutation MinHash, banded buckets, star edges.

Every text becomes its set of distinct word shingles, hashed to 64 bits. One hash
per shingle fills ``bands * rows`` bins (the bin by the high bits, the smallest
value stays); empty bins copy a full one found by optimal densification, so that
short texts can be compared too. ``rows`` bins make the key of one bucket. Texts
with equal sets are one class, and only its smallest id goes on.

A bucket of n classes gives n - 1 candidate pairs, a star around its first member
in one of eight orders, so a large group has centres that differ between buckets. Each
pair is confirmed on the full sets; components of the confirmed links follow by
alternating large-star and small-star steps.

With 40 bands of 6 rows, two texts of similarity 0.8 share no bucket with a
probability of 5e-6, and the more similar the less. A star leaves the pairs of its
other members undecided. Where those of a bucket lie in several components after
the stars, all of them go through an exact join by prefix filter (rarest shingles
first, so a passage that thousands share makes no keys), which decides every pair of
theirs in different components. So each link of two texts that share a bucket counts.
Keys that few sets have give candidate pairs; the sets of a frequent key meet in
blocks of bounded size, where a matrix product counts what they share and only links
that join two components come out.

Rows without words have an empty set and are linked with nothing, as are rows with
a null id. Rows that repeat an id are one node: the links of each of them count.
Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm._shared import as_bytes, chunks, free_name, join_counted, mix64, only_known, ranges, small_batches, stored

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Orders from which the centres of buckets are taken.
ORDERS = 8
#: Sets of a key that are paired row by row; sets and shingles of a block beyond that.
FEW, BLOCK_SETS, BLOCK_SHINGLES = 128, 1024, 1 << 20


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words is one shingle."""
    number: dict[bytes, int] = {}
    split = [x.translate(_LOWER).split() for x in texts]
    ids = np.array([number.setdefault(w, len(number)) for x in split for w in x], np.int64)
    of_word = np.array([xxhash.xxh3_64_intdigest(w) for w in number], np.uint64)
    words, out, at = of_word[ids] if len(ids) else np.zeros(0, np.uint64), [], 0
    wide = mix64(words + _C1)
    for k in range(1, width):
        wide = mix64(wide[:-1] * _C2 + words[k:]) if len(wide) > 1 else wide[:0]
    for x in split:
        n = len(x)
        if n >= width:
            found = np.sort(wide[at : at + n - width + 1])
            found = found[np.concatenate(([True], found[1:] != found[:-1]))]
        elif n:
            one = mix64(words[at : at + 1] + _C1)
            for k in range(1, n):
                one = mix64(one * _C2 + words[at + k : at + k + 1])
            found = mix64(one + np.uint64(n))
        else:
            found = wide[:0]
        out.append(found)
        at += n
    return out


def one_permutation(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """The smallest hash of each bin, a row a set; rows of empty sets have no meaning."""
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    column = ((values >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    place = row * bins + column  # ascending, as each set is sorted
    first = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, bool)
    out, full = np.zeros(len(sets) * bins, np.uint64), np.zeros(len(sets) * bins, bool)
    out[place[first]], full[place[first]] = values[first], True
    out, full = out.reshape(-1, bins), full.reshape(-1, bins)
    row, column = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 1
    while len(row):  # an empty bin asks the same bins in the same order in every text
        asked = (mix64(column.astype(np.uint64) * _C2 + np.uint64(attempt * int(_C3) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(bins)).astype(np.int64)
        has = full[row, asked]
        out[row[has], column[has]] = out[row[has], asked[has]]
        row, column = row[~has], column[~has]
        attempt += 1
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = signatures.reshape(-1, bands, rows)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64) * _C3), cut.shape[:2])
    for k in range(rows):
        key = key * _C2 + mix64(cut[:, :, k] + _C1)
    return mix64(key).view(np.int64)


def _signature(width: int, bands: int, rows: int):
    kind = pa.struct([("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<n: bigint, digest: binary, bands: array<bigint>>")
    def signature(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = []
            for part in chunks(batch):
                sets = shingle_sets(as_bytes(part), width)
                keys = band_keys(one_permutation(sets, bands * rows), bands, rows)
                sizes = np.array([len(x) for x in sets], np.int64)
                empty = sizes == 0
                digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary())
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.where(empty, 0, bands)))), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys[~empty].ravel(), pa.int64()))
                done.append(pa.StructArray.from_arrays([pa.array(sizes), digests, lists], fields=list(kind)))
            yield pa.concat_arrays(done) if done else pa.array([], kind)

    return signature


def _shingles(width: int):
    @F.arrow_udf("array<bigint>")
    def shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = []
            for part in chunks(batch):
                sets = shingle_sets(as_bytes(part), width)
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in sets]))), pa.int32())
                done.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64))))
            yield pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int64()))

    return shingles


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, component) of every node of the undirected ``edges`` (src, dst): its smallest reachable node.

    Alternating large-star and small-star steps, each a grouped minimum and a join
    on narrow rows; every step is written out, so a lost executor costs one step.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    def minima(rows: DataFrame) -> DataFrame:
        return rows.groupBy("src").agg(F.min("dst").alias("m"), F.count("*").alias("times"))

    now = stored(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), name)
    before, after = None, mark(now)
    while before != after:
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = minima(both).withColumn("m", F.least("src", "m"))
        large = stored(join_counted(both, least, "src", 2 * after[0]).filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct(), name)
        small = join_counted(large, minima(large), "src", after[0]).select(
            F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")), F.struct("src", F.col("m").alias("dst")))).alias("e")
        )
        now = stored(small.select("e.*").filter("src <> dst").distinct(), name)
        before, after = after, mark(now)
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component"))


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets are similar enough, as (src, dst)."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = only_known(texts, "id", ids).join(ids, "id").select("id", _shingles(width)("text").alias("set"))
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    sized = both.filter(F.least(F.size("set_a"), F.size("set_b")) * 100 >= F.greatest(F.size("set_a"), F.size("set_b")) * percent)
    return sized.filter(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _prefix_keys(sets: DataFrame, percent: int) -> DataFrame:
    """Keys (h, id, component, row, n, place) of ``sets`` (id, component, row, set): two sets that are similar enough share one.

    Shingles are ordered by how many sets have them, rarest first. Sets share one of
    the first n - ceil(t n) + 1 of the larger and of the first n - ceil(2 t / (1 + t) n) + 1
    of the smaller. Keys within one component are left out.
    """
    each = stored(sets.select("id", "component", "row", F.size("set").cast("long").alias("n"), F.explode("set").alias("h")), "shingles")
    shared = each.groupBy("h").agg(F.count("*").alias("times")).filter("times > 1").withColumn("often", F.col("times"))  # the others come first and meet nothing
    text = Window.partitionBy("id", "row")
    place = F.row_number().over(text.orderBy("often", "h")) + F.col("n") - F.count("*").over(text)
    keys = join_counted(each, shared, "h", each.count()).withColumn("place", place).filter(f"place <= n - ceil({percent} * n / 100) + 1").drop("often")
    keys = stored(keys, "keys")
    mixed = keys.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("times"), F.sum("n").alias("shingles"))
    mixed = stored(mixed.filter("low <> high").select("h", "times", F.col("times").alias("many"), "shingles"), "mixed")
    return stored(join_counted(keys, mixed, "h", keys.count()), "mixed_keys")


def _few_pairs(keys: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of the keys that FEW sets have at most; what can follow after the shared shingle bounds their intersection."""
    found = keys.filter(f"many <= {FEW}").groupBy("h").agg(F.sort_array(F.collect_list(F.struct("n", "id", "component", "place"))).alias("s"))

    def may(x: Column, y: Column) -> Column:  # x isn't the larger
        first = x["place"] <= x["n"] - F.ceil(2 * percent * x["n"] / (100 + percent)) + 1
        rest = (100 + percent) * (1 + F.least(x["n"] - x["place"], y["n"] - y["place"])) >= percent * (x["n"] + y["n"])
        return (x["component"] != y["component"]) & (100 * x["n"] >= percent * y["n"]) & first & rest

    def partners(x: Column, k: Column) -> Column:
        others = F.filter(F.slice("s", k + 2, F.size("s")), lambda y: may(x, y))
        return F.transform(others, lambda y: F.struct(F.least(x["id"], y["id"]).alias("a"), F.greatest(x["id"], y["id"]).alias("b")))

    return found.select(F.explode(F.flatten(F.transform("s", partners))).alias("p")).select("p.*").distinct()


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``a`` shares with each of ``b``; sets have distinct elements."""
    flat = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    out = np.zeros((len(a), len(b)), np.int64)
    order = np.argsort(number, kind="stable")
    row, start = row[order], np.concatenate(([0], np.cumsum(times)))
    rare = np.flatnonzero((times > 1) & (times <= 16))
    for n in range(2, 17):  # all pairs of the few rows that have an element
        of = rare[times[rare] == n]
        rows = row[start[of][:, None] + np.arange(n)]
        for i in range(n):
            for j in range(i + 1, n):
                left, right = np.minimum(rows[:, i], rows[:, j]), np.maximum(rows[:, i], rows[:, j])
                across = (left < len(a)) & (right >= len(a))
                np.add.at(out, (left[across], right[across] - len(a)), 1)
    often = np.flatnonzero(times > 16)
    for k in range(0, len(often), 2048):
        of = often[k : k + 2048]
        dense = np.zeros((len(a) + len(b), len(of)), np.float32)
        dense[row[ranges(start[of], times[of])], np.repeat(np.arange(len(of)), times[of])] = 1
        out += (dense[: len(a)] @ dense[len(a) :].T).astype(np.int64)
    return out


def joining_links(links: np.ndarray, of_a: list, of_b: list) -> list[tuple[int, int]]:
    """Of the ``links`` (row, column) as many as join components that weren't joined by those before."""
    root: dict = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for i, j in links.tolist():
        x, y = find(of_a[i]), find(of_b[j])
        if x != y:
            root[x] = y
            out.append((i, j))
    return out


def _block_links(keys: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (src, dst) between components among the sets of each key that more than FEW have.

    A key's sets are dealt to blocks by hash; each two blocks meet in one task.
    """
    id_type = sets.schema["id"].dataType.simpleString()
    blocks = F.greatest(F.ceil(F.col("many") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = keys.filter(f"many > {FEW}").select("h", "id", "row", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("id", "row"), blocks).cast("int").alias("mine"))
    # a set is on the left of the meetings with later blocks and on the right of those with earlier ones; with its own it is on both
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    sides = F.flatten(
        F.transform(
            other,
            lambda k: F.when(k == F.col("mine"), F.array(F.struct(k.alias("i"), k.alias("j"), F.lit(0).alias("side")), F.struct(k.alias("i"), k.alias("j"), F.lit(1).alias("side"))))
            .when(k > F.col("mine"), F.array(F.struct(F.col("mine").alias("i"), k.alias("j"), F.lit(0).alias("side"))))
            .otherwise(F.array(F.struct(k.alias("i"), F.col("mine").alias("j"), F.lit(1).alias("side")))),
        )
    )
    meetings = dealt.select("h", "id", "row", "component", F.explode(sides).alias("m")).select("h", "m.i", "m.j", "m.side", "id", "row", "component")
    full = meetings.join(sets.select("id", "row", "set"), ["id", "row"])

    def meet(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, components_, found = table.column("id").to_pylist(), table.column("component").to_pylist(), table.column("set").combine_chunks()
        ends = found.offsets.to_numpy()
        flat = found.values.to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = ([flat[ends[k] : ends[k + 1]] for k in at.tolist()] for at in (left, right))
        links = np.zeros((0, 2), np.int64)
        if a and b:
            common = common_counts(a, b)
            sizes = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :]
            links = np.argwhere(100 * common >= percent * (sizes - common))
        chosen = joining_links(links, [components_[k] for k in left.tolist()], [components_[k] for k in right.tolist()])
        src, dst = ([ids[at[p[k]]] for p in chosen] for k, at in enumerate((left.tolist(), right.tolist())))
        kind = table.schema.field("id").type
        return pa.table({"src": pa.array(src, kind), "dst": pa.array(dst, kind)})

    return full.groupBy("h", "i", "j").applyInArrow(meet, f"src {id_type}, dst {id_type}")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = 40,
    rows: int = 6,
) -> DataFrame:
    """(id, n_shingles, component, kept) for each row of ``docs``.

    Links hold where 100 * intersection >= ``percent`` * union of the shingle sets.
    """
    texts = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(texts.select("id", _signature(width, bands, rows)("text").alias("s")).select("id", "s.*"), "signatures")
    classes = signed.filter("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("times"))
    classes = stored(classes, "classes")

    member = classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    rank: Column = F.xxhash64("id", F.col("band") % ORDERS)
    buckets = member.select("bucket", "id", rank.alias("rank")).groupBy("bucket")
    centre = buckets.agg(F.min_by("id", "rank").alias("a"), F.count("*").alias("times")).filter("times > 1")
    centre = stored(centre, "centres")  # most buckets have one member, so little is left
    total = centre.agg(F.sum("times")).first()[0] or 0
    members = stored(join_counted(only_known(member.select("bucket", "id"), "bucket", centre), centre, "bucket", total).filter("id <> a"), "members")
    # which of two is the centre doesn't matter any more
    pairs = stored(members.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct(), "pairs")
    found = components(_confirmed(pairs, texts, width, percent))

    # the members of one star that are in different components haven't been compared
    placed = members.join(found, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    several = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("times")).filter("low <> high").select("bucket", "times")
    rest = stored(join_counted(placed, several, "bucket", total).select("id", "component").distinct(), "undecided")
    if not rest.isEmpty():
        sets = only_known(texts, "id", rest).join(rest, "id").select("id", "component", _shingles(width)("text").alias("set"))
        sets = stored(sets.filter(F.size("set") > 0).withColumn("row", F.xxhash64("set")).distinct(), "sets")
        keys = _prefix_keys(sets, percent)
        more = _confirmed(stored(_few_pairs(keys, percent), "few"), texts, width, percent).unionByName(_block_links(keys, sets, percent))
        found = components(found.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(more))

    least = classes.select("digest", "times", F.col("id").alias("least")).join(found, F.col("least") == F.col("node"), "left").select("digest", "times", F.coalesce("component", "least").alias("component"))
    alone = F.col("digest").isNull() | F.col("id").isNull()
    linked = join_counted(signed.filter(~alone).select("id", "n", "digest"), least, "digest", signed.count())
    out = linked.select("id", "n", "component").unionByName(signed.filter(alone).select("id", "n", F.col("id").alias("component")))
    kept = F.coalesce(F.col("component") == F.col("id"), F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component", kept.alias("kept"))


def near_deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row of its smallest id."""
    gone = near_duplicates(docs, id_col, text_col, **options).filter(~F.col("kept")).select(F.col(id_col).alias(name := free_name(docs, "gone"))).distinct()
    return docs.join(gone, docs[id_col] == F.col(name), "left_anti")
