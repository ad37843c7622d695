"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target of words; each of its documents is then wanted
``target / source size`` times. The whole part is taken as it is. The fraction left
is a probability, and documents are rounded in pairs: mass moves at random from one
to the other, in words, until one of them is integral, so the words of the source
stay the same and each document keeps its expectation. The document still fractional
meets the next one. Blocks of documents are rounded at once, at most one
residual of each goes to the next level, and so on in a tree until each source has one
residual.

A pair's smaller document becomes integral first, so a residual tends to be a large
one. Each source therefore keeps a reserve out of that tree: a small source all of its
documents, a large one up to RESERVE of its smaller half, by hash. The largest
fractional document, the residual first, is then paired with the next ones one after
another under one coin: each takes as much as keeps its expectation, until the large
one is integral; after SETTLED such steps the rest is rounded by the tree, and what is
left at last by itself. A source therefore misses its target by less than one document
of its reserve, mostly a small one.

Random numbers are hashes of the seed, the level and the documents, so reruns agree
on any partitioning. Blocks are dealt by hash within the source: a source with a
third of all rows has as many more blocks.

Rows with a null text have size 0 and are taken the whole number of times only.
Rows that repeat id, source and size are one unit, taken equally often. Null ids and
sources are values of their own; columns keep their names and pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm._shared import free_name, stored
from quirework.operators.ordering import numbered

WEIGHTS = (5.0, 2.0, 1.0)
#: Units of a block, on average, and the rounding noise below which a fraction is none.
BLOCK, EPSILON = 256, 1e-12
#: Units that a source keeps for the end, and how many of its largest are settled one by one.
RESERVE, SETTLED = 2048, 8


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn. All targets
    together are ``share`` of all sizes. With t the words per weight, a source gets
    ``min(most * size, t * weight)``; the excess of those above their cap is reshared, by
    an aggregate over the sources a round, until none is above. Sums are of integers
    and weights, so they don't depend on the order of the rows.
    """
    by_source = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "turn")
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    weighed = stored(weighed.drop("turn"), "weights")
    total = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    t, capped_size = 0.0, -1
    while True:
        # the sources that are above their cap at the last t stay capped, as t only grows
        capped = (F.col("cap") <= t * F.col("weight")) if capped_size >= 0 else F.lit(False)
        held, weight = weighed.agg(F.sum(F.when(capped, F.col("source_size")).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if held == capped_size or not weight:
            break
        t, capped_size = (total - most * held) / weight, held
    target = F.when(F.col("source_size") == 0, 0.0).when(F.lit(not weight), F.col("cap")).otherwise(F.least("cap", t * F.col("weight")))
    return weighed.select("source", F.col("source_size").cast("long").alias("source_size"), target.cast("double").alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the parts' hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _round_block(units: Column, seed: Column, last: Column) -> Column:
    """One fold over the units (key, size, p) of a block: who got one more copy, and who is still fractional."""
    none = F.lit(None).cast("struct<key: bigint, size: bigint, p: double>")

    def pair(state: Column, unit: Column) -> Column:
        held = state["held"]
        up = F.least(1 - held["p"], unit["p"] * unit["size"] / held["size"])  # what the held one can gain, the other paying
        down = F.least(held["p"], (1 - unit["p"]) * unit["size"] / held["size"])
        gains = _uniform(seed, held["key"], unit["key"]) * (up + down) < down
        moved = F.when(gains, up).otherwise(-down)
        # the side that sets the limit becomes integral, exactly
        held_done = F.when(gains, 1 - held["p"] <= unit["p"] * unit["size"] / held["size"]).otherwise(held["p"] <= (1 - unit["p"]) * unit["size"] / held["size"])
        held_p, unit_p = held["p"] + moved, unit["p"] - moved * held["size"] / unit["size"]
        ends = F.when(gains, F.when(held_done, 1).otherwise(0)).otherwise(F.when(held_done, 0).otherwise(1))
        stays_p = F.when(held_done, unit_p).otherwise(held_p)
        stays = F.when(held_done, F.struct(unit["key"].alias("key"), unit["size"].alias("size"), stays_p.alias("p"))).otherwise(F.struct(held["key"].alias("key"), held["size"].alias("size"), stays_p.alias("p")))
        decided = F.struct(F.when(held_done, held["key"]).otherwise(unit["key"]).alias("key"), ends.cast("int").alias("more"))
        # both may become integral at once
        sure = F.when(stays_p <= EPSILON, 0).when(stays_p >= 1 - EPSILON, 1)
        also = F.when(sure.isNotNull(), F.array(F.struct(stays["key"].alias("key"), sure.cast("int").alias("more")))).otherwise(empty)
        met = F.struct(F.when(sure.isNull(), stays).alias("held"), F.concat(state["done"], F.array(decided), also).alias("done"))
        return F.when(held.isNull(), F.struct(unit.alias("held"), state["done"].alias("done"))).otherwise(met)

    empty = F.array().cast("array<struct<key: bigint, more: int>>")
    folded = F.aggregate(units, F.struct(none.alias("held"), empty.alias("done")), pair)
    held = folded["held"]
    alone = F.array(F.struct(held["key"].alias("key"), F.when(_uniform(seed, held["key"], F.lit("last")) < held["p"], 1).otherwise(0).alias("more")))
    return F.when(last & held.isNotNull(), F.struct(none.alias("held"), F.concat(folded["done"], alone).alias("done"))).otherwise(folded)


def _reserved(units: DataFrame, seed: int) -> DataFrame:
    """``units`` with ``reserve``: all of a source of RESERVE units at most, else about as many of its smaller half."""
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    by_size = units.groupBy("source", "size").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(upto))  # a row a size of a source
    half = by_size.withColumn("all", F.sum("n").over(Window.partitionBy("source"))).filter("2 * upto <= all or upto = n")  # the smallest size at least
    limits = half.groupBy(F.col("source").alias("of")).agg(F.max("size").alias("small"), F.max("upto").alias("n_small"), F.first("all").alias("all"))
    chance = F.pmod(F.xxhash64(F.lit(seed), F.lit("reserve"), "key"), F.ceil(F.col("n_small") / RESERVE)) == 0
    joined = units.join(limits, units["source"].eqNullSafe(F.col("of")))
    return joined.select(*units.columns, ((F.col("all") <= RESERVE) | (F.col("size") <= F.col("small")) & chance).alias("reserve"))


def _settled(units: DataFrame, seed: Column) -> DataFrame:
    """``units`` (key, source, size, p) after the largest fractional one of each source was paired with as many of the next as it takes.

    One coin says whether it gains or pays. A partner with p and size s gives (1 - q) c
    or gets q c words, where q is the large one's p and c the most that leaves p within
    0 and 1 either way; so every expectation stays, as do the words of the source.
    """
    whole = Window.partitionBy("source")
    before = whole.orderBy(F.col("size").desc(), F.col("key").desc()).rowsBetween(Window.unboundedPreceding, -1)
    fractional = (F.col("p") > 0) & (F.col("p") < 1)
    held = F.max(F.when(fractional, F.struct("size", "key", "p"))).over(whole)
    q, need = F.col("held_")["p"], F.col("held_")["size"]
    is_held = F.col("held_")["key"] == F.col("key")
    most = F.when(fractional & ~is_held, F.least(F.col("p") * F.col("size") / (1 - q), (1 - F.col("p")) * F.col("size") / q)).otherwise(0.0)
    used = F.least(F.col("most_"), F.greatest(need - F.coalesce(F.sum("most_").over(before), F.lit(0.0)), F.lit(0.0)))
    moved = F.when(is_held, F.least(need, F.sum("most_").over(whole))).otherwise(F.col("used_"))
    gains = _uniform(seed, F.col("held_")["key"], F.lit("settle")) < q
    p = F.col("p") + F.when(gains == is_held, F.when(is_held, 1 - q).otherwise(q)).otherwise(F.when(is_held, -q).otherwise(q - 1)) * moved / F.col("size")
    snapped = F.when(p <= EPSILON, 0.0).when(p >= 1 - EPSILON, 1.0).otherwise(p)
    marked = units.withColumn("held_", held).withColumn("most_", most).withColumn("used_", used)
    return marked.withColumn("p", F.when(F.col("held_").isNull() | ~fractional, F.col("p")).otherwise(snapped)).select(*units.columns)


def _rounded(level: DataFrame, seed: int, name: str, last: bool) -> tuple[list[DataFrame], DataFrame | None]:
    """What the tree decides of ``level`` (key, source, size, p), and the residual of each source; none with ``last``, when it is rounded too."""
    decided, n = [], 0
    while True:
        level = stored(level, f"{name}{n}")
        counts = level.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        largest = counts.agg(F.max("blocks")).first()[0]
        if largest is None:
            return decided, None
        counts = counts.withColumnRenamed("source", "of")
        dealt = level.join(counts, level["source"].eqNullSafe(counts["of"])).withColumn("block", F.pmod(F.xxhash64(F.lit(n), "key"), F.col("blocks")))
        # large units first, so that what is left over tends to be small
        blocks = dealt.groupBy("source", "block").agg(F.first("blocks").alias("blocks"), F.sort_array(F.collect_list(F.struct("size", "key", "p")), asc=False).alias("units"))
        units_of = F.transform("units", lambda u: F.struct(u["key"].alias("key"), u["size"].alias("size"), u["p"].alias("p")))
        ends = (F.col("blocks") == 1) & F.lit(last)
        rounded = stored(blocks.select("source", _round_block(units_of, F.lit(seed + n), ends).alias("r")), f"{name}-rounded{n}")
        decided.append(rounded.select(F.explode("r.done").alias("d")).select("d.key", "d.more"))
        level = rounded.filter("r.held is not null").select("r.held.key", "source", "r.held.size", "r.held.p")
        if largest == 1:
            return decided, None if last else level
        n += 1


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
) -> DataFrame:
    """(id, source, size, source_size, target, copies) for each row of ``docs``."""
    sized = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size")), "sizes")
    targets = stored(source_targets(sized, weights, share, most), "targets")
    # a unit's key stands for its id, source and size, nulls too
    key = F.xxhash64(F.lit(seed), F.to_json(F.struct(F.col("id").cast("string").alias("id"), "source", "size"), {"ignoreNullFields": "false"}))
    keyed = sized.withColumn("key", key)
    units = keyed.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("size"))
    wanted = targets.withColumn("x", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    wanted = wanted.withColumn("whole", F.floor(F.col("x") + EPSILON)).withColumn("p", F.greatest(F.col("x") - F.col("whole"), F.lit(0.0)))
    open_ = units.join(wanted, units["source"].eqNullSafe(wanted["source"])).filter((F.col("size") > 0) & (F.col("p") > EPSILON))
    open_ = stored(_reserved(open_.select("key", units["source"].alias("source"), "size", "p"), seed), "open")

    decided, residual = _rounded(open_.filter("not reserve").drop("reserve"), seed, "large", False)
    pool = open_.filter("reserve").drop("reserve")
    pool = pool if residual is None else pool.unionByName(residual)
    for n in range(SETTLED):
        pool = _settled(pool, F.lit(seed - 1 - n))
    pool = stored(pool, "pool")
    decided.append(pool.filter("p = 0 or p = 1").select("key", F.col("p").cast("int").alias("more")))
    decided += _rounded(pool.filter("p > 0 and p < 1"), seed + 100, "small", True)[0]

    more = decided[0]
    for part in decided[1:]:
        more = more.unionByName(part)
    named = keyed.join(wanted.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).join(more, "key", "left")
    copies = (F.col("whole") + F.coalesce("more", F.lit(0))).cast("long")
    return named.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row as many times as it is taken, with its number from 1 in ``copy``."""
    taken = mix_sources(docs, id_col, text_col, source_col, **options).filter("copies > 0").select(id_col, source_col, "size", "copies").distinct().toDF("id_", "source_", "size_", "copies_")
    same = docs[id_col].eqNullSafe(F.col("id_")) & docs[source_col].cast("string").eqNullSafe(F.col("source_")) & (word_count(docs[text_col].cast("string")) == F.col("size_"))
    copy = free_name(docs, "copy")
    return docs.join(taken, same).select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("copies_").cast("int"))).alias(copy))
