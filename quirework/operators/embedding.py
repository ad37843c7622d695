"""Around an embedding model: prompts, vectors of a cache, and what has to be embedded anew. The model is no part of this."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.text import fnv1a32


def query_prompt(template: Column, question: Column) -> Column:
    return F.when(template == "", question).otherwise(F.replace(template, F.lit("{q}"), question))


def document_prompt(template: Column, title: Column, text: Column) -> Column:
    """The template with title (``none`` if empty) and text; braces in them are left alone."""
    named = F.when(F.coalesce(title, F.lit("")) == "", "none").otherwise(title)
    pieces = F.transform(F.split(template, r"\{text\}"), lambda p: F.replace(p, F.lit("{title}"), named))
    return F.when(template == "", text).otherwise(F.call_function("array_join", pieces, text))


def model_identity(model: Column, dimensions: Column, query: Column, document: Column) -> Column:
    """What made a vector: the model, and its size and prompts where they are set."""
    prompts = F.lower(F.lpad(F.hex(fnv1a32(F.concat(query, F.lit("\0"), document))), 8, "0"))
    plain = (query == "") & (document == "") & (dimensions == 0)
    return F.when(plain, model).otherwise(F.format_string("%s [%dd, prompts %s]", model, dimensions, prompts))


def truncated(vector: Column, dimensions: Column) -> Column:
    return F.when((dimensions > 0) & (dimensions < F.size(vector)), F.slice(vector, F.lit(1), dimensions)).otherwise(vector)


def cache_key(text: Column, provider: str, model: str) -> Column:
    return F.sha2(F.concat_ws("\0", F.sha2(F.coalesce(text, F.lit("")), 256), F.lit(provider), F.lit(model)), 256)


def cached(texts: DataFrame, cache: DataFrame, provider: str, model: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``texts`` that have a vector in ``cache`` (key, vector), with it, and the distinct rows (key, text) to embed.

    A key is of content, provider and model, so a text that stands often is embedded once.
    An entry of no or an empty vector is a miss.
    """
    keyed = texts.withColumn("key", cache_key(F.col(text), provider, model))
    usable = cache.filter(F.size("vector") > 0).select("key", "vector")
    missing = keyed.select("key", F.coalesce(F.col(text), F.lit("")).alias("text")).join(usable, "key", "left_anti")
    return keyed.join(usable, "key").drop("key"), missing.dropDuplicates(["key"])


def vector_state(pointers: DataFrame, replicas: DataFrame, wanted: str) -> DataFrame:
    """Each active generation's vectors: ``current``, ``stale`` (another model), ``none`` (to fill in) or ``no replica``.

    ``replicas``: generation, embedding_model.
    """
    model = F.coalesce("embedding_model", F.lit(""))
    state = F.when(F.col("there").isNull(), "no replica").when(model == "", "none").when(model == wanted, "current").otherwise("stale")
    known = replicas.select("generation", "embedding_model", F.lit(True).alias("there"))
    return pointers.select("generation").join(known, "generation", "left").select("generation", state.alias("vectors"))


def unindexed(pointers: DataFrame, points: DataFrame) -> DataFrame:
    """Active generations without a point in an index: those to fill in."""
    return pointers.join(points.select("generation").distinct(), "generation", "left_anti")


def point_faults(points: DataFrame, dimensions: int, metadata: list[str]) -> DataFrame:
    """(fault, generation, points): vectors of another size, metadata with a NUL, generations with two kinds of metadata.

    ``points``: generation, vector and the columns of ``metadata``, which one generation shares.
    """
    nul = F.lit(False)
    for c in metadata:
        nul = nul | F.coalesce(F.contains(F.col(c), F.lit("\0")), F.lit(False))
    kinds = points.groupBy("generation", *metadata).agg(F.count("*").alias("n"), F.count_if(F.size("vector") != dimensions).alias("sizes"), F.count_if(nul).alias("nuls"))
    of = kinds.groupBy("generation").agg(F.sum("sizes").alias("dimensions"), F.sum("nuls").alias("nul in metadata"), F.when(F.count("*") > 1, F.sum("n")).otherwise(0).alias("two kinds of metadata"))
    faults = of.unpivot("generation", ["dimensions", "nul in metadata", "two kinds of metadata"], "fault", "points")
    return faults.filter("points > 0")


def embedded(missing: DataFrame, model: Callable[[list[str]], list[list[float]]], dimensions: int, batch: int = 64) -> DataFrame:
    """(key, vector): what ``model`` makes of the texts of ``missing`` (key, text), ``batch`` at a time.

    The model is called in the tasks. One vector a text, each of ``dimensions`` numbers: anything else is an error, and nothing of the table is written.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrived in batches:
            for start in range(0, len(arrived), batch):
                part = arrived.slice(start, batch)
                vectors = model(part.column(1).to_pylist())
                if len(vectors) != len(part):
                    raise ValueError(f"the model returned {len(vectors)} vectors for {len(part)} texts")
                odd = next((len(v) for v in vectors if len(v) != dimensions), None)
                if odd is not None:
                    raise ValueError(f"the model returned a vector of {odd} dimensions, not {dimensions}")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32()))], ["key", "vector"])

    return missing.select("key", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(made, "key string, vector array<float>")


def embedding_plan(pointers: DataFrame, replicas: DataFrame, points: DataFrame, wanted: str) -> DataFrame:
    """(generation, drop, embed): what a switch to the model ``wanted`` has to do for each active generation.

    Vectors of another model are dropped and made anew (keywords answer meanwhile); where none
    were made, or the index lost them, they are filled in; a generation without a
    replica is left to its build.
    """
    state = vector_state(pointers, replicas, wanted)
    lost = unindexed(pointers.select("generation"), points).withColumn("lost", F.lit(True))
    joined = state.join(lost, "generation", "left").withColumn("lost", F.coalesce("lost", F.lit(False)))
    drop = (F.col("vectors") == "stale") & ~F.col("lost")
    embed = F.col("vectors").isin("stale", "none") | ((F.col("vectors") == "current") & F.col("lost"))
    return joined.select("generation", drop.alias("drop"), embed.alias("embed"))


def to_embed(plan: DataFrame, chunks: DataFrame, cache: DataFrame, provider: str, model: str) -> tuple[DataFrame, DataFrame]:
    """Of the chunks (generation, text and more) of generations to embed: those with a vector in the cache, and the distinct texts that lack one."""
    wanted = chunks.join(plan.filter("embed").select("generation"), "generation", "left_semi")
    return cached(wanted, cache, provider, model)
