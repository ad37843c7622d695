"""From documents to chunks: sections, packing, identity, reuse and manifests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.markdown import sections
from quirework.functions.text import chunk_title, identity, stripped
from quirework.operators.ordering import numbered
from quirework.operators.skew import join_back

_SECTION = pa.struct([("ordinal", pa.int32()), ("heading", pa.string()), ("path", pa.list_(pa.string())), ("body", pa.string())])
SECTIONS = "array<struct<ordinal: int, heading: string, path: array<string>, body: string>>"


#: Texts whose sections are Python objects at one time.
TEXTS_AT_ONCE = 64


def _sections(texts: pa.Array) -> pa.Array:
    def made(some: pa.Array) -> pa.Array:
        rows = [[dict(zip(("ordinal", "heading", "path", "body"), (n, *s))) for n, s in enumerate(sections(t or ""))] for t in some.to_pylist()]
        return pa.array(rows, pa.list_(_SECTION))

    return pa.concat_arrays([made(texts[n : n + TEXTS_AT_ONCE]) for n in range(0, max(1, len(texts)), TEXTS_AT_ONCE)])


def split_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per section of each document, with the columns of ``docs`` but the text."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.explode(F.arrow_udf(_sections, SECTIONS)(F.col(text))).alias("s")).select(*keep, "s.ordinal", "s.heading", "s.path", "s.body")


def pack_paragraphs(body: Column, max_bytes: int = 2000, separator: str = "\n\n", joiner: str = "\n\n") -> Column:
    """Paragraphs gathered in order into groups of at most ``max_bytes`` bytes; one that is larger stands alone.

    The joiner counts. This is a fold inside the JVM.
    """
    parts = F.filter(F.transform(F.split(body, separator), stripped), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, part: Column) -> Column:
        fits = F.octet_length(state["open"]) + len(joiner) + F.octet_length(part) <= max_bytes
        return (
            F.when(state["open"] == "", F.struct(state["done"].alias("done"), part.alias("open")))
            .when(fits, F.struct(state["done"].alias("done"), F.concat(state["open"], F.lit(joiner), part).alias("open")))
            .otherwise(F.struct(F.concat(state["done"], F.array(state["open"])).alias("done"), part.alias("open")))
        )

    return F.aggregate(parts, start, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def pack_section(heading: Column, body: Column, max_bytes: int = 2000) -> Column:
    """The chunks of a section: whole if it fits, else packed paragraphs with the heading on the first."""

    def joined(a: Column, b: Column) -> Column:
        return F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.lit("\n\n"), b))

    whole = joined(heading, body)
    groups = pack_paragraphs(body, max_bytes)
    led = F.concat(F.array(joined(heading, groups[0])), F.slice(groups, 2, F.greatest(F.size(groups) - 1, F.lit(0))))
    return F.when((F.octet_length(whole) <= max_bytes) | (F.size(groups) == 0), F.array(whole)).otherwise(led)


def section_chunks(docs: DataFrame, text: str = "text", max_bytes: int = 2000) -> DataFrame:
    """Chunks of Markdown documents with their section path, numbered within the document."""
    sections = split_sections(docs, text)
    keep = [c for c in docs.columns if c != text]
    parts = sections.select(*keep, "ordinal", "path", F.posexplode(pack_section(F.col("heading"), F.col("body"), max_bytes)).alias("part", "content"))
    return parts.withColumnRenamed("ordinal", "section")


def ordered_chunks(docs: DataFrame, text: str = "text", max_bytes: int = 2000) -> DataFrame:
    """The chunks of :func:`section_chunks` with their ordinal in the document, path and content: numbered where the document is, without a shuffle or sort."""
    keep = [c for c in docs.columns if c != text]
    split = docs.select(*keep, F.arrow_udf(_sections, SECTIONS)(F.col(text)).alias("s"))
    each = F.flatten(F.transform("s", lambda s: F.transform(pack_section(s["heading"], s["body"], max_bytes), lambda c: F.struct(s["path"].alias("path"), c.alias("content")))))
    return split.select(*keep, F.posexplode(each).alias("ordinal", "c")).select(*keep, "ordinal", "c.path", "c.content")


def symbol_content(content: Column, package: Column, symbol: Column, signature: Column) -> Column:
    """The content of an API entry; a blank one falls back to its signature, then its names."""
    sig = F.coalesce(signature, F.lit(""))
    return F.when(stripped(F.coalesce(content, F.lit(""))) != "", content).when(sig != "", sig).otherwise(chunk_title(package, symbol, package))


def content_hash(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def reuse_content(docs: DataFrame, doc_id: str, content: str, order: list[Column], known: DataFrame | None = None) -> DataFrame:
    """``docs`` with content_hash, object_id and reused: equal contents share the first object's id.

    First is by ``order``; a content in ``known`` (content_hash, object_id) is reused from
    there. The minimum per hash is combined before the shuffle, and contents that many rows
    share are joined back by broadcast, so one that a third of the rows have is no task's alone.
    """
    return reuse_hashed(docs.withColumn("content_hash", content_hash(F.col(content))), doc_id, order, known)


def reuse_hashed(hashed: DataFrame, doc_id: str, order: list[Column], known: DataFrame | None = None) -> DataFrame:
    """:func:`reuse_content` of rows that have their content_hash, and needn't carry the content."""
    rank = F.struct(*[c.alias(f"o{n}") for n, c in enumerate(order)], F.col(doc_id).alias("id"))
    first = hashed.groupBy("content_hash").agg(F.min(rank)["id"].alias("first_id"), F.count("*").alias("times_"))
    if known is not None:
        first = first.join(known.groupBy("content_hash").agg(F.min("object_id").alias("known_id")), "content_hash", "left")
    else:
        first = first.withColumn("known_id", F.lit(None).cast(hashed.schema[doc_id].dataType))
    found = join_back(hashed, first, "content_hash")
    object_id = F.coalesce("known_id", "first_id")
    return found.withColumn("object_id", object_id).withColumn("reused", F.col("known_id").isNotNull() | (F.col("first_id") != F.col(doc_id))).drop("first_id", "known_id")


def first_by_id(chunks: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first by ``order``."""
    rest = [c for c in chunks.columns if c not in key]
    best = chunks.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*key, *[F.col("r")[c].alias(c) for c in rest])


def chunk_identity(object_id: Column, ordinal: Column, content: Column) -> Column:
    return F.concat(F.lit("chk_"), identity(object_id, ordinal, content))


def manifests(chunks: DataFrame, objects: DataFrame) -> DataFrame:
    """Counters of each generation: objects, distinct chunks, reused, created and the distinct sources."""
    by_object = objects.groupBy("generation").agg(
        F.count("*").alias("object_count"), F.count(F.when(F.col("reused"), 1)).alias("reused_count"), F.count(F.when(~F.col("reused"), 1)).alias("created_count"), F.countDistinct("source").alias("source_count")
    )
    by_chunk = chunks.groupBy("generation").agg(F.countDistinct("chunk_id").alias("chunk_count"))
    return by_object.join(by_chunk, "generation", "left").na.fill(0, ["chunk_count"])


def stride_sample(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """``most`` rows evenly spread over the sorted rows: positions ``floor(i * n / most)``.

    Positions come from ranges with an offset each, so no task numbers all rows.
    """
    n = rows.count()
    if n <= most:
        return rows
    at = numbered(rows, [F.col(c) for c in order], "at_")
    # position p is taken if some i has floor(i * n / most) = p
    i = F.ceil(F.col("at_") * most / n)
    return at.filter((F.floor(i * n / most) == F.col("at_")) & (i < most)).select(*rows.columns)


def swept(objects: DataFrame, chunks: DataFrame, max_bytes: int = 2000, tolerance: int = 5) -> DataFrame:
    """One row over a corpus: objects, chunks, empty and oversized ones, and ids that stand twice in an object.

    ``objects``: object_id; ``chunks``: object_id, chunk_id, content.
    """
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    by = chunks.groupBy("object_id", "chunk_id").agg(F.count("*").alias("n"), F.count_if(size == 0).alias("empty"), F.count_if(size > max_bytes * tolerance).alias("oversized"))
    counts = by.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in ((F.col("n"), "chunks"), (F.col("empty"), "empty_chunks"), (F.col("n") - 1, "duplicate_ids"), (F.col("oversized"), "oversized_chunks"))])
    return objects.agg(F.count("*").alias("objects")).crossJoin(counts)  # one row each
