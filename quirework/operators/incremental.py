"""Builds of a version that redo only what changed since the last one.

The tables of a root (:mod:`quirework.plans.snapshots`) are ``listing`` (path, hash, normalizer, source_type,
object_id), ``objects`` (object_id, content_hash, content_type, path) and ``chunks`` (object_id,
chunk_id, ordinal, path_in_object, content); the last two only ever get parts with what is
new. A file whose hash and normaliser are as before keeps its object, wherever it lies now;
one that changed is read, normalised and, if no object has its content yet, chunked. A
version is its listing: it joins to the chunks by object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.text import identity
from quirework.operators.documents import chunk_identity, content_hash, ordered_chunks, reuse_hashed
from quirework.operators.normalizing import chunker, normalized, normalizer
from quirework.operators.skew import chosen
from quirework.plans.snapshots import Parts, Snapshot, View, commit
from quirework.session import stored

COUNTS = "carried long, reused long, created long, dropped long, chunks long"


def build(spark: SparkSession, root: str, files: DataFrame, max_bytes: int = 2000) -> Snapshot:
    """The next version: ``files`` are path, source_type, include_license, content and, if at hand, hash (of the content).

    With ``hash`` the contents of unchanged files aren't read. Of files with one path the
    one with the smallest hash counts. ``counts`` tells what was carried over, reused, created and dropped.
    """
    hashed = files if "hash" in files.columns else files.withColumn("hash", F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit("").cast("binary")), 256))
    taken = normalizer(F.col("path"), F.col("source_type"), F.col("include_license"))
    wanted = hashed.select("path", "hash", F.coalesce("source_type", F.lit("")).alias("source_type"), taken.alias("normalizer")).filter("normalizer is not null")

    def change(v: View) -> dict:
        seq = str(1 + max((int(k) for k in v.parts("objects")), default=0)) if "listing" in v else "1"
        new = stored(wanted.groupBy("path").agg(F.min(F.struct("hash", "source_type", "normalizer")).alias("f"), F.count("*").alias("n")).select("path", "f.*", "n"), "listing")
        kind = "path string, hash string, source_type string, normalizer string, object_id string"
        old = v.table("listing") if "listing" in v else spark.createDataFrame([], kind)
        same = ["hash", "normalizer", "source_type"]
        # what an object is made from is told by hash, normaliser and suffix; its place doesn't matter
        suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)?$", 0))
        by_content = old.withColumn("suffix", suffix).groupBy(*same, "suffix").agg(F.min("object_id").alias("object_id"))
        known = new.withColumn("suffix", suffix).join(by_content, [*same, "suffix"], "left").drop("suffix")
        before = old.select("path", F.struct(*same).alias("was"))
        known = stored(known.join(before, "path", "left").withColumn("carried", F.coalesce(F.col("was") == F.struct(*same), F.lit(False))).drop("was"), "known")
        missing = known.filter("object_id is null and path is not null").select("path", "hash")
        n_files, n_paths, n_missing = (x or 0 for x in known.agg(F.sum("n"), F.count("*"), F.count_if(F.col("object_id").isNull() & F.col("path").isNotNull())).first())
        read = hashed.filter(taken.isNotNull() & F.col("path").isNotNull()).select("path", "hash", "source_type", "include_license", "content")
        if n_missing < n_files:  # else all files are read, each has a path of its own
            read = chosen(read, missing, ["path", "hash"], n_missing)
        if n_files > n_paths:
            read = read.dropDuplicates(["path", "hash"])
        # contents are written once as objects and once as chunks; what is told of them meets without them
        own_id = F.concat(F.lit("obj_"), identity(F.col("path"), F.col("normalizer"), F.col("content")))
        made = (normalized(read) if n_missing else normalized(read.limit(0))).select("path", own_id.alias("object_id"), content_hash(F.col("content")).alias("content_hash"), "content_type", "content")
        made = stored(made, "made")
        index = v.table("objects").select("content_hash", "object_id") if "objects" in v else None
        objects = made.select("path", F.col("object_id").alias("own_id"), "content_hash", "content_type")
        built = stored(reuse_hashed(objects, "own_id", [F.col("path")], index), "built")
        fresh = built.filter("not reused").select("object_id", "content_hash", "content_type", "path").dropDuplicates(["object_id"])
        n_again, n_fresh = built.agg(F.count_if("reused"), F.count_if(~F.col("reused"))).first()
        copies = built.filter("reused")
        texts = made.filter(chunker(F.col("content_type")) == "sections").select("path", "object_id", F.col("content").alias("text"))
        if n_again:
            texts = chosen(texts, copies, ["path"], n_again, without=True) if n_again <= n_fresh else chosen(texts, fresh, ["path"], n_fresh)
        parts = ordered_chunks(texts.select("object_id", "text"), "text", max_bytes)
        chunks = parts.select("object_id", chunk_identity(F.col("object_id"), F.col("ordinal").cast("string"), F.col("content")).alias("chunk_id"), "ordinal", F.col("path").alias("path_in_object"), "content")
        found = known.join(built.select("path", F.col("object_id").alias("built_id")), "path", "left").withColumn("object_id", F.coalesce("object_id", "built_id"))
        dropped = old.join(new, "path", "left_anti")
        tally = found.agg(F.count_if("carried").alias("carried"), F.count_if(~F.col("carried") & F.col("built_id").isNull()).alias("moved"))
        told = tally.crossJoin(built.agg(F.count_if("reused").alias("again"), F.count_if(~F.col("reused")).alias("created"))).crossJoin(dropped.agg(F.count("*").alias("dropped")))  # one row each
        told = told.select("carried", (F.col("moved") + F.col("again")).alias("reused"), "created", "dropped")
        return {
            "listing": found.select("path", "hash", "source_type", "normalizer", "object_id"),
            "objects": Parts(fresh.withColumn("part_", F.lit(seq))),
            "chunks": Parts(chunks.withColumn("part_", F.lit(seq))),
            "counts": lambda after: told.crossJoin(after.table("chunks", only=[seq]).agg(F.count("*").alias("chunks"))),
        }

    return commit(spark, root, change)


def version_chunks(v: View) -> DataFrame:
    """(path, object_id, chunk_id, ordinal, path_in_object, content): the chunks of the version, under every path that has their object."""
    return v.table("listing").select("path", "object_id").join(v.table("chunks"), "object_id")


def compacted(spark: SparkSession, root: str) -> Snapshot:
    """Objects and chunks that the listing still names, as one part."""

    def change(v: View) -> dict:
        used, out = v.table("listing").select("object_id").distinct(), {}
        for name in ("objects", "chunks"):
            rows = v.table(name)
            out[name] = Parts(rows.join(used, "object_id", "left_semi").select(*rows.columns).withColumn("part_", F.lit(str(1 + max(map(int, v.parts(name)), default=0)))), gone=list(v.parts(name)))
        return out

    return commit(spark, root, change)
