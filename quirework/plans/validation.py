"""Checks of generations before and after promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.text import search_terms
from quirework.operators.index import Index, live
from quirework.operators.retrieval import bm25, scan


def _failures(*checks: tuple[Column, str]) -> Column:
    """The names of the checks that fail, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in checks]), lambda x: x.isNotNull())


def structural(generations: DataFrame, manifests: DataFrame, replicas: DataFrame, staged: DataFrame) -> DataFrame:
    """(generation, failures) of each generation: empty counts, and counts that disagree. All failures are listed."""
    g = generations.select(F.col("id").alias("generation"))
    m = manifests.select("generation", F.lit(True).alias("has_manifest"), "source_count", "object_count", "chunk_count")
    joined = g.join(m, "generation", "left").join(replicas.select("generation", "point_count"), "generation", "left").join(staged.select("generation", "staged_count"), "generation", "left")
    joined = joined.na.fill(0, ["source_count", "object_count", "chunk_count", "point_count", "staged_count"])
    found = _failures(
        (F.col("source_count") == 0, "no sources"),
        (F.col("object_count") == 0, "no objects"),
        (F.col("chunk_count") == 0, "no chunks"),
        (F.col("point_count") != F.col("chunk_count"), "points differ from chunks"),
        (F.col("has_manifest").isNull(), "manifest of another generation"),
        (F.col("staged_count") != F.col("chunk_count"), "staged chunks differ from manifest"),
    )
    return joined.select("generation", found.alias("failures"))


def sanity(candidates: DataFrame, prior: DataFrame, least_objects: float = 0.5, most_chunks: float = 3.0) -> DataFrame:
    """(ecosystem, package, failures): counts of a candidate against the version active before; none passes, a prior count of 0 is skipped."""
    key = ["ecosystem", "package"]
    before = prior.select(*key, F.col("object_count").alias("prior_objects"), F.col("chunk_count").alias("prior_chunks"))
    joined = candidates.join(before, key, "left")
    objects = F.when(F.col("prior_objects") > 0, F.col("object_count") / F.col("prior_objects"))
    chunks = F.when(F.col("prior_chunks") > 0, F.col("chunk_count") / F.col("prior_chunks"))
    return joined.select(*key, _failures((objects < least_objects, "too few objects"), (chunks > most_chunks, "too many chunks")).alias("failures"))


def version_correctness(hits: DataFrame, samples: DataFrame) -> DataFrame:
    """(generation, failures): each sample's search must find something, and only its own version and generation.

    ``samples``: generation, version, query_id; ``hits``: query_id and the generation and version found.
    """
    by = hits.select("query_id", F.col("generation").alias("hit_generation"), F.col("version").alias("hit_version"))
    joined = samples.join(by, "query_id", "left")
    none = F.col("hit_generation").isNull()
    strange = ~none & ((F.col("hit_generation") != F.col("generation")) | (F.col("hit_version") != F.col("version")))
    per = joined.groupBy("generation", "query_id").agg(F.max(none).alias("none"), F.max(strange).alias("strange"))
    return per.groupBy("generation").agg(F.count(F.when(F.col("none"), 1)).alias("without_result"), F.count(F.when(F.col("strange"), 1)).alias("wrong_version"), (~F.max(F.col("none") | F.col("strange"))).alias("passed"))


def sample_hits(found: Index, samples: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, generation, version): what a search for each sample's text finds within its generation.

    ``samples``: query_id, generation, text. A text without search terms finds the
    generation's points as they come, as a search without terms does. The version is that
    which the index has for the generation.
    """
    asked = samples.select("query_id", F.col("generation").alias("scope"), "text")
    worded = F.size(search_terms(F.col("text"))) > 0
    ranked = bm25(found, asked.filter(worded), k).select("query_id", "scope")
    scanned = scan(live(found.points, found.gone).select("scope", "id"), ["scope"], ["id"], k)
    plain = asked.filter(~worded).select("query_id", "scope").join(scanned.select("scope"), "scope").select("query_id", "scope")
    hits = ranked.unionByName(plain).join(found.scopes.select("scope", "version"), "scope", "left")
    return hits.select("query_id", F.col("scope").alias("generation"), "version")


def validated(structural_failures: DataFrame, sanity_failures: DataFrame, found: Index, samples: DataFrame, generations: DataFrame) -> DataFrame:
    """(generation, state, failures): all three checks of each generation; READY if none failed.

    ``structural_failures`` and ``sanity_failures``: generation, failures; ``samples``: generation, version,
    query_id, text; a generation without samples passes the third. Failures name their check.
    """
    by = version_correctness(sample_hits(found, samples), samples)
    third = by.select("generation", _failures((F.col("without_result") > 0, "no result"), (F.col("wrong_version") > 0, "wrong version")).alias("failures"))

    def prefixed(name: str) -> Column:
        return F.transform("failures", lambda f: F.concat(F.lit(f"{name}: "), f)).alias("failures")

    named = [c.select("generation", prefixed(n)) for n, c in (("structural", structural_failures), ("sanity", sanity_failures), ("version", third))]
    none = generations.select(F.col("id").alias("generation"), F.array().cast("array<string>").alias("failures"))
    return report(none, *[c.join(none.select("generation"), "generation", "left_semi") for c in named])


def report(*checks: DataFrame) -> DataFrame:
    """(generation, state, failures) from several results of (generation, failures): READY if none failed."""
    rows = None
    for part in checks:
        part = part.select("generation", "failures")
        rows = part if rows is None else rows.unionByName(part)
    every = rows.groupBy("generation").agg(F.array_sort(F.flatten(F.collect_list("failures"))).alias("failures"))
    return every.withColumn("state", F.when(F.size("failures") == 0, "READY").otherwise("FAILED"))


def pointer_health(pointers: DataFrame, generations: DataFrame, manifests: DataFrame, replicas: DataFrame) -> DataFrame:
    """Each active pointer and what is wrong with it: a missing or inactive generation, no manifest, no replica, an empty one or counts that differ."""
    g = generations.select(F.col("id").alias("generation"), F.col("state").alias("g_state"))
    joined = pointers.join(g, "generation", "left").join(manifests.select("generation", "chunk_count"), "generation", "left").join(replicas.select("generation", "point_count"), "generation", "left")
    health = (
        F.when(F.col("g_state").isNull(), "dangling")
        .when(F.col("g_state") != "ACTIVE", "not active")
        .when(F.col("chunk_count").isNull(), "no manifest")
        .when(F.col("point_count").isNull(), "no replica")
        .when(F.col("point_count") == 0, "empty")
        .when(F.col("point_count") != F.col("chunk_count"), "counts differ")
        .otherwise("ok")
    )
    return joined.withColumn("health", health)


def never_built(references: DataFrame, pointers: DataFrame, no_source: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Versions referenced for more than ``minutes`` without an active generation, and whether a source is known to be missing."""
    key = ["ecosystem", "package", "version"]
    old = references.filter(F.col("first_seen") < now - F.expr(f"INTERVAL {minutes} MINUTES")).select(*key).distinct()
    missing = old.join(pointers.select(*key).distinct(), key, "left_anti")
    return missing.join(no_source.select(*key).distinct().withColumn("known", F.lit(True)), key, "left").select(*key, F.coalesce("known", F.lit(False)).alias("no_source"))


def fleet_status(projects: DataFrame, dependencies: DataFrame, pointers: DataFrame) -> DataFrame:
    """One row: projects, their dependencies, and how many of those have an active generation."""
    key = ["ecosystem", "package", "version"]
    active = pointers.select(*key).distinct().withColumn("active", F.lit(1))
    deps = dependencies.join(projects.select("project"), "project", "left_semi").join(active, key, "left")
    counts = deps.agg(F.count("*").alias("dependencies"), F.count("active").alias("active"), F.count(F.when(F.col("active").isNull(), 1)).alias("inactive"))
    return projects.agg(F.countDistinct("project").alias("projects")).crossJoin(counts)  # one row each


def job_counts(jobs: DataFrame) -> DataFrame:
    """One row: pending (and to be retried), running, failed and all."""
    state = F.col("state")
    return jobs.agg(F.count(F.when(state.isin("PENDING", "RETRY"), 1)).alias("pending"), F.count(F.when(state == "RUNNING", 1)).alias("running"), F.count(F.when(state == "FAILED", 1)).alias("failed"), F.count("*").alias("total"))


def consistent_metadata(points: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """Groups whose rows don't all have the same metadata."""
    return points.groupBy(by).agg(F.countDistinct(F.struct(*fields)).alias("kinds")).filter("kinds > 1")


def lowest_chunks(chunks: DataFrame, most: int = 5) -> DataFrame:
    """The sample of each generation that a check searches for: its ``most`` lowest chunk ids."""
    w = Window.partitionBy("generation").orderBy("chunk_id")
    return chunks.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).drop("n")


def invalid_objects(objects: DataFrame) -> DataFrame:
    """Objects that lack a source or a trust class, and what is missing."""

    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""

    return objects.withColumn("failures", _failures((blank("source_uri"), "no source"), (blank("trust_class"), "no trust class"))).filter(F.size("failures") > 0)


def last_promotion(pointers: DataFrame, generations: DataFrame) -> DataFrame:
    """One row: when an active generation was last promoted; null if none is active."""
    return pointers.join(generations.select(F.col("id").alias("generation"), "updated_at"), "generation").agg(F.max("updated_at").alias("last_promotion"))


def named(dependencies: DataFrame, names: DataFrame | None) -> DataFrame:
    """The dependencies of these names (package); no set of names, or an empty one, is all."""
    if names is None:
        return dependencies
    size = names.agg(F.count("*").alias("names"))
    asked = dependencies.join(names.select("package", F.lit(True).alias("asked")).distinct(), "package", "left").crossJoin(size)  # one row
    return asked.filter(F.col("asked") | (F.col("names") == 0)).select(*dependencies.columns)
