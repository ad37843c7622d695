"""Where an answer comes from and where a question is asked: joins of hits, chunks, objects, sources and pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.plans.reconcile import KEY, latest_active

NO_PROJECT, NO_DEPENDENCY, NO_GENERATION = "project not found", "dependency not found", "no active generation for this version"


def origins(chunks: DataFrame, objects: DataFrame) -> DataFrame:
    """The origin of each chunk (generation, chunk_id, object_id), read from its object.

    ``objects``: object_id, source_uri, source_type, logical_path, authority, version.
    A chunk whose object is gone is left out.
    """
    told = objects.select("object_id", "source_uri", "source_type", "logical_path", "authority", "version")
    return chunks.select("generation", "chunk_id", "object_id").join(told, "object_id")


def current_sources(chunks: DataFrame, objects: DataFrame, sources: DataFrame) -> DataFrame:
    """(generation, chunk_id, source_type, authority): the registry's present word on a source replaces the stored one.

    ``objects`` also have source_id, ``sources`` are source_id, source_type, authority with one row an id.
    """
    now = sources.select("source_id", F.struct("source_type", "authority").alias("now"))
    found = chunks.select("generation", "chunk_id", "object_id").join(objects.select("object_id", "source_id", "source_type", "authority"), "object_id").join(now, "source_id", "left")
    return found.select("generation", "chunk_id", *[F.when(F.col("now").isNotNull(), F.col("now")[c]).otherwise(F.col(c)).alias(c) for c in ("source_type", "authority")])


def first_dependencies(dependencies: DataFrame) -> DataFrame:
    """(project, module, ecosystem, first): a project's first dependency (ordinal, found_in, version) of each name in each ecosystem, and in any (an empty one)."""
    first = F.struct("ordinal", F.col("ecosystem").alias("found_in"), "version")
    exact = dependencies.groupBy("project", F.col("package").alias("module"), "ecosystem").agg(F.min(first).alias("first"))
    anywhere = exact.groupBy("project", "module").agg(F.min("first").alias("first")).withColumn("ecosystem", F.lit(""))
    return exact.filter("ecosystem <> ''").unionByName(anywhere)


def dependencies_of_symbols(symbols: DataFrame, dependencies: DataFrame) -> DataFrame:
    """``symbols`` (project, module, ecosystem) with the version of the project's first dependency of that name.

    ``dependencies``: project, ordinal, ecosystem, package, version. A symbol of no known
    ecosystem (null or empty) takes any; without a match the version is null.
    """
    asked = symbols.withColumn("ecosystem", F.coalesce("ecosystem", F.lit("")))
    return asked.join(first_dependencies(dependencies), ["project", "module", "ecosystem"], "left").select(*symbols.columns, F.col("first.found_in").alias("dependency_ecosystem"), F.col("first.version").alias("version"))


def release_changes(asked: DataFrame, references: DataFrame, pointers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, ecosystem, version, excerpt, error): release notes of exactly two versions of a package.

    ``asked``: query_id, package, from_version, to_version. Each ecosystem that refers to the
    package is read in the active generation of the later version, or else of the earlier
    one; ``chunks``: generation, content_type, release_version, content. A package that
    nothing refers to gives one row with an error.
    """
    ecosystems = references.select("package", "ecosystem").distinct()
    each = asked.join(ecosystems, "package", "left")
    at = pointers.select("ecosystem", "package", "version", "generation")
    newer = at.withColumnsRenamed({"version": "to_version", "generation": "newer"})
    older = at.withColumnsRenamed({"version": "from_version", "generation": "older"})
    there = each.join(newer, ["ecosystem", "package", "to_version"], "left").join(older, ["ecosystem", "package", "from_version"], "left").withColumn("generation", F.coalesce("newer", "older"))
    notes = chunks.filter("content_type = 'release_note'").select("generation", F.col("release_version").alias("version"), F.col("content").alias("excerpt"))
    found = there.join(notes, "generation").filter(F.col("version").isin(F.col("from_version"), F.col("to_version")))
    unknown = each.filter("ecosystem is null").select("query_id", "ecosystem", F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("excerpt"), F.lit(NO_DEPENDENCY).alias("error"))
    return found.select("query_id", "ecosystem", "version", "excerpt", F.lit(None).cast("string").alias("error")).unionByName(unknown)


def _in_project(asked: DataFrame, projects: DataFrame, dependencies: DataFrame, pointers: DataFrame) -> DataFrame:
    known = projects.select("project", F.lit(True).alias("known"))
    first = dependencies.groupBy("project", "package").agg(F.min(F.struct("ordinal", "ecosystem", "version")).alias("d"))
    found = asked.join(known, "project", "left").join(first, ["project", "package"], "left").select("query_id", "package", "known", F.col("d.ecosystem").alias("ecosystem"), F.col("d.version").alias("version"))
    error = F.when(F.col("known").isNull(), NO_PROJECT).when(F.col("version").isNull(), NO_DEPENDENCY).when(F.col("generation").isNull(), NO_GENERATION)
    return found.join(pointers, KEY, "left").select("query_id", "generation", error.alias("error"), F.lit("project").alias("found_by"))


def _latest(asked: DataFrame, references: DataFrame, pointers: DataFrame) -> DataFrame:
    """By the references with the reason ``latest`` alone; of several the first by key."""
    key = F.concat_ws("|", *KEY, "project", "reason")
    newest = references.filter("reason = 'latest'").groupBy("package").agg(F.min_by(F.struct("ecosystem", "version"), key).alias("r"))
    found = asked.join(newest, "package", "left").select("query_id", "package", F.col("r.ecosystem").alias("ecosystem"), F.col("r.version").alias("version"))
    error = F.when(F.col("version").isNull(), NO_DEPENDENCY).when(F.col("generation").isNull(), NO_GENERATION)
    return found.join(pointers, KEY, "left").select("query_id", "generation", error.alias("error"), F.lit("latest").alias("found_by"))


def search_scopes(asked: DataFrame, projects: DataFrame, dependencies: DataFrame, references: DataFrame, pointers: DataFrame) -> DataFrame:
    """(query_id, generation, error, found_by): the generations that a question is asked in, by its mode.

    ``asked``: query_id, mode, project, package. Modes: ``project`` (the version that the
    project resolves), ``latest`` (the reference recorded as the latest), ``compare`` (both, one of
    them may fail; one row with both errors if both do) and ``all-retained`` (each referred version that is active). What can't be
    searched has one row with an error, so it differs from a search without hits.
    ``dependencies``: project, ordinal, ecosystem, package, version; ``references`` have
    last_seen; ``pointers``: ecosystem, package, version, generation, one row a version.
    """
    at = pointers.select(*KEY, "generation")
    mode = F.col("mode")
    own = _in_project(asked.filter(mode.isin("project", "compare")), projects, dependencies, at)
    last = _latest(asked.filter(mode.isin("latest", "compare")), references, at)
    versions = references.select(*KEY).distinct()
    retained = asked.filter(mode == "all-retained").join(versions, "package", "left").join(at, KEY, "left")
    everything = retained.filter(F.col("generation").isNotNull() | F.col("version").isNull()).select("query_id", "generation", F.when(F.col("version").isNull(), NO_DEPENDENCY).alias("error"), F.lit("all-retained").alias("found_by"))
    single = own.unionByName(last)
    said = {name: F.max(F.when(F.col("found_by") == name, F.col("error"))) for name in ("project", "latest")}
    both = single.join(asked.filter(mode == "compare").select("query_id"), "query_id", "left_semi").groupBy("query_id").agg(F.count("generation").alias("works"), *[c.alias(f"{n}_error") for n, c in said.items()])
    failed = both.filter("works = 0").select("query_id", F.lit(None).cast(pointers.schema["generation"].dataType).alias("generation"), F.concat(F.lit("compare: project search: "), "project_error", F.lit("; latest search: "), "latest_error").alias("error"), F.lit("compare").alias("found_by"))
    kept = single.join(both, "query_id", "left").filter(F.col("works").isNull() | F.col("generation").isNotNull())
    return kept.drop("works", "project_error", "latest_error").unionByName(failed).unionByName(everything)


def described(references: DataFrame, matches: DataFrame, pointers: DataFrame, generations: DataFrame, manifests: DataFrame, replicas: DataFrame) -> DataFrame:
    """A row for each package that is referred to: its manifest, the version promoted last, the other active ones and their counts.

    ``matches``: ecosystem, package, alias; ``generations``: id, updated_at; ``manifests``:
    generation, chunk_count, object_count, reused_count; ``replicas``: generation, status, point_count.
    Without a manifest or an active generation its columns are null; a missing replica is ``unknown``.
    """
    packages = references.select("ecosystem", "package").distinct()
    last = latest_active(pointers, generations).select("ecosystem", "package", F.struct("version", "generation").alias("last"))
    active = pointers.join(generations.select(F.col("id").alias("generation")), "generation").groupBy("ecosystem", "package").agg(F.array_sort(F.collect_set("version")).alias("versions"))
    named = packages.join(matches.select("ecosystem", "package", "alias"), ["ecosystem", "package"], "left").join(last, ["ecosystem", "package"], "left").join(active, ["ecosystem", "package"], "left")
    found = named.select("ecosystem", "package", "alias", F.col("last.version").alias("active_version"), F.col("last.generation").alias("generation"), F.array_remove("versions", F.col("last.version")).alias("other_versions"))
    counted = found.join(manifests.select("generation", "chunk_count", "object_count", "reused_count"), "generation", "left").join(replicas.select("generation", "status", "point_count"), "generation", "left")
    return counted.withColumn("status", F.when(F.col("generation").isNotNull(), F.coalesce("status", F.lit("unknown"))))


def hybrid_count(*counts: Column) -> Column:
    """How many points a hybrid index holds: the most of its parts."""
    return F.greatest(*[F.coalesce(c, F.lit(0)) for c in counts])
