"""Desired against recorded state: plans, references, garbage and promotion, for all projects at once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.text import path_prefixes

KEY = ["ecosystem", "package", "version"]
BLOCKING = ("project", "latest", "manual_pin")
# The reasons of actions.
UNMAPPED, CHANGED, REMOVED, RETRY = "no knowledge source mapped", "version changed", "dependency removed", "referenced but not built — retrying"
UNREFERENCED = "no longer referenced by this project (provisional — see RET-001)"


def plan(desired: DataFrame, current: DataFrame, active: DataFrame, mapped: DataFrame, no_source: DataFrame) -> DataFrame:
    """(project, ordinal, kind, ecosystem, package, version, reason): the actions of each project.

    ``desired`` has project, ecosystem, package, version; ``current`` the same and
    last_seen, of which the latest row per package counts; ``active`` and ``no_source``
    hold versions, ``mapped`` packages. One full outer join on the package, compared
    by version afterwards.
    """
    pkg = ["project", "ecosystem", "package"]
    # of versions seen at one time the larger counts, so that the plan is the same every time
    recorded = current.groupBy(*pkg).agg(F.max(F.struct("last_seen", "version"))["version"].alias("old"))
    wanted = (
        desired.select(*pkg, "version")
        .join(active.select(*KEY).distinct().withColumn("built", F.lit(True)), KEY, "left")
        .join(mapped.select("ecosystem", "package").distinct().withColumn("mapped", F.lit(True)), ["ecosystem", "package"], "left")
        .join(no_source.select(*KEY).distinct().withColumn("sourceless", F.lit(True)), KEY, "left")
        .na.fill(False, ["built", "mapped", "sourceless"])
    )
    both = wanted.join(recorded, pkg, "full_outer")
    build = ~F.col("built") & (F.col("mapped") | ~F.col("sourceless"))
    why = F.when(~F.col("mapped"), UNMAPPED).otherwise("")

    def act(kind: str, version: str, reason: Column | str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(version).alias("version"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    none = F.array().cast("array<struct<kind: string, version: string, reason: string>>")
    sync = F.when(build, F.array(act("SYNC_VERSION", "version", why))).otherwise(none)
    add = F.array(act("ADD_REFERENCE", "version", why))

    def drop(reason: str) -> Column:
        return F.array(act("DROP_REFERENCE", "old", reason), act("GC_CANDIDATE", "old", UNREFERENCED))

    actions = (
        F.when(F.col("version").isNull(), drop(REMOVED))
        .when(F.col("old").isNull(), F.concat(add, sync))
        .when(F.col("old") != F.col("version"), F.concat(drop(CHANGED), add, sync))
        .when(build, F.array(act("SYNC_VERSION", "version", RETRY)))
        .otherwise(F.array(act("NOOP", "version", "")))
    )
    return both.select(*pkg, F.posexplode(actions).alias("ordinal", "a")).select(*pkg, "ordinal", "a.kind", "a.version", "a.reason")


def expired_references(references: DataFrame, now: Column, grace_days: int = 14) -> DataFrame:
    """Versions that may go: no blocking reference, and the last grace reference ended strictly before ``now``."""
    days = grace_days if grace_days > 0 else 14
    blocked = F.max(F.col("reason").isin(*BLOCKING))
    last = F.max(F.when(F.col("reason") == "grace_period", F.col("last_seen")))
    by = references.groupBy(*KEY).agg(blocked.alias("blocked"), last.alias("grace_from"))
    return by.filter(~F.col("blocked") & (now > F.col("grace_from") + F.expr(f"INTERVAL {days} DAYS"))).select(*KEY, F.lit("grace_expired").alias("reason"))


def orphans(generations: DataFrame, pointers: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Generations that failed, or that have been unfinished for more than ``hours``, and that no pointer names."""
    unfinished = F.col("state").isin("ACQUIRING", "NORMALIZING", "INDEXING", "VALIDATING")
    stale = unfinished & (now > F.col("updated_at") + F.expr(f"INTERVAL {hours} HOURS"))
    why = F.when(F.col("state") == "FAILED", "failed").otherwise("stale")
    found = generations.filter((F.col("state") == "FAILED") | stale)
    return found.join(pointers.select(F.col("generation").alias("id")), "id", "left_anti").withColumn("why", why)


def superseded_duplicates(generations: DataFrame) -> DataFrame:
    """Superseded generations of a version that has an active one."""
    active = generations.filter("state = 'ACTIVE'").select(*KEY).distinct()
    return generations.filter("state = 'SUPERSEDED'").join(active, KEY, "left_semi")


def add_references(references: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by project, version and reason: the first sighting stays, the last moves on."""
    key = ["project", *KEY, "reason"]
    both = references.select(*key, "first_seen", "last_seen").unionByName(new.select(*key, "first_seen", "last_seen"))
    return both.groupBy(*key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def drop_references(references: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """References less those of ``gone`` (project, version); versions left with none get a grace period from ``now``."""
    left = references.join(gone.select("project", *KEY).distinct(), ["project", *KEY], "left_anti")
    touched = references.join(gone.select("project", *KEY).distinct(), ["project", *KEY], "left_semi").select(*KEY).distinct()
    bare = touched.join(left.select(*KEY).distinct(), KEY, "left_anti")
    grace = bare.select(F.lit("_grace").alias("project"), *KEY, F.lit("grace_period").alias("reason"), now.alias("first_seen"), now.alias("last_seen"))
    return left.select(*grace.columns).unionByName(grace)


def promote(generations: DataFrame, pointers: DataFrame, ready: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The generations and pointers after ``ready`` (ids) became active: prior ones are superseded, pointers moved."""
    chosen = generations.join(ready.select("id").distinct(), "id", "left_semi").select("id", *KEY)
    newest = chosen.groupBy(*KEY).agg(F.max("id").alias("new_id"))  # one active generation a version
    joined = generations.join(newest, KEY, "left")
    state = F.when(F.col("id") == F.col("new_id"), "ACTIVE").when(F.col("new_id").isNotNull() & (F.col("state") == "ACTIVE"), "SUPERSEDED").otherwise(F.col("state"))
    moved = pointers.join(newest.select(*KEY), KEY, "left_anti").select(*KEY, "generation").unionByName(newest.select(*KEY, F.col("new_id").alias("generation")))
    return joined.withColumn("state", state).drop("new_id"), moved


def latest_active(pointers: DataFrame, generations: DataFrame) -> DataFrame:
    """Of each package the active generation updated last; of equal ones the smallest id."""
    rows = pointers.join(generations.select(F.col("id").alias("generation"), "updated_at"), "generation")
    best = rows.groupBy("ecosystem", "package").agg(F.max("updated_at").alias("updated_at"))
    same = rows.join(best, ["ecosystem", "package", "updated_at"])
    return same.groupBy("ecosystem", "package", "updated_at").agg(F.min_by(F.struct("version", "generation"), "generation").alias("g")).select("ecosystem", "package", "updated_at", "g.version", "g.generation")


def invalid_transitions(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """State changes (from_state, to_state) that no edge allows."""
    return changes.join(edges.select("from_state", "to_state"), ["from_state", "to_state"], "left_anti")


def bumped(queue: DataFrame, bump: str, ordinal: str = "ordinal") -> DataFrame:
    """The queue with its place: bumped rows first, then the others, each in their order."""
    return queue.withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy(F.col(bump).desc(), F.col(ordinal))))


def nearest_module(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(import_path, module): the longest module whose path is the import or an ancestor of it.

    Ancestors are listed and joined by equality, so there is no comparison of every pair.
    """
    rows = imports.select("import_path", F.explode(path_prefixes(F.col("import_path"))).alias("module"))
    hits = rows.join(modules.select("module").distinct(), "module")
    return hits.groupBy("import_path").agg(F.max_by("module", F.length("module")).alias("module"))


def publish(table: DataFrame, root: str, view: str) -> str:
    """Writes a version of a table to a folder of its own, then points the view at it.

    Readers of the view see the old or the new version, never a part; what is written stays as it is.
    """
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    table.write.parquet(path)
    table.sparkSession.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT * FROM parquet.`{path}`")
    return path
