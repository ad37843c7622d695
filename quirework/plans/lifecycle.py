"""Changes of recorded state as transactions: promotion, rebuild, and deletion that can be taken up again.

The tables of a root (see :mod:`snapshots`) are ``generations`` (id, ecosystem, package,
version, state, updated_at), ``pointers`` (ecosystem, package, version, generation),
``references`` (project, ecosystem, package, version, reason, first_seen, last_seen),
``chunks`` (generation and more, in parts by a hash of it), ``jobs`` and ``no_source``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.text import identity
from quirework.plans.reconcile import KEY, promote
from quirework.plans.snapshots import Parts, Snapshot, View, commit, view
from quirework.session import stored

CHUNK_PARTS = 64
JOBS = "job string, kind string, ecosystem string, package string, version string, generation string, state string, error string, updated_at timestamp"


def chunk_part(generation: Column) -> Column:
    """The part of ``chunks`` that a generation is in."""
    return F.pmod(F.xxhash64(generation.cast("string")), F.lit(CHUNK_PARTS)).cast("string")


def create(spark: SparkSession, root: str, **tables: DataFrame) -> Snapshot:
    """The first version: the tables given; ``chunks`` in parts, ``jobs`` empty unless given."""

    def made(_: View) -> dict:
        out: dict = dict(tables)
        if "chunks" in out:
            out["chunks"] = Parts(out["chunks"].withColumn("part_", chunk_part(F.col("generation"))))
        out.setdefault("jobs", spark.createDataFrame([], JOBS))
        return out

    return commit(spark, root, made)


def promote_validated(spark: SparkSession, root: str, reports: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """Promotes the candidates whose checks passed, in one commit; (generation, outcome) of each.

    ``reports``: generation, structural, sanity, version_correctness (failures of each, as
    arrays). ``force`` overrides sanity alone. Outcomes: ``promoted``, ``validation failed``,
    ``not ready`` (only READY generations are), ``unknown``, ``superseded`` (another candidate of
    the version has the larger id). Nothing changes for those that aren't promoted. A version
    that has a source now loses its record of having none.
    """

    def judged(v: View) -> DataFrame:
        failed = (F.size("structural") > 0) | (F.size("version_correctness") > 0)
        failed = failed if force else failed | (F.size("sanity") > 0)
        g = v.table("generations").select(F.col("id").alias("generation"), "state", *KEY)
        joined = reports.join(g, "generation", "left")
        fit = F.when(F.col("state").isNull(), "unknown").when(failed, "validation failed").when(F.col("state") != "READY", "not ready")
        fit = joined.withColumn("outcome", fit)
        newest = fit.filter("outcome is null").groupBy(*KEY).agg(F.max("generation").alias("newest"))
        last = F.when(F.col("generation") == F.col("newest"), "promoted").otherwise("superseded")
        return fit.join(newest, KEY, "left").select("generation", *KEY, F.coalesce("outcome", last).alias("outcome"))

    outcome: list[DataFrame] = []

    def change(v: View) -> dict:
        found = stored(judged(v), "outcome")
        outcome[:] = [found]
        chosen = found.filter("outcome = 'promoted'")
        if chosen.isEmpty():
            return {}
        ids = chosen.select(F.col("generation").alias("id"))
        before = v.table("generations")
        after, pointers = promote(before, v.table("pointers"), ids)
        old = before.select("id", F.col("state").alias("old_state"))
        touched = after.join(old, "id").withColumn("updated_at", F.when(F.col("state") != F.col("old_state"), now).otherwise(F.col("updated_at"))).select(*before.columns)
        made: dict = {"generations": touched, "pointers": pointers.select(*v.table("pointers").columns)}
        if "no_source" in v:
            made["no_source"] = v.table("no_source").join(chosen.select(*KEY).distinct(), KEY, "left_anti").select(*v.table("no_source").columns)
        return made

    commit(spark, root, change)
    return outcome[0].select("generation", "outcome")


def _without_pointers(v: View, versions: DataFrame, now: Column) -> dict:
    """Pointers less those of ``versions``; the generations they named are superseded."""
    pointers, generations = v.table("pointers"), v.table("generations")
    cleared = pointers.join(versions.select(*KEY).distinct(), KEY, "left_semi").select(F.col("generation").alias("id"), F.lit(True).alias("cleared")).distinct()
    left = pointers.join(versions.select(*KEY).distinct(), KEY, "left_anti").select(*pointers.columns)
    hit = F.coalesce("cleared", F.lit(False))
    marked = generations.join(cleared, "id", "left").withColumn("state", F.when(hit, "SUPERSEDED").otherwise(F.col("state"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))
    return {"pointers": left, "generations": marked.select(*generations.columns)}


def clear_for_rebuild(spark: SparkSession, root: str, resolved: DataFrame, packages: DataFrame, now: Column, project: str | None = None) -> Snapshot:
    """Makes named packages unbuilt for the projects that resolve them, in one commit.

    ``resolved``: project, ecosystem, package, version; ``packages``: package. The references
    of those projects and the pointers of those versions go, so that the next plan adds
    and builds them anew; other versions and packages stay. ``project``: of one alone.
    """
    hit = resolved.join(packages.select("package").distinct(), "package", "left_semi")
    hit = hit if project is None else hit.filter(F.col("project") == project)
    mine = hit.select("project", *KEY).distinct()

    def change(v: View) -> dict:
        references = v.table("references")
        left = references.join(mine, ["project", *KEY], "left_anti").select(*references.columns)
        return {"references": left} | _without_pointers(v, mine, now)

    return commit(spark, root, change)


Failures = DataFrame | None
Erase = Callable[[DataFrame], Failures]


def _jobs_after(v: View, jobs: DataFrame, state: str, now: Column) -> DataFrame:
    """The job log with ``jobs`` (job, kind, KEY, generation, error) in ``state``."""
    rest = v.table("jobs").join(jobs.select("job").distinct(), "job", "left_anti")
    return rest.unionByName(jobs.select("job", "kind", *KEY, "generation", F.lit(state).alias("state"), "error", now.alias("updated_at")))


def _chunks_without(v: View, gone: DataFrame) -> Parts | None:
    """``chunks`` without some generations; parts that hold none of them aren't read."""
    touched = [r.part for r in gone.select(chunk_part(F.col("id")).alias("part")).distinct().collect()]  # CHUNK_PARTS at most
    touched = [p for p in touched if p in v.parts("chunks")]
    if not touched:
        return None
    rows = v.table("chunks", only=touched)
    left = rows.join(gone.select(F.col("id").alias("generation")).distinct(), "generation", "left_anti").select(*rows.columns)
    return Parts(left.withColumn("part_", chunk_part(F.col("generation"))), gone=touched)


def _run(spark: SparkSession, root: str, jobs: DataFrame, now: Column, steps: list[tuple[str, Callable[[View, DataFrame], dict] | Erase]]) -> DataFrame:
    """Runs the steps for all jobs that haven't succeeded, a commit each; (job, state, error).

    A step returns tables to commit, or, if it works elsewhere (``erase``), the jobs that
    failed there with their ``error``: those stop, the others go on. If a step raises, all
    jobs that are left fail with its message. Whoever runs the same jobs again starts
    at the first step, and every step finds what is left to do.
    """
    done = view(spark, root).table("jobs").filter("state = 'SUCCEEDED'").select("job")
    todo = stored(jobs.join(done, "job", "left_anti").withColumn("error", F.lit(None).cast("string")), "jobs")
    left, failed = todo, []
    commit(spark, root, lambda v: {"jobs": _jobs_after(v, todo, "RUNNING", now)})
    for name, step in steps:
        try:
            if name == "erase":
                bad = step(left)
                if bad is not None:
                    bad = stored(left.drop("error").join(bad.groupBy("job").agg(F.min("error").alias("error")), "job"), "failed")
                    failed.append(bad)
                    left = stored(left.join(bad.select("job"), "job", "left_anti"), "left")
            else:
                commit(spark, root, lambda v, step=step, left=left: step(v, left))
        except Exception as problem:
            failed.append(left.withColumn("error", F.lit(f"{name}: {problem}"[:500])))
            left = left.limit(0)
            break
    every = [left.select(*todo.columns)]
    for bad in failed:
        every.append(bad.select(*todo.columns))

    def ended(v: View) -> dict:
        log = _jobs_after(v, every[0], "SUCCEEDED", now)
        for bad in every[1:]:
            rest = log.join(bad.select("job"), "job", "left_anti")
            log = rest.unionByName(bad.select("job", "kind", *KEY, "generation", F.lit("FAILED").alias("state"), "error", now.alias("updated_at")))
        return {"jobs": log}

    commit(spark, root, ended)
    return jobs.select("job", *KEY, "generation").join(view(spark, root).table("jobs").select("job", "state", "error"), "job")


def job_id(kind: str, *parts: Column) -> Column:
    """A job's id by its content, so that the same work has the same job."""
    return F.concat(F.lit("job_"), identity(F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def collect_versions(spark: SparkSession, root: str, candidates: DataFrame, now: Column, erase: Erase | None = None) -> DataFrame:
    """Deletes whole versions (KEY) in a fixed order: pointer, index, chunks, generations and references.

    The pointer goes first, so that no search meets what is half deleted. ``erase`` deletes
    the versions (job, KEY) from an index kept elsewhere. Jobs that have succeeded are left alone.
    """
    jobs = candidates.select(*KEY).distinct().withColumns({"job": job_id("gc", *map(F.col, KEY)), "kind": F.lit("gc"), "generation": F.lit(None).cast("string")})

    def ids(v: View, left: DataFrame) -> DataFrame:
        return v.table("generations").join(left.select(*KEY), KEY, "left_semi").select("id")

    def chunks(v: View, left: DataFrame) -> dict:
        made = _chunks_without(v, ids(v, left)) if "chunks" in v else None
        return {} if made is None else {"chunks": made}

    def records(v: View, left: DataFrame) -> dict:
        return {n: v.table(n).join(left.select(*KEY), KEY, "left_anti").select(*v.table(n).columns) for n in ("generations", "references")}

    steps = [("clear pointers", lambda v, left: _without_pointers(v, left, now)), ("delete chunks", chunks), ("delete records", records)]
    if erase is not None:
        steps.insert(1, ("erase", erase))
    return _run(spark, root, jobs, now, steps)


def collect_generations(spark: SparkSession, root: str, kind: str, ids: DataFrame, now: Column, erase: Erase | None = None) -> DataFrame:
    """Deletes single generations (``id``), orphans or superseded duplicates: index, chunks, record; references and pointers stay."""
    known = view(spark, root).table("generations").select("id", *KEY)
    jobs = ids.select("id").distinct().join(known, "id", "left").select(*KEY, F.col("id").cast("string").alias("generation")).withColumns({"job": job_id(kind, F.col("generation")), "kind": F.lit(kind)})

    def gone(left: DataFrame) -> DataFrame:
        return left.select(F.col("generation").alias("id"))

    def chunks(v: View, left: DataFrame) -> dict:
        made = _chunks_without(v, gone(left)) if "chunks" in v else None
        return {} if made is None else {"chunks": made}

    def records(v: View, left: DataFrame) -> dict:
        g = v.table("generations")
        return {"generations": g.join(gone(left).withColumn("id", F.col("id").cast(g.schema["id"].dataType)), "id", "left_anti").select(*g.columns)}

    steps = [("delete chunks", chunks), ("delete records", records)]
    if erase is not None:
        steps.insert(0, ("erase", erase))
    return _run(spark, root, jobs, now, steps)
