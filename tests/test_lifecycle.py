"""Commits of several tables, promotion, rebuild and deletion, with jobs that die in between."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from quirework.plans import lifecycle as L
from quirework.plans import snapshots as Z



def now():
    return F.expr("TIMESTAMP '2024-05-01 00:00:00'")


THEN = datetime.datetime(2024, 1, 1)
GENERATION = "id string, ecosystem string, package string, version string, state string, updated_at timestamp"


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "root")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def made(spark, root, states=(("g1", "a", "v1", "ACTIVE"), ("g2", "a", "v1", "SUPERSEDED"), ("g3", "a", "v2", "ACTIVE"), ("g4", "b", "v1", "READY"))):
    generations = spark.createDataFrame([(i, "go", p, v, s, THEN) for i, p, v, s in states], GENERATION).coalesce(1)
    pointers = spark.createDataFrame([("go", p, v, i) for i, p, v, s in states if s == "ACTIVE"], "ecosystem string, package string, version string, generation string").coalesce(1)
    references = spark.createDataFrame([(x, "go", p, v, "project", THEN, THEN) for x in ("x", "y") for p, v in (("a", "v1"), ("a", "v2"), ("b", "v1"))], "project string, ecosystem string, package string, version string, reason string, first_seen timestamp, last_seen timestamp").coalesce(1)
    chunks = spark.createDataFrame([(i, f"{i}-{k}") for i, *_ in states for k in range(3)], "generation string, chunk_id string").coalesce(1)
    L.create(spark, root, generations=generations, pointers=pointers, references=references, chunks=chunks)


def states(spark, root):
    return {r.id: r.state for r in Z.view(spark, root).table("generations").collect()}


def test_a_commit_is_all_or_nothing(spark, root, monkeypatch):
    assert Z.current(spark, root).version == 0
    Z.commit(spark, root, lambda v: {"a": spark.range(3), "b": spark.range(1)})

    class Killed(BaseException):
        pass

    def killed(*_):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(Z, "_claimed", killed)  # all folders are written, the version isn't
        with pytest.raises(Killed):
            Z.commit(spark, root, lambda v: {"a": spark.range(10), "b": spark.range(10)})
    v = Z.view(spark, root)
    assert (v.snapshot.version, v.table("a").count(), v.table("b").count()) == (1, 3, 1)
    Z.commit(spark, root, lambda v: {"b": v.table("b").union(spark.range(5))})
    assert v.table("b").count() == 1  # an older view stays as it was
    assert Z.view(spark, root).table("b").count() == 6 and Z.view(spark, root).table("a").count() == 3
    assert Z.swept_folders(spark, root, versions=1, hours=0) == 3  # two of the killed job, one replaced
    assert Z.view(spark, root).table("b").count() == 6 and Z.view(spark, root).table("a").count() == 3


def test_the_loser_of_two_commits_starts_again(spark, root):
    Z.commit(spark, root, lambda v: {"a": spark.range(1)})
    calls = []

    def change(v):
        calls.append(v.snapshot.version)
        if len(calls) == 1:  # another commit comes in between
            Z.commit(spark, root, lambda w: {"a": w.table("a").union(spark.range(10, 11))})
        return {"a": v.table("a").union(spark.range(20, 21))}

    assert Z.commit(spark, root, change).version == 3
    assert calls == [1, 2] and rows(Z.view(spark, root).table("a")) == [(0,), (10,), (20,)]
    with pytest.raises(Z.Conflict):
        Z.commit(spark, root, lambda v: Z.commit(spark, root, lambda w: {"a": spark.range(1)}) and {"a": spark.range(2)}, attempts=2)


def test_parts_are_replaced_one_by_one(spark, root):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "part_ string, n int")
    Z.commit(spark, root, lambda v: {"t": Z.Parts(df)})
    before = Z.view(spark, root).parts("t")
    Z.commit(spark, root, lambda v: {"t": Z.Parts(df.filter("n = 2").withColumn("n", F.lit(5)), gone=["y"])})
    after = Z.view(spark, root)
    assert after.parts("t")["x"] == before["x"] and rows(after.table("t")) == [(1,), (5,)]
    assert rows(after.table("t", tagged=True)) == [(1, "x"), (5, "y")] and rows(after.table("t", only=["y"])) == [(5,)]
    Z.commit(spark, root, lambda v: {"t": Z.Parts(None, gone=["x", "y"])})
    assert Z.view(spark, root).table("t").count() == 0


def reports(spark, *given):
    return spark.createDataFrame([(g, *([x] if x else [] for x in rest)) for g, *rest in given], "generation string, structural array<string>, sanity array<string>, version_correctness array<string>")


def test_promotion_needs_passed_checks_and_a_ready_candidate(spark, root):
    made(spark, root, (("g1", "a", "v1", "ACTIVE"), ("g2", "a", "v1", "READY"), ("g3", "a", "v1", "INDEXING"), ("g4", "a", "v2", "ACTIVE")))
    before = Z.current(spark, root).version
    assert rows(L.promote_validated(spark, root, reports(spark, ("g2", "no chunks", "", ""), ("g3", "", "", ""), ("g9", "", "", "")), now())) == [("g2", "validation failed"), ("g3", "not ready"), ("g9", "unknown")]
    assert rows(L.promote_validated(spark, root, reports(spark, ("g2", "", "too few objects", "")), now())) == [("g2", "validation failed")]
    assert Z.current(spark, root).version == before and states(spark, root)["g2"] == "READY"
    assert rows(L.promote_validated(spark, root, reports(spark, ("g2", "", "too few objects", "")), now(), force=True)) == [("g2", "promoted")]
    assert states(spark, root) == {"g1": "SUPERSEDED", "g2": "ACTIVE", "g3": "INDEXING", "g4": "ACTIVE"}  # other versions stay
    assert rows(Z.view(spark, root).table("pointers").select("version", "generation")) == [("v1", "g2"), ("v2", "g4")]
    assert rows(Z.view(spark, root).table("generations").filter("updated_at > TIMESTAMP '2024-02-01'").select("id")) == [("g1",), ("g2",)]


def test_rebuild_clears_only_what_is_named(spark, root):
    made(spark, root)
    resolved = spark.createDataFrame([("x", "go", "a", "v1"), ("x", "go", "b", "v1"), ("y", "go", "a", "v2")], "project string, ecosystem string, package string, version string")
    L.clear_for_rebuild(spark, root, resolved, spark.createDataFrame([("a",)], "package string"), now(), project="x")
    v = Z.view(spark, root)
    assert rows(v.table("references").select("project", "package", "version")) == [("x", "a", "v2"), ("x", "b", "v1"), ("y", "a", "v1"), ("y", "a", "v2"), ("y", "b", "v1")]
    assert rows(v.table("pointers").select("version", "generation")) == [("v2", "g3")] and states(spark, root)["g1"] == "SUPERSEDED"


def candidates(spark, *versions):
    return spark.createDataFrame([("go", p, v) for p, v in versions], "ecosystem string, package string, version string")


def left(spark, root):
    v = Z.view(spark, root)
    return rows(v.table("pointers").select("generation")), rows(v.table("generations").select("id")), rows(v.table("references").select("package", "version").distinct()), rows(v.table("chunks").select("generation").distinct())


GONE = ([("g3",)], [("g3",), ("g4",)], [("a", "v2"), ("b", "v1")], [("g3",), ("g4",)])


def test_versions_are_deleted_in_order(spark, root):
    made(spark, root)
    seen = []

    def erase(jobs):
        v = Z.view(spark, root)
        seen.append((rows(jobs.select("package", "version")), rows(v.table("pointers").select("generation")), v.table("chunks").count()))

    assert [r.state for r in L.collect_versions(spark, root, candidates(spark, ("a", "v1")), now(), erase).collect()] == ["SUCCEEDED"]
    assert seen == [([("a", "v1")], [("g3",)], 12)]  # the pointer was gone, nothing else
    assert left(spark, root) == GONE
    version = Z.current(spark, root).version
    assert [r.state for r in L.collect_versions(spark, root, candidates(spark, ("a", "v1")), now(), erase).collect()] == ["SUCCEEDED"]
    assert seen[1:] == [([], [("g3",)], 6)] and left(spark, root) == GONE and Z.current(spark, root).version > version


def test_a_failure_stops_its_own_job_only(spark, root):
    made(spark, root)
    away = lambda jobs: jobs.filter("version = 'v1' and package = 'a'").select("job", F.lit("index away").alias("error"))
    got = {(r.package, r.version): (r.state, r.error) for r in L.collect_versions(spark, root, candidates(spark, ("a", "v1"), ("b", "v1")), now(), away).collect()}
    assert got == {("a", "v1"): ("FAILED", "index away"), ("b", "v1"): ("SUCCEEDED", None)}
    assert states(spark, root) == {"g1": "SUPERSEDED", "g2": "SUPERSEDED", "g3": "ACTIVE"}  # retired, not deleted
    assert [r.state for r in L.collect_versions(spark, root, candidates(spark, ("a", "v1")), now()).collect()] == ["SUCCEEDED"]
    assert set(states(spark, root)) == {"g3"}


@pytest.mark.parametrize("stop", [1, 2, 3, 4])
def test_a_run_that_dies_between_steps_ends_the_same(spark, root, monkeypatch, stop):
    made(spark, root)
    calls, inner = [], L.commit

    class Killed(BaseException):
        pass

    def dying(*args):
        calls.append(1)
        if len(calls) > stop:
            raise Killed
        return inner(*args)

    with monkeypatch.context() as m:
        m.setattr(L, "commit", dying)
        with pytest.raises(Killed):
            L.collect_versions(spark, root, candidates(spark, ("a", "v1")), now())
    assert [r.state for r in Z.view(spark, root).table("jobs").collect()] == ["RUNNING"]
    L.collect_versions(spark, root, candidates(spark, ("a", "v1")), now())
    assert left(spark, root) == GONE and [r.state for r in Z.view(spark, root).table("jobs").collect()] == ["SUCCEEDED"]


def test_a_step_that_raises_fails_all_that_is_left(spark, root):
    made(spark, root)

    def erase(jobs):
        raise OSError("no route")

    got = L.collect_versions(spark, root, candidates(spark, ("a", "v1")), now(), erase).collect()
    assert [(r.state, r.error) for r in got] == [("FAILED", "erase: no route")] and Z.view(spark, root).table("chunks").count() == 12


def test_single_generations_leave_references_and_pointers(spark, root):
    made(spark, root)
    got = L.collect_generations(spark, root, "gc_superseded", spark.createDataFrame([("g2",), ("g9",)], "id string"), now())
    assert rows(got.select("generation", "state")) == [("g2", "SUCCEEDED"), ("g9", "SUCCEEDED")]
    v = Z.view(spark, root)
    assert set(states(spark, root)) == {"g1", "g3", "g4"} and v.table("references").count() == 6 and v.table("pointers").count() == 2 and v.table("chunks").count() == 9
