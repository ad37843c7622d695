"""Joins of hits, chunks, objects and pointers, and the modes of a search, on literal inputs."""

from __future__ import annotations

import pytest

from quirework.operators import provenance as P
from quirework.operators import retrieval as R
from quirework.plans import reconcile


@pytest.fixture(scope="module")
def world(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return {
        "projects": make([("p",)], "project string"),
        "dependencies": make([("p", 0, "go", "a", "1"), ("p", 1, "go", "b", "1"), ("p", 2, "node", "a", "7")], "project string, ordinal int, ecosystem string, package string, version string"),
        "references": make([("go", "a", "1", 5), ("go", "a", "2", 9), ("node", "a", "7", 1), ("go", "b", "1", 2), ("go", "c", "3", 3)], "ecosystem string, package string, version string, last_seen int"),
        "pointers": make([("go", "a", "1", "g1"), ("go", "a", "2", "g2"), ("node", "a", "7", "g7"), ("go", "c", "3", "g9")], "ecosystem string, package string, version string, generation string"),
    }


def test_scopes_of_each_mode(spark, world):
    """The reference recorded as the latest counts, not the one seen last: of several the first by key."""
    references = spark.createDataFrame(
        [("go", "a", "2", "p", "latest", "2024-01-01"), ("go", "a", "9", "p", "project", "2025-01-01"), ("node", "a", "7", "p", "latest", "2026-01-01"), ("go", "b", "3", "q", "latest", "2024-01-01"), ("go", "c", "1", "p", "project", "2024-01-01"), ("go", "a", "1", "q", "project", "2023-01-01")],
        "ecosystem string, package string, version string, project string, reason string, last_seen string",
    )
    asked = spark.createDataFrame(
        [(1, "project", "p", "a"), (2, "project", "x", "a"), (3, "project", "p", "zz"), (4, "project", "p", "b"), (5, "latest", None, "a"), (6, "latest", None, "b"), (7, "latest", None, "zz"),
         (8, "compare", "p", "a"), (9, "compare", "x", "a"), (10, "compare", "x", "b"), (11, "all-retained", None, "a"), (12, "all-retained", None, "zz"), (13, "all-retained", None, "b"), (14, "project", "p", None), (15, "latest", None, "c")],
        "query_id int, mode string, project string, package string",
    )
    got = {}
    for r in P.search_scopes(asked, world["projects"], world["dependencies"], references, world["pointers"]).collect():
        got.setdefault(r.query_id, set()).add((r.generation, r.error))
    assert got == {
        1: {("g1", None)}, 2: {(None, P.NO_PROJECT)}, 3: {(None, P.NO_DEPENDENCY)}, 4: {(None, P.NO_GENERATION)}, 5: {("g2", None)}, 6: {(None, P.NO_GENERATION)}, 7: {(None, P.NO_DEPENDENCY)},
        8: {("g1", None), ("g2", None)}, 9: {("g2", None)}, 10: {(None, f"compare: project search: {P.NO_PROJECT}; latest search: {P.NO_GENERATION}")}, 11: {("g1", None), ("g2", None), ("g7", None)}, 12: {(None, P.NO_DEPENDENCY)}, 14: {(None, P.NO_DEPENDENCY)}, 15: {(None, P.NO_DEPENDENCY)},
    }  # fmt: skip  # 13: referred to, nothing active: an empty result and no error


def test_origins_and_current_sources(spark):
    chunks = spark.createDataFrame([("g", "c1", "o1"), ("g", "c2", "o2"), ("g", "c3", "gone")], "generation string, chunk_id string, object_id string")
    objects = spark.createDataFrame([("o1", "s1", "uri", "git", "a.md", "low", "1"), ("o2", "s2", "uri2", "git", "b.md", "low", "1")], "object_id string, source_id string, source_uri string, source_type string, logical_path string, authority string, version string")
    assert sorted((r.chunk_id, r.source_uri, r.logical_path, r.version, r.generation) for r in P.origins(chunks, objects).collect()) == [("c1", "uri", "a.md", "1", "g"), ("c2", "uri2", "b.md", "1", "g")]
    sources = spark.createDataFrame([("s1", "website", None)], "source_id string, source_type string, authority string")
    assert sorted((r.chunk_id, r.source_type, r.authority) for r in P.current_sources(chunks, objects, sources).collect()) == [("c1", "website", None), ("c2", "git", "low")]


def test_hits_without_a_chunk_are_dropped(spark):
    hits = spark.createDataFrame([(1, "g", "c1"), (1, "g", "c2"), (1, "h", "c1")], "query_id int, generation string, id string")
    chunks = spark.createDataFrame([("g", "c1", "text")], "generation string, id string, content string")
    assert [(r.query_id, r.generation, r.content) for r in R.attach(hits, chunks, ["generation", "id"]).collect()] == [(1, "g", "text")]


def test_symbols_take_the_first_dependency(spark, world):
    symbols = spark.createDataFrame([("p", "a", ""), ("p", "a", "node"), ("p", "a", None), ("p", "a", "python"), ("p", "zz", ""), ("q", "a", "")], "project string, module string, ecosystem string")
    got = sorted((r.project, r.module, r.ecosystem or "", r.version or "-") for r in P.dependencies_of_symbols(symbols, world["dependencies"]).collect())
    assert got == [("p", "a", "", "1"), ("p", "a", "", "1"), ("p", "a", "node", "7"), ("p", "a", "python", "-"), ("p", "zz", "", "-"), ("q", "a", "", "-")]


def test_release_changes(spark, world):
    asked = spark.createDataFrame([(1, "a", "1", "2"), (2, "a", "1", "8"), (3, "zz", "1", "2"), (4, "b", "1", "2"), (5, "a", "6", "7")], "query_id int, package string, from_version string, to_version string")
    chunks = spark.createDataFrame(
        [("g1", "release_note", "1", "one in g1"), ("g2", "release_note", "1", "one"), ("g2", "release_note", "2", "two"), ("g2", "release_note", "0", "zero"), ("g2", "markdown", "2", "text"), ("g7", "release_note", "7", "seven")],
        "generation string, content_type string, release_version string, content string",
    )
    got = sorted((r.query_id, r.ecosystem or "", r.version or "", r.excerpt or "", r.error or "") for r in P.release_changes(asked, world["references"], world["pointers"], chunks).collect())
    assert got == [(1, "go", "1", "one", ""), (1, "go", "2", "two", ""), (2, "go", "1", "one in g1", ""), (3, "", "", "", P.NO_DEPENDENCY), (5, "node", "7", "seven", "")]


def test_described_packages(spark, world):
    generations = spark.createDataFrame([("g1", 5), ("g2", 3), ("g7", 1)], "id string, updated_at int")
    matches = spark.createDataFrame([("go", "a", "alias-a")], "ecosystem string, package string, alias string")
    manifests = spark.createDataFrame([("g1", 10, 4, 1)], "generation string, chunk_count int, object_count int, reused_count int")
    replicas = spark.createDataFrame([("g1", "READY", 10)], "generation string, status string, point_count int")
    rows = P.described(world["references"], matches, world["pointers"], generations, manifests, replicas).collect()
    got = {(r.ecosystem, r.package): (r.alias, r.active_version, r.other_versions, r.chunk_count, r.status) for r in rows}
    assert got == {("go", "a"): ("alias-a", "1", ["2"], 10, "READY"), ("node", "a"): (None, "7", [], None, "unknown"), ("go", "b"): (None, None, None, None, None), ("go", "c"): (None, None, None, None, None)}


def test_publish_moves_the_view_to_a_whole_version(spark, tmp_path):
    try:
        first = reconcile.publish(spark.range(3), str(tmp_path), "published_numbers")
        assert spark.table("published_numbers").count() == 3
        second = reconcile.publish(spark.range(5), str(tmp_path), "published_numbers")
        assert spark.table("published_numbers").count() == 5 and first != second
        assert spark.read.parquet(first).count() == 3
    finally:
        spark.sql("DROP VIEW IF EXISTS published_numbers")
