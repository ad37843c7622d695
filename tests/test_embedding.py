"""Model calls in batches, what a switch of models does, and small checks over tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import embedding as M
from quirework.operators import evaluation as E
from quirework.plans import validation as V


def test_texts_go_to_the_model_in_batches(spark):
    df = spark.createDataFrame([(f"k{n}", None if n == 5 else "x" * n) for n in range(150)], "key string, text string").coalesce(1)
    made = M.embedded(df, lambda texts: [[float(len(t)), float(len(texts))] for t in texts], 2).collect()
    assert {r.key: r.vector[0] for r in made} == {f"k{n}": 0.0 if n == 5 else float(n) for n in range(150)}
    assert sorted({r.vector[1] for r in made}) == [22.0, 64.0]
    for bad in (lambda texts: [[0.0, 0.0]], lambda texts: [[0.0]] * len(texts)):
        with pytest.raises(Exception, match="the model returned"):
            M.embedded(df, bad, 2).collect()


def test_only_what_is_missing_is_embedded(spark):
    pointers = spark.createDataFrame([(g,) for g in ("old", "new", "lost", "none", "bare")], "generation string")
    replicas = spark.createDataFrame([("old", "m1"), ("new", "m2"), ("lost", "m2"), ("none", None)], "generation string, embedding_model string")
    points = spark.createDataFrame([("old",), ("new",), ("none",)], "generation string")
    plan = M.embedding_plan(pointers, replicas, points, "m2")
    assert sorted(map(tuple, plan.collect())) == [("bare", False, False), ("lost", False, True), ("new", False, False), ("none", False, True), ("old", True, True)]
    chunks = spark.createDataFrame([(g, t) for g in ("old", "new", "lost") for t in ("same", g)], "generation string, text string")
    cache = chunks.filter("text = 'lost'").select(M.cache_key(F.col("text"), "p", "m2").alias("key"), F.array(F.lit(1.0)).alias("vector"))
    have, missing = M.to_embed(plan, chunks, cache, "p", "m2")
    assert [tuple(r)[:2] for r in have.select("generation", "text").collect()] == [("lost", "lost")]
    assert sorted(r.text for r in missing.collect()) == ["old", "same"]


def test_progress_of_runs(spark):
    rows = [("a", "done", float(s)) for s in range(1, 12)] + [("a", "failed", None), ("a", "pending", None), ("a", "pending", None), ("b", "pending", None), ("c", "done", 2.0)] + [("d", "done", 1.0)] * 30
    got = {r.run: r for r in E.sync_progress(spark.createDataFrame(rows, "run string, state string, seconds double")).collect()}
    a = got["a"]
    assert (a.done, a.failed, a.pending, a.total, a.median, a.p90, a.remaining, a.confidence) == (11, 1, 2, 14, 6.0, 10.0, 12.0, "medium")
    assert got["b"].remaining is None and got["b"].confidence == "low" and got["c"].confidence == "low" and got["d"].confidence == "high"


def test_named_dependencies_and_invalid_objects(spark):
    dependencies = spark.createDataFrame([("a", 1), ("b", 2)], "package string, n int")
    names = spark.createDataFrame([("b",), ("b",), ("z",)], "package string")
    assert [r.n for r in V.named(dependencies, names).collect()] == [2]
    assert V.named(dependencies, names.limit(0)).count() == 2 and V.named(dependencies, None).count() == 2
    objects = spark.createDataFrame([(1, "u", "t"), (2, "", "t"), (3, None, None)], "id int, source_uri string, trust_class string")
    assert {r.id: r.failures for r in V.invalid_objects(objects).collect()} == {2: ["no source"], 3: ["no source", "no trust class"]}
    points = spark.createDataFrame([("g", "v1"), ("g", "v1"), ("h", "v1"), ("h", None)], "g string, v string")
    assert [r.g for r in V.consistent_metadata(points, "g", ["v"]).collect()] == ["h"]


def test_package_names_and_trust(spark):
    row = spark.range(1).select(T.plain_package_name(F.lit("__A.b--C_")).alias("n"), T.trust_class(F.lit("godoc")).alias("t"), T.trust_class(F.lit(None).cast("string")).alias("u")).first()
    assert tuple(row) == ("a-b-c", "repository", "unknown")
