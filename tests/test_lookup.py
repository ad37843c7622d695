"""Call sites, right answers, inverted lists and joins with hot keys, against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.operators import callsites as K
from quirework.operators import documents as D
from quirework.operators import evaluation as E
from quirework.operators import gold as G
from quirework.operators import retrieval as R
from quirework.operators import vectors as I

USES = "use_id int, file string, line int, column int, end_line int, end_column int"
SITES = "site_id int, file string, line int, column int"


def naive_innermost(sites, uses):
    out = {}
    for s, file, line, column in sites:
        around = [((el - ln, ec - c) if False else (el * K.COLUMNS + ec) - (ln * K.COLUMNS + c), -(ln * K.COLUMNS + c), u) for u, f, ln, c, el, ec in uses if f == file and file is not None and (ln, c) <= (line, column) < (el, ec)]
        if around:
            out[s] = min(around)[2]
    return out


def test_sites_find_the_innermost_use(spark):
    """Nested, overlapping, empty and equal ranges; ranges over many lines and within one."""
    rng = random.Random(1)
    uses = []
    for u in range(400):
        line, column = rng.randrange(60), rng.randrange(40)
        kind = rng.randrange(4)
        end = (line, column + rng.randrange(30)) if kind == 0 else (line + rng.randrange(3), rng.randrange(60)) if kind == 1 else (line + rng.randrange(50_000), 0) if kind == 2 else (line, column)
        uses.append((u, rng.choice(["a", "b", None]), line, column, *end))
    uses += [(1000 + k, *uses[k][1:]) for k in range(20)]
    sites = [(s, rng.choice(["a", "b", "c", None]), rng.randrange(70), rng.randrange(50)) for s in range(500)] + [(900 + k, "a", 30, 20) for k in range(90)]
    got = {r.site_id: r.use_id for r in K.innermost(spark.createDataFrame(sites, SITES).repartition(3), spark.createDataFrame(uses, USES).repartition(3)).collect()}
    assert got == naive_innermost(sites, uses) and len(got) > 300


def test_one_file_of_many_nested_uses(spark):
    """Of 200,000 ranges in one line and around it each site meets a few: those of all levels."""
    n = 100_000
    uses = spark.range(n).select(F.col("id").cast("int").alias("use_id"), F.lit("f").alias("file"), F.lit(7).alias("line"), (F.col("id") * 8).cast("int").alias("column"), F.lit(7).alias("end_line"), (F.col("id") * 8 + 6).cast("int").alias("end_column"))
    outer = spark.range(n).select((F.col("id") + n).cast("int").alias("use_id"), F.lit("f").alias("file"), F.col("id").cast("int").alias("line"), F.lit(0).alias("column"), (F.col("id") + 2).cast("int").alias("end_line"), F.lit(1).alias("end_column"))
    sites = spark.createDataFrame([(1, "f", 7, 80), (2, "f", 7, 86), (3, "f", 7, 87), (4, "f", 50_000, 5), (5, "f", n + 5, 0)], SITES)
    got = {r.site_id: r.use_id for r in K.innermost(sites, uses.unionByName(outer)).collect()}
    assert got == {1: 10, 2: n + 7, 3: n + 7, 4: n + 50_000}


def test_call_sites_name_what_to_search(spark):
    uses = spark.createDataFrame([(1, "f", 1, 0, 1, 9, "m", "go", "m.Do"), (2, "f", 2, 0, 2, 9, "", "", "inner"), (3, "f", 3, 0, 3, 9, "other", "", "other.X"), (4, "f", 4, 0, 4, 9, "late", "", "late.Y")], USES + ", module string, ecosystem string, symbol string")
    sites = spark.createDataFrame([(1, "f", 1, 3, "p", None), (2, "f", 1, 3, "p", "how"), (3, "f", 2, 3, "p", ""), (4, "f", 3, 3, "p", ""), (5, "f", 4, 3, "p", ""), (6, "f", 9, 3, "p", "")], SITES + ", project string, text string")
    dependencies = spark.createDataFrame([("p", 1, "go", "m", "v1"), ("p", 2, "go", "late", "v3"), ("q", 1, "go", "other", "v1")], "project string, ordinal int, ecosystem string, package string, version string")
    pointers = spark.createDataFrame([("go", "m", "v1", "g1")], "ecosystem string, package string, version string, generation string")
    got = {r.site_id: (r.package, r.version, r.generation, r.query_text, r.error) for r in K.resolved_sites(sites, uses, dependencies, pointers).collect()}
    assert got == {1: ("m", "v1", "g1", "m.Do", None), 2: ("m", "v1", "g1", "how", None), 4: ("other", None, None, "other.X", "dependency not found"), 5: ("late", "v3", None, "late.Y", "no active generation for this version")}


def test_right_answers_by_id_symbol_and_phrase(spark):
    rng = random.Random(3)
    words = ["ab", "bc", "cab", "a", "é", "b c"]
    chunks = [(rng.choice(["d1", "d2"]), k, rng.choice(["p", None]), rng.choice(["S", "T", "", None]), rng.choice([None, "", " ".join(rng.choice(words) for _ in range(5))])) for k in range(80)]
    questions = [(q, rng.choice(["d1", "d2", "d3"]), rng.sample(range(90), 2), rng.choice([[], ["S"], ["p.T", "x"]]), rng.choice([[], ["ab"], ["é b", "zz"], [""], ["cab a", "ab"]])) for q in range(30)]
    right = G.right_answers(spark.createDataFrame(questions, "query_id int, dependency string, ids array<int>, symbols array<string>, contains array<string>"), spark.createDataFrame(chunks, "dependency string, id int, package string, symbol string, text string").repartition(4))
    want = {(q, i) for q, dep, ids, symbols, phrases in questions for d, i, package, symbol, text in chunks if d == dep and (i in ids or symbol and (symbol in symbols or f"{package or ''}.{symbol}" in symbols) or any(p in (text or "") for p in phrases))}
    assert {tuple(r) for r in right.collect()} == want
    asked = spark.createDataFrame([(q,) for q in range(30)], "query_id int")
    assert {r.query_id for r in G.unanswerable(asked, right).collect()} == set(range(30)) - {q for q, _ in want}


def test_phrases_in_several_blocks(spark):
    texts = spark.createDataFrame([(k, f"x{k} y{k % 7} z") for k in range(50)], "at int, text string")
    phrases = spark.createDataFrame([(f"y{k}",) for k in range(7)] + [(f"x{k} ",) for k in range(50)] + [("",), (None,)], "phrase string")
    one, many = (sorted(map(tuple, G.holders(texts, phrases, b).collect())) for b in (1 << 20, 400))
    assert one == many and len(one) == 100


def test_tally_counts_lenient_ranks_apart(spark):
    ranks = spark.createDataFrame([("m", 1, 2, 1), ("m", 2, None, 3), ("m", 3, 11, 11), ("n", 1, 1, 1)], "method string, query_id int, right_rank int, lenient_rank int")
    groups = spark.createDataFrame([(1, "all"), (2, "all"), (3, "all"), (1, "g")], "query_id int, group string")
    got = {(r.method, r.group): tuple(r)[2:] for r in E.tallied(ranks, groups).collect()}
    assert got[("m", "all")] == (3, 0, 1, 1, 2, round(0.5 / 3, 6), round((1 + 1 / 3) / 3, 6)) and got[("n", "g")][:2] == (1, 1) and len(got) == 4


def test_bootstrap_interval_holds_the_difference_and_is_the_same_again(spark):
    rng = random.Random(4)
    rows = [(m, q, rng.choice([1, 2, 3, None]) if m == "a" else rng.choice([2, 5, None, None])) for q in range(200) for m in ("a", "b")]
    df = spark.createDataFrame(rows, "method string, query_id int, right_rank int")
    one, two = (E.paired_bootstrap(d, "a", "b", 300).first() for d in (df, df.repartition(7)))
    assert one == two and one.low < one.difference < one.high and one.low > 0
    by = {}
    for m, q, r in rows:
        by.setdefault(q, {})[m] = 1 / r if r else 0.0
    mean = sum(x["a"] - x["b"] for x in by.values()) / 200
    spread = math.sqrt(sum((x["a"] - x["b"] - mean) ** 2 for x in by.values())) / 200
    assert one.difference == pytest.approx(mean, abs=1e-6) and one.high - one.low == pytest.approx(2 * 1.96 * spread, rel=0.25)


def test_inverted_lists_reach_their_recall_and_all_lists_are_exact(spark, sf_dir, tmp_path):
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    points = points.unionByName(spark.createDataFrame([(10**6, None), (None, [1.0] * 64)], "id long, vector array<float>"))
    asked = points.filter("id % 10 = 0 and vector is not null").select(F.col("id").alias("query_id"), "vector")
    root = str(tmp_path / "lists")
    I.build_lists(spark, root, points)
    exact = {(r.query_id, r.rank): r.id for r in R.cosine(points, asked, 10).collect()}
    assert {(r.query_id, r.rank): r.id for r in I.search_lists(spark, root, asked, 10, probes=64).collect()} == exact
    near = {(r.query_id, r.id) for r in I.search_lists(spark, root, asked, 10).collect()}
    assert len(near & {(q, i) for (q, _), i in exact.items()}) >= 0.9 * len(exact)
    scanned = I.search_lists(spark, root, asked.limit(1), 10, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert scanned.count("part_=") <= 2  # one folder of 64
    empty = str(tmp_path / "empty")
    I.build_lists(spark, empty, points.limit(0))
    assert I.search_lists(spark, empty, asked, 10).count() == 0


def test_few_lists_find_clustered_points(spark, tmp_path):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    made = [(k, (centres[k % 12] + rng.normal(size=16) * 0.1).tolist()) for k in range(1200)]
    points, root = spark.createDataFrame(made, "id long, vector array<double>"), str(tmp_path / "lists")
    asked = points.filter("id % 40 = 0").select(F.col("id").alias("query_id"), "vector")
    I.build_lists(spark, root, points, lists=16)
    exact, near = ({(r.query_id, r.id) for r in df.collect()} for df in (R.cosine(points, asked, 10), I.search_lists(spark, root, asked, 10, probes=4)))
    assert len(near & exact) >= 0.95 * len(exact)


def test_quantizer_covers_its_sample():
    rng = np.random.default_rng(5)
    sample = rng.normal(size=(500, 8))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    assert I.fitted(sample, 20).shape == (20, 8) and I.fitted(sample[:3], 20).shape == (3, 8) and len(I.fitted(sample[:0], 5)) == 0
    assert len(I.fitted(np.repeat(sample[:2], 50, axis=0), 20)) == 2  # no centre twice


def test_text_ids_and_ties(spark):
    points = spark.createDataFrame([(i, [1.0, 0.0]) for i in ("b", "a", "é", "c")] + [("z", [0.0, 1.0]), (None, [1.0, 0.0])], "id string, vector array<double>")
    asked = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, vector array<double>")
    assert [(r.id, r["rank"]) for r in sorted(R.cosine(points, asked, 3).collect(), key=lambda r: r["rank"])] == [("a", 1), ("b", 2), ("c", 3)]


def test_reuse_with_known_contents_and_one_that_a_third_share(spark):
    rows = [(k, "shared" if k % 3 == 0 else f"t{k // 2}") for k in range(6000)] + [(9000, None), (9001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    known = docs.filter("text in ('t1', 'shared')").select(F.sha2("text", 256).alias("content_hash"), F.lit(77).cast("long").alias("object_id"))
    got = {r.doc_id: (r.object_id, r.reused) for r in D.reuse_content(docs, "doc_id", "text", [F.col("doc_id")], known).collect()}
    first = {}
    for k, t in rows:
        first.setdefault(t or "", k)
    assert got == {k: (77, True) if t in ("shared", "t1") else (first[t or ""], first[t or ""] != k) for k, t in rows}
