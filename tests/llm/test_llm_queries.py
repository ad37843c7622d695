"""The numbered queries: against SQL where there is some, held-out accuracy, the pipeline and empty tables."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from quirework.llm import mixing, near_dedup, queries, quality_rules, secret_scan
from quirework.llm._shared import only_known

TABLES = ("documents", "benchmark", "pages", "labels", "embeddings", "conversations")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(queries.SQL[name])
    names = [x[0] for x in want.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize(("name", "label", "least"), [("op7_quality_classifier", "quality", 0.8), ("op10_toxicity", "toxic", 0.8)])
def test_held_out_labels(spark, sf_dir, name, label, least):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", label)
    rows = queries.QUERIES[name](spark, sf_dir).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r[label] for r in rows) >= least * len(rows)


def test_filtering_operators_keep_clashing_columns(spark, sf_dir):
    """Columns that are called as what an operator adds pass through as they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "1 as quality", "2 as contamination", "3 as gone", "4 as copy", "5 as found", "6 as measured")
    for f in (quality_rules.keep_quality, near_dedup.near_deduplicate, secret_scan.redact_secrets):
        out = f(docs)
        assert out.columns == docs.columns and out.select("quality", "contamination", "gone", "copy", "found", "measured").distinct().collect() == [(1, 2, 3, 4, 5, 6)]
    assert mixing.mixed(docs).columns == [*docs.columns, "copy_"]


def test_only_known_keeps_all_known_keys(spark):
    rows, known = spark.range(10_000).withColumnRenamed("id", "k"), spark.range(0, 10_000, 500).withColumnRenamed("id", "k")
    left = {r.k for r in only_known(rows, "k", known).collect()}
    assert set(range(0, 10_000, 500)) <= left and len(left) < 100
    assert only_known(rows, "k", known.limit(0)).count() == 0


def test_pipeline_equals_its_operators(spark, sf_dir):
    """What each stage keeps is what brute force or its operator's own verdicts say."""
    from test_llm_operators import naive_base, naive_components, naive_contamination

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, text = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, sf_dir)
    kept = {r.doc_id for r in quality_rules.quality_rules(docs, result_col="q").filter("q.kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept and good.columns == columns
    single = stages["near_dedup"](spark, good, sf_dir)
    roots = naive_components([(i, text[i]) for i in kept], 5)
    kept = {i for i in kept if roots[i][1] == i}
    assert {r.doc_id for r in single.collect()} == kept and single.columns == columns
    clean = stages["benchmark_decontamination"](spark, single, sf_dir)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    suspects = {r.doc_id for r in single.collect()} - {r.doc_id for r in clean.collect()}
    assert all(naive_contamination(text[i], items)[1] for i in suspects) and clean.columns == columns
    some = sorted(kept - suspects)[:20]
    assert not any(naive_contamination(text[i][:4000], items)[1] for i in some)
    kept -= suspects
    safe = stages["secret_scan"](spark, clean, sf_dir)
    for r in safe.collect():
        assert not naive_base(r.text) and (r.text == text[r.doc_id] or "[SECRET]" in r.text)
    mix = stages["mix_sources"](spark, safe, sf_dir).collect()
    assert {r.doc_id for r in mix} <= kept
    assert {(r.doc_id, r.copy) for r in corpus_pipeline.run(spark, sf_dir).collect()} == {(r.doc_id, r.copy) for r in mix}
