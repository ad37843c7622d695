"""What tasks and the driver hold is bounded, whatever the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirework.llm import _shared, decontaminate, quality_crf, toxicity


def test_a_sample_is_collected_within_its_budget(spark):
    rows = spark.createDataFrame([(bytes([k]) * 10, k % 2, 10) for k in range(100)], "c binary, label int, size long")
    taken = _shared.collected_within(rows, "c", 200)
    assert [sum(r.label == x for r in taken) for x in (0, 1)] == [10, 10]
    assert taken == _shared.collected_within(rows.repartition(7), "c", 200)
    assert [sum(r.label == x for r in _shared.collected_within(rows, "c", 1)) for x in (0, 1)] == [1, 1]
    assert len(_shared.collected_within(rows, "c", 10**9)) == 100 and _shared.collected_within(rows.limit(0), "c", 9) == []


def test_broadcasts_are_dropped_one_by_one(spark):
    sent = [spark.sparkContext.broadcast([k] * 1000) for k in range(12)]

    def held(batches):
        for batch in batches:
            most = 0
            for _ in _shared.each_value(sent):
                most = max(most, sum("_value" in s.__dict__ for s in sent))
            again = [v[0] for v in _shared.each_value(sent)]
            yield batch.from_pydict({"most": [most], "again": [sum(again)]})

    assert [tuple(r) for r in spark.range(1, numPartitions=1).mapInArrow(held, "most long, again long").collect()] == [(1, 66)]


def test_twelve_blocks_find_what_one_finds(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    one, many = (decontaminate.find_contamination(docs, items, block_bytes=b, result_col="c").select("doc_id", "c.n_words", "c.n_hit", "c.item_ids").orderBy("doc_id").collect() for b in (16 << 20, size // 12))
    assert one == many and any(r.n_hit for r in one)


def test_long_documents_are_learned_from_within_bounds(spark):
    """Texts of 300 kB: a tenth of a percent of their features come to the driver, and the model still tells them apart."""
    good = [(k, f"alpha beta {k}. " * 20_000) for k in range(0, 40)]
    bad = [(100 + k, f"gamma {k}. vile rotten words. alpha beta. ") for k in range(40)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100), int(i < 100)) for i, _ in good + bad], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels, max_bytes=2000, max_features=60_000)
    scores = {r.doc_id: r.t.score for r in toxicity.score_toxicity(docs, model, result_col="t").collect()}
    assert min(scores[i] for i, _ in bad) > max(scores[i] for i, _ in good)
    field = quality_crf.train(docs, labels, max_lines=50, all_lines=60)
    assert field is not None
