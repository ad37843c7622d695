"""Right answers of questions: chunks by id, by symbol or by a phrase that they hold.

Phrases are looked for by an automaton: a block of them, of bounded size, is sent to the
tasks, and each chunk's text is read once a block, however many phrases there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.session import stored


def _containing(sent: Broadcast):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for phrase in sent.value:
            automaton.add_word(phrase, phrase)
        automaton.make_automaton()
        for batch in batches:
            where, what = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                held = {phrase for _, phrase in automaton.iter(text)} if text else ()
                where += [k] * len(held)
                what += held
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), pa.array(what, pa.string())], ["at", "phrase"])

    return found


def holders(texts: DataFrame, phrases: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """(at, phrase): every pair of a text (at, text) and a phrase (phrase) that it holds, letter by letter. Empty phrases and null ones are in none."""
    spark = texts.sparkSession
    every = stored(phrases.select("phrase").filter("phrase <> ''").distinct(), "phrases")
    total = every.agg(F.sum(F.octet_length("phrase") + 64)).first()[0] or 0
    parts = max(1, -(-int(total) // block_bytes))
    kind = f"at {texts.schema['at'].dataType.simpleString()}, phrase string"
    out = spark.createDataFrame([], kind)
    for part in range(parts):
        block = [r.phrase for r in every.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part).toLocalIterator()]
        if block:
            out = out.unionByName(texts.select("at", F.col("text").cast("string").alias("text")).mapInArrow(_containing(spark.sparkContext.broadcast(block)), kind))
    return out


def right_answers(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, id): the chunks of a question's dependency that are right.

    ``questions``: query_id, dependency, ids, symbols and contains (arrays); ``chunks``:
    dependency, id, package, symbol, text. A symbol is named alone or after its package; an
    empty phrase is in every text.
    """
    here = ["dependency", "id"]
    by_id = questions.select("query_id", "dependency", F.explode("ids").alias("id")).join(chunks.select(*here), here)
    named = chunks.filter(F.coalesce("symbol", F.lit("")) != "")
    names = F.array("symbol", F.concat(F.coalesce("package", F.lit("")), F.lit("."), "symbol"))
    by_symbol = questions.select("query_id", "dependency", F.explode("symbols").alias("name")).join(named.select(*here, F.explode(names).alias("name")), ["dependency", "name"])
    asked = questions.select("query_id", "dependency", F.explode("contains").alias("phrase"))
    known = chunks.join(questions.select("dependency").distinct(), "dependency", "left_semi")
    held = holders(known.select(F.struct(*here).alias("at"), "text"), asked).select("at.dependency", "at.id", "phrase")
    by_phrase = asked.join(held, ["dependency", "phrase"])
    empty = asked.filter("phrase = ''").join(chunks.select(*here), "dependency")
    parts = [p.select("query_id", "id") for p in (by_id, by_symbol, by_phrase, empty)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct()


def unanswerable(questions: DataFrame, right: DataFrame) -> DataFrame:
    """The questions that no chunk answers: any would count as a miss for every method."""
    return questions.join(right.select("query_id").distinct(), "query_id", "left_anti")


def answer_kind(questions: DataFrame, right: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, answer): ``API doc`` where a right chunk has a symbol, else ``prose``."""
    api: Column = F.coalesce("symbol", F.lit("")) != ""
    by = right.join(chunks.select("id", "symbol"), "id").groupBy("query_id").agg(F.max(api).alias("api"))
    return questions.select("query_id").join(by, "query_id", "left").select("query_id", F.when(F.coalesce("api", F.lit(False)), "API doc").otherwise("prose").alias("answer"))
