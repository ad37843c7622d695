"""Substring dedup by hashing units of lines: what an earlier document holds is removed.

Each text is cut into units at line ends and at the ends of sentences and clauses
(or, on request, at paragraphs alone). Units are normalised (A-Z lower-cased, white
space and ASCII marks squeezed). Each one begins a key: it and the units after it, up
to ``key_words`` words, hashed to 128 bits, so that a short phrase counts in its
surroundings only. Digests meet globally, and the earliest document by rank keeps
them all: in any later one the words under such keys are marked. Marked stretches of
``run_words`` words or more are removed, with the offsets of the original text in code
points; shorter ones stay, as common phrases are no copies.

Rank is (id, hash of the text), a null id last. Rows that repeat an id and its text are
one document, so neither loses to the other. What repeats within one document
only stays, unless ``within`` is set; then the first place keeps it. Letters of scripts
without blanks between words count as a word each. Null and empty texts have no units.
Texts are read whole; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm._shared import chunks, free_name, join_counted, maybe_known, only_known, small_batches, stored

_CUTS = {"line": re.compile(r"\n+|[.!?,;:]+[\"')\]]*[\x20\t\r]+|[。！？]+"), "paragraph": re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")}
#: Words are runs of a-z, digits and anything beyond ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_UNSPACED = re.compile("[฀-໿က-႟ក-៿ぁ-ヿ㐀-鿿豈-﫿]")


def units(text: str, unit: str) -> Iterator[tuple[int, int, bytes, int]]:
    """(start, end, normalised, words) of the units that have a word; the end is after the cut that follows."""
    at = 0
    plain = text.isascii()
    for end in [m.end() for m in _CUTS[unit].finditer(text)] + [len(text)]:
        words = text[at:end].encode("utf-8", "surrogatepass").translate(_FOLD).split()
        if words:
            yield at, end, b" ".join(words), len(words) + (0 if plain else len(_UNSPACED.findall(text, at, end)))
        at = end


def keys(text: str, unit: str, key_words: int) -> tuple[list, list, list, list, list]:
    """Columns of the keys: start, end, words before, words up to the end, digest."""
    found = list(units(text, unit))
    total = np.cumsum([0] + [u[3] for u in found])
    stops = np.searchsorted(total, total[:-1] + key_words)  # after the last unit of each key
    whole = int(np.searchsorted(stops, len(found), side="right"))  # later keys lack words
    stops = stops[:whole]
    return (
        [u[0] for u in found[:whole]],
        [found[k - 1][1] for k in stops.tolist()],
        total[:whole].tolist(),
        total[stops].tolist(),
        [xxhash.xxh3_128_digest(b" ".join([u[2] for u in found[k:stop]])) for k, stop in enumerate(stops.tolist())],
    )


def _runs(run_words: int):
    """The stretches of ``run_words`` words at least that marked keys (w0, w1, start, end; in order) make up."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))

    @F.arrow_udf("array<struct<start: int, end: int, words: int>>")
    def runs(marked: pa.Array) -> pa.Array:
        rows = []
        for row in marked.to_pylist():
            out, first, last, start, end = [], 0, -1, 0, 0
            for key in [*row, {"w0": 1 << 60, "w1": 0, "start": 0, "end": 0}]:
                if key["w0"] > last:
                    if last - first >= run_words:
                        out.append({"start": start, "end": end, "words": last - first})
                    first, last, start, end = key["w0"], key["w1"], key["start"], key["end"]
                elif key["w1"] > last:
                    last, end = key["w1"], key["end"]
            rows.append(out)
        return pa.array(rows, kind)

    return runs


def _again(found: DataFrame, within: bool) -> DataFrame:
    """The rows of ``found`` (doc, place, digest, ...) whose digest an earlier document has."""
    rank = F.struct("doc", "w0") if within else F.struct("doc")
    first = found.select("digest", rank.alias("r")).groupBy("digest").agg(F.min("r").alias("first"), F.max("r").alias("last"), F.count("*").alias("times"))
    first = stored(first.filter("first <> last").select("digest", "first", "times"), "first")
    rows = only_known(found.withColumn("r", rank), "digest", first)
    return join_counted(rows, first, "digest", found.count()).filter("r <> first").drop("r", "first", "digest")


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", key_words: int = 10, run_words: int = 40, within: bool = False) -> DataFrame:
    """(doc, removed) of the documents that lose something: a struct (last, id, text) and spans (start, end, words)."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("w0", pa.int32()), ("w1", pa.int32()), ("digest", pa.binary())]))

    @F.arrow_udf("array<struct<start: int, end: int, w0: int, w1: int, digest: binary>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = []
            for part in chunks(batch):
                columns, ends = ([], [], [], [], []), [0]
                for text in part.to_pylist():
                    for column, found in zip(columns, keys(text or "", unit, key_words)):
                        column += found
                    ends.append(len(columns[0]))
                flat = pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(columns, kind.value_type)], fields=list(kind.value_type))
                done.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
            yield pa.concat_arrays(done) if done else pa.array([], kind)

    text = F.col(text_col).cast("string")
    found = small_batches(docs).select(_document(id_col, text).alias("doc"), F.explode(cut(text)).alias("u")).select("doc", "u.*")
    again = _again(stored(found, "units"), within)
    marked = again.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("w0", "w1", "start", "end"))).alias("m"))  # at most the units of one text
    return marked.select("doc", _runs(run_words)("m").alias("removed")).filter(F.size("removed") > 0)


def _document(id_col: str, text: Column) -> Column:
    """What makes a document: its id, null last, and its text's hash."""
    return F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(text).alias("text"))


def dedup_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", result_col: str = "dedup", **options) -> DataFrame:
    """``docs`` with a struct in ``result_col``: the spans removed (start, end, words) and the text that is left.

    A column of that name is replaced. Only the texts that lose something are shuffled.
    """

    @F.arrow_udf("string")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, gone in zip(texts.to_pylist(), spans.to_pylist()):
            starts, ends = [0, *(s["end"] for s in gone)], [*(s["start"] for s in gone), len(text)]
            out.append("".join(text[a:b] for a, b in zip(starts, ends)))
        return pa.array(out, pa.string())

    text = F.col(text_col).cast("string")
    gone = stored(removed_spans(docs, id_col, text_col, **options), "gone")
    doc, spans = free_name(docs, "doc_key"), free_name(docs, "gone_spans")
    known = maybe_known(docs.withColumn(doc, _document(id_col, text)), doc, gone.select(F.col("doc").alias(doc)))
    none = F.array().cast("array<struct<start: int, end: int, words: int>>")
    columns = [c for c in docs.columns if c.lower() != result_col.lower()]
    same = known.filter("not known_").select(*[F.col(f"`{c}`") for c in columns], F.struct(none.alias("removed"), text.alias("text")).alias(result_col))
    joined = known.filter("known_").join(gone.select(F.col("doc").alias(doc), F.col("removed").alias(spans)), doc, "left")
    held = F.coalesce(spans, none)
    clean = F.when(F.size(held) > 0, without(text, held)).otherwise(text)
    return same.unionByName(joined.select(*[F.col(f"`{c}`") for c in columns], F.struct(held.alias("removed"), clean.alias("text")).alias(result_col)))
