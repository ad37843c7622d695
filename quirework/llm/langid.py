"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds those of
its letters, each permuted by its place (rolled, then multiplied). A text bundles
(adds) the vectors of its trigrams, a language those of all its training texts, and
a text gets the language whose prototype has the highest cosine.

Prototypes are exact sums of integers, gathered per task and added up by language
and dimension, so they cover all training rows and don't depend on their order.

Texts that are null or have no letter get ``und`` and score 0, as do all texts if
there is nothing to learn from. Of equally near languages the first by name is taken. Rows with a null language aren't learned from. Each
row counts, repeated or not, and texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm._shared import chunks, each_value, free_name, small_batches

#: Known trigrams (and letters) that a task keeps the vectors of, and trigrams that are summed at a time.
KEPT, SLICE = 24_000, 2048
#: Languages whose prototypes a task compares with at a time.
LANGUAGES = 1024
_alpha: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _alpha


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of the lower-cased text and their counts; words are set off by 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    spots = np.concatenate(([0], np.where(_letters()[points], points, 0), [0]))
    spots = spots[np.concatenate(([True], (spots[1:] != 0) | (spots[:-1] != 0)))]
    if len(spots) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = (spots[:-2] << 42) | (spots[1:-1] << 21) | spots[2:]
    return np.unique(grams[spots[1:-1] != 0], return_counts=True)


class GramVectors:
    """The vectors of trigrams; known ones are kept up to KEPT, others are made anew, SLICE at a time."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.grams, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64)  # sorted, and where each one's vector is
        self.vectors = np.zeros((KEPT, self.dimensions), np.float32)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) >= KEPT:
                self.letters.clear()
            bits = np.random.Generator(np.random.Philox(key=[self.seed, point])).integers(0, 2, self.dimensions)
            self.letters[point] = (2 * bits - 1).astype(np.float32)
        return self.letters[point]

    def make(self, grams: np.ndarray) -> np.ndarray:
        """The vector of each trigram: its letters', rolled by their place and multiplied."""
        vectors = np.ones((len(grams), self.dimensions), np.float32)
        for place, shift in ((2, 42), (1, 21), (0, 0)):
            points, at = np.unique((grams >> shift) & 0x1FFFFF, return_inverse=True)
            vectors *= np.array([np.roll(self.letter(p), place) for p in points.tolist()])[at]
        return vectors

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the vectors of distinct, sorted ``grams``, times their counts; whole numbers, so exact."""
        new = np.setdiff1d(grams, self.grams, assume_unique=True)
        if len(self.grams) + len(new) > KEPT and len(new) <= KEPT // 2:
            self.forget()
            new = grams[:KEPT]
        if len(self.grams) + len(new) <= KEPT and len(new):
            rows = len(self.grams) + np.arange(len(new))
            for k in range(0, len(new), SLICE):
                self.vectors[rows[k : k + SLICE]] = self.make(new[k : k + SLICE])
            known, where = np.concatenate((self.grams, new)), np.concatenate((self.rows, rows))
            order = np.argsort(known)
            self.grams, self.rows = known[order], where[order]
        total = np.zeros(self.dimensions)
        for k in range(0, len(grams), SLICE):
            part, times = grams[k : k + SLICE], counts[k : k + SLICE].astype(np.float32)
            at = np.minimum(np.searchsorted(self.grams, part), max(0, len(self.grams) - 1))
            known = self.grams[at] == part if len(self.grams) else np.zeros(len(part), bool)
            if known.any():
                total += times[known] @ self.vectors[self.rows[at[known]]]
            if not known.all():
                total += times[~known] @ self.make(part[~known])
        return total


def language_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = 1024, seed: int = 42) -> tuple[list[str], np.ndarray]:
    """The languages of ``docs`` and a prototype of each: one row of ``dimensions`` numbers a language comes to the driver."""

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = GramVectors(dimensions, seed), {}
        for batch in batches:
            langs, at = batch.column(0).to_pylist(), 0
            for part in chunks(batch.column(1)):
                by_lang: dict[str, list] = {}
                for text in part.to_pylist():
                    by_lang.setdefault(langs[at], []).append(trigrams(text or ""))
                    at += 1
                for lang, pairs in by_lang.items():
                    grams, place = np.unique(np.concatenate([g for g, _ in pairs]), return_inverse=True)
                    counts = np.bincount(place, np.concatenate([c for _, c in pairs]), len(grams))
                    total[lang] = total.get(lang, 0) + np.rint(known.bundle(grams, counts)).astype(np.int64)
                    if len(total) > LANGUAGES:
                        yield from out(total)
                        total = {}
        yield from out(total)

    def out(total: dict) -> Iterator[pa.RecordBatch]:
        for lang, vector in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dimensions, "at": np.arange(dimensions, dtype=np.int32), "n": np.broadcast_to(vector, dimensions)})

    rows = small_batches(docs).filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sums = rows.mapInArrow(bundles, "lang string, at int, n bigint").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    vectors = sums.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("v"))  # one vector a language
    langs, prototypes = [], []
    for r in vectors.orderBy("lang").toLocalIterator():
        langs.append(r.lang)
        prototypes.append(np.array(r.v, np.float64))
    return langs, np.array(prototypes).reshape(len(langs), dimensions)


def identify_languages(docs: DataFrame, langs: list[str], prototypes: np.ndarray, text_col: str = "text", seed: int = 42, result_col: str = "language") -> DataFrame:
    """``docs`` with a struct: lang and score, the cosine with its prototype (0 at least); of equal ones the first by name.

    A column of that name is replaced.
    """
    dimensions = prototypes.shape[1]
    units = (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    blocks = [docs.sparkSession.sparkContext.broadcast(units[k : k + LANGUAGES]) for k in range(0, len(langs), LANGUAGES)]

    @F.arrow_udf("struct<lang: string, score: double>")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = GramVectors(dimensions, seed)
        for batch in batches:
            names, scores = [], []
            for part in chunks(batch):
                found = [trigrams(t or "") for t in part.to_pylist()]
                vectors = np.zeros((len(found), dimensions), np.float32)
                for k, (grams, counts) in enumerate(found):
                    if len(grams) and langs:
                        vector = known.bundle(grams, counts)
                        vectors[k] = vector / max(np.linalg.norm(vector), 1e-12)
                best, score = np.full(len(found), -1), np.full(len(found), -np.inf)
                for n, block in enumerate(each_value(blocks)):
                    cosine = vectors @ block.T
                    at = cosine.argmax(axis=1)
                    top = cosine[np.arange(len(found)), at]
                    better = top > score
                    best[better], score[better] = at[better] + n * LANGUAGES, top[better]
                for k, (grams, _) in enumerate(found):
                    sure = len(grams) and langs
                    names.append(langs[best[k]] if sure else "und")
                    scores.append(float(min(1.0, max(0.0, score[k]))) if sure else 0.0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    text = free_name(docs, "whole_text")
    return small_batches(docs).withColumn(text, F.col(text_col).cast("string")).withColumn(result_col, identify(F.col(text))).drop(text)
