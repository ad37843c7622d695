"""Toxicity by multiple-instance learning over sentences.

A sentence's probability is a logistic score of its distinct words, each by itself
and by its beginnings (of 4 to 8 bytes), so that inflected forms share what is learned; a document is toxic if any of its sentences is: noisy-or, 1 - prod(1 - p). Only documents have labels,
and the gradient of the noisy-or spreads them over sentences, so the offending
ones can be located afterwards.

The model is fitted on a bounded sample of labelled documents (``per_class`` of each
label at most, weighed by how often the label occurs), with the words that occur in
``min_docs`` of them. Of a longer document ``max_bytes`` are learned from, from a place given
by its hash, and none if it is toxic, as the offending sentence may lie elsewhere; all
documents together have ``max_features`` features. Tasks make these; the driver gets
numbers only.

Null and empty texts have no sentence and score what the bias alone gives. Each row
is scored by itself, from its whole text; other columns pass through, except one of the
result's name, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm._shared import as_bytes, chunks, collected_within, free_name, labelled_sample, small_batches

_SENTENCE = re.compile(rb"[.!?\n]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 or 48 <= b <= 57 else 46 if b in b".!?\n" else 32 for b in range(256))
#: Features are hashed to so many bits.
BITS = 22


#: Words that a task remembers.
KNOWN_WORDS = 500_000


def word_features(word: bytes) -> list[int]:
    """The feature numbers of a word: of itself and of its beginnings."""
    return [xxhash.xxh3_64_intdigest(x) & ((1 << BITS) - 1) for x in (word, *(word[:k] + b"-" for k in range(4, min(9, len(word)))))]


class Remembered(dict):
    """What a function says of a word, kept up to a bound."""

    def __init__(self, of_word):
        self.of_word = of_word

    def __missing__(self, word: bytes):
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = self.of_word(word)
        return value


def sentences(text: bytes) -> list[tuple[int, int]]:
    """(start, end) in bytes of the stretches between sentence ends that have a character."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def sentence_words(text: bytes, spans: list[tuple[int, int]]) -> list[set[bytes]]:
    folded = text.translate(_FOLD)
    return [set(folded[a:b].split()) for a, b in spans]


def fit(docs: list[list[np.ndarray]], labels: np.ndarray, weights: np.ndarray, min_docs: int = 4, rounds: int = 200, sparse: float = 2e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, their weights, bias) by proximal gradient steps on the noisy-or likelihood."""
    found = [np.unique(np.concatenate(d)) if d else np.zeros(0, np.int64) for d in docs]
    numbers, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    kept = numbers[counts >= min_docs]
    flat, of_sentence, of_doc, k = [], [], [], 0
    for d, sents in enumerate(docs):
        for s in sents or [np.zeros(0, np.int32)]:
            at = np.searchsorted(kept, s)
            ok = at < len(kept)
            ok[ok] = kept[at[ok]] == s[ok]
            flat.append(at[ok].astype(np.int32))
            of_sentence.append(np.full(int(ok.sum()), k, np.int32))
            of_doc.append(d)
            k += 1
    flat, of_sentence, of_doc = np.concatenate(flat), np.concatenate(of_sentence), np.array(of_doc)
    share = weights / weights.sum()
    w, bias = np.zeros(len(kept)), -4.0
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(of_sentence, w[flat], k) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(of_doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(docs)))
        whole = np.maximum(1 - none, 1e-9)
        # d log-likelihood / dz of each sentence
        g = share[of_doc] * np.where(labels[of_doc] == 1, (none / whole)[of_doc] * p, -p)
        grad = np.concatenate((np.bincount(flat, g[of_sentence], len(kept)), [g.sum()]))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        scale = np.sqrt(v / (1 - 0.99**step)) + 1e-6
        move = 0.1 * (m / (1 - 0.9**step)) / scale
        w, bias = w + move[:-1], bias + float(move[-1])
        limit = 0.1 * sparse / scale[:-1]  # soft threshold: rare words end at 0
        w = np.sign(w) * np.maximum(np.abs(w) - limit, 0)
    used = w != 0
    return kept[used], w[used], bias


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 2000, max_bytes: int = 64_000, max_features: int = 12_000_000, id_col: str = "doc_id", text_col: str = "text"
) -> dict | None:
    """The fitted model, from a sample of ``per_class`` documents of each label at most; None without both labels."""
    sample, totals = labelled_sample(docs, labels, label, per_class, id_col, text_col)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(word_features)
        for batch in batches:
            rows, marks = [], []
            for text, mark in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                if len(text) > max_bytes:
                    if mark:
                        continue
                    at = xxhash.xxh3_64_intdigest(text) % (len(text) - max_bytes + 1)
                    text = text[at : at + max_bytes]
                marks.append(mark)
                found = [[n for w in sorted(s) for n in known[w]] for s in sentence_words(text, sentences(text))]
                parts = np.concatenate([np.concatenate(([len(f)], f)) for f in found]) if found else np.zeros(0)
                rows.append(parts.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(marks, pa.int32()), pa.array([len(r) // 4 for r in rows], pa.int64())], ["f", "label", "size"])

    rows = collected_within(sample.mapInArrow(features, "f binary, label int, size long"), "f", max_features)
    if {r.label for r in rows} != {0, 1}:
        return None
    read = []
    for r in rows:
        flat, at, doc = np.frombuffer(r.f, np.int32), 0, []
        while at < len(flat):
            doc.append(flat[at + 1 : at + 1 + flat[at]])
            at += 1 + flat[at]
        read.append(doc)
    y = np.array([r.label for r in rows])
    weights = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    kept, w, bias = fit(read, y, weights)
    return {"features": kept, "weights": w, "bias": bias}


def score_toxicity(docs: DataFrame, model: dict | None, text_col: str = "text", result_col: str = "toxicity", locate: float | None = None) -> DataFrame:
    """``docs`` with a score; with ``locate`` also the sentences of that probability at least.

    Sentences have start and end in code points and their probability. Without a model the score is 0.
    """
    kind = pa.struct([("score", pa.float64()), ("sentences", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))])

    @F.arrow_udf("struct<score: double, sentences: array<struct<start: bigint, end: bigint, p: double>>>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = np.zeros(1 << BITS, np.float32)
        if model is not None:
            table[model["features"]] = model["weights"]
        known = Remembered(lambda word: float(table[word_features(word)].sum()))
        for batch in batches:
            rows: list[dict] = []
            for part in chunks(batch):
                for text in as_bytes(part):
                    spans = sentences(text) if model is not None else []
                    z = np.array([sum(known[w] for w in s) for s in sentence_words(text, spans)] or [0.0])
                    p = 1 / (1 + np.exp(-np.clip(z + model["bias"], -30, 30))) if model is not None else np.zeros(1)
                    bad = []
                    for (a, b), q in zip(spans, p.tolist()) if locate is not None else ():
                        if q >= locate:
                            bad.append({"start": len(text[:a].decode("utf-8", "replace")), "end": len(text[:b].decode("utf-8", "replace")), "p": q})
                    rows.append({"score": float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), "sentences": bad})
            yield pa.array(rows, kind)

    whole = free_name(docs, "whole_text")
    return small_batches(docs).withColumn(whole, F.col(text_col).cast("string")).withColumn(result_col, score(F.col(whole))).drop(whole)
