"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are binned measures of its own characters
and words and of those of the lines before and after it; neighbouring labels are
linked by transition weights. Forward-backward gives the marginal of each line, and
the score of a document is the mean of the marginals of good, weighted by length.

The field is fitted on a bounded sample of labelled documents (``per_class`` of each
label and ``max_lines`` lines of each, at most), whose lines all carry the label of their document; documents count
by how often their label occurs. Features are gathered by tasks, and only they come to the driver.

Null and empty texts are one empty line and get a score like any other. Each row is
scored by itself, from its whole text; other columns pass through, except one of the
result's name, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm._shared import as_bytes, chunks, collected_within, free_name, labelled_sample, small_batches

_KINDS = 8
#: white space, a-z, A-Z, digit, sentence mark, bang, other symbol, beyond ASCII; 8 is none (within a character).
_KIND = np.array(
    [
        0 if b == 32 or 9 <= b <= 13 else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57
        else 4 if b in b".,;:?'\"()-" else 5 if b == 33 else 6 if b < 128 else 8 if b < 192 else 7
        for b in range(256)
    ],
    np.int64,
)
#: Measures of a line: log length, log words, shares of seven kinds, mean word length, distinct words, seen before.
MEASURES = 12
BINS = 8
#: A line looks at itself and its two neighbours.
FEATURES = 3 * MEASURES * (BINS + 1)


def line_measures(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(measures, characters) of each line of the text."""
    lines = text.split(b"\n")
    n = len(lines)
    raw = np.frombuffer(text, np.uint8)
    of_line = np.cumsum(raw == 10)
    kinds = np.bincount(of_line * (_KINDS + 1) + _KIND[raw], minlength=n * (_KINDS + 1)).reshape(n, _KINDS + 1)[:, :_KINDS].astype(np.float64)
    chars = kinds.sum(axis=1)
    split = [x.split() for x in lines]
    words = np.array([len(x) for x in split], np.float64)
    distinct = np.array([len(set(x)) for x in split], np.float64)
    seen: set[bytes] = set()
    again = np.zeros(n)
    for k, x in enumerate(lines):
        again[k] = x in seen
        seen.add(x)
    some = np.maximum(chars, 1)
    solid = np.maximum(words, 1)
    columns = [np.log1p(chars), np.log1p(words), *(kinds[:, 1:] / some[:, None]).T, (chars - kinds[:, 0]) / solid, np.where(words > 0, distinct / solid, 1), again]
    return np.stack(columns, axis=1), chars


def features(measures: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The numbers of the features that each line has: its bins, and those of its neighbours."""
    bins = np.stack([np.searchsorted(edges[k], measures[:, k], side="right") for k in range(MEASURES)], axis=1)
    outside = np.full((1, MEASURES), BINS)
    near = np.concatenate((bins, np.concatenate((outside, bins[:-1])), np.concatenate((bins[1:], outside))), axis=1)
    return (near + np.arange(3 * MEASURES) * (BINS + 1)).astype(np.int32)


def _scan(m: np.ndarray, longest: int) -> np.ndarray:
    """Products of the 2 x 2 matrices up to each place, each scaled by its largest entry, by doubling.

    A matrix whose rows are equal forgets what came before it, so texts follow one another.
    """
    m = m / m.max(axis=(0, 1))
    reach = 1
    while reach < longest:
        left, right = m[:, :, :-reach], m[:, :, reach:]
        product = np.empty_like(right)
        for a in (0, 1):
            for b in (0, 1):
                product[a, b] = left[a, 0] * right[0, b] + left[a, 1] * right[1, b]
        product /= product.max(axis=(0, 1))
        m = np.concatenate((m[:, :, :reach], product), axis=2)
        reach *= 2
    return m


def forward_backward(score: np.ndarray, sizes: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lines of texts of the ``sizes``, one after another: the probability of good, and those of each pair of labels.

    ``score`` is that of good against bad. Pairs are (label, label of the next line, line); of a last line they have no meaning.
    """
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2, 0))
    last = np.cumsum(sizes) - 1
    emit = np.exp(np.stack((np.minimum(0, -score), np.minimum(0, score))).clip(-60))  # the larger of the two is 1
    step = np.exp(transition - transition.max())[:, :, None] * emit[None]  # into each line
    start = step.copy()
    start[:, :, np.concatenate(([0], last[:-1] + 1))] = emit[None, :, np.concatenate(([0], last[:-1] + 1))]
    longest = int(sizes.max())
    forward = _scan(start, longest)[0]
    onward = np.concatenate((step[:, :, 1:], np.ones((2, 2, 1))), axis=2)  # out of each line
    onward[:, :, last] = 1
    # the same from the end: products from each line on are those of the transposed matrices, in reverse
    backward = _scan(onward.transpose(1, 0, 2)[:, :, ::-1], longest)[0, :, ::-1]
    both = forward * backward
    pairs = forward[:, None] * onward * np.concatenate((backward[:, 1:], backward[:, :1]), axis=1)[None]
    return both[1] / both.sum(axis=0), pairs / pairs.sum(axis=(0, 1))


def marginals(emission: list[np.ndarray], transition: np.ndarray) -> list[np.ndarray]:
    """The probability of good (label 1) for each line; emission is its score of good against bad."""
    if not emission:
        return []
    sizes = np.array([len(x) for x in emission])
    return np.split(forward_backward(np.concatenate(emission), sizes, transition)[0], np.cumsum(sizes)[:-1])


def gradient(flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the weighted mean log-likelihood a line, for the emission weights (the bias last) and the transition weights: observed less expected."""
    of_doc = np.repeat(np.arange(len(sizes)), sizes)
    # a document counts once, however many lines it has
    pull = (weights / weights.sum() / sizes)[of_doc]
    want = labels[of_doc]
    p, pairs = forward_backward(w[flat].sum(axis=1) + w[-1], sizes, t)
    off = pull * (want - p)
    g = np.bincount(flat.ravel(), np.repeat(off, flat.shape[1]), len(w))
    g[-1] += off.sum()
    inner = np.flatnonzero(of_doc[1:] == of_doc[:-1])
    gt = -(pairs[:, :, inner] * pull[inner]).sum(axis=2)
    for label in (0, 1):  # the labels of a document agree
        gt[label, label] += pull[inner][want[inner] == label].sum()
    return g, gt


def fit(lines: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, rounds: int = 120, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(emission weights with the bias last, transition weights) by gradient ascent on the weighted likelihood."""
    flat, sizes = np.concatenate(lines), np.array([len(x) for x in lines])
    w, t = np.zeros(FEATURES + 1), np.zeros((2, 2))
    m, v = np.zeros(FEATURES + 5), np.zeros(FEATURES + 5)
    for step in range(1, rounds + 1):
        g, gt = gradient(flat, sizes, labels, weights, w, t)
        g = np.concatenate((g - decay * w / len(w), (gt - 0.05 * t).ravel()))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, t = w + move[:-4], t + move[-4:].reshape(2, 2)
    return w, t


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, max_lines: int = 2000, all_lines: int = 600_000, id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """The fitted field, from a sample of ``per_class`` documents of each label at most; None without both labels.

    Of a document with more than ``max_lines`` lines as many are learned from, from a place given by the hash of its text; all
    documents together have ``all_lines``.
    """
    sample, totals = labelled_sample(docs, labels, label, per_class, id_col, text_col)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in as_bytes(batch.column(0)):
                found = line_measures(text)[0].astype(np.float32)
                at = xxhash.xxh3_64_intdigest(text) % max(1, len(found) - max_lines + 1)
                rows.append(found[at : at + max_lines].tobytes())
            sizes = [len(r) // (4 * MEASURES) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1), pa.array(sizes, pa.int64())], ["m", "label", "size"])

    rows = collected_within(sample.mapInArrow(measure, "m binary, label int, size long"), "m", all_lines)
    if {r.label for r in rows} != {0, 1}:
        return None
    measures = [np.frombuffer(r.m, np.float32).reshape(-1, MEASURES) for r in rows]
    y = np.array([r.label for r in rows])
    flat = np.concatenate(measures)
    edges = np.quantile(flat, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    edges = np.ascontiguousarray(np.pad(edges, ((0, 0), (0, BINS - 1 - edges.shape[1])), mode="edge"))
    weights = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    w, t = fit([features(x, edges) for x in measures], y, weights)
    return {"edges": edges, "weights": w, "transition": t}


def score_quality(docs: DataFrame, model: dict | None, text_col: str = "text", result_col: str = "quality", lines: bool = False) -> DataFrame:
    """``docs`` with a score, and with ``lines`` also the marginal of every line; 0.5 without a model."""
    kind = pa.struct([("score", pa.float64()), ("lines", pa.list_(pa.float64()))])

    @F.arrow_udf("struct<score: double, lines: array<double>>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows: list[dict] = []
            for part in chunks(batch, 1 << 20):
                if model is None:
                    rows += [{"score": 0.5, "lines": None}] * len(part)
                    continue
                found = [line_measures(t) for t in as_bytes(part)]
                emission = [model["weights"][features(m, model["edges"])].sum(axis=1) + model["weights"][-1] for m, _ in found]
                out = marginals(emission, model["transition"])
                for (_, chars), p in zip(found, out):
                    by = chars + 1e-9
                    rows.append({"score": float((p * by).sum() / by.sum()), "lines": p.tolist() if lines else None})
            yield pa.array(rows, kind)

    whole = free_name(docs, "whole_text")
    return small_batches(docs).withColumn(whole, F.col(text_col).cast("string")).withColumn(result_col, score(F.col(whole))).drop(whole)
