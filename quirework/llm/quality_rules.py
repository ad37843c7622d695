"""Quality rules by distribution divergence.

Two histograms of each text, of character classes and of common words, are compared
with the references of every language by Jensen-Shannon distance (base 2, so 0 to
1). References are the summed histograms of all documents of one language, each language
that the corpus names having its own. A text is rejected if no language has both distances
within the limits. Texts shorter than a rule's minimum can't be told from chance,
and that rule keeps them; so can't those of a language whose reference has fewer than
MIN_REFERENCE characters, or of none: of these the share of symbols and control
characters alone is compared, with that of all references together. So clean texts of a
language stay however few they are. The base rules on length and repetition come first.

Words are runs of anything but ASCII white space. Null texts count as empty: no
words, so the base rules reject them. Rows count one by one, repeated or not; every
text is read whole; of references that fit equally well the first by name is nearest. Other
columns pass through, except one of the result's name, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm._shared import as_bytes, chunks, free_name, small_batches

# The most frequent function words of four languages.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with be by as this are at from or an not have which".split(),
    "de": "der die und in den von zu das mit sich auf des für ist nicht dem im ein als eine es an auch werden".split(),
    "fr": "de la le et les des en un du une que pour est qui par dans sur au pas avec ce il plus ne".split(),
    "es": "de la que el en y los se del las por un no con su una es para al lo como más o pero".split(),
}
#: Character classes: white space, a-z and digits, A-Z, sentence mark, symbol, control, beyond ASCII; 7 is none (within a character).
_MARKS = b".,;:!?'\"()-"
_CLASS = np.array(
    [
        0 if b == 32 or 9 <= b <= 13 else 1 if 97 <= b <= 122 or 48 <= b <= 57 else 2 if 65 <= b <= 90
        else 3 if b in _MARKS else 5 if b < 32 or b == 127 else 4 if b < 128 else 7 if b < 192 else 6
        for b in range(256)
    ],
    np.uint8,
)
N_CLASSES = 7
_WORDS = {w.encode(): k for k, w in enumerate(sorted({w for ws in COMMON_WORDS.values() for w in ws}))}
#: A word as the histogram takes it: A-Z lower-cased, marks and symbols cut off.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 or 48 <= b <= 57 else 32 for b in range(256))
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
#: Characters that a reference needs to stand for its language.
MIN_REFERENCE = 50_000


def class_histogram(text: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8)[:N_CLASSES]


def word_histogram(text: bytes) -> np.ndarray:
    get = _WORDS.get
    return np.bincount([get(w, len(_WORDS)) for w in text.translate(_FOLD).split()] or [len(_WORDS) + 1], minlength=len(_WORDS) + 2)[: len(_WORDS) + 1]


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    words = text.split()
    n = len(words)
    solid = text.translate(None, _SPACE)
    chars = len(solid) - len(solid.translate(None, bytes(range(128)) + bytes(range(192, 256))))
    symbols = len(solid) - len(solid.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)] if n else []
    repeated = 0
    if n > 2:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        if len(number) < n:
            _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
            _, triple, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
            again = times[triple] > 1
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + n - 2] |= again
            repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``counts`` from ``reference``; 0 for empty rows."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    q = np.broadcast_to(reference / max(reference.sum(), 1), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(parts.sum(axis=1), 0) / 2), 0)


def signs(letters: np.ndarray) -> np.ndarray:
    """Of class histograms: letters and marks of any script, symbols, control characters."""
    return np.stack([letters[..., 1] + letters[..., 2] + letters[..., 3] + letters[..., 6], letters[..., 4], letters[..., 5]], axis=-1)


def nearest(letters: np.ndarray, words: np.ndarray, refs: list, limits: tuple[float, float], minima: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the reference that fits best, and its two distances; 0 where a text is too short for a rule."""
    chars, n = letters[:, 1:].sum(axis=1), words.sum(axis=1)
    by_class = np.array([np.where(chars >= minima[0], js_distance(letters, r[0]), 0) for _, r in refs]).reshape(-1, len(n))
    by_word = np.array([np.where(n >= minima[1], js_distance(words, r[1]), 0) for _, r in refs]).reshape(-1, len(n))
    if not refs:
        return np.full(len(n), -1), np.zeros(len(n)), np.zeros(len(n))
    best = np.maximum(by_class / limits[0], by_word / limits[1]).argmin(axis=0)
    line = np.arange(len(n))
    return best, by_class[best, line], by_word[best, line]


def language_references(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", limits: tuple[float, float] = (0.14, 0.46), minima: tuple[int, int] = (200, 100)
) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Class and word histograms of the documents, by language, in three passes over all of them.

    The second pass leaves out the texts that are beyond twice the limits from every
    reference of the first, the third those beyond the limits from those of the second, so
    that junk doesn't shape what it is measured by.
    A reference is a kilobyte, on the driver and in each task, and there are as many as the
    corpus names languages. Rows without a language shape none.
    """
    rows = small_batches(docs).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null")

    def gather(first: list, most: tuple[float, float]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                langs, at = batch.column(0).to_pylist(), 0
                for part in chunks(batch.column(1)):
                    texts = as_bytes(part)
                    letters, words = np.array([class_histogram(x) for x in texts]), np.array([word_histogram(x) for x in texts])
                    _, by_class, by_word = nearest(letters, words, first, limits, minima)
                    fits = (by_class <= most[0]) & (by_word <= most[1])
                    for k, found in enumerate(np.concatenate((letters, words), axis=1)):
                        if fits[k]:
                            total[langs[at + k]] = total.get(langs[at + k], 0) + found
                    at += len(texts)
            for lang, found in total.items():
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(found), "at": np.arange(len(found), dtype=np.int32), "n": found.astype(np.int64)})

        parts = rows.mapInArrow(sums, "lang string, at int, n bigint").groupBy("lang", "at").agg(F.sum("n").alias("n"))
        out: dict[str, np.ndarray] = {}
        for r in parts.collect():  # fewer than 120 numbers a language
            out.setdefault(r.lang, np.zeros(N_CLASSES + len(_WORDS) + 1, np.int64))[r.at] = r.n
        return {k: (v[:N_CLASSES], v[N_CLASSES:]) for k, v in out.items()}

    found = gather([], limits)
    for wider in (2, 1):
        found |= gather(sorted(found.items()), (wider * limits[0], wider * limits[1]))
    return found


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    references: dict[str, tuple[np.ndarray, np.ndarray]] | None = None,
    class_limit: float = 0.14,
    word_limit: float = 0.46,
    min_chars: int = 200,
    min_words: int = 100,
    result_col: str = "quality",
) -> DataFrame:
    """``docs`` with a struct: the base counts, base_failed, the distances, the language that fits best, whether the text's own has a reference to rely on, and kept."""
    limits, minima = (class_limit, word_limit), (min_chars, min_words)
    found = language_references(docs, text_col, lang_col, limits, minima) if references is None else references
    refs = sorted(found.items())
    settled = {lang for lang, (letters, _) in refs if letters.sum() >= MIN_REFERENCE}
    plain = signs(np.sum([letters for _, (letters, _) in refs], axis=0)) if refs else np.zeros(3)
    whole = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    distances = ("class_distance", "word_distance", "sign_distance")
    kind = pa.struct([(c, pa.int64()) for c in whole] + [(c, pa.float64()) for c in distances] + [("nearest", pa.string()), ("settled", pa.bool_())])

    @F.arrow_udf(f"struct<{', '.join(f'{c}: bigint' for c in whole)}, {', '.join(f'{c}: double' for c in distances)}, nearest: string, settled: boolean>")
    def measure(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch, langs in batches:
            known, at, done = [x in settled for x in langs.to_pylist()], 0, []
            for part in chunks(batch):
                texts = as_bytes(part)
                counts = np.array([base_counts(x) for x in texts], np.int64)
                letters, words = np.array([class_histogram(x) for x in texts]), np.array([word_histogram(x) for x in texts])
                best, by_class, by_word = nearest(letters, words, refs, limits, minima)
                by_sign = np.where(letters[:, 1:].sum(axis=1) >= min_chars, js_distance(signs(letters), plain), 0)
                columns = [pa.array(counts[:, k]) for k in range(5)] + [pa.array(by_class), pa.array(by_word), pa.array(by_sign)]
                columns += [pa.array([refs[k][0] if k >= 0 else None for k in best.tolist()], pa.string()), pa.array(known[at : at + len(texts)], pa.bool_())]
                done.append(pa.StructArray.from_arrays(columns, fields=list(kind)))
                at += len(texts)
            yield pa.concat_arrays(done) if done else pa.array([], kind)

    name = free_name(docs, "measured")
    at: dict[str, Column] = {c: F.col(name)[c] for c in (*whole, *distances, "nearest", "settled")}
    failed = (at["n_words"] < 50) | (100 * at["n_repeat_words"] > 50 * at["n_words"])
    near = (at["class_distance"] <= class_limit) & (at["word_distance"] <= word_limit)
    unknown = ~at["settled"] & (at["sign_distance"] <= class_limit)
    result = F.struct(*[c.alias(k) for k, c in at.items()], failed.alias("base_failed"), (~failed & (near | unknown)).alias("kept"))
    return small_batches(docs).withColumn(name, measure(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))).withColumn(result_col, result).drop(name)


def keep_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    name = free_name(docs, "quality")
    judged = quality_rules(docs, text_col, lang_col, result_col=name, **options)
    return judged.filter(F.col(name)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
