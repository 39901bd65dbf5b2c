"""Hierarchical language identification.

First the family is told, then linear support vector machines, one for each
pair of languages of that family, vote on the language. Families with one
learned language need no vote. All classifiers are linear in the counts of
hashed letter n-grams of the words, divided by the number of n-grams. The
n-grams of a whole text are hashed at once, as arrays.

Training takes a sample of at most ``rows_per_lang`` rows of each language,
the ones with the least hash of their id. Rows are reduced to n-gram counts on
the executors; the driver gets that bounded sample, some 5 MB a language, and
solves the dual of the L2-loss SVM by coordinate descent over the counts that
are not zero, in a fixed order.

Letters are the characters of Unicode category L. Defined cases: null texts and
texts without a letter are ``und`` with score 0; null languages teach nothing;
languages without a known family are a family of their own; with no labelled
row every text is ``und``; ties go to the label that sorts first; repeated rows
get the same answer; extra columns do not matter and are kept by
``keep_identified``, whatever their names. Whole texts are read, of any length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import free_name, released, text_batches

# Families of ISO 639-1 codes, for the languages most often told apart.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sh", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu", "se"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "ug", "uz"),
    "indic": ("as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "sa", "sd", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "semitic": ("am", "ar", "he", "mt"),
    "austronesian": ("id", "jv", "mg", "mi", "ms", "su", "tl"),
}

UNDETERMINED = "und"
LONGEST_GRAM = 4
#: Characters whose n-grams are counted at once, and rows whose counts are weighed at once.
BLOCK_CHARS, BLOCK_ROWS = 1 << 18, 64


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


# ---------------------------------------------------------------- features


@cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), dtype=bool, count=0x110000)


def letter_runs(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, runs parted and enclosed by one space each; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    is_letter = letters()[points]
    if not is_letter.any():
        return points[:0]
    after = np.zeros_like(is_letter)
    after[1:] = is_letter[:-1]
    runs = np.where(is_letter, points, 32)[is_letter | after]
    return np.concatenate([[32], runs, [32] if is_letter[-1] else []]).astype(np.uint64)


def gram_counts(text: str, dims: int) -> np.ndarray:
    """How many n-grams of 1 to ``LONGEST_GRAM`` characters of the words fall to each of ``dims`` cells.

    A word is taken with the space before and after it; no n-gram spans words.
    """
    total, runs = np.zeros(dims, dtype=np.int64), letter_runs(text)
    step, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - dims.bit_length() + 1)
    with np.errstate(over="ignore"):
        for at in range(0, len(runs), BLOCK_CHARS):
            x = runs[at : at + BLOCK_CHARS + LONGEST_GRAM - 1]
            here = min(BLOCK_CHARS, len(runs) - at)
            inner, h = x != 32, np.zeros(len(x), dtype=np.uint64)
            valid = np.ones(len(x), dtype=bool)
            for n in range(1, LONGEST_GRAM + 1):
                m = len(x) - n + 1  # starts of n-grams in the block
                if m < 1:
                    break
                h = (h[:m] + x[n - 1 :]) * step
                if n == 1:
                    start = inner
                else:
                    valid = valid[:m] & inner[n - 2 : n - 2 + m] if n > 2 else valid[:m]
                    start = valid
                cells = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)) >> shift
                total += np.bincount(cells[:here][start[:here]].astype(np.int64), minlength=dims)
    return total


def sample_counts(docs: DataFrame, dims: int) -> DataFrame:
    """``lang, cells, counts`` of each row: its n-gram counts, without the zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            cells, counts = [], []
            for text in batch.column(1):
                total = gram_counts(text.as_py() or "", dims)
                at = np.flatnonzero(total)
                cells.append(at.astype(np.int32))
                counts.append(total[at])
            columns = [batch.column(0), pa.array(cells, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "cells", "counts"])

    return text_batches(docs.select("lang", "text")).mapInArrow(run, "lang string, cells array<int>, counts array<long>")


# ---------------------------------------------------------------- model


Row = tuple[np.ndarray, np.ndarray]


def fit_svm(rows: list[Row], y: list[float], dims: int, cost: float, epochs: int = 40) -> np.ndarray:
    """Weights and, last, the bias of an L2-loss linear SVM by dual coordinate descent.

    ``rows`` are ``(cells, values)`` without zeros, ``y`` is +1 or -1. The bias
    is the weight of one more cell of value 1.
    """
    weights, ridge = np.zeros(dims + 1), 1 / (2 * cost)
    alpha, curve = [0.0] * len(rows), [float(v @ v) + 1 + ridge for _, v in rows]
    for _ in range(epochs):
        most = 0.0
        for i, (cells, values) in enumerate(rows):
            slope = y[i] * (float(weights[cells] @ values) + weights[-1]) - 1 + ridge * alpha[i]
            new = max(0.0, alpha[i] - slope / curve[i])
            step = new - alpha[i]
            if step:
                weights[cells] += (step * y[i]) * values
                weights[-1] += step * y[i]
                alpha[i], most = new, max(most, abs(step) * curve[i])
        if most < 1e-4:
            break
    return weights


@dataclass
class LanguageModel:
    """``levels[0]`` tells families, the others the languages of one family.

    A level is ``(name, classes, columns)``: column numbers of the pairwise
    classifiers in ``weights``, in the order (0,1), (0,2) .. (1,2) ..
    """

    weights: np.ndarray  # (dims + 1, classifiers); the last row is the bias
    levels: list[tuple[str, list[str], list[int]]]

    @property
    def dims(self) -> int:
        return len(self.weights) - 1

    def predict(self, sums: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Labels and scores from the mean classifier values of texts."""
        top, score = self._vote(self.levels[0], sums)
        names, labels = self.levels[0][1], np.empty(len(sums), dtype=object)
        for k, family in enumerate(names):
            rows = np.flatnonzero(top == k)
            level = next(x for x in self.levels[1:] if x[0] == family)
            best, share = self._vote(level, sums[rows])
            labels[rows] = np.array(level[1], dtype=object)[best]
            score[rows] = np.round(score[rows] * share, 9)
        return labels.tolist(), score

    @staticmethod
    def _vote(level: tuple[str, list[str], list[int]], sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class with most support and its share of all support."""
        n, columns = len(level[1]), iter(level[2])
        if n == 1:
            return np.zeros(len(sums), dtype=int), np.ones(len(sums))
        support = np.zeros((len(sums), n))
        for i in range(n):
            for j in range(i + 1, n):
                p = 1 / (1 + np.exp(np.clip(-4 * sums[:, next(columns)], -50, 50)))
                support[:, i] += p
                support[:, j] += 1 - p
        best = support.argmax(axis=1)
        return best, np.round(support[np.arange(len(sums)), best] / (n * (n - 1) / 2), 9)


def train(docs: DataFrame, rows_per_lang: int = 400, dims: int = 1 << 13, cost: float = 10.0) -> LanguageModel | None:
    """Fit on labelled rows ``(doc_id, text, lang)``; None if there is no label."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    labelled = labelled.withColumn("order", F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    # Rows under a share of the hash range that yields the wanted number with room to spare; then the least.
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, (1.2 * rows_per_lang + 100) / n))).otherwise(share)
    some = labelled.filter(F.pmod("order", F.lit(1 << 30)) / float(1 << 30) <= share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id", F.xxhash64("text")))
    some = some.withColumn("rank", rank).filter(F.col("rank") <= rows_per_lang)
    found = sorted(((r["lang"], r["cells"], r["counts"]) for r in sample_counts(some, dims).toLocalIterator()), key=lambda r: r[:3])  # the same order on every run
    rows = [(np.array(cells, dtype=np.int32), np.array(n, dtype=np.float32) / max(1, sum(n))) for _, cells, n in found]
    scale = float(1 / np.sqrt(np.mean([float(v @ v) for _, v in rows]) + 1e-12))
    rows, y = [(cells, v * np.float32(scale)) for cells, v in rows], np.array([r[0] for r in found], dtype=object)
    del found

    weights, levels = [], []

    def level(name: str, classes: list[str], of: np.ndarray) -> None:
        columns = []
        for i, a in enumerate(classes):
            for b in classes[i + 1 :]:
                both = np.flatnonzero((of == a) | (of == b)).tolist()
                weights.append(fit_svm([rows[k] for k in both], [1.0 if of[k] == a else -1.0 for k in both], dims, cost))
                columns.append(len(weights) - 1)
        levels.append((name, classes, columns))

    langs = sorted(counts)
    families = sorted({family_of(v) for v in langs})
    level("", families, np.array([family_of(v) for v in y], dtype=object))
    for f in families:
        level(f, [v for v in langs if family_of(v) == f], y)
    table = np.stack(weights, axis=1) if weights else np.zeros((dims + 1, 0))
    table[:-1] *= scale
    return LanguageModel(table, levels)


# ---------------------------------------------------------------- prediction


def predict(docs: DataFrame, model: LanguageModel | None, label: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with the columns ``label`` and ``score``; only ``text`` is looked at."""
    if model is None:
        return docs.withColumns({label: F.lit(UNDETERMINED), score: F.lit(0.0)})
    names, at = [*docs.columns, label, score], docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])

    def told(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        counts = np.array([gram_counts(t or "", model.dims) for t in texts], dtype=float)
        grams = counts.sum(axis=1)
        labels, scores = model.predict(counts @ model.weights[:-1] / np.maximum(1, grams)[:, None] + model.weights[-1])
        return [v if n else UNDETERMINED for v, n in zip(labels, grams, strict=True)], np.where(grams > 0, scores, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                labels, scores = told(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(labels, pa.string()), pa.array(scores)], names)

    return text_batches(docs).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows that no training may see: CRC-32 of the id as text, modulo 5, is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 0


def language_report(docs: DataFrame, rows_per_lang: int = 400) -> DataFrame:
    """One row per document, by a model that saw no held-out row."""
    model = train(docs.filter(~held_out()), rows_per_lang)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def keep_identified(docs: DataFrame, min_score: float = 0.0, rows_per_lang: int = 400) -> DataFrame:
    """The rows whose language is told with at least ``min_score``; columns as they came."""
    model = train(docs.filter(~held_out()), rows_per_lang)
    label, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    found = predict(docs, model, label, score).filter((F.col(label) != UNDETERMINED) & (F.col(score) >= min_score))
    return found.drop(label, score)
