"""Quality selection by ordinal cumulative-link regression.

Graded ratings 0 < 1 < .. < K are modelled as ``P(grade > k) = sigmoid(w.x - t_k)``
with one weight vector for all thresholds ``t_0 < t_1 < ..``. ``x`` marks which
words a text holds, hashed; words that say nothing get no weight. The model
yields the expected grade and every tail probability; a selection keeps the
texts whose tail probability passes a cut.

Training takes at most ``max_rows`` rated rows, the ones with the least hash of
the id; they become word sets on the executors, and the driver fits the bounded
sample by accelerated gradient steps with a soft threshold, in a fixed order.

Defined cases: null and empty texts have no words and get the grade that the
thresholds alone give; rows without a rating teach nothing; an id rated more
than once has the least of its grades; a single grade, or none, gives that
grade (or 0) to all; whole texts are read; repeated rows get equal answers; extra
columns are kept by ``score`` unless they bear the name of an output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def word_cells(text: str, dims: int, known: dict[str, int]) -> np.ndarray:
    """Distinct hashed words of a text; punctuation at their ends does not count."""
    import xxhash

    tokens = set(text.split())
    try:
        cells = [known[t] for t in tokens]
    except KeyError:
        if len(known) > 300_000:
            known.clear()
        for t in tokens:
            if t not in known:
                known[t] = xxhash.xxh32_intdigest(t.lower().strip(".,;:!?\"'()[]|").encode("utf-8", "surrogatepass")) % dims
        cells = [known[t] for t in tokens]
    return np.unique(np.array(cells, dtype=np.int32))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]

    def tails(self, values: np.ndarray) -> np.ndarray:
        """``P(grade above the k-th)`` for each value of ``w.x``."""
        z = values[:, None] - self.thresholds[None, :]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        steps = np.diff(np.array(self.grades, dtype=float))
        return self.grades[0] + tails @ steps if len(steps) else np.full(len(tails), float(self.grades[0]))


def fit_ordinal(cells: list[np.ndarray], grade: np.ndarray, dims: int, sparsity: float = 2e-4, rounds: int = 400) -> OrdinalModel:
    """Cumulative logit with shared weights, by proximal gradient with momentum."""
    grades = sorted(set(grade.tolist()))
    k = len(grades) - 1
    if k < 1:
        return OrdinalModel(np.zeros(dims), np.zeros(0), grades or [0])
    above = np.stack([(grade > g) for g in grades[:-1]], axis=1).astype(float)
    share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    t = -np.log(share / (1 - share))
    at = np.concatenate(cells) if len(cells) else np.empty(0, dtype=np.int32)
    row = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    n = len(cells)
    # Each word is measured by its spread, so frequent words cannot take all the weight.
    seen = np.bincount(at, minlength=dims) / n
    spread = np.sqrt(np.maximum(seen * (1 - seen), 1 / n))
    unit = 1 / spread[at]
    mean = seen / spread
    w, v, before = np.zeros(dims), np.zeros(dims), 1.0
    size = 0.25 * k * max(1.0, float((np.bincount(row, unit**2, minlength=n)).mean()) ** 0.5)
    for _ in range(rounds):
        value = np.bincount(row, v[at] * unit, minlength=n) - mean @ v
        p = 1 / (1 + np.exp(-np.clip(value[:, None] - t[None, :], -40, 40)))
        miss = p - above
        per = miss.sum(axis=1)
        slope = (np.bincount(at, per[row] * unit, minlength=dims) - mean * per.sum()) / n
        t = np.maximum.accumulate(t + 2.0 * miss.mean(axis=0))
        new = v - slope / size
        new = np.sign(new) * np.maximum(0, np.abs(new) - sparsity / size * 10)
        after = (1 + np.sqrt(1 + 4 * before**2)) / 2
        v, w, before = new + (before - 1) / after * (new - w), new, after
    real = w / spread
    return OrdinalModel(real, t + mean @ w, grades)


def train(docs: DataFrame, ratings: DataFrame, max_rows: int = 8000, dims: int = 1 << 17) -> OrdinalModel:
    """Fit on ``ratings (doc_id, grade)`` joined to ``docs``."""
    rated = ratings.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("long").alias("grade"))
    chosen = rated.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            cells = [word_cells(t.as_py() or "", dims, known) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cells, pa.list_(pa.int32()))], ["doc_id", "grade", "cells"])

    found = rows.select("doc_id", "text", "grade").mapInArrow(run, "doc_id long, grade long, cells array<int>").toArrow()
    found = found.take(pa.compute.sort_indices(found, sort_keys=[("doc_id", "ascending"), ("grade", "ascending")])) if len(found) else found
    cells = [np.asarray(c.values) for c in found.column("cells")]
    return fit_ordinal(cells, found.column("grade").to_numpy(), dims)


def score(docs: DataFrame, model: OrdinalModel, cut_grade: int | None = None) -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tail_prob``: the chance of a grade above ``cut_grade``."""
    kept = [c for c in docs.columns if c not in ("expected_grade", "tail_prob")]
    cut = model.grades[0] if cut_grade is None else cut_grade
    column = sum(g <= cut for g in model.grades) - 1
    at = kept.index("text")
    dims = len(model.weights)
    some = np.flatnonzero(model.weights)
    packed = some.astype(np.int32), model.weights[some]
    rest = OrdinalModel(np.zeros(0), model.thresholds, model.grades)
    docs = docs.select(*kept)
    schema = T.StructType([*docs.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_prob", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(dims)
        weights[packed[0]] = packed[1]
        known: dict[str, int] = {}
        for batch in batches:
            values = np.array([weights[word_cells(t.as_py() or "", dims, known)].sum() for t in batch.column(at)])
            tails = rest.tails(values)
            tail = tails[:, column] if 0 <= column < tails.shape[1] else np.full(len(values), float(column < 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rest.expected(tails)), pa.array(tail)], [*kept, "expected_grade", "tail_prob"])

    return docs.mapInArrow(run, schema)


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)``: 0 for toxic, 1 for low and 2 for high quality."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def quality_report(docs: DataFrame, labels: DataFrame, keep_above: float = 0.5) -> DataFrame:
    """``doc_id, expected_grade, tail_prob, kept``: kept if a grade above the lowest is likely."""
    model = train(docs, grades_of_labels(labels))
    rows = score(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", "expected_grade", "tail_prob", (F.col("tail_prob") >= keep_above).alias("kept"))
