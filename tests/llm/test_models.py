"""The trained models against their definitions: optimality of the fits, votes and probabilities by brute force."""

import itertools
import math

import numpy as np

from tabulon.llm import langid, quality


def sparse_rows(rng, n, dims):
    out = []
    for _ in range(n):
        cells = np.sort(rng.choice(dims, size=rng.integers(1, 5), replace=False)).astype(np.int32)
        out.append((cells, rng.normal(size=len(cells)).astype(np.float32)))
    return out


def test_svm_reaches_the_optimum():
    rng = np.random.default_rng(4)
    dims, cost = 12, 1.5
    rows = sparse_rows(rng, 60, dims)
    y = [1.0 if rng.random() < 0.5 else -1.0 for _ in rows]
    w = langid.fit_svm(rows, y, dims, cost, epochs=2000)
    x = np.zeros((len(rows), dims + 1))
    for k, (cells, values) in enumerate(rows):
        x[k, cells], x[k, -1] = values, 1.0

    def objective(w):
        return 0.5 * w @ w + cost * (np.maximum(0, 1 - np.array(y) * (x @ w)) ** 2).sum()

    slack = np.maximum(0, 1 - np.array(y) * (x @ w))
    gradient = w - 2 * cost * ((slack * np.array(y)) @ x)
    assert np.abs(gradient).max() < 0.05  # the fit ends when no step exceeds 1e-4 of a row
    assert all(objective(w) <= objective(w + 0.05 * rng.normal(size=dims + 1)) + 1e-6 for _ in range(200))


def test_votes_by_brute_force():
    rng = np.random.default_rng(8)
    families, langs = ["f0", "f1", "f2"], {"f0": ["a"], "f1": ["b", "c"], "f2": ["d", "e", "g"]}
    levels, at = [("", families, [0, 1, 2])], 3
    for f in families:
        pairs = list(itertools.combinations(langs[f], 2))
        levels.append((f, langs[f], list(range(at, at + len(pairs)))))
        at += len(pairs)
    model = langid.LanguageModel(np.zeros((5, at)), levels)
    sums = rng.normal(size=(200, at))

    def won(level, row):
        _, classes, columns = level
        if len(classes) == 1:
            return classes[0], 1.0
        support = dict.fromkeys(classes, 0.0)
        for (a, b), c in zip(itertools.combinations(classes, 2), columns, strict=True):
            p = 1 / (1 + math.exp(-4 * row[c]))
            support[a] += p
            support[b] += 1 - p
        best = max(classes, key=lambda c: (support[c], -classes.index(c)))
        return best, support[best] / (len(classes) * (len(classes) - 1) / 2)

    labels, scores = model.predict(sums)
    for row, label, score in zip(sums, labels, scores, strict=True):
        family, first = won(levels[0], row)
        lang, second = won(next(x for x in levels[1:] if x[0] == family), row)
        assert label == lang and abs(score - first * second) < 1e-6


def test_ordinal_fit_is_stationary_and_its_probabilities_add_up():
    rng = np.random.default_rng(2)
    dims, n = 10, 400
    truth = rng.normal(size=dims)
    cells = [np.sort(rng.choice(dims, size=rng.integers(1, 6), replace=False)).astype(np.int32) for _ in range(n)]
    value = np.array([truth[c].sum() for c in cells]) + rng.logistic(size=n)
    grade = np.digitize(value, [-1.0, 1.0])
    model = quality.fit_ordinal(cells, grade, dims, sparsity=0.0, rounds=5000)
    x = np.zeros((n, dims))
    for k, c in enumerate(cells):
        x[k, c] = 1
    f = x @ model.weights
    tails = model.tails(f)
    assert np.all(np.diff(model.thresholds) >= 0) and np.all(np.diff(tails, axis=1) <= 1e-12)
    above = np.stack([grade > 0, grade > 1], axis=1)
    spread = np.sqrt(x.mean(0) * (1 - x.mean(0)))
    slope = ((x - x.mean(0)) / spread).T @ (tails - above).sum(axis=1) / n
    assert np.abs(slope).max() < 1e-3 and np.abs((tails - above).mean(axis=0)).max() < 1e-3
    by_hand = [sum(g * p for g, p in zip((0, 1, 2), (1 - t[0], t[0] - t[1], t[1]), strict=True)) for t in tails]
    assert np.allclose(model.expected(tails), by_hand)
    loss = lambda w, t: -np.where(above, np.log(1 / (1 + np.exp(-((x @ w)[:, None] - t)))), np.log(1 - 1 / (1 + np.exp(-((x @ w)[:, None] - t))))).sum() / n
    best = loss(model.weights, model.thresholds)
    assert all(best <= loss(model.weights + 0.1 * rng.normal(size=dims), np.sort(model.thresholds + 0.1 * rng.normal(size=2))) + 1e-6 for _ in range(100))


def test_ordinal_edge_cases():
    one = quality.fit_ordinal([np.array([1], dtype=np.int32)] * 3, np.array([2, 2, 2]), 4)
    assert one.expected(one.tails(np.zeros(2))).tolist() == [2.0, 2.0]
    none = quality.fit_ordinal([], np.array([], dtype=int), 4)
    assert none.expected(none.tails(np.zeros(1))).tolist() == [0.0]
