"""Classifiers of an acronym's expansions: fitted once for each acronym, applied to documents wherever they are.

A learner is a pair of functions on a matrix of hashed terms: ``fit(x, y, k)``
returns a dict of arrays, ``score(model, x)`` one column of scores per class.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 1 << 10
#: Training documents of one acronym that a model is fitted on: a bound of the sample of labelled rows.
FIT_ROWS = 2_000


def matrix(terms: list[dict[str, float]]) -> np.ndarray:
    """Rows of unit length over hashed terms."""
    x = np.zeros((len(terms), DIM), np.float32)
    for i, t in enumerate(terms):
        for w, v in t.items():
            x[i, zlib.crc32(w.encode()) % DIM] += v
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _one_vs_rest(x, y, k, loss, c, rounds=60, balanced=False):
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    t = np.where(y[:, None] == np.arange(k), 1.0, -1.0)
    weight = np.ones_like(t)
    if balanced:
        n = np.bincount(y, minlength=k)
        weight = np.where(t > 0, len(y) / (2.0 * n), len(y) / (2.0 * np.maximum(len(y) - n, 1)))
    w = v = np.zeros((x.shape[1], k))
    lip = 1.0 + c * weight.max() * (0.25 if loss == "logistic" else 2.0) * float(np.linalg.norm(x, 2) ** 2)
    for i in range(rounds):
        m = t * (x @ v)
        g = -t / (1 + np.exp(np.clip(m, -30, 30))) if loss == "logistic" else -2 * t * np.maximum(0, 1 - m)
        new = v - (v + c * (x.T @ (weight * g))) / lip
        v = new + i / (i + 3) * (new - w)
        w = new
    return {"w": w.astype(np.float32)}


def _linear_score(model, x):
    return np.column_stack([x, np.ones(len(x), np.float32)]) @ model["w"]


def _sigmoids(z, y, k):
    """Platt's a and b of each class, on scores of left-out rows."""
    ab = np.zeros((2, k))
    ab[0] = 1.0
    for j in range(k):
        t = (y == j).astype(float)
        t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-(a * z[:, j] + b)))
            g = p - t
            h = p * (1 - p)
            haa, hab, hbb = (h * z[:, j] ** 2).sum() + 1e-3, (h * z[:, j]).sum(), h.sum() + 1e-3
            ga, gb = (g * z[:, j]).sum() + 1e-3 * (a - 1), g.sum() + 1e-3 * b
            det = haa * hbb - hab * hab
            a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
        ab[:, j] = a, b
    return ab


def _calibrated(x, y, k, c=1.0, folds=5):
    """Linear scores turned to probabilities by sigmoids fitted on left-out rows; a class of one row is doubled."""
    once = np.flatnonzero(np.bincount(y, minlength=k)[y] < 2)
    x, y = np.concatenate([x, x[once]]), np.concatenate([y, y[once]])
    part = np.empty(len(y), int)
    for j in range(k):
        at = np.flatnonzero(y == j)
        part[at] = np.arange(len(at)) % min(folds, max(2, len(at)))
    z = np.zeros((len(y), k))
    for f in range(part.max() + 1):
        z[part == f] = _linear_score(_one_vs_rest(x[part != f], y[part != f], k, "hinge", c, 40), x[part == f])
    return _one_vs_rest(x, y, k, "hinge", c) | {"ab": _sigmoids(z, y, k)}


def _calibrated_score(model, x):
    a, b = model["ab"]
    p = 1 / (1 + np.exp(-(a * _linear_score(model, x) + b)))
    return p / np.maximum(p.sum(1, keepdims=True), 1e-9)


def _sgd(x, y, k, rate=0.5, epochs=5, penalty=1e-3, seed=5):
    """Stochastic steps on the hinge loss, one row at a time (a batch of one each, so rows may also arrive one by one)."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    w = np.zeros((x.shape[1], k), np.float32)
    t = np.where(y[:, None] == np.arange(k), 1.0, -1.0)
    step = 0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            step += 1
            lr = rate / (1 + rate * penalty * step)
            m = t[i] * (x[i] @ w) < 1
            w *= 1 - lr * penalty
            w += lr * np.outer(x[i], t[i] * m)
    return {"w": w}


def _tree(x, y, k, rng, features, depth):
    """Arrays (feature, threshold, left, right, distribution) of one decision tree on Gini impurity."""
    nodes: list[list] = []

    def grow(rows, level):
        at = len(nodes)
        dist = np.bincount(y[rows], minlength=k) / len(rows)
        nodes.append([-1, 0.0, -1, -1, dist])
        if level == depth or dist.max() == 1.0 or len(rows) < 2:
            return at
        best = None
        used = np.flatnonzero(x[rows].any(0))
        for f in rng.permutation(used)[:features]:
            v = x[rows, f]
            cut = (v.min() + v.max()) / 2
            left = v <= cut
            if left.all() or not left.any():
                continue
            gini = sum(m.sum() * (1 - ((np.bincount(y[rows][m], minlength=k) / m.sum()) ** 2).sum()) for m in (left, ~left))
            if best is None or gini < best[0]:
                best = (gini, f, cut, left)
        if best:
            nodes[at][:2] = best[1], best[2]
            nodes[at][2] = grow(rows[best[3]], level + 1)
            nodes[at][3] = grow(rows[~best[3]], level + 1)
        return at

    grow(np.arange(len(y)), 0)
    return nodes


def _forest(x, y, k, trees=30, depth=8, seed=123456):
    """Bagged trees that look at the square root of the terms at each node."""
    rng = np.random.default_rng(seed)
    features = max(1, int(np.sqrt(max(1, x.any(0).sum()))) * 2)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_tree(x[rows], y[rows], k, rng, features, depth))
    return {"trees": out}


def _forest_score(model, x):
    def leaf(nodes, row):
        at = 0
        while nodes[at][0] >= 0:
            at = nodes[at][2] if row[nodes[at][0]] <= nodes[at][1] else nodes[at][3]
        return nodes[at][4]

    return np.array([np.mean([leaf(t, row) for t in model["trees"]], axis=0) for row in x])


def _network(x, y, k, hidden=64, epochs=60, rate=0.5, seed=7):
    """One hidden layer of rectified units, softmax output."""
    rng = np.random.default_rng(seed)
    a = rng.normal(0, np.sqrt(2 / DIM), (DIM, hidden)).astype(np.float32) * 4
    b = np.zeros((hidden, k), np.float32)
    t = np.eye(k, dtype=np.float32)[y]
    for _ in range(epochs):
        h = np.maximum(x @ a, 0)
        z = np.exp(h @ b - (h @ b).max(1, keepdims=True))
        g = (z / z.sum(1, keepdims=True) - t) / len(x)
        gh = (g @ b.T) * (h > 0)
        b -= rate * 4 * (h.T @ g)
        a -= rate * (x.T @ gh)
    return {"a": a, "b": b}


def _network_score(model, x):
    z = np.maximum(x @ model["a"], 0) @ model["b"]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


LEARNERS = {
    "svm": (lambda x, y, k, c=1.0, balanced=False: _one_vs_rest(x, y, k, "hinge", c, balanced=balanced), _linear_score),
    "lr": (lambda x, y, k, c=1.0: _one_vs_rest(x, y, k, "logistic", c), _linear_score),
    "svm_calibrated": (_calibrated, _calibrated_score),
    "svm_sgd": (_sgd, _linear_score),
    "rf": (_forest, _forest_score),
    "network": (_network, _network_score),
}


def trained_expander(train: DataFrame, tests: DataFrame, learner: str = "svm", **params) -> DataFrame:
    """``article_id, acronym, expansion, confidence`` by per-acronym classifiers (C-06 to C-11).

    ``train`` has ``acronym, expansion, article_id, terms map<string,double>``,
    ``tests`` the same without expansion. Every acronym with several expansions
    is fitted in one task on at most about ``FIT_ROWS`` rows (a hashed share of
    its rows); test rows are scored wherever they are, by a join with the
    models, so a frequent acronym isn't one task. Acronyms with one expansion
    or none have no row; ties go to the least expansion.
    """
    fit, score = LEARNERS[learner]
    hashed = train.withColumn("_h", F.pmod(F.xxhash64("article_id", "expansion"), F.lit(1 << 30)))
    size = train.groupBy("acronym").agg(F.count("*").alias("_n"), F.count_distinct("expansion").alias("_k")).where("_k > 1")
    sample = hashed.join(size, "acronym").where((F.col("_n") <= FIT_ROWS) | (F.col("_h") < F.lit(float(1 << 30)) * FIT_ROWS / F.col("_n")))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "expansion"])
        labels = sorted(pdf["expansion"].unique())
        if len(labels) < 2:
            return pd.DataFrame({"acronym": [], "labels": [], "model": []})
        y = pdf["expansion"].map({e: i for i, e in enumerate(labels)}).to_numpy()
        model = fit(matrix([dict(t) for t in pdf["terms"]]), y, len(labels), **params)
        return pd.DataFrame({"acronym": [pdf["acronym"].iloc[0]], "labels": [labels], "model": [pickle.dumps(model)]})

    models = sample.select("acronym", "expansion", "terms", "_h").groupBy("acronym").applyInPandas(learn, "acronym string, labels array<string>, model binary")

    def apply(batches):
        seen: dict[str, dict] = {}
        for pdf in batches:
            out = []
            for acr, rows in pdf.groupby("acronym", sort=False):
                if acr not in seen:
                    seen.clear()
                    seen[acr] = pickle.loads(rows["model"].iloc[0])
                labels = list(rows["labels"].iloc[0])
                z = np.asarray(score(seen[acr], matrix([dict(t) for t in rows["terms"]])))
                best = z.argmax(1)
                out += [(a, acr, labels[b], round(float(z[i, b]), 6)) for i, (a, b) in enumerate(zip(rows["article_id"], best))]
            yield pd.DataFrame(out, columns=["article_id", "acronym", "expansion", "confidence"])

    return tests.join(models, "acronym").select("article_id", "acronym", "terms", "labels", "model").mapInPandas(
        apply, "article_id string, acronym string, expansion string, confidence double"
    )
