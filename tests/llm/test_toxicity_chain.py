"""The classifier chain against a dense one: features counted in plain Python, links fitted by Newton's method."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from platelens.llm.toxicity import CATEGORIES, toxicity, word_features


def newton(x, y, l2=1e-4):
    """Logistic regression with a free intercept, to convergence; (weights, intercept)."""
    if y.min() == y.max():
        return np.zeros(x.shape[1]), math.inf if y.max() else -math.inf
    d, n = np.column_stack([x, np.ones(len(y))]), len(y)
    ridge = np.diag([l2] * x.shape[1] + [0.0])
    w = np.zeros(d.shape[1])
    loss = lambda w: np.logaddexp(0, d @ w).sum() / n - (y * (d @ w)).sum() / n + 0.5 * w @ ridge @ w
    for _ in range(200):
        p = 1 / (1 + np.exp(-d @ w))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + ridge + 1e-12 * np.eye(len(w)), d.T @ (p - y) / n + ridge @ w)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
    return w[:-1], w[-1]


def predict(model, x):
    w, b = model
    return np.full(len(x), float(b > 0)) if math.isinf(b) else 1 / (1 + np.exp(-(x @ w + b)))


def dense_chain(order, sets, labels, min_z, folds=3):
    """(chosen features, links): the links in the chain's order, with out-of-fold probabilities between them."""
    n, seen = len(order), Counter(f for i in order for f in sets[i])
    chosen = []
    for j in range(3):
        positive, share = Counter(f for i in order if labels[i][j] for f in sets[i]), sum(labels[i][j] for i in order) / n
        if 0 < share < 1:
            z = {f: (positive[f] - c * share) / math.sqrt(c * share * (1 - share)) for f, c in seen.items() if c >= 3}
            chosen += [f for f, v in sorted(z.items(), key=lambda e: (-e[1], e[0])) if v >= min_z and f not in chosen]
    x = np.array([[f in sets[i] for f in chosen] for i in order], float)
    y, fold, links = np.array([labels[i] for i in order], float), np.arange(n) % folds, []
    for j in range(3):
        out = np.zeros(n)
        for f in range(folds):
            out[fold == f] = predict(newton(x[fold != f], y[fold != f, j]), x[fold == f])
        links.append(newton(x, y[:, j]))
        x = np.column_stack([x, out])
    return chosen, links


def test_chain_equals_a_dense_one(spark):
    rng = random.Random(12)
    plain, vile, junk = [f"word{c}" for c in "abcdefghij"], ["vilest", "scum", "hateful"], ["zzz", "qqq#", "xkcd"]
    docs, labels = [], {}
    for i in range(300):
        toxic, poor = rng.random() < 0.3, rng.random() < 0.35
        words = rng.choices(plain, k=12) + (rng.choices(vile, k=2) if toxic and rng.random() < 0.9 else []) + (rng.choices(junk, k=3) if poor and rng.random() < 0.9 else []) + (rng.choices(vile + junk, k=1) if rng.random() < 0.1 else [])
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        if i < 240:
            labels[i] = (int(poor), int(toxic), int(poor and toxic))
    docs += [(900, None), (901, ""), (902, "Scum VILEST " * 20_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = spark.createDataFrame([(i, 1 - p, t) for i, (p, t, _) in labels.items()], "doc_id long, quality int, toxic int")
    got = {r.doc_id: [r[f"p_{c}"] for c in CATEGORIES] for r in toxicity(frame, rows, min_z=4.0).collect()}

    sets = {i: {f for w in set((t or "").lower().split()) for f in word_features(w)} for i, t in docs}
    order = [r.doc_id for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    chosen, links = dense_chain(order, sets, labels, 4.0)
    assert len(chosen) > 5
    x = np.array([[f in sets[i] for f in chosen] for i, _ in docs], float)
    for link in links:
        x = np.column_stack([x, predict(link, x)])
    want = x[:, -3:]
    mine = np.array([got[i] for i, _ in docs])
    # the chain's links are fitted by a fixed number of accelerated steps
    assert np.abs(mine - want).max() < 0.05 and np.abs(mine - want).mean() < 0.005
    assert ((mine[:, 1] >= 0.4) == (want[:, 1] >= 0.4)).all()
    assert got[902][1] > 0.9 > 0.3 > got[900][1] == got[901][1]
