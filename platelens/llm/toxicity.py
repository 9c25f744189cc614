"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; a later model takes the earlier categories' probabilities as
features. In training these are out-of-fold predictions, so that a link never sees a probability fitted on
the row itself. Features say which words, and which word beginnings, a document has; each category keeps
those that speak for it significantly, so a long document's other words add no noise.

Training takes at most `max_labelled` labelled documents, those of smallest hash of doc_id (a documented
bound); feature counts are made by Spark over that sample, and only the chosen features of its documents
reach the driver, at most `max_features` a category. Scoring covers every row and whole texts.

Defined results: null or empty text scores like a document without any known feature; without labels, or
where a category has one class only, its probability is that class's share (0 without rows); labels that
contradict each other count as the larger one in each category; a repeated doc_id trains once, on the smallest
feature set of its texts; repeated rows score alike; extra columns pass through, except that toxicity() leaves out
those named as its own results (drop_toxic keeps all columns as they are).
"""

from __future__ import annotations

import math
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release_memory

_RUN = re.compile(r"[^\W\d_]+|[^\w\s]+")
_CACHE_WORDS = 200_000
#: Texts that are taken out of Arrow at a time.
_SLICE = 256


def word_features(word: str) -> set[int]:
    """Hashes of a lower-case chunk's runs of letters or signs and of the beginnings of 4 to 6 characters."""
    out = set()
    for run in _RUN.findall(word):
        out.add(zlib.crc32(b"w" + run.encode()))
        for n in (4, 5, 6):
            if len(run) >= n:
                out.add(zlib.crc32(b"p" + run[:n].encode()))
    return out


class FeatureMap(dict):
    """Chunk to the indices of its chosen features, looked up at first sight; emptied when it grows."""

    def __init__(self, chosen: dict[int, int]):
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > _CACHE_WORDS:
            self.clear()
        found = self[word] = tuple(self.chosen[f] for f in word_features(word) if f in self.chosen)
        return found

    def document(self, text: str | None) -> list[int]:
        if not text:
            return []
        return sorted({i for hit in map(self.__getitem__, set(text.lower().split())) for i in hit})


class LinearModel:
    """Logistic regression over binary features and a few dense columns, fitted by accelerated gradients."""

    def __init__(self, weights: np.ndarray, dense: np.ndarray, bias: float):
        self.weights, self.dense, self.bias = weights, dense, bias

    @classmethod
    def fit(cls, rows: np.ndarray, cols: np.ndarray, n_features: int, dense: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 300) -> LinearModel:
        n, k = dense.shape
        p = float(y.mean()) if n else 0.0
        if p in (0.0, 1.0):
            return cls(np.zeros(n_features), np.zeros(k), math.inf if p else -math.inf)
        w = np.zeros(n_features + k + 1)
        w[-1] = math.log(p / (1 - p))
        ahead, t = w.copy(), 1.0
        v = np.ones(len(w)) / math.sqrt(len(w))
        for _ in range(20):  # the largest curvature, by power iteration
            z = np.bincount(rows, v[cols], n) + dense @ v[n_features:-1] + v[-1]
            v = np.concatenate([np.bincount(cols, z[rows], n_features), dense.T @ z, [z.sum()]]) / n
            top = float(np.linalg.norm(v))
            v /= top
        rate = 1.0 / (0.3 * top + l2)
        for _ in range(steps):
            z = np.bincount(rows, ahead[cols], n) + dense @ ahead[n_features:-1] + ahead[-1]
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
            grad = np.concatenate([np.bincount(cols, g[rows], n_features), dense.T @ g, [g.sum()]])
            grad[:-1] += l2 * ahead[:-1]
            new = ahead - rate * grad
            t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
            ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
        return cls(w[:n_features], w[n_features:-1], float(w[-1]))

    def predict(self, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray) -> np.ndarray:
        if math.isinf(self.bias):
            return np.full(len(dense), float(self.bias > 0))
        z = np.bincount(rows, self.weights[cols], len(dense)) + dense @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class ClassifierChain:
    """One link per category; link j has the probabilities of links 0..j-1 as dense features."""

    def __init__(self, chosen: dict[int, int], links: list[LinearModel]):
        self.chosen, self.links = chosen, links

    @classmethod
    def fit(cls, chosen: dict[int, int], features: list[list[int]], labels: np.ndarray, folds: int = 3) -> ClassifierChain:
        """labels: a row per document, a column per category. Rows are dealt to folds in turn."""
        n, k = labels.shape
        sizes = np.array([len(f) for f in features], np.int64)
        rows = np.repeat(np.arange(n), sizes)
        cols = np.array([i for f in features for i in f], np.int64)
        fold, dense, links = np.arange(n) % folds, np.zeros((n, 0)), []
        for j in range(k):
            y, out = labels[:, j].astype(float), np.zeros(n)
            if j + 1 < k:
                for f in range(folds):
                    inside, test = fold[rows] != f, fold == f
                    renumber = np.cumsum(fold != f) - 1
                    part = LinearModel.fit(renumber[rows[inside]], cols[inside], len(chosen), dense[~test], y[~test])
                    renumber = np.cumsum(test) - 1
                    out[test] = part.predict(renumber[rows[~inside]], cols[~inside], dense[test])
            links.append(LinearModel.fit(rows, cols, len(chosen), dense, y))
            dense = np.column_stack([dense, out])
        return cls(chosen, links)

    def predict(self, features: list[list[int]]) -> np.ndarray:
        n = len(features)
        rows = np.repeat(np.arange(n), [len(f) for f in features])
        cols = np.array([i for f in features for i in f], np.int64)
        out = np.zeros((n, 0))
        for link in self.links:
            out = np.column_stack([out, link.predict(rows, cols, out)])
        return out


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], max_labelled: int = 20_000, max_features: int = 2_000, min_z: float = 5.0, folds: int = 3) -> ClassifierChain:
    """labels has doc_id; categories maps each name to a boolean expression over its columns, in the order
    of the chain. Rows with a null doc_id or category are left out."""
    names = list(categories)
    wanted = labels.select("doc_id", *(c.cast("int").alias(f"c{i}") for i, c in enumerate(categories.values()))).dropna().groupBy("doc_id").agg(*(F.max(f"c{i}").alias(f"c{i}") for i in range(len(categories))))
    # at most max_labelled rows of a few integers: a proven bound for the broadcast
    sample = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = materialise(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "labelled")

    def counts(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE):
                b = batch.slice(start, _SLICE)
                ys = np.array([b.column(2 + i).to_pylist() for i in range(len(names))], np.int64).reshape(len(names), -1)
                ids, sizes = array("q"), []
                for text in b.column(1).to_pylist():
                    got = {f for w in set((text or "").lower().split()) for f in word_features(w)}
                    ids.extend(got)
                    sizes.append(len(got))
                found, at = np.unique(np.frombuffer(ids, np.int64), return_inverse=True)
                who = np.repeat(np.arange(len(sizes)), sizes)
                n = np.bincount(at, minlength=len(found)).astype(np.int64)
                positive = [np.bincount(at, y[who], len(found)).astype(np.int64) for y in ys]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (found, n, *positive)], ["feature", "n", *(f"p{i}" for i in range(len(names)))])

    schema = ", ".join(["feature long", "n long", *(f"p{i} long" for i in range(len(names)))])
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"c{i}").alias(f"p{i}") for i in range(len(names)))).first()
    per_feature = materialise(rows.mapInArrow(counts, schema).groupBy("feature").agg(*(F.sum(c).alias(c) for c in ["n", *(f"p{i}" for i in range(len(names)))])), "feature-counts")
    chosen: dict[int, int] = {}
    for i in range(len(names)):
        share = (totals[f"p{i}"] or 0) / max(1, totals["n"])
        if not 0 < share < 1:
            continue
        z = (F.col(f"p{i}") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
        best = per_feature.filter("n >= 3").select("feature", z.alias("z")).filter(F.col("z") >= min_z).orderBy(F.desc("z"), "feature").limit(max_features)
        for r in best.collect():
            chosen.setdefault(r.feature, len(chosen))

    def known(batches):
        table = FeatureMap(chosen)
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE):
                b = batch.slice(start, _SLICE)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([table.document(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32())), *(b.column(2 + i) for i in range(len(names)))], ["doc_id", "features", *cs])

    cs = [f"c{i}" for i in range(len(names))]
    kind = docs.schema["doc_id"].dataType.simpleString()
    features = rows.mapInArrow(known, f"doc_id {kind}, features array<int>, " + ", ".join(f"{c} int" for c in cs))
    # bounded: at most max_labelled rows of at most max_features * len(categories) small integers
    data = features.groupBy("doc_id").agg(F.min("features").alias("features"), *(F.max(c).alias(c) for c in cs)).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    y = data[cs].to_numpy(np.int64)
    return ClassifierChain.fit(chosen, [list(f) for f in data["features"]], y, folds)


def score_toxicity(docs: DataFrame, chain: ClassifierChain, names: list[str], prefix: str = "p_") -> DataFrame:
    """Adds <prefix><category> for each category to the rows of docs, whose columns have other names."""
    shared = docs.sparkSession.sparkContext.broadcast((chain.chosen, chain.links))  # at most max_features a category
    fields = [f.name for f in docs.schema.fields]
    at = fields.index("text")

    def score(batches):
        chosen, links = shared.value
        model, table = ClassifierChain(chosen, links), FeatureMap(chosen)
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE):
                b = batch.slice(start, _SLICE)
                p = model.predict([table.document(t) for t in b.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, i]) for i in range(len(names)))], [*fields, *(prefix + n for n in names)])
        del model, table
        release_memory()

    columns = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{prefix}{n}` double" for n in names])
    return docs.mapInArrow(score, columns)


#: The chain over this corpus' labels: prose that is junk, toxic prose, and both at once.
CATEGORIES = ("low_quality", "toxic", "toxic_junk")


def categories() -> dict[str, Column]:
    poor, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return dict(zip(CATEGORIES, (poor, toxic, poor & toxic)))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.4, **options) -> DataFrame:
    """The rows of docs with p_<category>, toxic and kept."""
    chain = train_chain(docs, labels, categories(), **options)
    scored = score_toxicity(docs.drop(*(f"p_{c}" for c in CATEGORIES), "toxic", "kept"), chain, list(CATEGORIES))
    return scored.withColumn("toxic", F.col("p_toxic") >= threshold).withColumn("kept", F.col("p_toxic") < threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.4, **options) -> DataFrame:
    """The rows of docs that aren't toxic, with the columns of docs whatever their names."""
    chain = train_chain(docs, labels, categories(), **options)
    prefix = "__p_"
    while any(f.startswith(prefix) for f in docs.columns):
        prefix = "_" + prefix
    return score_toxicity(docs, chain, list(CATEGORIES), prefix).filter(F.col(f"{prefix}toxic") < threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
