"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

Nodes of a document are its pattern matches and the other chunks that hold a digit or '@'. Chain edges join
neighbours, twin edges join a node to a pattern match of the same content (a number's last seven digits, an
address' local part, or the text), skip edges to the next node of the same shape, so edges grow with the nodes and
not with their square. Labels are the four kinds and none. Loopy belief propagation passes messages along all until
each document's settle; pattern matches are clamped to their kind, so that they stay, and what they say reaches
repeated and similar chunks, a repeated one at any distance in one step. A free node whose best kind has at least
`min_probability` becomes a span. Twin edges begin at matches only: mentions that no pattern has ever matched
(a number that fails its check, written twice) say nothing to each other.

Parameters are fitted piecewise on a bounded sample (`max_sample` documents of smallest hash of doc_id among those
that have nodes). In training a share of the matches is hidden: they are free nodes whose kind is known, as those
will be that the patterns miss, and the edges are drawn as if no pattern had matched them. Node weights come from
multinomial logistic regression of kinds on shapes and neighbouring words, the potentials of each sort of edge from
counts of label pairs; those of twin edges begin with counts by which twins agree, since repeats are rare in small
samples. A free chunk of a match's content is no example of none; it is left out of the regression and has the
match's kind in the label pairs.

Defined results: null or empty text has no spans; a table without matches trains a model that adds nothing; of a
doc_id that repeats in the sample the text of smallest hash trains; repeated rows are judged alike; offsets are code
points, the end exclusive; counts are of pattern matches; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_CHUNK = re.compile(r"[^\s\"'<>,;|]*[0-9@][^\s\"'<>,;|]*")
_EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@")
_BUCKETS = 1 << 14
#: Pairs of each kind by which twins agree before any are seen, the largest log potential of chain and skip edges
#: and of twins, and the change of a message that counts as settled.
_AGREE, _MOST, _MOST_TWIN, _SETTLED = 1000.0, 3.0, 8.0, 1e-4
#: One match in so many is hidden in training.
_HIDDEN = 3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str):
    """Matches of _EMAIL, sought only in the runs of its characters around each '@'."""
    at = text.find("@")
    while at >= 0:
        a, b = at, at + 1
        while a > 0 and text[a - 1] in _EMAIL_CHARS:
            a -= 1
        while b < len(text) and text[b] in _EMAIL_CHARS:
            b += 1
        yield from ((m.start(), m.end()) for m in _EMAIL.finditer(text, a, b))
        at = text.find("@", b)


def pattern_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns' matches, by kind, then start."""
    if not text or not _ANY.search(text):
        return []
    spans = [(0, a, b) for a, b in _emails(text)]
    spans += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, m.start(), m.end()))
    spans += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return spans


def shape(token: str) -> str:
    """Runs of digits (with their length), letters and signs."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", token))


class Nodes:
    """The nodes of one document: spans, labels of those that patterns match (else NONE) and features."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        taken = sorted((a, b, kind) for kind, a, b in base)
        spans, end = [], -1
        for a, b, kind in taken:  # where two patterns match one place, the earlier and longer leads the node
            if a >= end:
                spans.append((a, b, kind))
                end = b
        covered = [(a, b) for a, b, _ in spans]
        k = 0
        for m in _CHUNK.finditer(text):
            a, b = m.span()
            while b > a and text[b - 1] in ".:!?)]}&%*#$":
                b -= 1
            while a < b and text[a] in "([{":
                a += 1
            while k < len(covered) and covered[k][1] <= a:
                k += 1
            if a < b and not (k < len(covered) and covered[k][0] < b):
                spans.append((a, b, NONE))
        spans.sort()
        self.spans = spans
        self.texts = [text[a:b] for a, b, _ in spans]
        self.shapes = [shape(t) for t in self.texts]
        self.features = [self._features(text, a, b, s) for (a, b, _), s in zip(spans, self.shapes)]

    @staticmethod
    def _features(text: str, a: int, b: int, s: str) -> list[int]:
        before, after = text[max(0, a - 24) : a].split(), text[b : b + 24].split()
        signs = "".join(sorted(set(re.sub(r"[a9]\d*", "", s))))
        digits = sum(c.isdigit() for c in text[a:b])
        names = ("s" + s, "g" + signs, f"d{min(digits, 20)}", f"l{min((b - a) // 4, 12)}", "b" + (before[-1].lower() if before else ""), "n" + (after[0].lower() if after else ""))
        return [zlib.crc32(n.encode()) % _BUCKETS for n in names]

    def edges(self, hidden: frozenset[int] = frozenset()) -> list[list[tuple[int, int]]]:
        """Chain, twin and skip edges: neighbours; a node and the last match of its content before it (or the
        first behind it); successive nodes of one shape. Hidden matches count as nodes that no pattern matches."""
        chain = [(i, i + 1) for i in range(len(self.spans) - 1)]
        twin, skip, last = [], [], {}
        keys = [content(t) for t in self.texts]
        sure = [kind != NONE and i not in hidden for i, (_, _, kind) in enumerate(self.spans)]
        match = {}
        for i in reversed(range(len(keys))):
            if sure[i]:
                match[keys[i]] = i
        for i, (key, s) in enumerate(zip(keys, self.shapes)):
            to = match.get(key, i)
            if to != i:
                twin.append((to, i))
            if sure[i]:
                match[key] = i
            if s in last:
                skip.append((last[s], i))
            last[s] = i
        return [chain, twin, skip]

    def training(self) -> tuple[list[int], list[int], list[list[tuple[int, int]]]]:
        """(label of each node, nodes whose label is sure, edges) with a share of the matches hidden, by content,
        place and neighbourhood. A node that patterns miss has the kind of the match that it repeats."""
        hidden = frozenset(i for i, (a, _, kind) in enumerate(self.spans) if kind != NONE and zlib.crc32(f"{a} {self.texts[i]}".encode()) % _HIDDEN == 0)
        label = [kind for _, _, kind in self.spans]
        for a, b in self.edges()[1]:
            if self.spans[b][2] == NONE:
                label[b] = self.spans[a][2]
        return label, [i for i, (_, _, kind) in enumerate(self.spans) if kind == label[i]], self.edges(hidden)


def content(token: str) -> tuple[str, str]:
    """What repeated mentions of one thing have in common however they are written."""
    digits = re.sub(r"\D", "", token)
    if len(digits) >= 7 and not re.search(r"[^\W\d_]", token):
        return "digits", digits[-7:]
    return "text", token.lower().partition("@")[0] or token.lower()


class SkipChainCRF:
    """weights: a row of kinds for each feature bucket; potentials: log potentials of label pairs for each
    sort of edge (chain, twin, skip)."""

    def __init__(self, weights: np.ndarray, potentials: list[np.ndarray]):
        self.weights, self.potentials = weights, potentials

    @classmethod
    def fit(cls, features: np.ndarray, labels: np.ndarray, pairs: list[np.ndarray], steps: int = 200, l2: float = 1e-3) -> SkipChainCRF:
        """features: (nodes, 6) buckets; pairs: for chain, twin and skip edges (edges, 2) labels of their ends."""
        k, n = NONE + 1, len(labels)
        w = np.zeros((_BUCKETS, k))
        if n:
            used, local = np.unique(features, return_inverse=True)
            local = local.reshape(features.shape)
            v, mean = np.zeros((len(used), k)), np.eye(k)[labels]
            for step in range(steps):
                z = v[local].sum(1)
                z -= z.max(1, keepdims=True)
                e = np.exp(z)
                g = (e / e.sum(1, keepdims=True) - mean) / n
                grad = np.stack([sum(np.bincount(local[:, f], g[:, c], len(used)) for f in range(local.shape[1])) for c in range(k)], 1)
                v -= (2.0 / features.shape[1]) * 4 * (grad + l2 * v / 10)
            w[used] = v
        else:
            w[:, NONE] = 1.0

        def joint(pairs: np.ndarray, before: np.ndarray) -> np.ndarray:
            """Shares of the label pairs, in either order; before: counts to begin with."""
            counts = 1.0 + before
            np.add.at(counts, (pairs[:, 0], pairs[:, 1]), 1.0)
            return (counts + counts.T) / (2 * counts.sum())

        def potential(pairs: np.ndarray) -> np.ndarray:
            """log of how much likelier two labels meet on an edge than apart."""
            j = joint(pairs, np.zeros((k, k)))
            return np.clip(np.log(j / np.outer(j.sum(1), j.sum(1))), -_MOST, _MOST)

        chain, twin, skip = pairs
        # a twin edge begins at a match, so what counts is how likely each label is behind a match's kind
        given = joint(twin, _AGREE * np.diag([1.0] * NONE + [0.0]))
        given = np.maximum(np.log(given / given.max(1, keepdims=True)), -_MOST_TWIN)
        return cls(w, [potential(chain), given, potential(skip)])

    def marginals(self, features: np.ndarray, clamped: np.ndarray, sorts: list[np.ndarray], doc: np.ndarray, damping: float = 0.3) -> np.ndarray:
        """Beliefs of the nodes of many documents at once by damped loopy sum-product; clamped: label or -1;
        doc: which document a node belongs to. A document rests when its messages have settled."""
        n, k = len(features), NONE + 1
        node = self.weights[features].sum(1) if n else np.zeros((0, k))
        held = np.flatnonzero(clamped >= 0)
        node[held] = -30.0
        node[held, clamped[held]] = 0.0
        edges = np.concatenate(sorts).reshape(-1, 2)
        pot = np.concatenate([np.broadcast_to(p, (len(e), k, k)) for p, e in zip(self.potentials, sorts)])
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(src), k))
        live, of, rounds = np.arange(len(src)), doc[src], 0
        while len(live):
            total = node.copy()
            np.add.at(total, dst[live], message[live])
            into = (total[src[live]] - message[back[live]])[:, :, None] + pot[live]
            top = into.max(1)
            new = top + np.log(np.exp(into - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            new = damping * message[live] + (1 - damping) * new
            moved = np.zeros(int(doc[-1]) + 1)
            np.maximum.at(moved, of[live], np.abs(new - message[live]).max(1))
            message[live] = new
            live = live[moved[of[live]] > _SETTLED]
            rounds += 1
            if rounds % 100 == 0:  # messages that go round in circles are damped until they rest
                damping = (1 + damping) / 2
        np.add.at(node, dst, message)
        node -= node.max(1, keepdims=True)
        e = np.exp(node)
        return e / e.sum(1, keepdims=True)


def train_crf(docs: DataFrame, max_sample: int = 4_000) -> SkipChainCRF:
    """Fit on at most max_sample documents that have a digit or '@'."""
    docs = docs.select("doc_id", "text")
    able = docs.filter(F.col("text").rlike("[0-9@]"))
    # at most max_sample ids: a proven bound for the broadcast
    ids = materialise(able.select("doc_id").dropna().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample).distinct(), "pii-sample")
    sample = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def nodes(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for text in batch.column(1).slice(at, 512).to_pylist():
                    d = Nodes(text or "", pattern_spans(text))
                    label, sure, edges = d.training()
                    rows.append(([x for i in sure for x in d.features[i]], [label[i] for i in sure], *([label[i] for e in found for i in e] for found in edges)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in range(5)], names)

    # bounded by max_sample documents; a node is 6 small integers
    names = ["features", "labels", "chain", "twin", "skip"]
    data = sample.mapInArrow(nodes, ", ".join(f"{n} array<int>" for n in names)).toPandas()
    flat = lambda c, width: np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in data[c])]).reshape(-1, width)
    return SkipChainCRF.fit(flat("features", 6), flat("labels", 1).ravel(), [flat(c, 2) for c in names[2:]])


def add_spans(texts: list[str | None], crf: SkipChainCRF, min_probability: float) -> list[tuple[list, list]]:
    """(pattern spans, all spans) of each text; the field runs over all texts of the batch at once."""
    bases = [pattern_spans(t) for t in texts]
    docs = [Nodes(t, b) if t and _ANY.search(t) else None for t, b in zip(texts, bases)]
    features, clamped, sorts, offset, of, n = [], [], ([], [], []), [], [], 0
    for k, d in enumerate(docs):
        offset.append(n)
        if d:
            features += d.features
            clamped += [-1 if kind == NONE else kind for _, _, kind in d.spans]
            for found, edges in zip(sorts, d.edges()):
                found += [(i + n, j + n) for i, j in edges]
            of += [k] * len(d.spans)
            n += len(d.spans)
    belief = crf.marginals(np.array(features, np.int64).reshape(-1, 6), np.array(clamped, np.int64), [np.array(e, np.int64).reshape(-1, 2) for e in sorts], np.array(of, np.int64))
    best, sure = belief[:, :NONE].argmax(1), belief[:, :NONE].max(1, initial=0.0)
    out = []
    for d, base, at in zip(docs, bases, offset):
        more = [(int(best[at + i]), a, b) for i, (a, b, kind) in enumerate(d.spans) if kind == NONE and sure[at + i] >= min_probability] if d else []
        out.append((base, sorted({*base, *more})))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, min_probability: float = 0.8, max_sample: int = 4_000) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    crf = train_crf(docs, max_sample)
    shared = docs.sparkSession.sparkContext.broadcast((crf.weights, crf.potentials))  # 0.7 MB at any size of docs

    def run(batches):
        model = SkipChainCRF(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                got = add_spans(b.column(1).to_pylist(), model, min_probability)
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in got], pa.int64()) for k in range(NONE)]
                hashes = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in got]
                yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(hashes), pa.array([written(s) for _, s in got])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
