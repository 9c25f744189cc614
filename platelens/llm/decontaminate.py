"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are taken in blocks of bounded size, so whatever a task holds of them is bounded; every document
meets every block. For a block: document frequencies of its words over all documents, TF-IDF passages of the
items and of all documents, a randomised SVD whose sums Spark makes over the passages, and then a pass over all
documents: each window of words is projected and candidate items are those of sufficient cosine. A
candidate counts as a leak when the longest common subsequence of the item and the words around the window covers
at least `near` of the item, or at least `loose` of it (a paraphrase) with the answer, the item's last words,
covered as well. Windows are passed over only if the words around them prove that no item can be covered by
`loose`: too few of the rare words, or too little weight, for any subset of that many of its words.

Items of fewer than `min_words` words are too short for a paraphrase to be told from chance; they leak where all
their words follow each other, and this is checked exactly.

Defined results: null or empty text or items match nothing, nor do items of one or two words, which chance would
match; without items everything is kept; repeated rows are judged alike, each by its own text; extra columns don't
matter and pass through drop_leaks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory
from .shingles import mix, word_values

#: Words are what white space and ASCII signs separate.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_hashes(texts: list[bytes | None], stretch: int = 1 << 19):
    """(text numbers, hashes) of the words of the texts, some texts at a time. Case is folded for A-Z and the
    letters of Latin-1."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size < stretch):
            size += len(texts[upto] or b"") + 1
            upto += 1
        part = [t or b"" for t in texts[at:upto]]
        data = np.frombuffer(b"\n".join(part) + b"\n", np.uint8).copy()
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[capital] += 0x20
        start, h = word_values(data, _BETWEEN)
        ends = np.cumsum([len(t) + 1 for t in part])
        yield at + np.searchsorted(ends, start, side="right"), h
        at = upto


class WordIndex:
    """Hash of a word to its index in the block's vocabulary, or -1."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        # most words of a text aren't in the vocabulary, and a table of hash prefixes says so at once
        self.shift = np.uint64(64 - min(24, max(16, 5 + len(hashes).bit_length())))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[hashes >> self.shift] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        maybe = np.flatnonzero(self.table[hashes >> self.shift])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), len(self.sorted) - 1)
            hit = self.sorted[at] == hashes[maybe]
            out[maybe[hit]] = self.order[at[hit]]
        return out

    def texts(self, texts: list[bytes | None]):
        """(number of the text, its word indices), for texts that have words."""
        for number, h in word_hashes(texts):
            index = self.of(h)
            cut = np.flatnonzero(np.diff(number)) + 1
            for n, words in zip(number[np.concatenate([[0], cut])] if len(number) else [], np.split(index, cut)):
                yield int(n), words


class Block:
    """Items of one block: word indices, weights, and the latent space once it is fitted. Items of fewer than
    min_words words are in short_ids and shorts."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, least_words: int = 3):
        self.ids, self.items, self.short_ids, self.shorts, vocabulary = [], [], [], [], {}
        texts = [(t or "").encode() for _, t in items]
        for number, h in word_hashes(texts):
            cut = np.flatnonzero(np.diff(number)) + 1
            for n, words in zip(number[np.concatenate([[0], cut])].tolist() if len(number) else [], np.split(h, cut)):
                if len(words) >= least_words:
                    index = np.array([vocabulary.setdefault(x, len(vocabulary)) for x in words.tolist()], np.int32)
                    (self.ids if len(words) >= min_words else self.short_ids).append(items[n][0])
                    (self.items if len(words) >= min_words else self.shorts).append(index)
        self.hashes = np.array(list(vocabulary), np.uint64)
        self.rare = np.zeros(len(vocabulary), bool)
        self.idf = np.ones(len(vocabulary), np.float32)
        self.basis = np.zeros((len(vocabulary), 0), np.float32)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, word, weight) of the TF-IDF rows of the items, of length 1."""
        item = np.repeat(np.arange(len(self.items)), [len(w) for w in self.items])
        word = np.concatenate([np.zeros(0, np.int32), *self.items]).astype(np.int64)
        key, tf = np.unique(item * len(self.hashes) + word, return_counts=True)
        item, word = key // max(1, len(self.hashes)), key % max(1, len(self.hashes))
        weight = tf * self.idf[word]
        return item, word, (weight / np.sqrt(np.bincount(item, weight.astype(np.float64) ** 2, len(self.items)))[item]).astype(np.float32)

    def size_classes(self) -> list[tuple[int, np.ndarray]]:
        """(window, items): items by length, each class in windows that hold its longest."""
        sizes = np.array([len(w) for w in self.items])
        classes, window = [], 16
        while len(sizes) and window // 2 < max(sizes.max(), 16):
            at = np.flatnonzero((sizes <= window) & ((sizes > window // 2) | (window == 16)))
            if len(at):
                classes.append((window, at))
            window *= 2
        return classes


def _row_sums(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows of each of n groups, for sorted groups."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(group):
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[group[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _passages(number: np.ndarray, words: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """(the passage of each word, how many there are): texts in stretches of `window` words, of which a text's last
    one takes what would not fill another half."""
    new = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    sizes = np.diff(np.append(new, len(words)))
    count = np.maximum(1, -(-(sizes - window // 2) // window))
    place = np.arange(len(words)) - np.repeat(new, sizes)
    return np.repeat(np.cumsum(count) - count, sizes) + np.minimum(place // window, np.repeat(count - 1, sizes)), int(count.sum())


def _line_sums(group: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the groups, the sums of each line over each of them), for sorted groups."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return group[first], np.add.reduceat(lines, first, axis=1)


def fit_block(docs: DataFrame, block: Block, rank: int, window: int = 48, seed: int = 7, rare_share: float = 0.02) -> None:
    """Weights and the latent basis, both from all documents; the basis from the items as well."""
    d = len(block.hashes)
    vocabulary = docs.sparkSession.sparkContext.broadcast(block.hashes)  # at most the words of block_items items

    def frequencies(batches):
        index, seen, n = WordIndex(vocabulary.value), np.zeros(d, np.int64), 0
        for b in batches:
            n += b.num_rows
            for at in range(0, b.num_rows, 1024):
                for number, h in word_hashes(b.column(0).slice(at, 1024).to_pylist()):
                    words = index.of(h)
                    known = np.flatnonzero(words >= 0)
                    pairs = np.unique(number[known].astype(np.int64) * d + words[known])
                    seen += np.bincount(pairs % d, minlength=d)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(seen[at], n), pa.int64())], ["word", "n"])

    texts = docs.select(F.col("text").cast("binary").alias("text"))
    found = {r.word: r.n for r in texts.mapInArrow(frequencies, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row per word of the block
    n = found.pop(-1, 0)
    df = np.zeros(d)
    df[list(found)] = list(found.values())
    block.idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(1e-3)
    block.rare = df <= rare_share * n

    item, word, weight = block.rows()
    by_word, width, idf = np.argsort(word, kind="stable"), min(rank + 10, d), block.idf

    def times(x: np.ndarray) -> np.ndarray:
        """The items' rows times x, some columns at a time."""
        return np.hstack([_row_sums(item, weight[:, None] * x[word, c : c + 8], len(block.items)) for c in range(0, x.shape[1], 8)])

    def transposed(y: np.ndarray) -> np.ndarray:
        return np.hstack([_row_sums(word[by_word], weight[by_word][:, None] * y[item[by_word], c : c + 8], d) for c in range(0, y.shape[1], 8)])

    def sketched(project: np.ndarray) -> np.ndarray:
        """Sum over the passages of all documents of a'(aP): a task adds up its own, Spark the tasks'."""
        context = docs.sparkSession.sparkContext
        shared = context.broadcast(np.ascontiguousarray(project.T))

        def partial(batches):
            p, index = shared.value, WordIndex(vocabulary.value)
            total = np.zeros(p.shape, np.float64)
            for b in batches:
                for lo in range(0, b.num_rows, 1024):
                    for number, h in word_hashes(b.column(0).slice(lo, 1024).to_pylist()):
                        words = index.of(h)
                        passage, n = _passages(number, words, window)
                        known = words >= 0
                        if not known.any():
                            continue
                        key, tf = np.unique(passage[known] * d + words[known], return_counts=True)
                        of, at = key // d, key % d
                        a = tf * idf[at]
                        a = (a / np.sqrt(np.bincount(of, a.astype(np.float64) ** 2, n))[of]).astype(np.float32)
                        by_word = np.argsort(at, kind="stable")
                        there, a_by_word, of_by_word = at[by_word], a[by_word], of[by_word]
                        y = np.zeros((8, n), np.float32)
                        for c in range(0, len(p), 8):
                            own, y_own = _line_sums(of, p[c : c + 8].take(at, axis=1) * a)
                            y[: len(y_own), own] = y_own
                            own, sums = _line_sums(there, y[: len(y_own)].take(of_by_word, axis=1) * a_by_word)
                            total[c : c + 8, own] += sums
            parts = range(0, d, 32)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([TaskContext.get().partitionId()] * len(parts), pa.int64()), pa.array([np.ascontiguousarray(total[:, r : r + 32]).tobytes() for r in parts], pa.binary())], ["row", "task", "part"])

        def add(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"row": [part["row"].iloc[0]], "part": [sum(np.frombuffer(x, np.float64) for x in part.sort_values("task")["part"]).tobytes()]})

        # a task's sums are as large as the basis, so there are some for each core and not for each part of the input
        few = texts.coalesce(16 * context.defaultParallelism)
        got = few.mapInArrow(partial, "row long, task long, part binary").groupBy("row").applyInPandas(add, "row long, part binary").collect()  # d * (rank + 10) numbers
        out = np.zeros((d, project.shape[1]))
        for r in got:
            out[r.row : r.row + 32] = np.frombuffer(r.part, np.float64).reshape(project.shape[1], -1).T
        shared.unpersist()
        return out

    omega = np.random.default_rng(seed).standard_normal((d, width)).astype(np.float32)
    corpus = sketched(omega)
    mine = transposed(times(omega))
    share = max(1.0, np.linalg.norm(corpus) / max(np.linalg.norm(mine), 1e-9))  # both halves weigh alike
    # of the sum of both, which is symmetric and without negative eigenvalues, its product with omega is enough (Nystrom)
    y = corpus + share * mine
    core = omega.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    kept = values > max(values[-1], 0) * 1e-7
    left = np.linalg.svd(y @ (vectors[:, kept] / np.sqrt(values[kept])), full_matrices=False)[0]
    block.basis = left[:, :rank].astype(np.float32)


def lcs(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel: masks has the places of each word in the item."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = masks.get(w, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


class Matcher:
    """Leaks in many texts at once. A text's words are indices, -1 for those that no item has."""

    def __init__(self, block: Block, cosine: float, near: float, loose: float, answer: float):
        self.block, self.cosine, self.near, self.loose, self.answer, self.words = block, cosine, near, loose, answer, len(block.hashes)
        self.loaded = block.basis * block.idf[:, None]  # a word's share of a projected window; the last row is no word's
        self.mass = np.append(block.idf, 0).astype(np.float64)  # the last one: no word of the block
        self.rare = np.append(block.rare, False)
        # what the words around a window have at least if they cover `loose` of an item: weight, and rare words
        self.least, self.need = np.zeros(len(block.items)), np.zeros(len(block.items), np.int64)
        self.covered = np.zeros(len(block.items), np.int64)
        self.masks = []
        for k, w in enumerate(block.items):
            self.covered[k] = covered = int(np.ceil(loose * len(w) - 1e-9))
            self.least[k] = np.sort(block.idf[w])[:covered].sum() * (1 - 1e-5)
            self.need[k] = max(0, int(block.rare[w].sum()) - (len(w) - covered))
            places: dict[int, int] = {}
            for i, x in enumerate(w.tolist()):
                places[x] = places.get(x, 0) | 1 << i
            self.masks.append(places)
        self.loaded = np.vstack([self.loaded, np.zeros((1, self.loaded.shape[1]), np.float32)])
        # items of one window, parted by how many rare words they need, so that the others' windows are few
        self.classes = []
        for window, every in block.size_classes():
            level = np.searchsorted([1, 3, 6], self.need[every], side="right")
            for at in (every[level == x] for x in np.unique(level)):
                rows = np.stack([self.loaded[block.items[k]].sum(0) for k in at])
                self.classes.append((window, at, (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)).T.copy()))
        # (item, word) of all items and how often each occurs
        keys = np.concatenate([np.zeros(0, np.int64), *(k * self.words + w.astype(np.int64) for k, w in enumerate(block.items))])
        self.bag, self.times = np.unique(keys, return_counts=True)
        self.shorts: dict[int, list[int]] = {}
        for k, w in enumerate(block.shorts):
            self.shorts.setdefault(len(w), []).append(k)

    def candidates(self, number: np.ndarray, words: np.ndarray) -> np.ndarray:
        """(text, item, start, first and last word around it, half a window) of windows with a sufficient cosine.
        number: the text of each word; windows and what lies around them end with their text."""
        mass = np.concatenate([[0], np.cumsum(self.mass[words])])
        rare = np.concatenate([[0], np.cumsum(self.rare[words])])
        new = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        sizes, found, last = np.diff(np.append(new, len(words))), [], 0
        # each text is laid out from a multiple of the largest step on, with room behind it for a window's rest
        widest = max((c[0] for c in self.classes), default=16) // 4
        room = -(-(sizes + 3 * widest) // widest) * widest
        base = np.cumsum(room) - room
        laid = np.full(int(room.sum()), -1, np.int32)
        laid[np.arange(len(words)) + np.repeat(base - new, sizes)] = words
        for window, at, items in self.classes:
            step = window // 4
            if window != last:  # windows are four blocks of words, and blocks are two of the last class' blocks
                if last:
                    for _ in range((window // last).bit_length() - 1):
                        blocks = blocks[::2] + blocks[1::2]
                else:
                    blocks = np.concatenate([self.loaded[laid[lo : lo + 4096 * step]].reshape(-1, step, self.loaded.shape[1]).sum(1) for lo in range(0, len(laid), 4096 * step)])
                last = window
                z = blocks.copy()
                for k in range(1, 4):
                    z[:-k] += blocks[k:]
                least_dot = self.cosine * np.maximum(np.linalg.norm(z, axis=1), 1e-9)
                windows = np.maximum(1, -(-(sizes - window) // step) + 1)
                text = np.repeat(np.arange(len(new)), windows)
                offset = (np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)) * step
                start = new[text] + offset
                a, b = np.maximum(start - window // 2, new[text]), np.minimum(start + window + window // 2, new[text] + sizes[text])
                weight, rares, block = mass[b] - mass[a], rare[b] - rare[a], (base[text] + offset) // step
            able = np.flatnonzero((weight >= self.least[at].min()) & (rares >= self.need[at].min()))
            for lo in range(0, len(able), 4096):
                w = able[lo : lo + 4096]
                i, k = np.nonzero(z[block[w]] @ items >= least_dot[block[w], None])
                k, w = at[k], w[i]
                ok = (weight[w] >= self.least[k]) & (rares[w] >= self.need[k])
                k, w = k[ok], w[ok]
                found.append(np.stack([number[start[w]], k, start[w], a[w], b[w], np.full(len(w), window // 2)], 1))
        return np.concatenate(found) if found else np.zeros((0, 6), np.int64)

    def _able(self, pairs: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Those of the candidates whose item shares enough words with the stretch around, in whatever order."""
        keep = np.zeros(len(pairs), bool)
        for lo in range(0, len(pairs), 4096):
            item, a, b = pairs[lo : lo + 4096, 1], pairs[lo : lo + 4096, 3], pairs[lo : lo + 4096, 4]
            pair = np.repeat(np.arange(len(item)), b - a)
            word = words[a[pair] + np.arange(len(pair)) - np.repeat(np.cumsum(b - a) - b + a, b - a)]
            pair, word = pair[word >= 0], word[word >= 0]
            at = np.minimum(np.searchsorted(self.bag, item[pair] * self.words + word), len(self.bag) - 1)
            hit = self.bag[at] == item[pair] * self.words + word
            key, often = np.unique(pair[hit] * len(self.bag) + at[hit], return_counts=True)
            shared = np.bincount(key // len(self.bag), np.minimum(often, self.times[key % len(self.bag)]), len(item))
            keep[lo : lo + 4096] = shared >= self.covered[item]
        return pairs[keep]

    def matches(self, number: np.ndarray, words: np.ndarray) -> list[tuple[int, int, float]]:
        """(text, item_id, covered share) of the leaks."""
        if not len(words):
            return []
        best: dict[tuple[int, int], float] = {}
        done: dict[tuple[int, int], int] = {}
        for text, k, start, a, b, half in sorted(self._able(self.candidates(number, words), words).tolist()):
            key = text, k
            if start < done.get(key, -1):
                continue
            # neighbouring windows share one stretch, cut so that chance does not fill it up
            done[key] = start + half
            stretch, n = words[a:b].tolist(), len(self.block.items[k])
            share = lcs(self.masks[k], n, stretch) / n
            if share > best.get(key, 0.0) and (share >= self.near or share >= self.loose and self._answered(k, stretch)):
                best[key] = share
        found = [(text, self.block.ids[k], share) for (text, k), share in best.items()]
        return found + [(text, self.block.short_ids[k], 1.0) for text, k in self._whole(number, words)]

    def _answered(self, k: int, stretch: list[int]) -> bool:
        tail = self.block.items[k][-max(3, len(self.block.items[k]) // 4) :].tolist()
        places: dict[int, int] = {}
        for i, x in enumerate(tail):
            places[x] = places.get(x, 0) | 1 << i
        return lcs(places, len(tail), stretch) >= self.answer * len(tail)

    def _whole(self, number: np.ndarray, words: np.ndarray) -> set[tuple[int, int]]:
        """(text, short item) where all words of the item follow each other."""
        found = set()
        for size, items in self.shorts.items():
            if len(words) < size:
                continue
            n = len(words) - size + 1
            h, own = np.zeros(n, np.uint64), np.zeros(len(items), np.uint64)
            table = np.stack([self.block.shorts[k] for k in items])
            for j in range(size):
                h, own = mix(h ^ (words[j : j + n] + 1).astype(np.uint64)), mix(own ^ (table[:, j] + 1).astype(np.uint64))
            for p in np.flatnonzero(np.isin(h, own) & (number[:n] == number[size - 1 :])).tolist():
                for k in np.flatnonzero((table == words[p : p + size]).all(1)).tolist():
                    found.add((int(number[p]), items[k]))
        return found


def _judged(
    docs: DataFrame,
    benchmark: DataFrame,
    found: str,
    cover: str,
    rank: int | None = None,
    cosine: float = 0.5,
    near: float = 0.8,
    loose: float = 0.6,
    answer: float = 0.7,
    min_words: int = 8,
    block_items: int = 20_000,
    block_chars: int = 16 << 20,
) -> DataFrame:
    """docs (with doc_id and text) and two columns more, `found` and `cover`: ids of the leaking items and the
    largest covered share. Without a rank it grows with the block's items, from 64 to 256."""
    spark = docs.sparkSession
    size = benchmark.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size.n // block_items), -(-size.chars // block_chars))
    # ids of any type, null among them; an item has its place in its block for a name in the tasks
    result = docs.withColumn(found, F.array().cast(f"array<{benchmark.schema['item_id'].dataType.simpleString()}>")).withColumn(cover, F.lit(0.0))
    schema, at = result.schema, docs.columns.index("text")
    for number in range(blocks):
        # about block_items items, or block_chars characters, reach the driver and the tasks at once
        part = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).select("item_id", "text").collect()
        part.sort(key=lambda r: (r.item_id is None, r.item_id if r.item_id is not None else r.text or ""))
        block = Block([(k, r.text) for k, r in enumerate(part)], min_words)
        if not len(block.hashes):
            continue
        fit_block(docs, block, rank or min(256, max(64, len(block.items) // 32)))
        shared = spark.sparkContext.broadcast((block, [r.item_id for r in part]))

        def search(batches, shared=shared):
            release_memory()  # of the stages before
            block, names = shared.value
            matcher, index = Matcher(block, cosine, near, loose, answer), WordIndex(block.hashes)
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    b = batch.slice(lo, 1024)
                    ids, cover_ = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
                    for number, h in word_hashes(b.column(at).cast(pa.binary()).to_pylist()):
                        for i, item, share in sorted(matcher.matches(number, index.of(h))):
                            ids[i].append(names[item])
                            cover_[i] = max(cover_[i], share)
                    yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(ids, b.column(b.num_columns - 2).type), pa.array(cover_, pa.float64())], b.schema.names)

        result = result.mapInArrow(search, schema)
    return result


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_ids, coverage, contaminated, kept) for every row of docs. Options: see _judged."""
    rows = _judged(docs.select("doc_id", "text"), benchmark, "item_ids", "coverage", **options)
    return rows.select("doc_id", "item_ids", "coverage", (F.col("coverage") > 0).alias("contaminated"), (F.col("coverage") == 0).alias("kept"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without a leak, each judged by its own text; the columns of docs, whatever their names."""
    found, cover = "__item_ids", "__coverage"
    while {found, cover} & set(docs.columns):
        found, cover = "_" + found, "_" + cover
    return _judged(docs, benchmark, found, cover, **options).filter(F.col(cover) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
