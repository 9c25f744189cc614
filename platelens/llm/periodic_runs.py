"""Periodic runs of words: stretches in which a short sequence of words comes again and again.

Only places whose next words (the fewest that a run's second copy must share) come again in the document can begin
a run, so the suffixes at those places are all that is sorted. Each document's suffixes are put in order by
doubling, and the length that neighbours share is read off the ranks at each width. Neighbours are then united by decreasing shared length, Kruskal's way: a union-find names the
classes, and each class keeps its places in order. When a union makes places i < j neighbours, they share exactly the
length at hand, l; with j - i = q at most l / (exponent - 1), words from i to j + l have the smallest period q, and
they are a run if the word before i does not go on with it. No shorter period hides in between, since a place
between i and j that shared l words with i would have become j's neighbour first.

Defined results: null texts, empty ones and ones without words have no runs and an empty collapsed text; every row is
a document of its own; an empty table gives no rows; extra columns don't matter. A document is one row of one task,
whatever its length; the work is n log n in its words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix

RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def repeating_places(codes: np.ndarray, size: int) -> np.ndarray:
    """The places whose next `size` words come at another place too (by hash: never fewer, hardly ever more)."""
    n = len(codes) - size + 1
    if n < 2:
        return np.zeros(0, np.int64)
    window, at, width = np.zeros(n, np.uint64), 0, 1
    power = mix(codes.astype(np.uint64) + np.uint64(1))
    while width <= size:  # windows of 1, 2, 4, ... words; those that make up `size` are strung together
        if size & width:
            window = mix(window ^ power[at : at + n]) + np.uint64(width)
            at += width
        if 2 * width <= size:
            power = mix(power[:-width] + np.uint64(0x9E3779B97F4A7C15) * mix(power[width:]))
        width *= 2
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return np.flatnonzero(again)


def suffix_neighbours(codes: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(the places in the order of their suffixes, words that each shares with the one before). Suffixes at other
    places than these differ from all others within `size` words, so after that many only these are sorted on."""
    n = len(codes)
    # a suffix's rank is the number of smaller ones, by their first `width` words; the end is smaller than all words
    every = np.arange(n)
    rank = _refined(np.zeros(n, np.int64), codes)
    width, ranks = 1, [(1, rank)]
    while width < size:
        rank = _refined(rank, _behind(rank, every, width))
        width *= 2
        ranks.append((width, rank))
    own = places.astype(np.int64)
    while len(np.unique(rank[own])) < len(own):
        finer = rank.copy()
        finer[own] = _refined(rank[own], _behind(rank, own, width))
        rank, width = finer, 2 * width
        ranks.append((width, rank))
    order = own[np.argsort(rank[own])]
    m = len(own)
    shared = np.zeros(m, np.int64)
    a, b = order[:-1], order[1:]
    for width, rank in reversed(ranks):
        x, y = a + shared[1:], b + shared[1:]
        inside = (x < n) & (y < n)
        equal = inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
        shared[1:] += width * equal
    return order, shared


def _behind(rank: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Ranks of what follows `width` words behind the places, 0 for the end."""
    at = places + width
    return np.where(at < len(rank), rank[np.minimum(at, len(rank) - 1)] + 1, 0)


def _refined(rank: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Ranks, of which equal ones are told apart by what follows."""
    order = np.lexsort((follow, rank))
    by_rank, by_follow, at = rank[order], follow[order], np.arange(len(order))
    group = np.diff(by_rank, prepend=-1) != 0
    part = group | (np.diff(by_follow, prepend=-1) != 0)
    out = np.empty(len(order), np.int64)
    out[order] = by_rank + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
    return out


class OrderedPlaces:
    """A set of places in order, in blocks, so that an insertion moves few of them."""

    BLOCK = 1024
    __slots__ = ("blocks", "lows", "size")

    def __init__(self, place: int):
        self.blocks, self.lows, self.size = [[place]], [place], 1

    def add(self, place: int) -> tuple[int, int]:
        """(the place before, the place behind), -1 for none."""
        k = max(0, bisect_left(self.lows, place) - 1)
        block = self.blocks[k]
        i = bisect_left(block, place)
        before = block[i - 1] if i else -1
        behind = block[i] if i < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1
        block.insert(i, place)
        self.lows[k] = block[0]
        self.size += 1
        if len(block) > 2 * self.BLOCK:
            self.blocks[k : k + 1] = [block[: self.BLOCK], block[self.BLOCK :]]
            self.lows[k : k + 1] = [block[0], block[self.BLOCK]]
        return before, behind

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def seeds(order: np.ndarray, shared: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(i, j, shared words) of places i < j that a union of classes makes neighbours, by decreasing shared length
    down to `least`."""
    parent = list(range(len(order)))
    places: list[OrderedPlaces | None] = [OrderedPlaces(p) for p in order.tolist()]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    at, beyond = np.argsort(-shared, kind="stable"), int(order.max()) + 1
    for k, length in zip(at.tolist(), shared[at].tolist()):
        if length < least:
            break
        a, b = find(k - 1), find(k)
        big, small = (places[a], places[b]) if places[a].size >= places[b].size else (places[b], places[a])
        parent[b], places[b], places[a] = a, None, big
        last = -1
        incoming = list(small)
        for p, later in zip(incoming, [*incoming[1:], beyond]):
            before, behind = big.add(p)
            if before >= 0 and before != last:
                yield before, p, length
            if 0 <= behind < later:
                yield p, behind, length
            last = p


def runs_of(codes: np.ndarray, min_length: int = 24, exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least min_length words and `exponent` periods, by start and
    period."""
    # a run's first place shares length - q words with the place q behind; that is least where both bounds meet
    least = min(max((exponent - 1) * q, min_length - q) for q in range(1, min_length + 1))
    places = repeating_places(codes, least)
    if not len(places):
        return []
    order, shared = suffix_neighbours(codes, places, least)
    found = []
    for i, j, length in seeds(order, shared, least):
        q = j - i
        if length >= (exponent - 1) * q and length + q >= min_length and (i == 0 or codes[i - 1] != codes[j - 1]):
            found.append((i, length + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """The numbers of the words that no run holds after its first period."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.flatnonzero(np.cumsum(gone[:n]) == 0)


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the doc_ids: the words' numbers when a stretch from some place on is repeated to the end."""
    import zlib

    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n or doc_id is None:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def periodic_runs(docs: DataFrame, min_length: int = 24, exponent: int = 3, change: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """Rows of RUNS: each document's runs by start and period, and its words, joined by blanks, without the repeats.
    `change` may give the numbers of the words to take in place of the document's n words."""

    def find(batches):
        for batch in batches:
            for b in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                sizes, runs, texts = [], [], []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    words = (text or b"").split()
                    taken = change(doc_id, len(words)) if change else None
                    if taken is not None:
                        words = [words[i] for i in taken.tolist()]
                    number: dict[bytes, int] = {}
                    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                    own = runs_of(codes, min_length, exponent)
                    sizes.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                    texts.append(b" ".join([words[i] for i in kept_words(len(words), own).tolist()] if own else words).decode())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(find, RUNS)
