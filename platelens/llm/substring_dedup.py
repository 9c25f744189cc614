"""Removal of repeated substrings with sharded suffix arrays.

Every window of `length` bytes belongs to the least hash of the q-grams in it. Windows next to each other
that share it are one stretch, and equal windows, wherever they are, have equal least hashes and so meet in
one shard. Steps, all over batches of documents whose packed bytes are a table bucketed by batch:

1. Each batch sends the least hashes of its stretches to groups of shards; a group answers, bit by bit, which
   occur in more than one document, and which have so many stretches that no shard should get them all. Most
   text ends here.
2. Stretches of the others go to their shards, each distinct one once per batch with its occurrences; where
   the least hash is a hot one, window by window, dealt by the windows' own hashes. A shard keeps each distinct
   stretch once with the smallest doc_id (so a passage that a third of the corpus shares is one stretch), builds
   the suffix array of what is left by induced sorting, gets the permuted common prefixes, and so knows for each
   window the smallest doc_id it starts in. Occurrences in larger doc_ids are sent back as byte ranges.
3. Each batch unites its ranges and cuts them out.

A group has the shards of about `group_bytes` of text and sorts them one after the other, so batch and group
meet in one row, and what a task holds and sorts keeps its size as the corpus grows.

Defined results: null text is empty; texts shorter than `length` bytes stay whole; a null doc_id counts as
larger than all others; rows of one doc_id remove nothing from each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialise
from .shingles import mix
from .suffix_array import permuted_prefixes, suffix_array

_NULL = np.iinfo(np.int64).max
#: Windows that are hashed together.
_CHUNK = 1 << 14
#: Never a byte of UTF-8.
_BREAK = 0xFF


class Batch:
    """The documents of one packed row."""

    def __init__(self, ids: bytes, sizes: bytes, blob: bytes):
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.text = np.frombuffer(_expanded(blob), np.uint8)
        self.ends = np.cumsum(self.sizes)

    @staticmethod
    def pack(texts: list[bytes], ids: list[int | None]) -> tuple[int, bytes, bytes, bytes]:
        number = int.from_bytes(os.urandom(8), "little") >> 1
        return number, np.array([_NULL if i is None else i for i in ids], np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), _squeezed(b"".join(texts))

    def stretches(self, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, windows, least hash, document) of each stretch, of at most length - q + 1 windows."""
        n, width = len(self.text), length - q + 1
        none = np.zeros(0, np.int64)
        if n < length:
            return none, none, none.astype(np.uint64), none
        padded = np.concatenate([self.text, np.zeros(8, np.uint8)])
        view = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
        windows = n - length + 1
        low = np.empty(windows, np.uint64)
        for a in range(0, windows, _CHUNK):  # what a step makes stays in the processor's cache
            z = min(a + _CHUNK, windows)
            h = np.zeros(z - a + width - 1, np.uint64)
            for k in [*range(0, q - 8, 8), q - 8]:
                h = mix(h ^ view[a + k : a + k + len(h)])
            span = 1
            while span < width:  # sliding minimum by doubling
                step = min(span, width - span)
                h = np.minimum(h[: len(h) - step], h[step:])
                span += step
            low[a:z] = h
        within = np.maximum(self.sizes - length + 1, 0)  # a document's windows come before the places that begin none
        inside = np.repeat(np.tile([True, False], len(self.sizes)), np.stack([within, self.sizes - within], axis=1).ravel())[:windows]
        begin = np.ones(windows, bool)
        begin[1:] = (low[1:] != low[:-1]) | ~inside[:-1]
        firsts = self.ends - self.sizes
        begin[firsts[firsts < windows]] = True
        starts = np.flatnonzero(begin & inside)
        if not len(starts):
            return none, none, none.astype(np.uint64), none
        stop = np.append(np.flatnonzero(begin | ~inside), windows)
        count = stop[np.searchsorted(stop, starts, side="right")] - starts
        pieces = -(-count // width)
        if pieces.max() > 1:
            which = np.repeat(np.arange(len(starts)), pieces)
            step = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts, count = starts[which] + step * width, np.minimum(width, count[which] - step * width)
        return starts, count, low[starts], np.searchsorted(self.ends, starts, side="right")


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Least hashes lie near 0, so their bits are stirred first."""
    return ((mix(hashes) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _by_number(number: np.ndarray):
    """(a number, its places) for each distinct number, the places in order."""
    order = np.argsort(number, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], number[order][1:] != number[order][:-1], [True]])) if len(order) else [0]
    for a, z in zip(edges, edges[1:]):
        yield int(number[order[a]]), order[a:z]


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _expanded(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _packed_batches(docs: DataFrame, batch_bytes: int) -> DataFrame:
    def pack(batches):
        texts, ids, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts.append(t or b"")
                ids.append(i)
                size += len(texts[-1])
                if size >= batch_bytes:
                    yield _binary_rows([Batch.pack(texts, ids)], ["batch", "ids", "sizes", "blob"])
                    texts, ids, size = [], [], 0
        if texts:
            yield _binary_rows([Batch.pack(texts, ids)], ["batch", "ids", "sizes", "blob"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(pack, "batch long, ids binary, sizes binary, blob binary")


def _binary_rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32() if n == "part" else pa.list_(pa.binary()) if n == "pieces" else pa.list_(pa.int32()) if n == "shards" else pa.int64() if n == "batch" else pa.binary() for n in names]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _distinct_hashes(batch: Batch, length: int, q: int):
    """(stretches, sorted distinct hashes, stretches of each, which of them are in two documents of the batch, which of
    them each stretch has)."""
    starts, count, low, doc = batch.stretches(length, q)
    order = np.argsort(low)
    by_hash = low[order]
    new = np.ones(len(order), bool)
    new[1:] = by_hash[1:] != by_hash[:-1]
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(order)) if len(first) else first
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    many = np.zeros(len(first), bool)
    if len(first):
        d = doc[order]
        many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    return (starts, count, low, doc), by_hash[first], stop - first, many, place


def _with_answers(batches: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """The batches, each with its groups' answers; the answers of a batch are bounded by its size."""
    per_batch = answers.groupBy("batch").agg(F.collect_list(F.struct("part", "bits")).alias(name))
    return batches.join(per_batch.hint("shuffle_hash"), "batch", "left")


def shared_windows(rows: np.ndarray, sizes: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For distinct stretches (one per row, of `sizes` bytes) and the smallest doc_id that has each: the
    smallest doc_id that has each window, as a matrix (unused places have the largest integer)."""
    width = rows.shape[1] - length + 1
    used = np.arange(rows.shape[1] + 1) <= sizes[:, None]  # a break follows each stretch
    text = np.concatenate([rows, np.zeros((len(rows), 1), np.uint8)], axis=1)
    text[np.arange(len(rows)), sizes] = _BREAK
    t = text[used]
    sa = suffix_array(t, depth=length + 2)
    # only suffixes that hold a window are compared
    count = sizes - length + 1
    row = np.repeat(np.arange(len(rows)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    place = np.repeat(np.cumsum(sizes + 1) - sizes - 1, count) + offset
    number = np.full(len(t), -1, np.int64)
    number[place] = np.arange(len(place))
    # a suffix that holds a window follows at once on those that share it
    joined = permuted_prefixes(t, sa, _BREAK, place) >= length
    which = number[sa]
    which = which[which >= 0]
    row, offset = row[which], offset[which]
    first = np.flatnonzero(~joined[which])
    out = np.full((len(rows), width), _NULL, np.int64)
    if len(which):
        least = np.minimum.reduceat(owner[row], first)
        out[row, offset] = np.repeat(least, np.diff(np.append(first, len(which))))
    return out


def repeated_ranges(docs: DataFrame, length: int = 50, q: int = 24, batch_bytes: int = 3 << 20, shard_bytes: int = 1 << 20, group_bytes: int = 16 << 20, hot: int = 4096) -> DataFrame:
    """The batches (batch, ids, sizes, blob), each with `ranges`: its repeated byte ranges, by group. A least
    hash with over `hot` stretches is a hot one."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, width = f"text_batches_{uuid.uuid4().hex}", length - q + 1
    _packed_batches(docs, batch_bytes).write.bucketBy(buckets, "batch").option("path", fresh_path(spark, "text-batches")).saveAsTable(name)
    batches = spark.table(name)
    size = batches.count() * batch_bytes
    parts = max(buckets, size // group_bytes)
    per_part = max(1, size // (parts * shard_bytes))

    def ask(rows):
        for b in rows:
            for number, ids, sizes, blob in zip(*(b.column(i).to_pylist() for i in range(4))):
                _, hashes, often, many, _ = _distinct_hashes(Batch(ids, sizes, blob), length, q)
                out = []
                for part, at in _by_number(_shard(hashes, parts)):
                    # the lower 48 bits tell hashes of a group apart, and counts end at 255: chance costs work, not results
                    low = hashes[at].view(np.uint8).reshape(-1, 8)[:, :6]
                    out.append((number, part, low.tobytes() + np.minimum(often[at], 255).astype(np.uint8).tobytes() + np.packbits(many[at]).tobytes(), len(at).to_bytes(8, "little")))
                if out:
                    yield _binary_rows(out, ["batch", "part", "hashes", "n"])

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        values, counts, many, cuts = [], [], [], [0]
        for blob, size in zip(part["hashes"], part["n"]):
            n = int.from_bytes(size, "little")
            raw = np.zeros((n, 8), np.uint8)
            raw[:, :6] = np.frombuffer(blob, np.uint8, 6 * n).reshape(n, 6)
            values.append(raw.view(np.uint64).ravel())
            counts.append(np.frombuffer(blob, np.uint8, n, 6 * n))
            many.append(np.unpackbits(np.frombuffer(blob, np.uint8, offset=7 * n), count=n).astype(bool))
            cuts.append(cuts[-1] + n)
        _, back, often = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        yes = (np.bincount(back, np.concatenate(many), len(often)) + (often > 1) > 0)[back]
        full = (np.bincount(back, np.concatenate(counts), len(often)) > hot)[back]
        bits = [np.packbits(yes[a:b]).tobytes() + np.packbits(full[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
        return pd.DataFrame({"batch": part["batch"], "part": part["part"], "bits": bits})

    answers = batches.mapInArrow(ask, "batch long, part int, hashes binary, n binary").groupBy("part").applyInPandas(answer, "batch long, part int, bits binary")

    def send(rows):
        for b in rows:
            for number, ids, sizes, blob, bits in zip(*(b.column(i).to_pylist() for i in range(5))):
                batch = Batch(ids, sizes, blob)
                (starts, count, low, doc), hashes, _, _, place = _distinct_hashes(batch, length, q)
                shared, full = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
                said = {x["part"]: x["bits"] for x in bits or []}
                for part, at in _by_number(_shard(hashes, parts)):
                    got = np.frombuffer(said[part], np.uint8).reshape(2, -1)
                    shared[at], full[at] = (np.unpackbits(g, count=len(at)).astype(bool) for g in got)
                keep = np.flatnonzero(shared[place])
                split = full[place[keep]]
                starts, count, low, doc = starts[keep], count[keep], low[keep], doc[keep]
                padded = np.concatenate([batch.text, np.zeros(length + width, np.uint8)])
                if split.any():
                    each = np.flatnonzero(split)
                    which = np.repeat(each, count[each])
                    windows = starts[which] + np.arange(len(which)) - np.repeat(np.cumsum(count[each]) - count[each], count[each])
                    starts, doc = np.concatenate([starts[~split], windows]), np.concatenate([doc[~split], doc[which]])
                    low = np.concatenate([low[~split], _window_hashes(padded, windows, length)])
                    count = np.concatenate([count[~split], np.ones(len(windows), np.int64)])
                where = _shard(low, parts * per_part)  # the shards of one group follow each other
                out = []
                for part, mine in _by_number(where // np.uint64(per_part)):
                    names, pieces = [], []
                    for shard, inner in _by_number(where[mine]):
                        at = mine[inner]
                        size = count[at] + length - 1
                        rows_ = padded[starts[at][:, None] + np.arange(length + width - 1)]
                        rows_[np.arange(length + width - 1) >= size[:, None]] = _BREAK
                        rows_, owner, which = _distinct_rows(rows_, batch.ids[doc[at]])
                        names.append(shard % per_part)
                        pieces += [_squeezed(rows_.tobytes()), owner.tobytes(), _squeezed(b"".join(x.astype(np.int64).tobytes() for x in (which, batch.ids[doc[at]], starts[at])))]
                    out.append((number, part, names, pieces))
                if out:
                    yield _binary_rows(out, ["batch", "part", "shards", "pieces"])

    def sort(part: pd.DataFrame) -> pd.DataFrame:
        wide = length + width - 1
        inside: dict[int, list[tuple[int, int]]] = {}
        for k, shards in enumerate(part["shards"]):
            for i, shard in enumerate(shards):
                inside.setdefault(int(shard), []).append((k, i))
        found: list[list[np.ndarray]] = [[] for _ in range(len(part))]
        pieces = part["pieces"].tolist()
        for members in inside.values():  # one shard after the other
            texts = [np.frombuffer(_expanded(pieces[k][3 * i]), np.uint8).reshape(-1, wide) for k, i in members]
            base = np.cumsum([0] + [len(x) for x in texts])
            rows_, owner, which = _distinct_rows(np.concatenate(texts), np.concatenate([np.frombuffer(pieces[k][3 * i + 1], np.int64) for k, i in members]))
            least = shared_windows(rows_, (rows_ != _BREAK).sum(1), owner, length)
            for at, (k, i) in zip(base, members):
                row, ids, starts = np.frombuffer(_expanded(pieces[k][3 * i + 2]), np.int64).reshape(3, -1)
                again = least[which[at + row]] < ids[:, None]
                edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                r, a = np.nonzero(edge == 1)
                _, z = np.nonzero(edge == -1)
                found[k].append(np.stack([starts[r] + a, starts[r] + z - 1 + length]))
        return pd.DataFrame({"batch": part["batch"], "part": part["part"], "bits": [np.concatenate(f, axis=1).astype(np.int64).tobytes() for f in found]})

    sent = _with_answers(batches, answers, "bits").select("batch", "ids", "sizes", "blob", "bits").mapInArrow(send, "batch long, part int, shards array<int>, pieces array<binary>")
    ranges = materialise(sent.groupBy("part").applyInPandas(sort, "batch long, part int, bits binary"), "ranges")
    return _with_answers(batches, ranges, "ranges").select("batch", "ids", "sizes", "blob", "ranges")


def _window_hashes(padded: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` bytes from each start on."""
    view = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    h = np.zeros(len(starts), np.uint64)
    for k in [*range(0, length - 8, 8), length - 8]:
        h = mix(h ^ view[starts + k])
    return h


def _distinct_rows(rows: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, least owner of each, which of them each row is)."""
    key = np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel()
    h = np.zeros(len(rows), np.uint64)
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    for k in range(wide.shape[1] // 8):
        h = mix(h ^ np.ascontiguousarray(wide[:, 8 * k : 8 * k + 8]).view(np.uint64).ravel())
    order = np.argsort(h)
    new = np.ones(len(rows), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (key[order][1:] != key[order][:-1])
    first = np.flatnonzero(new)
    which = np.empty(len(rows), np.int64)
    which[order] = np.cumsum(new) - 1
    return rows[order[first]], np.minimum.reduceat(owner[order], first) if len(first) else owner[:0], which


def cut_repeats(docs: DataFrame, length: int = 50, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) of each document."""

    def cut(rows):
        for b in rows:
            for ids, sizes, blob, ranges in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                batch = Batch(ids, sizes, blob)
                n = len(batch.text)
                depth = np.zeros(n + 1, np.int32)
                for x in ranges or []:
                    a, z = np.frombuffer(x["bits"], np.int64).reshape(2, -1)
                    np.add.at(depth, a, 1)
                    np.add.at(depth, z, -1)
                gone = np.cumsum(depth[:n]) > 0
                starts = batch.ends - batch.sizes
                out = []
                for i, s, e in zip(batch.ids.tolist(), starts.tolist(), batch.ends.tolist()):
                    g = gone[s:e]
                    kept = batch.text[s:e][~g].tobytes()
                    out.append((None if i == _NULL else i, e - s, int(g.sum()), int(np.count_nonzero(g[1:] & ~g[:-1])) + int(len(g) > 0 and g[0]), hashlib.sha256(kept).hexdigest(), kept))
                if out:
                    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return repeated_ranges(docs, length, **options).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
