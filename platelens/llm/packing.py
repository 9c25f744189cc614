"""Packing documents into fixed token windows, best-fit decreasing.

A document's ids (and the separator) are cut: full windows first, one remainder at most. Pieces are dealt
by hash into shards of about `shard_pieces`, and each shard is packed on its own: longest first, a segment
tree over remaining capacity gives the tightest open window. What sharding costs is about one part-filled
window per shard. Token ids stay where they are made; only (id, start, length) is shuffled for placement.

Defined results: null text is an empty document, which still has its separator; repeated rows, and rows that
share a doc_id, are packed as often as they occur; of pieces of one length, the smaller (doc_id, start) is placed
first, and of windows with one capacity the last opened is taken; an empty table gives no pieces; extra columns
of documents don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release_memory

PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary"
#: A word and what follows it can be encoded apart: the tokenizer splits between letters and signs. Of these
#: letters the normaliser changes no more than the case.
_LETTERS, _SIGNS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", ".,!?;:%&*$#|()\"/+=<>-"
_CACHE_PARTS = 150_000
#: Texts that are encoded together, by number and by bytes.
_SLICE_ROWS, _SLICE_BYTES = 1024, 1 << 20


class WordEncoder:
    """Token ids of texts by their distinct words. ASCII white space always separates tokens in this vocabulary
    and is dropped, so a text's ids are its words' ids in a row: Arrow splits a slice of texts, numbers the
    distinct words and parts letters from signs behind them; each part is encoded once and remembered, and two
    gathers put the ids in place. The memory is emptied at _CACHE_PARTS parts and belongs to one task."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # lower-case letters, and signs, need no normaliser; with blanks between them, many take one call
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        """number of each part; where the ids of each begin among all."""
        self.parts, self.ids, self.stops = {"": 0}, np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def _encode_plain(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the parts in a row, ids of each)."""
        joined = [" ".join(parts[i : i + 128]) for i in range(0, len(parts), 128)]
        ids = np.fromiter((i for e in self.plain.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids), np.uint32)
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) == len(parts) and stop[-1] == len(ids):
            return ids, np.diff(stop, prepend=0)
        return self._encode(parts)  # a vocabulary without word ends

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter((i for ids in found for i in ids), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _numbers(self, parts: list[str], encode) -> np.ndarray:
        new = list(dict.fromkeys(p for p in parts if p not in self.parts))
        if new:
            self.parts.update(zip(new, range(len(self.parts), len(self.parts) + len(new))))
            ids, sizes = encode(new)
            self.ids, self.stops = np.concatenate([self.ids, ids]), np.concatenate([self.stops, self.stops[-1] + np.cumsum(sizes)])
        return np.fromiter(map(self.parts.__getitem__, parts), np.int64, len(parts))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the distinct words in a row, where each word's begin and the last one's end)."""
        if len(self.parts) > _CACHE_PARTS:
            self._forget()
        stem = pc.utf8_rtrim(words, _SIGNS)
        plain = pc.match_substring_regex(stem, _LETTERS).to_numpy(zero_copy_only=False)
        whole = words.to_numpy(zero_copy_only=False)
        cut = pc.utf8_length(stem).to_numpy(zero_copy_only=False)
        signed = np.flatnonzero(plain & (cut < pc.utf8_length(words).to_numpy(zero_copy_only=False)))
        halves = np.zeros((len(words), 2), np.int64)
        stems = pc.utf8_lower(stem.filter(pa.array(plain))).dictionary_encode()
        halves[plain, 0] = self._numbers(stems.dictionary.to_numpy(zero_copy_only=False).tolist(), self._encode_plain)[stems.indices.to_numpy(zero_copy_only=False)]
        halves[signed, 1] = self._numbers([w[k:] for w, k in zip(whole[signed].tolist(), cut[signed].tolist())], self._encode_plain)
        halves[~plain, 0] = self._numbers(whole[~plain].tolist(), self._encode)
        ids, sizes = _gather(self.ids, self.stops, halves.ravel())
        return ids, np.concatenate([[0], np.cumsum(sizes[::2] + sizes[1::2])])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        ids, sizes = self.encode_array(pa.array(texts, pa.string()))
        stops = np.concatenate([[0], np.cumsum(4 * sizes)]).tolist()
        data = ids.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip(stops, stops[1:])]

    def encode_array(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each with `end` behind it; ids of each text). Null counts as empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        ids, sizes = _gather(*self._words(words.dictionary), words.indices.to_numpy(zero_copy_only=False))
        stops = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        per_text = np.diff(stops)
        if end is None:
            return ids, per_text
        return np.insert(ids, stops[1:], end), per_text + 1


def _gather(ids: np.ndarray, stops: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of the numbered sequences in a row, size of each); sequence k has ids[stops[k]:stops[k + 1]]."""
    start = stops[number]
    sizes = stops[number + 1] - start
    at = np.repeat(start - np.cumsum(sizes) + sizes, sizes)
    at += np.arange(len(at))
    return ids[at], sizes


def _slices(batch: pa.RecordBatch, column: int):
    """The batch cut into slices of bounded rows and bytes (a longer text is a slice of its own)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        upto = max(at + 1, min(at + _SLICE_ROWS, int(np.searchsorted(size, done + _SLICE_BYTES, side="right"))))
        yield batch.slice(at, upto - at)
        at = upto


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int = 4096, separator: int = 2) -> DataFrame:
    """Rows of PIECE: every id of every document, separator included, in exactly one piece."""

    def cut(batches):
        release_memory()  # of the stages before
        encoder = WordEncoder(tokenizer_path)
        for batch in batches:
            for b in _slices(batch, 1):
                ids, n = encoder.encode_array(b.column(1), separator)
                pieces = -(-n // window)
                row = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(window, n[row] - start)
                stops = np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(stops), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(n[row]), blob], ["doc_id", "start", "length", "doc_tokens", "ids"])
                del ids, blob
        del encoder
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECE)


class CapacityTree:
    """Segment tree over remaining capacity: how many open windows there are in each subtree."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i, count = capacity + self.size, self.count
        while i:
            count[i] += by
            i >>= 1

    def put(self, capacity: int, window_id: int) -> None:
        self.open[capacity].append(window_id)
        self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(remaining capacity, id) of the tightest open window that holds `length`."""
        i, count, size = length + self.size, self.count, self.size
        while not count[i]:
            while i & 1:  # a right child: its parent's right neighbour lies beyond
                i >>= 1
            if not i:
                return None
            i += 1
        while i < size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - size
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset in it) of each piece."""
    tree, where, offset, used = CapacityTree(window), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        found = tree.take(n)
        if found is None:
            found = window, used
            used += 1
        capacity, where[k] = found
        offset[k] = window - capacity
        if capacity > n:
            tree.put(capacity - n, int(where[k]))
    return where, offset


def place_pieces(pieces: DataFrame, window: int = 4096, shard_pieces: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, start and length. pieces is read twice, so it
    should be a written table."""
    shards = max(1, -(-pieces.count() // shard_pieces))
    # the place in the written table deals out an id that many rows have
    sharded = pieces.withColumn("__shard", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(shards)))
    kinds = {f.name: f.dataType for f in pieces.schema.fields}
    schema = ", ".join([f"`{n}` {t.simpleString()}" for n, t in kinds.items()] + ["sequence_id long", "offset long"])

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "start"], kind="stable", ignore_index=True)
        where, offset = best_fit_decreasing(part["length"].to_numpy(), window)
        shard = int(part["__shard"].iloc[0])
        return part.drop(columns="__shard").assign(sequence_id=where + (shard << 32), offset=offset)

    return sharded.groupBy("__shard").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 4096, separator: int = 2, shard_pieces: int = 4096) -> DataFrame:
    """The packed pieces with their ids: doc_id, start, length, doc_tokens, ids, sequence_id, offset."""
    return place_pieces(materialise(token_pieces(docs, tokenizer_path, window, separator), "pieces"), window, shard_pieces)


def piece_digests(docs: DataFrame, tokenizer_path: str, window: int = 4096, separator: int = 2, shard_pieces: int = 4096) -> DataFrame:
    """As pack_documents, with the CRC-32 of each piece's ids in place of the ids, so that these stay in
    the task that makes them."""
    pieces = token_pieces(docs, tokenizer_path, window, separator)
    digests = materialise(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "piece-digests")
    return place_pieces(digests, window, shard_pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def sequences(packed: DataFrame, window: int = 4096, padding: int = 0) -> DataFrame:
    """(sequence_id, ids): the windows themselves. A window is padded to `window` ids unless what it holds
    is a power of two."""

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("offset")
        ids = np.frombuffer(b"".join(part["ids"]), "<u4")
        if len(ids) & (len(ids) - 1):
            ids = np.pad(ids, (0, window - len(ids)), constant_values=padding)
        return pd.DataFrame({"sequence_id": [part["sequence_id"].iloc[0]], "ids": [ids.astype(np.int32)]})

    return packed.groupBy("sequence_id").applyInPandas(fill, "sequence_id long, ids array<int>")
