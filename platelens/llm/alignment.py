"""Alignment of two tokenizers' tokens of the same text, by products of token-byte incidence matrices.

A text is cut before each blank or line feed that a word follows; there both tokenizers end a token, whatever
stands around, so a text's alignment is its stretches' alignments in a row. The distinct stretches of a slice of
documents are encoded once. Row i of a tokenizer's incidence matrix has the bytes that token i covers. The product
of A's matrix and B's transposed one, row by row (Gustavson), links tokens that overlap; the last link of each row
tells where both end a token, which cuts the groups. The product of the incidence of A's ids and groups with that
of groups and B's ids counts the links of each id pair.

How many documents hold an id pair is counted over the whole corpus: a task gives one row for an id pair and block
of documents, with the documents' places in the block, so a pair that every document holds is one row a block.
The counts go back to the blocks by a shuffled join, and each block sums up its documents.

Defined results: null and empty texts, and texts whose joined token bytes differ from blank + text under either
tokenizer (U+2581, for one), have zeros and no groups and count for no pair; every row is a document of its own,
so rows that repeat, also in their doc_id, are counted each; an empty table gives no rows; extra columns don't
matter. A text is one row of one task, whatever its length.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

STEP = "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups string, pair long, docs binary, times binary"
#: Documents of one block, by number and bytes (a longer text is a block of its own); stretches that a task remembers.
_BLOCK_ROWS, _BLOCK_BYTES, _MEMORY = 16_384, 4 << 20, 350_000
#: Stretches that are encoded in one call, and their bytes that are multiplied together.
_JOINED, _PRODUCT_BYTES = 128, 1 << 19
#: An id pair as a number: A's id, then these bits for B's.
_B_BITS = 16


class Csr(NamedTuple):
    """A sparse matrix by rows: entries start[i]:start[i + 1] of column and value are row i."""

    start: np.ndarray
    column: np.ndarray
    value: np.ndarray


def csr(row: np.ndarray, column: np.ndarray, rows: int) -> Csr:
    """The matrix that counts how often each (row, column) comes."""
    width = int(column.max(initial=0)) + 1
    key, count = np.unique(row * width + column, return_counts=True)
    return Csr(np.searchsorted(key, np.arange(rows + 1) * width), key % width, count)


def intervals(size: np.ndarray) -> Csr:
    """Token-byte incidence of tokens of these sizes that cover the bytes in a row."""
    start = np.concatenate([[0], np.cumsum(size)])
    return Csr(start, np.arange(start[-1]), np.ones(start[-1], np.int64))


def transposed(m: Csr, columns: int) -> Csr:
    order = np.argsort(m.column, kind="stable")
    row = np.repeat(np.arange(len(m.start) - 1), np.diff(m.start))
    return Csr(np.searchsorted(m.column[order], np.arange(columns + 1)), row[order], m.value[order])


def product(a: Csr, b: Csr) -> Csr:
    """a·b by Gustavson's rule: row i is the sum of those rows of b that row i of a names, each times a's entry."""
    sizes = np.diff(b.start)[a.column]
    row = np.repeat(np.repeat(np.arange(len(a.start) - 1), np.diff(a.start)), sizes)
    at = np.arange(len(row)) + np.repeat(b.start[a.column] - (np.cumsum(sizes) - sizes), sizes)
    width = int(b.column.max(initial=0)) + 1
    key, value = row * width + b.column[at], np.repeat(a.value, sizes) * b.value[at]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    total = np.add.reduceat(value[order], first) if len(first) else value
    return Csr(np.searchsorted(key[first], np.arange(len(a.start)) * width), key[first] % width, total)


class ByteBpe:
    """Byte-level tokenizer of the tokenizers library; special tokens in texts are plain text."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # bytes that are no visible sign are written as the letters from 256 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.token_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a blank."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceBpe:
    """Sentencepiece model that puts a blank before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.token_bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            inner = piece.lstrip("▁")
            if "▁" in inner or "\n" in piece:
                raise ValueError(f"piece {i} goes on past a blank or line feed, so texts can't be cut there")
            self.token_bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a blank, which the model puts there itself."""
        return self.model.encode([t[1:] for t in texts], num_threads=1)


class Aligner:
    """Alignments of stretches, remembered by number: sizes, groups as text and id pairs with their links."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        self.sides = ByteBpe(byte_bpe), PieceBpe(piece_bpe)
        self.pools = [_pool(s.token_bytes) for s in self.sides]
        ids = [[str(i) for i in range(len(s.token_bytes))] for s in self.sides]
        #: an id of A within its group and as its last, then the same of B
        self.names = _pool([f"{i}{end}".encode() for side, ends in zip(ids, (",|", ",;")) for end in ends for i in side])
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        #: by stretch: n_a, n_b, n_groups, n_links, n_overlaps, and 1 if its bytes don't come back
        self.sums = np.zeros((0, 6), np.int32)
        #: stretch k: id pairs pair[stop[k]:stop[k + 1]], each with its number of links, and groups as text
        self.stop, self.pair, self.times = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int32)
        self.groups: list[bytes] = []
        self.blocks = np.zeros(0, np.int32)  # in how many blocks a stretch has come

    def _forget_rare(self) -> None:
        """Keep the stretches that came in several blocks, if they leave room for others."""
        kept = np.flatnonzero(self.blocks > 1)
        if len(kept) > _MEMORY // 2:
            return self.forget()
        names = list(self.numbers)  # in the order of their numbers
        self.numbers = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.groups = [self.groups[k] for k in kept.tolist()]
        self.sums, self.blocks = self.sums[kept], np.ones(len(kept), np.int32)
        self.pair, size = _gather(self.pair, self.stop, kept)
        self.times, _ = _gather(self.times, self.stop, kept)
        self.stop = np.concatenate([[0], np.cumsum(size)])

    def number(self, stretches: list[bytes]) -> np.ndarray:
        new = [s for s in stretches if s not in self.numbers]
        if len(self.numbers) + len(new) > _MEMORY and self.numbers:
            self._forget_rare()
            new = [s for s in stretches if s not in self.numbers]
        at, added = 0, []
        while at < len(new):
            upto, size = at, 0
            while upto < len(new) and (upto == at or size < _PRODUCT_BYTES):
                size += len(new[upto])
                upto += 1
            added.append(self._add(new[at:upto]))
            at = upto
        if added:
            sums, size, pair, times = (np.concatenate(x) for x in zip(*added))
            self.sums = np.concatenate([self.sums, sums.astype(np.int32)])
            self.stop = np.concatenate([self.stop, self.stop[-1] + np.cumsum(size)])
            self.pair, self.times = np.concatenate([self.pair, pair.astype(np.uint32)]), np.concatenate([self.times, times.astype(np.int32)])
            self.blocks = np.concatenate([self.blocks, np.zeros(len(self.sums) - len(self.blocks), np.int32)])
        found = np.fromiter(map(self.numbers.__getitem__, stretches), np.int64, len(stretches))
        self.blocks[found] += 1
        return found

    def _encode(self, side: int, groups: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all stretches in a row, number of each stretch's ids, groups whose bytes come back and whose
        tokens end with the stretches). Each group is encoded as one text, behind a word that is dropped."""
        lead = b" x"
        found = self.sides[side].encode([(lead + b"".join(g)).decode() for g in groups])
        n = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for x in found for i in x), np.int64, int(n.sum()))
        data, stops = self.pools[side]
        got, size = _gather(data, stops, ids)
        want = np.frombuffer(b"".join(x for g in groups for x in (lead, *g)), np.uint8)
        stretch = np.fromiter((len(x) for g in groups for x in (lead, *g)), np.int64)
        members = np.fromiter((len(g) + 1 for g in groups), np.int64, len(groups))
        ends, bounds = np.cumsum(np.append(0, size)), np.cumsum(stretch)
        of_token, of_stretch = np.repeat(np.arange(len(groups)), n), np.repeat(np.arange(len(groups)), members)
        bytes_got, bytes_want = np.bincount(of_token, size, len(groups)), np.bincount(of_stretch, stretch, len(groups))
        fine = bytes_got == bytes_want
        if not fine.all():  # the others by themselves, so that their bytes lie side by side
            ids, sizes, good = self._encode(side, [g for g, ok in zip(groups, fine) if ok])
            fine[fine] = good
            return ids, sizes, fine
        at = np.searchsorted(ends, bounds)
        unlike = np.bincount(np.repeat(of_stretch, stretch)[got != want], minlength=len(groups)) + np.bincount(of_stretch[ends[np.minimum(at, len(ends) - 1)] != bounds], minlength=len(groups))
        fine = unlike == 0
        sizes = np.diff(at, prepend=0)
        stays = fine[of_stretch]
        stays[np.cumsum(members) - members] = False
        keep = np.repeat(stays, sizes)
        return ids[keep], sizes[stays], fine

    def _add(self, stretches: list[bytes]) -> tuple[np.ndarray, ...]:
        """Numbers the stretches; their sums, numbers of pairs, pairs and links."""
        alone = [s for s in stretches if s[-1] in b" \t\n\x0b\f\r" or len(s) > 256]
        rest = [s for s in stretches if not (s[-1] in b" \t\n\x0b\f\r" or len(s) > 256)]
        groups, lost = [rest[i : i + _JOINED] for i in range(0, len(rest), _JOINED)] + [[s] for s in alone], []
        while True:
            both = [self._encode(side, groups) for side in (0, 1)]
            fine = both[0][2] & both[1][2]
            if fine.all():
                break
            lost += [g[0] for g, ok in zip(groups, fine) if not ok and len(g) == 1]
            groups = [g for g, ok in zip(groups, fine) if ok] + [[s] for g, ok in zip(groups, fine) if not ok and len(g) > 1 for s in g]
        done = [s for g in groups for s in g]
        (a, n_a), (b, n_b) = ((ids, np.concatenate([sizes, np.zeros(len(lost), np.int64)])) for ids, sizes, _ in both)
        n = len(stretches)
        self.numbers.update(zip([*done, *lost], range(len(self.numbers), len(self.numbers) + n)))
        of_a, of_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        cover_a, cover_b = (intervals(np.diff(stops)[x]) for (_, stops), x in zip(self.pools, (a, b)))
        overlaps = product(cover_a, transposed(cover_b, int(cover_b.start[-1])))
        # where the last token of B that overlaps a token of A ends with it, a group ends
        last = overlaps.column[overlaps.start[1:] - 1]
        cut = cover_a.start[1:] == cover_b.start[1:][last] if len(a) else np.zeros(0, bool)
        group_a = np.cumsum(cut) - cut
        group_b = np.searchsorted(cover_a.start[1:][cut], cover_b.start[1:])
        row, row_a = np.unique((of_a << 32) | a, return_inverse=True)
        links = product(csr(row_a, group_a, len(row)), csr(group_b, b, int(cut.sum())))
        pair = (np.repeat(row & 0xFFFFFFFF, np.diff(links.start)) << _B_BITS) | links.column
        of_pair = np.repeat(row >> 32, np.diff(links.start))
        count = lambda where, weights=None: np.bincount(where, weights, n).astype(np.int64)
        sums = [n_a, n_b, count(of_a[cut]), count(of_pair, links.value), count(of_a, np.diff(overlaps.start)), np.arange(n) >= len(done)]
        self._write_groups(a, b, cut, group_a, group_b, n_a + n_b)
        return np.stack(sums, 1).astype(np.int64), count(of_pair), pair, links.value

    def _write_groups(self, a, b, cut, group_a, group_b, size) -> None:
        """The stretches' groups as text: ids with commas, | between A's and B's, ; behind each group."""
        k, m = len(self.pools[0][1]) - 1, len(self.pools[1][1]) - 1
        ends_b = np.diff(group_b, append=-1) != 0
        name = np.concatenate([a + cut * k, 2 * k + b + ends_b * m])
        # both sides lie in order; a group's A comes before its B
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        text, length = _gather(*self.names, name[order])
        upto = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(size)])].tolist()
        text = text.tobytes()
        self.groups += [text[i:j] for i, j in zip(upto, upto[1:])]


def _pool(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes in a row, where each item's begin and the last one's end)."""
    return np.frombuffer(b"".join(items), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64)


def _gather(data: np.ndarray, stops: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the numbered items in a row, size of each); item k is data[stops[k]:stops[k + 1]]."""
    size = stops[number + 1] - stops[number]
    at = np.repeat(stops[number] - (np.cumsum(size) - size), size)
    return data[at + np.arange(len(at))], size


def _may_start() -> np.ndarray:
    """By byte: no white space begins with it, ASCII or (by its first byte) any other."""
    may = np.ones(256, bool)
    may[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = False
    return may


_MAY_START = _may_start()


def stretches(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(the stretches of all blank + text in a row, which text each is of)."""
    data = np.frombuffer(b"".join(b" " + t for t in texts) + b"\0", np.uint8)
    start = np.cumsum([0, *(len(t) + 1 for t in texts)])
    blank = data[:-1] == 32
    cut = (blank | (data[:-1] == 10)) & _MAY_START[data[1:]]
    cut[1:] &= ~(blank[1:] & blank[:-1])
    cut[start[1:] - 1] = False  # what follows belongs to another text
    cut[start[:-1]] = True
    at = np.flatnonzero(cut)
    offsets = np.append(at, len(data) - 1).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), np.searchsorted(start, at, side="right") - 1


def _blocks(batch: pa.RecordBatch, column: int):
    """The batch cut into blocks of bounded rows and bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        upto = max(at + 1, min(at + _BLOCK_ROWS, int(np.searchsorted(size, done + _BLOCK_BYTES, side="right"))))
        yield batch.slice(at, upto - at)
        at = upto


def _documents(aligner: Aligner, number: np.ndarray, of: np.ndarray, n: int, digest: bool) -> tuple[np.ndarray, list[str]]:
    """(sums, groups) of n documents that consist of the numbered stretches."""
    import hashlib

    sums = np.stack([np.bincount(of, aligner.sums[number, k], n) for k in range(6)], 1).astype(np.int64)
    sums[sums[:, 5] > 0] = [0, 0, 0, 0, 0, 1]
    ends = np.cumsum(np.bincount(of, minlength=n)).tolist()
    names, numbers = aligner.groups, number.tolist()
    groups = []
    for a, b, bad in zip([0, *ends], ends, sums[:, 5].tolist()):
        text = b"" if bad else b"".join([names[k] for k in numbers[a:b]])[:-1]
        groups.append(hashlib.sha256(text).hexdigest() if digest and text else text.decode())
    return sums, groups


def _pairs(aligner: Aligner, number: np.ndarray, of: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct id pairs, where each one's entries begin and the last ones' end, documents, links): an entry for a
    document and pair."""
    good = ~bad[of]
    key, often = np.unique((of[good] << 32) | number[good], return_counts=True)
    doc, number = key >> 32, key & 0xFFFFFFFF
    size = np.diff(aligner.stop)[number]
    at = np.arange(size.sum()) + np.repeat(aligner.stop[number] - (np.cumsum(size) - size), size)
    key, times = (aligner.pair[at].astype(np.int64) << 24) | np.repeat(doc, size), aligner.times[at] * np.repeat(often, size)
    order = np.argsort(key)
    key, times = key[order], times[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.add.reduceat(times, first) if len(first) else times
    pair, doc = key[first] >> 24, key[first] & 0xFFFFFF
    begins = np.flatnonzero(np.diff(pair, prepend=-1))
    return pair[begins], np.append(begins, len(pair)), doc, times


@lru_cache(maxsize=1)
def _aligner(byte_bpe: str, piece_bpe: str) -> Aligner:
    """One for each Python worker: what it remembers holds for all of its tasks."""
    return Aligner(byte_bpe, piece_bpe)


def _align_blocks(docs: DataFrame, byte_bpe: str, piece_bpe: str, digest: bool) -> DataFrame:
    """Rows of STEP: one for each document, and one for each id pair of each block."""

    def align(batches):
        from pyspark import TaskContext

        aligner, block = _aligner(byte_bpe, piece_bpe), TaskContext.get().partitionId() << 32
        schema = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")), ("groups", pa.string()), ("pair", pa.int64()), ("docs", pa.binary()), ("times", pa.binary())])

        def rows(size: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema)

        for batch in batches:
            for b in _blocks(batch, 1):
                texts = [t or b"" for t in b.column(1).to_pylist()]
                there = np.flatnonzero([len(t) > 0 for t in texts])
                parts, of = stretches([texts[i] for i in there])
                coded = parts.dictionary_encode()
                number = aligner.number(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
                of, n = there[of], b.num_rows
                sums, groups = _documents(aligner, number, of, n, digest)
                named = {c: pa.array(sums[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links", "n_overlaps"))}
                yield rows(n, block=pa.array(np.full(n, block)), place=pa.array(np.arange(n, dtype=np.int32)), doc_id=b.column(0), groups=pa.array(groups, pa.string()), **named)
                pair, stop, doc, times = _pairs(aligner, number, of, sums[:, 5] > 0)
                lists = [pa.Array.from_buffers(pa.binary(), len(pair), [None, pa.py_buffer((stop * 4).astype(np.int32)), pa.py_buffer(x.astype("<u4"))]) for x in (doc, times)]
                yield rows(len(pair), block=pa.array(np.full(len(pair), block)), pair=pa.array(pair), docs=lists[0], times=lists[1])
                block += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(align, STEP)


def _sum_up(part: pd.DataFrame) -> pd.DataFrame:
    """n_best and count_sum of the documents of a block."""
    each = [len(x) // 4 for x in part["docs"]]
    doc = np.frombuffer(b"".join(part["docs"]), "<u4").astype(np.int64)
    times = np.frombuffer(b"".join(part["times"]), "<u4").astype(np.int64)
    n = int(doc.max()) + 1
    count, best = np.repeat(part["count"].to_numpy(), each), np.repeat(part["best"].to_numpy(), each)
    total, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(total, doc, times * count)
    np.add.at(most, doc, times * best)
    return pd.DataFrame({"block": part["block"].iloc[0], "place": np.arange(n, dtype=np.int32), "n_best": most, "count_sum": total})


def align_tokens(docs: DataFrame, byte_bpe: str, piece_bpe: str, digest: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum and groups (text,
    or with `digest` its SHA-256, made in the task that has the text; empty without tokens)."""
    steps = materialise(_align_blocks(docs, byte_bpe, piece_bpe, digest), "alignments")
    pairs = steps.filter("pair is not null").select("block", "pair", "docs", "times")
    counts = pairs.groupBy("pair").agg(F.sum(F.octet_length("docs") / 4).cast("long").alias("count"))
    same_a = Window.partitionBy(F.shiftright("pair", _B_BITS))
    counts = materialise(counts.withColumn("best", (F.col("count") == F.max("count").over(same_a)).cast("long")), "pair-counts")
    weighted = pairs.join(counts.hint("merge"), "pair").select("block", "docs", "times", "count", "best")
    sums = materialise(weighted.groupBy("block").applyInPandas(_sum_up, "block long, place int, n_best long, count_sum long"), "alignment-sums")
    discard(counts)
    rows = steps.filter("pair is null").drop("pair", "docs", "times").join(sums.hint("merge"), ["block", "place"], "left")
    return rows.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups"
    )


def pair_counts(docs: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """(a, b, documents): each pair of linked ids with the number of documents that hold it."""
    pairs = materialise(_align_blocks(docs, byte_bpe, piece_bpe, True), "alignments").filter("pair is not null")
    counts = pairs.groupBy("pair").agg(F.sum(F.octet_length("docs") / 4).cast("long").alias("documents"))
    return counts.select(F.shiftright("pair", _B_BITS).alias("a"), F.col("pair").bitwiseAND((1 << _B_BITS) - 1).alias("b"), "documents")
