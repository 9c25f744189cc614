"""Alignments against a brute-force version that encodes whole texts; sparse products against dense ones."""

import random
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from platelens.llm import alignment
from platelens.llm.alignment import Aligner, align_tokens, csr, intervals, pair_counts, product, transposed
from platelens.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def whole(text, aligner, byte_bpe, piece_bpe):
    """(n_a, n_b, n_groups, n_overlaps, groups as text, links by id pair) of one text."""
    empty = 0, 0, 0, 0, "", Counter()
    if not text:
        return empty
    full, ids = (" " + text).encode(), [byte_bpe.encode(" " + text, add_special_tokens=False).ids, piece_bpe.encode(text)]
    parts = [[side.token_bytes[i] for i in own] for side, own in zip(aligner.sides, ids)]
    if any(b"".join(p) != full for p in parts):
        return empty
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups = defaultdict(lambda: ([], []))
    for side in (0, 1):
        for end, i in zip(ends[side], ids[side]):
            groups[next(c for c in cuts[np.searchsorted(cuts, end) :])][side].append(i)
    spans = [list(zip([0, *e], e)) for e in ends]
    overlaps, j = 0, 0
    for s, e in spans[0]:
        while spans[1][j][1] <= s:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < e:
            overlaps, k = overlaps + 1, k + 1
    links = Counter((x, y) for g in groups.values() for x in g[0] for y in g[1])
    text = ";".join(f"{','.join(map(str, groups[c][0]))}|{','.join(map(str, groups[c][1]))}" for c in cuts)
    return len(ids[0]), len(ids[1]), len(cuts), overlaps, text, links


def corpus(rows):
    """The rows that align_tokens has to return."""
    byte_bpe, aligner = Tokenizer.from_file(A), Aligner(A, B)
    byte_bpe.encode_special_tokens = True
    found = [(i, *whole(t, aligner, byte_bpe, sentencepiece.SentencePieceProcessor(model_file=B))) for i, t in rows]
    count = Counter(p for *_, links in found for p in links)
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for i, n_a, n_b, n_groups, overlaps, text, links in found:
        best = sum(n for p, n in links.items() if count[p] == top[p[0]])
        out.append((i, n_a, n_b, n_groups, sum(links.values()), overlaps, best, sum(n * count[p] for p, n in links.items()), text))
    return sorted(out, key=repr), count


def texts():
    rng = random.Random(4)
    signs = [*" \n\t\r　  \u0085​\x1c\0ab'sé中文日한ñ_.,;!?0129😀", "<|endoftext|>", "<s>", "</s>", "<0x41>", "'ll", "the", "and", "   ", "\n\n", "def ", "    "]
    for k in range(160):
        yield "".join(rng.choice([*signs, "▁"] if k % 3 == 0 else signs) for _ in range(rng.choice([0, 1, 3, 20, 100, 400])))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_whole_encodings(spark):
    rows = list(enumerate(texts())) + [(900, None), (901, "plain words"), (901, "plain words"), (None, "plain words of no id"), (902, "a" * 3_000), (903, "long text of words " * 2_000), (904, "▁ only here")]
    want, count = corpus(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("*", F.lit(1).alias("pair"), F.lit("x").alias("block"), F.lit(0).alias("n_best"), F.lit("y").alias("groups"))
    assert rows_of(align_tokens(docs, A, B)) == want
    assert {(r.a, r.b): r.documents for r in pair_counts(docs, A, B).collect()} == dict(count)
    assert align_tokens(docs.limit(0), A, B).collect() == []


def test_forgetting_and_small_blocks(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts()) if i < 60]
    aligner = Aligner(A, B)
    monkeypatch.setattr(alignment, "_MEMORY", 400)
    monkeypatch.setattr(alignment, "_PRODUCT_BYTES", 64)
    monkeypatch.setattr(alignment, "_JOINED", 3)
    byte_bpe = Tokenizer.from_file(A)
    byte_bpe.encode_special_tokens = True
    for _, text in rows:
        want = whole(text, aligner, byte_bpe, sentencepiece.SentencePieceProcessor(model_file=B))
        if text:
            parts, of = alignment.stretches([text.encode()])
            sums, groups = alignment._documents(aligner, aligner.number(parts.to_pylist()), of, 1, False)
            assert (*sums[0, :3].tolist(), groups[0]) == (*want[:3], want[4])


def test_products_equal_dense_ones():
    rng = np.random.default_rng(8)
    for _ in range(50):
        m, n, p = rng.integers(1, 12, 3)
        x, y = rng.integers(0, 3, (m, n)), rng.integers(0, 3, (n, p))
        sparse = [csr(np.repeat(np.nonzero(d)[0], d[d > 0]), np.repeat(np.nonzero(d)[1], d[d > 0]), d.shape[0]) for d in (x, y)]
        got, dense = product(*sparse), np.zeros((m, p), np.int64)
        dense[np.repeat(np.arange(m), np.diff(got.start)), got.column] = got.value
        assert (dense == x @ y).all()
    cover = intervals(np.array([2, 0, 3]))
    assert cover.column.tolist() == [0, 1, 2, 3, 4] and transposed(cover, 5).column.tolist() == [0, 0, 2, 2, 2]
