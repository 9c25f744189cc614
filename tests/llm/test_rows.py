"""Rows that share ids, clashing columns, contradicting labels, short items, many items, very long texts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from platelens.llm import decontaminate
from platelens.llm.decontaminate import Block, drop_leaks, find_leaks, fit_block, word_hashes as leak_words
from platelens.llm.packing import piece_digests
from platelens.llm.queries import tokenizer_path
from platelens.llm.shingles import word_hashes, word_values
from platelens.llm.toxicity import drop_toxic, toxicity


def test_words_by_pieces():
    data = np.random.default_rng(0).choice(np.frombuffer(b"abcdefgh  \n", np.uint8), 20000)
    whole = word_values(data)
    for piece in (1, 7, 4096):
        part = word_values(data, piece=piece)
        assert (whole[0] == part[0]).all() and (whole[1] == part[1]).all()
    h, sizes = word_hashes([None, b"", b"A b", b"a  B\t", b"x" * 3_000_000 + b" a"])
    assert sizes.tolist() == [0, 0, 2, 2, 2] and h[0] == h[2] == h[5] and h[1] == h[3]


def test_leaks_by_row_and_short_items(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    item = " ".join(word() for _ in range(20))
    bench = spark.createDataFrame([(1, item), (2, "alpha beta gamma"), (3, "the end"), (4, None), (5, "")], "item_id long, text string")
    filler = " ".join(word() for _ in range(30))
    rows = [(7, f"{filler} {item}", 1.0), (7, filler, 2.0), (None, f"x {item} y", 3.0), (None, filler, 4.0), (8, "one alpha, beta GAMMA two", 5.0), (9, "alpha beta the end", 6.0), (10, None, 7.0), (11, "q " * 200_000 + item, 8.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, coverage double")
    assert sorted(r.coverage for r in drop_leaks(docs, bench).collect()) == [2.0, 4.0, 6.0, 7.0]
    assert drop_leaks(docs, bench).columns == docs.columns
    found = {(r.doc_id, tuple(r.item_ids)) for r in find_leaks(docs, bench).collect()}
    assert {(7, (1,)), (7, ()), (8, (2,)), (9, ()), (11, (1,))} <= found


def test_recall_among_many_items(spark):
    """Against brute force: every planted paraphrase covers at least 0.6 of its item with the answer whole."""
    rng = random.Random(2)
    words = [r.w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(F.split(F.lower("text"), r"\W+")).alias("w")).filter("length(w) > 2").limit(4000).collect()]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(25, 45)))) for i in range(1500)]
    rows, want = [], set()
    for d in range(150):
        i = rng.randrange(len(items))
        w = items[i][1].split()
        tail = max(3, len(w) // 4)
        body = [rng.choice(words) if rng.random() < 0.25 else x for x in w[:-tail]] + w[-tail:]
        rows.append((d, " ".join(rng.choice(words) for _ in range(60)) + " " + " ".join(body) + " " + " ".join(rng.choice(words) for _ in range(40))))
        want.add((d, i))
    clean = [(1000 + d, " ".join(rng.choice(words) for _ in range(150))) for d in range(100)]
    got = find_leaks(spark.createDataFrame(rows + clean, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, i) for r in got for i in r.item_ids}
    assert len(want & found) >= 0.9 * len(want)
    assert all(d < 1000 for d, _ in found)


def test_toxic_columns_and_labels(spark):
    docs = spark.createDataFrame([(i, "awful slur here" if i % 2 else "kind plain words", 5, "x") for i in range(60)] + [(None, None, 5, "x"), (3, "awful slur here", 5, "x")], "doc_id long, text string, p_toxic int, kept string")
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(60)] + [(1, 1, 0), (1, 0, 1), (None, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    left = drop_toxic(docs, labels).collect()
    assert left and all(r.p_toxic == 5 and r.kept == "x" and (r.text or "").find("slur") < 0 for r in left) and len(left) == 31
    again = toxicity(docs, labels)
    assert dict(again.dtypes)["p_toxic"] == "double" and again.filter("toxic").count() == 31


def test_packed_rows_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = set()
    for r in docs.collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want |= {(r.doc_id, s, min(4096, len(ids) - s), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)) for s in range(0, len(ids), 4096)}
    rows = piece_digests(docs, tokenizer_path()).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows} == want and len(rows) == len(want)
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0) and r.offset + r.length <= 4096
        used[r.sequence_id] = r.offset + r.length
    assert len(used) <= sum(used.values()) / 4096 * 1.05 + 2


NAMES = [f"{a}{b}" for a in "bcdfghjklm" for b in "aeiouy"]


def many_rows_without_ids():
    """(items, rows): texts end within a passage, and rows without an id have words of their own together."""
    rng = np.random.default_rng(6)
    items = [(i, " ".join(rng.choice(NAMES[:30], 10))) for i in range(6)] + [(9, " ".join(NAMES))]
    return items, [(d, " ".join(rng.choice(NAMES[:12], rng.integers(1, 200)))) for d in range(20)] + [(None, " ".join(rng.choice(NAMES[30 + 5 * (k % 4) :][:9], rng.integers(1, 200)))) for k in range(80)]


def share_of_the_best(block, items, rows, rank):
    """What the basis has of all passages, as a share of what the best one of its rank has."""
    place = {int(next(leak_words([w.encode()]))[1][0]): w for w in NAMES}
    column = {place[int(h)]: k for k, h in enumerate(block.hashes)}

    def lines(texts, window):
        for t in texts:
            w = t.split()
            starts = list(range(0, max(1, len(w) - window // 2), window))
            for s, e in zip(starts, [*starts[1:], len(w)]):
                a = np.bincount([column[x] for x in w[s:e]], minlength=len(column)) * block.idf
                yield a / np.linalg.norm(a)

    corpus, mine = (np.array(list(lines([t for _, t in x], n))) for x, n in ((rows, 48), (items, 1000)))
    corpus, mine = corpus.T @ corpus, mine.T @ mine
    both = corpus + max(1.0, np.linalg.norm(corpus) / np.linalg.norm(mine)) * mine
    basis = block.basis[:, :rank]
    assert basis.T @ basis == pytest.approx(np.eye(rank), abs=1e-4)
    return np.trace(basis.T @ both @ basis) / np.linalg.eigvalsh(both)[-rank:].sum()


def test_the_latent_basis_is_of_all_documents(spark):
    items, rows = many_rows_without_ids()
    block = Block(items, 8)
    fit_block(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block, 6)
    assert share_of_the_best(block, items, rows, 6) > 0.97


def test_the_pipelines_basis_is_of_all_documents(spark, tmp_path, monkeypatch):
    items, rows = many_rows_without_ids()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    fitted = []

    def small(docs, block, rank, *rest):
        fit_block(docs, block, 6, *rest)
        fitted.append(block)

    monkeypatch.setattr(decontaminate, "fit_block", small)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).count() <= len(rows)
    assert len(fitted) == 1 and share_of_the_best(fitted[0], items, rows, 6) > 0.97
