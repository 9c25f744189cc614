import hashlib
import random

import numpy as np
import pytest

from platelens.llm.substring_dedup import cut_repeats
from platelens.llm.suffix_array import permuted_prefixes, suffix_array


@pytest.mark.parametrize("letters", [1, 2, 3, 26, 256])
def test_suffix_array_matches_sorting(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 3, 8, 50, 400):
        for _ in range(5):
            t = rng.integers(0, letters, n).astype(np.uint8)
            t = np.concatenate([t, t[: n // 2], t])
            b = t.tobytes()
            sa = suffix_array(t)
            assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
            for stop in (0, 1000):
                want = {int(sa[0]): 0}
                for j, i in zip(sa.tolist(), sa[1:].tolist()):
                    k = 0
                    while max(i, j) + k < len(b) and b[i + k] == b[j + k] and b[i + k] != stop:
                        k += 1
                    want[i] = k
                assert permuted_prefixes(t, sa, stop).tolist() == [want[i] for i in range(len(b))]


def brute(rows, length=50):
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            rank = doc if doc is not None else 2**63 - 1
            first[w] = min(first.get(w, rank), rank)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        rank = doc if doc is not None else 2**63 - 1
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < rank:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.drop("kept").collect()), key=str)


def test_matches_brute_force_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(cut_repeats(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdé ") for _ in range(130))
    rows = [(i, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 90))) + passage[rng.randint(0, 60) : rng.randint(70, 130)] + "q" * rng.randint(0, 3)) for i in range(60)]
    rows += [(100, "a" * 400), (101, "a" * 49), (102, "b" + "a" * 70 + "c"), (103, None), (104, ""), (105, passage), (105, passage), (None, passage), (106, "ab" * 200), (107, "c" + "ab" * 100), (50, "a" * 55)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, batch int").repartition(3)
    assert got(cut_repeats(docs, batch_bytes=700)) == brute(rows)
    # every least hash a hot one, many shards in few groups
    assert got(cut_repeats(docs, batch_bytes=700, hot=0, shard_bytes=50, group_bytes=4000)) == brute(rows)
    assert cut_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_stretches_of_a_batch_name_their_hashes():
    from platelens.llm.substring_dedup import Batch, _distinct_hashes

    texts = [(b"abcdefghij" * 9)[i : i + 70] for i in range(4)] + [bytes(range(65, 140)), b"short"]
    (starts, count, low, doc), hashes, often, many, place = _distinct_hashes(Batch(*Batch.pack(texts, list(range(6)))[1:]), 50, 24)
    assert (hashes[place] == low).all() and (np.diff(hashes.astype(object)) > 0).all()
    assert often.tolist() == [int((low == h).sum()) for h in hashes]
    assert many.tolist() == [len(set(doc[low == h].tolist())) > 1 for h in hashes]


def test_stretches_do_not_hang_on_what_is_hashed_together(monkeypatch):
    from platelens.llm import substring_dedup as S

    rng = np.random.default_rng(6)
    sizes = [0, 49, 50, 51, 0, 0, 700, 3, 120, 0]
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in sizes]
    batch = S.Batch(*S.Batch.pack(texts, list(range(len(texts))))[1:])
    whole = batch.stretches(50, 24)
    monkeypatch.setattr(S, "_CHUNK", 7)
    assert all((a == b).all() for a, b in zip(whole, batch.stretches(50, 24)))
    starts, count, low, doc = whole
    windows = [(d, a + i) for d, (a, z) in enumerate(zip(batch.ends - batch.sizes, batch.ends)) for i in range(max(0, z - a - 49))]
    assert [(d, s + i) for d, s, n in zip(doc, starts, count) for i in range(n)] == windows
    grams = {w: batch.text[w : w + 24].tobytes() for w in range(len(batch.text) - 23)}
    least = {}
    for d, s, n, h in zip(doc, starts, count, low):  # every window of a stretch has one gram in common, that of its hash
        common = set.intersection(*({grams[w + i] for i in range(27)} for w in range(s, s + n)))
        least[int(h)] = least.get(int(h), common) & common
    assert all(least.values())


def test_names_are_ranked_in_few_sorts_and_prefixes_counted_where_asked(monkeypatch):
    from platelens.llm import suffix_array as A

    rng = np.random.default_rng(7)
    names = np.tile(rng.integers(0, 3, 500), 4)
    sorts = []
    argsort = np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: sorts.append(1) or argsort(*a, **k))
    order = A._rank_names(names, 27)
    assert len(sorts) <= 3
    monkeypatch.undo()
    cut = [tuple(names[i : i + 27]) for i in order]
    assert cut == sorted(cut)
    assert A._rank_names(names, len(names)).tolist() == sorted(range(len(names)), key=lambda i: tuple(names[i:]))
    t = np.concatenate([names, [9], names[3:400], [9]]).astype(np.uint8)
    sa = suffix_array(t)
    every, places = permuted_prefixes(t, sa, 9), np.array([0, 3, 700, 1990, 2001, 2005])
    assert permuted_prefixes(t, sa, 9, places).tolist() == every[places].tolist()
