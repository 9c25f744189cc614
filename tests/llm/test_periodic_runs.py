"""Runs against a brute-force version, by words and by documents."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from platelens.llm.periodic_runs import OrderedPlaces, kept_words, periodic_runs, repeated_tail, runs_of


def brute(words, min_length=24, exponent=3):
    found = []
    for q in range(1, len(words) // exponent + 1):
        same = [words[k] == words[k + q] for k in range(len(words) - q)] + [False]
        start = None
        for k, equal in enumerate(same):
            if equal and start is None:
                start = k
            if not equal and start is not None:
                run, start_, start = words[start : k + q], start, None
                if len(run) >= max(min_length, exponent * q) and not any(run[d:] == run[:-d] for d in range(1, q)):
                    found.append((start_, len(run), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts(rng, n):
    for _ in range(n):
        k = rng.choice([1, 2, 3, 5, 50])
        words = [rng.randrange(k) for _ in range(rng.randrange(0, 60))]
        period = [rng.randrange(k) for _ in range(rng.randrange(1, 12))]
        words = words[: rng.randrange(0, 20)] + (period * 20)[: rng.randrange(0, 120)] + words
        yield words + words[-rng.randrange(1, 30) :] * rng.randrange(0, 4)


def test_runs_equal_brute_force():
    rng, seen = random.Random(1), 0
    for words in texts(rng, 200):
        for least, exponent in ((24, 3), (9, 3), (6, 2), (1, 3)):
            want = brute(words, least, exponent)
            assert runs_of(np.array(words, np.int64), least, exponent) == want, words
            seen += len(want)
    assert seen > 200


def test_long_texts():
    n = 60_000
    for p in (1, 7, 20_000):
        words = np.random.default_rng(p).permutation(p)[np.arange(n) % p]
        assert runs_of(words) == [(0, n, p)]
    a, b = [0], [0, 1]
    while len(b) < 500:
        a, b = b, b + a
    assert runs_of(np.array(b)) == brute(b)


def test_ordered_places_in_blocks():
    rng = random.Random(2)
    places = rng.sample(range(10**6), 3_000)
    kept, have = OrderedPlaces(places[0]), [places[0]]
    for p in places[1:]:
        before, behind = kept.add(p)
        assert before == max((x for x in have if x < p), default=-1) and behind == min((x for x in have if x > p), default=-1)
        have.append(p)
    assert list(kept) == sorted(places)


def test_documents(spark):
    line = "the very same words again"
    rows = [(1, f"{line} " * 8 + "end"), (2, None), (3, ""), (4, " \t\n"), (5, "word " * 40_000), (None, f"{line}\n" * 6), (1, f"{line} " * 8 + "end"), (6, "a b " * 30), (7, "A a " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("runs"), F.lit("x").alias("collapsed"), F.lit(2).alias("n_words"))
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()), key=repr)
    want = []
    for i, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        runs = brute(words[:200]) if len(words) < 10_000 else [(0, len(words), 1)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert got == sorted(want, key=repr)
    assert periodic_runs(docs.limit(0)).collect() == []


def test_repeated_tail():
    import zlib

    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert len(ids) > 20 and all(repeated_tail(i, 50) is None for i in range(400) if i not in ids) and repeated_tail(ids[0], 0) is None
    for i in ids:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % 50
        p = 1 + (50 - a) // (3 + g % 8)
        assert repeated_tail(i, 50).tolist() == [k if k < a else a + (k - a) % p for k in range(50)]
    assert kept_words(6, [(1, 4, 2)]).tolist() == [0, 1, 2, 5]
