import random
import re

import numpy as np
import pytest

from platelens.llm.minhash import _family_links, drop_near_duplicates, near_duplicates


def brute(rows, n, num):
    """{doc_id: (n_shingles, component_id)} by comparing every pair."""
    sets = {}
    for doc, text in rows:
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    component = {d: d for d in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(component[a], component[b])
            if component[a] != low or component[b] != low:
                component[a] = component[b] = low
                changed = True
    return {d: (len(sets[d]), component[d]) for d in sets}


def test_matches_brute_force_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, n=3, num=85).collect()}
    assert got == want


@pytest.mark.parametrize("num", [80, 85])
def test_chains_edges_and_copies(spark, num):
    rng = random.Random(num)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choice(words) for _ in range(90)]
    for d in range(80):
        rows.append((d, " ".join(base)))
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = rng.choice(words)
    common = " ".join(rng.choice(words) for _ in range(60))
    rows += [(1000 + d, common + " " + " ".join(rng.choice(words) for _ in range(8))) for d in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, "One\ttwo"), (2007, "É a b"), (2008, "é a b")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, n=3, num=num).collect()}
    assert got == brute(rows, 3, num)


def test_empty_null_ids_and_the_stage(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).collect() == []
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (9, "q"), (None, "zz")], "doc_id long, text string")
    rows = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert rows == {(None, 5, False), (5, 5, True), (9, 9, True), (None, None, True)}
    assert sorted(r.doc_id or 0 for r in drop_near_duplicates(docs).collect()) == [0, 5, 9]
    # rows are judged by id and text: a near copy without an id goes, other rows that share an id stay
    long = [f"w{i}" for i in range(80)]
    near = " ".join(long[:79] + ["x"])
    rows = [(None, near, 1), (None, "other words that nobody else has here", 2), (7, " ".join(long), 3), (7, "seven other words in the second row", 4), (8, None, 5), (8, None, 6), (9, near, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest long")
    assert sorted(r.digest for r in drop_near_duplicates(docs).collect()) == [2, 3, 4, 5, 6]
    assert drop_near_duplicates(docs).columns == docs.columns


def test_a_family_sends_no_more_links_than_join_it(spark):
    rng = np.random.default_rng(3)
    common = rng.integers(1, 2**62, 90)
    sets = [np.unique(np.concatenate([common, rng.integers(1, 2**62, 4)])).astype("<u8") for _ in range(120)]  # all alike
    chain = [np.arange(10**6 + d, 10**6 + d + 60).astype("<u8") for d in range(0, 200, 5)]  # each like its neighbours only
    names = [bytes([i]) for i in range(len(sets) + len(chain))]
    rows = [(n, s.tobytes(), len(s)) for n, s in zip(names, sets + chain)]
    table = spark.createDataFrame(rows, "class binary, set binary, n_shingles long")
    placed = table.selectExpr("7L AS value", "class", "class AS component")
    mixed = spark.createDataFrame([(7, b"\0")], "value long, hub binary")
    links = [(bytes(r.a)[0], bytes(r.b)[0]) for r in _family_links(placed, mixed, table, 80, block=16).collect()]
    assert len(links) < 2 * len(rows)  # a link a pair would be 7,179
    group = list(range(len(rows)))
    for _ in rows:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    assert group == [0] * 120 + [120] * 40
