"""Line dedup against a brute-force version, over nulls, empty texts, ties, repeated rows and clashing names."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from platelens.llm.line_dedup import keep_bitmaps, kept_texts

SPACES = " \t\n\x0b\f\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACES))


def brute(rows, min_chars, min_docs):
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    lowest = lambda i: -(10**9) if i is None else i
    last = {k: max(v, key=lowest) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    stock = ["shared line number %d of some length" % k for k in range(12)] + ["", "short", "É" * 9, "é" * 9, "\tShared Line NUMBER 3 of some length \r", "\x85shared line number 4 of some length"]
    rows = [(i, "\n".join(rng.choice(stock) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "word " * 60_000), (None, stock[0] + "\n" + stock[1]), (None, stock[0]), rows[3], rows[3], (7, stock[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = docs.select("*", *(F.lit("x").alias(c) for c in ("h1", "h2", "t1", "t2", "pos", "first", "keep", "lines", "line", "key", "gone", "n", "last", "n_lines", "n_dropped")))
    for min_chars, min_docs in ((9, 5), (9, 2), (1, 3)):
        assert rows_of(kept_texts(docs, min_chars, min_docs)) == brute(rows, min_chars, min_docs)
    assert rows_of(kept_texts(clash, 9, 5)) == brute(rows, 9, 5)


def test_bitmaps_are_the_stretches_that_stay(spark):
    docs = spark.createDataFrame([(i, "own %d\n%s\nmine %d\n%s" % (i, "a" * 40, i, "b" * 40)) for i in range(6)] + [(9, "a" * 40)], "doc_id long, text string")
    got = {r.doc_id: (r.n_dropped, [tuple(s) for s in r.keep]) for r in keep_bitmaps(docs).collect()}
    # line 1 stays in the largest document that holds it, 9, and line 3 in 5
    assert got == {**{i: (2, [(0, 1), (2, 1)]) for i in range(5)}, 5: (1, [(0, 1), (2, 2)])}


def test_empty_table(spark):
    assert kept_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_python_worker_on_the_main_path(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = kept_texts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
