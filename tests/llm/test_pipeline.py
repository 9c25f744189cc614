"""The pipeline against brute force on a small table."""

import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from platelens.llm.common import load
from platelens.llm.queries import tokenizer_path
from platelens.llm.toxicity import toxicity

from .test_minhash import brute


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = load(spark, d, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]
    clean = {r.doc_id for r in toxicity(docs, load(spark, d, "labels")).filter("kept").collect()}
    left = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in clean}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i]), i)
    left = {i: left[i] for i in first.values()}
    groups = brute(list(left.items()), 5, 80)
    left = {i: t for i, t in left.items() if groups[i][1] == i}
    words = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [words(r.text) for r in load(spark, d, "benchmark").collect()]
    left = {i: t for i, t in left.items() if not any(x in words(t) for x in items)}
    got = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in got} == set(left)
    plain, pieces = Tokenizer.from_file(tokenizer_path()), set()
    for i, t in left.items():
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4")
        pieces |= {(i, s, min(4096, len(ids) - s), zlib.crc32(ids[s : s + 4096].tobytes())) for s in range(0, len(ids), 4096)}
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in got} == pieces and len(got) == len(pieces)
