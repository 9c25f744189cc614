"""Rows without ids, ids of any type, and columns whose names clash, where they once gave wrong rows or crashed."""

from pyspark.sql import functions as F

from platelens.llm.decontaminate import drop_leaks, find_leaks
from platelens.llm.exact_dedup import drop_exact_duplicates
from platelens.llm.minhash import drop_near_duplicates, near_duplicates

WORDS = [f"w{i}" for i in range(200)]
TEXT, NEAR, NEARER = " ".join(WORDS), " ".join(WORDS[:100] + ["x"] + WORDS[101:]), " ".join(WORDS[:150] + ["y"] + WORDS[151:])


def test_near_copies_without_ids_are_linked(spark):
    docs = spark.createDataFrame([(None, TEXT), (5, NEAR), (None, "nothing like the others at all")], "doc_id long, text string")
    rows = {(r.doc_id, r.component_id, r.kept, r.n_shingles) for r in near_duplicates(docs).collect()}
    assert rows == {(None, 5, False, 196), (5, 5, True, 196), (None, None, True, 2)}
    lone = spark.createDataFrame([(None, TEXT), (None, NEAR), (None, NEARER), (None, "else")], "doc_id long, text string")
    assert len(drop_near_duplicates(lone).collect()) == 2
    assert len({r.component_id for r in near_duplicates(lone).collect()}) == 1


def test_benchmark_ids_of_any_type(spark):
    item = "the quick brown fox jumps over the lazy dog and then runs far away from here"
    docs = spark.createDataFrame([(1, f"so {item} indeed"), (2, "clean text without any of it")], "doc_id long, text string")
    for kind, ids in (("string", ["b", None, "a"]), ("long", [3, None, 1]), ("int", [2, 1, None])):
        bench = spark.createDataFrame([(i, item) for i in ids], f"item_id {kind}, text string")
        got = {r.doc_id: r.item_ids for r in find_leaks(docs, bench).collect()}
        assert got == {1: [*sorted(i for i in ids if i is not None), None], 2: []}
        assert [r.doc_id for r in drop_leaks(docs, bench).collect()] == [2]


def test_stage_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a  b"), (2, "a b"), (2, "a b"), (None, "c"), (3, None), (4, "")], "doc_id long, text string")
    clash = docs.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in ("__id", "__digest", "__kept", "__own", "row", "digest", "kept", "keep_id", "text_sha256")))
    got = drop_exact_duplicates(clash)
    assert got.columns == clash.columns
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 3]
    assert {r["__digest"] for r in got.collect()} == {"__digest1", "__digest3", None}
