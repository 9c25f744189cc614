"""Lines that many documents share, dropped but for one document; native DataFrame operations only.

A line's key is hashed (128 bits) and dealt out by range of (hash, document), sorted by hash, document and
position: a line that fills a third of the table lies in as many ranges as it needs, and what one document holds of
one line lies in one. There the first line of each run of (hash, document) is marked as the stream passes; the marks
of a hash are counted, and its largest document found, with a row a range in the shuffle. Lines of widespread
hashes come back by a sort-merge join whose hot partitions adaptive execution splits. What is returned for a
document is its keep bitmap, run-length coded: the stretches of lines that stay. Texts are shuffled only by
`kept_texts`, which applies the bitmaps.

Defined results: null and empty texts are one empty line; documents are told apart by doc_id (rows that share one
are one document in the counting, null among them, which is smaller than all); lines of a document that is the
largest holding them all stay, however often they come; rows that repeat a text get the same bitmap; an empty table
gives no rows; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\f\r")), _UPPER, _LOWER)


def _hashes(value: Column, *names: str) -> list[Column]:
    """Two 64-bit hashes of unlike seeds."""
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit(7), value).alias(names[1])]


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the text's hashes, which tell apart rows that share a doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *_hashes(text, "t1", "t2"))


def sorted_lines(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(h1, h2, doc_id, pos, t1, t2, n_lines, first): the lines whose key has `min_chars` at least, range-partitioned
    and sorted by hash, document and position; `first` marks a document's first line of a hash."""
    text = _named(docs).select("doc_id", "t1", "t2", lines().alias("lines"))
    at = text.select("doc_id", "t1", "t2", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    keyed = at.select("doc_id", "t1", "t2", "n_lines", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    hashed = keyed.select(*_hashes(F.col("key"), "h1", "h2"), "doc_id", "pos", "t1", "t2", "n_lines")
    dealt = hashed.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    run = Window.partitionBy("h1", "h2", "doc_id").orderBy("pos")
    return dealt.withColumn("first", F.row_number().over(run) == 1)


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, t1, t2, n_lines, pos) of the lines to drop: the key is in `min_docs` documents at least, and this is
    not the largest of them."""
    found = materialise(sorted_lines(docs, min_chars), "sorted-lines")
    marks = found.filter("first").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    spread = materialise(marks.filter(F.col("n") >= min_docs).select("h1", "h2", "last"), "spread-lines")
    met = found.drop("first").join(spread.hint("merge"), ["h1", "h2"])
    return met.filter(~F.col("doc_id").eqNullSafe(F.col("last"))).select("doc_id", "t1", "t2", "n_lines", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, t1, t2, n_dropped, keep): for each document that loses lines, its keep bitmap as the stretches
    (start, length) of lines that stay, in order."""
    per = dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "t1", "t2")
    gone = materialise(per.agg(F.first("n_lines").alias("n_lines"), F.array_sort(F.collect_set("pos")).alias("gone")), "dropped-lines")
    before, after = F.concat(F.array(F.lit(-1)), "gone"), F.concat("gone", F.array("n_lines"))
    between = F.zip_with(before, after, lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")))
    return gone.select("doc_id", "t1", "t2", F.size("gone").alias("n_dropped"), F.filter(between, lambda s: s["length"] > 0).alias("keep"))


def kept_texts(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, keep (null where all lines stay) and kept_text."""
    # both tables hold arrays, so that no lambda below splits a text or makes a bitmap again
    bitmaps = materialise(keep_bitmaps(docs, min_chars, min_docs), "keep-bitmaps")
    rows = _named(docs).select("doc_id", "t1", "t2", lines().alias("lines"))
    same = (rows.t1 == bitmaps.t1) & (rows.t2 == bitmaps.t2) & rows.doc_id.eqNullSafe(bitmaps.doc_id)
    met = rows.join(bitmaps.hint("merge"), same, "left").select(rows.doc_id, "lines", "n_dropped", "keep")
    kept = F.flatten(F.transform("keep", lambda s: F.slice("lines", s["start"] + 1, s["length"])))
    return met.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep",
        F.array_join(F.when(F.col("keep").isNull(), F.col("lines")).otherwise(kept), "\n").alias("kept_text"),
    )
