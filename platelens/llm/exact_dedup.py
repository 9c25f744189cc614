"""Exact dedup against a persistent digest index, native DataFrame operations only.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per digest
(map-side combined, so a text that fills a third of the batch is one row before the shuffle), those rows
are anti-joined with the index by sort-merge on the buckets, and what is new is appended. The rows of the
batch then get their group's verdict by a plain sort-merge join of which both sides are shuffled, so that
adaptive execution splits the partition of a hot text.

Defined results: null text counts as empty; equal means identical after each run of white space became one
blank; the smallest doc_id stays; rows that repeat both doc_id and text are one document and share the
verdict; a group whose doc_ids are all null keeps null (`kept` is true for its rows); an empty table gives
no rows; extra columns don't matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, fresh_path, materialise


def text_digest(text: str = "text"):
    """SHA-256 (hex) of the text with each run of white space replaced by one blank."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE_CLASS, " "), 256)


class DigestIndex:
    """Table (digest BINARY, keep_id BIGINT), one row per distinct text seen so far."""

    def __init__(self, spark: SparkSession, path: str | None = None, n_buckets: int | None = None):
        """path: where the index lives (created when there is none); n_buckets is fixed at creation
        and must be given again to reopen the index in another session."""
        self.spark = spark
        self.path = path or fresh_path(spark, "digest-index")
        self.n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.n_buckets} BUCKETS LOCATION '{self.path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, groups: DataFrame) -> None:
        """Append the rows (digest, keep_id) whose digest the index lacks."""
        new = materialise(groups.select("digest", "keep_id").join(self.table().select("digest").hint("merge"), "digest", "left_anti"), "fresh-digests")
        self.spark.catalog.refreshTable(self.name)
        # one task per bucket, so that an append adds one file to each bucket at most
        new.repartition(self.n_buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size (in this batch), kept, text_sha256."""
    index = index or DigestIndex(docs.sparkSession)
    digests = materialise(docs.select(F.col(doc_id).alias("doc_id"), F.unhex(text_digest(text)).alias("digest")), "digests")
    groups = materialise(digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
    index.add(groups)
    verdicts = materialise(groups.select("digest", "group_size").join(index.table().hint("merge"), "digest"), "verdicts")
    return digests.join(verdicts.hint("merge"), "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of docs that stay; rows that repeat doc_id and text leave one. The columns of docs, whatever their
    names."""
    verdicts = exact_dedup(docs.select("doc_id", "text"), index).filter("kept")
    kept = verdicts.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__kept")).distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, F.col("doc_id").alias("__own"), text_digest().alias("__digest"))
    stay = keyed.join(kept.hint("merge"), F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__kept")), "left_semi")
    return stay.dropDuplicates(["__own", "__digest"]).select("row.*")
