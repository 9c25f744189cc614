"""Detection files as they arrive, progress and throughput. The batch twin of an aggregation is the same
function over a static frame."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import cut_lineage
from ..operators.summaries import number_rows
from ..operators.suppress import nms_global
from ..sources.tables import DETECTION_CSV, image_of


def stream_detections(spark: SparkSession, path: str, together: bool = False) -> DataFrame:
    """Rows of detection files in a folder, with the place of their split in the file; a file is one complete
    plate or, together, holds many complete ones, named in a first column."""
    schema = f"plate_id string, {DETECTION_CSV}" if together else DETECTION_CSV
    rows = spark.readStream.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    plate = [] if together else [image_of(F.col("_metadata.file_path")).alias("plate_id")]
    return rows.select(*plate, "*", F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_modification_time").alias("arrived"), F.col("_metadata.file_path").alias("path"))


def suppress_arrivals(stream: DataFrame, out: str, checkpoint: str, t: float = 0.5):
    """Start the query that writes the suppressed detections of each micro-batch's plates. Plates arrive
    whole, so suppression inside a batch is exact; a batch that is repeated overwrites its own folder."""

    def run(batch: DataFrame, number: int) -> None:
        # the order in the file: by split, and in a split as read; written before it is used twice
        read = batch.withColumnRenamed("confidence", "conf").withColumn("__at", F.monotonically_increasing_id())
        rows = cut_lineage(number_rows(read, "det_seq", "plate_id", F.asc("block"), F.asc("__at")).drop("__at", "block", "path"))
        nms_global(rows, t, mixed_sizes=True).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def suppress_with_late_rows(stream: DataFrame, store: str, out: str, checkpoint: str, t: float = 0.5):
    """As suppress_arrivals where a plate's rows may come in several files and batches, in any order: a batch's rows
    are kept in `store`, and the plates that it touches are suppressed again from all of their rows and replaced in
    `out`, a folder a plate. Equal confidences go by the rows' place in the files in order of their paths, so the
    result is that of one batch over all files. A batch that is repeated replaces what it had written. stream: rows
    of stream_detections."""
    order = ("path", "block", "__at")

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        numbered = batch.withColumnRenamed("confidence", "conf").withColumn("__at", F.monotonically_increasing_id())
        numbered.write.mode("overwrite").parquet(f"{store}/batch={number}")
        touched = spark.read.parquet(f"{store}/batch={number}").select("plate_id").distinct()
        known = spark.read.option("mergeSchema", True).parquet(store).filter(F.col("batch") <= number).drop("batch")
        rows = known.join(touched.hint("merge"), "plate_id", "left_semi")
        rows = cut_lineage(number_rows(rows, "det_seq", "plate_id", *(F.asc(c) for c in order)).drop(*order))
        kept = nms_global(rows, t, mixed_sizes=True).withColumn("plate", F.col("plate_id"))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("plate").parquet(out)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PLATE_STATE = "plate_id string, status string, detections long, updates long"


def plate_states(events: DataFrame, quiet: str = "10 minutes", watermark: str = "10 minutes", key: str = "plate_id", time: str = "arrived"):
    """Rows of PLATE_STATE as a stream: 'open' while rows of a plate come in, 'closed' once the watermark has passed
    its last row by `quiet`, whereupon its state is dropped; rows that come later open it again. So the state is one
    small row for each plate that is being worked on, however many have passed. Rows behind the watermark are
    dropped."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    milliseconds = _milliseconds(quiet)

    def step(name, frames, state):
        if state.hasTimedOut:
            detections, updates = state.get
            state.remove()
            yield pd.DataFrame({"plate_id": [name[0]], "status": ["closed"], "detections": [detections], "updates": [updates]})
            return
        detections, updates = state.get if state.exists else (0, 0)
        last = 0
        for part in frames:
            detections += len(part)
            last = max(last, int(part["__at"].max()))
        state.update((detections, updates + 1))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + milliseconds)
        yield pd.DataFrame({"plate_id": [name[0]], "status": ["open"], "detections": [detections], "updates": [updates + 1]})

    rows = _watermarked(events, time, watermark).select(F.col(key).cast("string").alias("plate_id"), time, (F.unix_millis(time)).alias("__at"))
    return rows.groupBy("plate_id").applyInPandasWithState(step, PLATE_STATE, "detections long, updates long", "update", GroupStateTimeout.EventTimeTimeout)


def _milliseconds(span: str) -> int:
    number, unit = span.split()
    return int(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def progress(done: DataFrame, total: int, key: str = "plate_id") -> DataFrame:
    """completed, total and whole percent. Streams need complete mode; their state is a row for each plate."""
    return done.select(key).filter(F.col(key).isNotNull()).dropDuplicates([key]).agg(F.count(F.lit(1)).alias("completed")).select("completed", F.lit(total).alias("total"), F.floor(F.col("completed") * 100 / total).alias("percent"))


def _watermarked(events: DataFrame, time: str, watermark: str) -> DataFrame:
    """A watermark takes timestamps with a time zone only."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)


def throughput(events: DataFrame, window: str = "1 hour", slide: str | None = None, watermark: str = "2 hours", time: str = "ts", value: str = "value") -> DataFrame:
    """Organisms and plates per event-time window; rows later than the watermark are dropped by a stream."""
    rows = _watermarked(events, time, watermark) if events.isStreaming else events
    span = F.window(time, window, slide) if slide else F.window(time, window)
    return rows.groupBy(span.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("organisms")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "organisms")


def sessions(events: DataFrame, gap: str = "10 minutes", watermark: str = "2 hours", key: str = "user_id", time: str = "ts", value: str = "value") -> DataFrame:
    """The same per plate and session, a session ending after `gap` without rows."""
    rows = _watermarked(events, time, watermark) if events.isStreaming else events
    return rows.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("organisms")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "organisms")


def stream_dedup(events: DataFrame, *keys: str, time: str = "ts", watermark: str = "2 hours") -> DataFrame:
    """Replayed rows removed; state is kept for the watermark only."""
    if not events.isStreaming:
        return events.dropDuplicates(list(keys))
    return _watermarked(events, time, watermark).dropDuplicatesWithinWatermark(list(keys))
