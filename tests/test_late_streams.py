"""Streams whose files come in any order and whose plates come in parts, against one batch over all files."""

import os
import random
import time

from pyspark.sql import functions as F

from platelens.operators.summaries import number_rows
from platelens.operators.suppress import nms_global
from platelens.sources import tables
from platelens.streaming import streams

BOX = "x1 double, y1 double, x2 double, y2 double, conf double, class int"


def write(spark, folder, name, rows):
    """One detection file in a folder of its own (a plate's files share their name)."""
    tables.detection_rows(spark.createDataFrame(rows, BOX)).coalesce(1).write.option("header", True).csv(f"{folder}-raw")
    os.makedirs(folder)
    os.rename(next(f"{folder}-raw/{f}" for f in os.listdir(f"{folder}-raw") if f.startswith("part")), f"{folder}/{name}_detections.csv")


def boxes(rng, n):
    out = []
    for _ in range(n):
        x, y = rng.randrange(60), rng.randrange(60)
        out.append((float(x), float(y), float(x + rng.randrange(10, 25)), float(y + rng.randrange(10, 25)), rng.randrange(4) / 4, 0))
    return out


def test_late_files_give_what_a_batch_gives(spark, tmp_path):
    rng = random.Random(9)
    files = [(f"{k}", f"plate{k % 3}", boxes(rng, 14)) for k in range(7)]
    for k, name, rows in files:
        write(spark, f"{tmp_path}/made/{k}", name, rows)
    come = tmp_path / "in"
    come.mkdir()
    order = list(range(7))
    rng.shuffle(order)
    for part in (order[:3], order[3:5], order[5:]):
        for k in part:
            os.rename(tmp_path / "made" / str(k), come / str(k))
        q = streams.suppress_with_late_rows(streams.stream_detections(spark, str(come)), f"{tmp_path}/store", f"{tmp_path}/kept", f"{tmp_path}/cp")
        q.awaitTermination(120)
    rows = [(f"plate{k % 3}", int(k), n, *row) for k, _, own in files for n, row in enumerate(own) for k in [int(k)]]
    every = spark.createDataFrame(rows, f"plate_id string, file int, n int, {BOX}")
    want = nms_global(number_rows(every, "det_seq", "plate_id", F.asc("file"), F.asc("n")), mixed_sizes=True)
    key = lambda r: (r.plate_id, r.x1, r.y1, r.x2, r.y2, r.conf, r.det_seq)
    assert sorted(map(key, spark.read.parquet(f"{tmp_path}/kept").collect())) == sorted(map(key, want.collect()))


def test_plates_close_and_open_again(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()

    def come(number, rows):
        df = spark.createDataFrame(rows, "plate_id string, at string").select("plate_id", F.to_timestamp("at").alias("arrived"))
        df.coalesce(1).write.parquet(f"{tmp_path}/raw{number}")
        os.rename(next(f"{tmp_path}/raw{number}/{f}" for f in os.listdir(f"{tmp_path}/raw{number}") if f.startswith("part")), folder / f"{number}.parquet")

    come(0, [("a", "2026-01-01 10:00:00"), ("a", "2026-01-01 10:01:00"), ("b", "2026-01-01 10:02:00")])
    stream = spark.readStream.schema("plate_id string, arrived timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))
    seen = []
    q = streams.plate_states(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    come(1, [("c", "2026-01-01 11:00:00")])  # the watermark passes a and b
    q.processAllAvailable()
    come(2, [("a", "2026-01-01 11:05:00")])  # a again, with a state of its own
    time.sleep(1)
    q.processAllAvailable()
    q.stop()
    assert {s for s in seen if s[1] == "open"} == {("a", "open", 2, 1), ("b", "open", 1, 1), ("c", "open", 1, 1), ("a", "open", 1, 1)}
    assert {s for s in seen if s[1] == "closed"} == {("a", "closed", 2, 1), ("b", "closed", 1, 1)}
