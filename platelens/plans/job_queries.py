"""Queries over sinks, streams and whole jobs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import duck, view
from ..operators import labels, suppress, summaries, tiles
from ..sources import tables
from ..streaming import streams
from . import jobs
from .io_queries import folder
from .registry import query, rounded
from .table_queries import _grid_sql, _nms_sql, _ROI_TILES, roi_tiles


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


@query("SELECT page_id, regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM pages")
def s01_stem(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", tables.stem("url").alias("stem"))


@query(duck("fx_det") + " SELECT plate_id, x1, y1, x2, y2, x2 - x1 AS width, y2 - y1 AS height, conf AS confidence, class FROM fx_det")
def s08_detection_rows(spark: SparkSession, d: str) -> DataFrame:
    return tables.detection_rows(view(spark, d, "fx_det"), "plate_id")


@query(duck("fx_det") + " SELECT plate_id, det_seq AS detection_id, w AS bbox_width_px, h AS bbox_height_px, round(w * 8.666 / 1000, 6) AS length_mm, conf AS confidence, class, 'fast' AS method, 22 AS n_columns FROM fx_det")
def s09_measurement_rows(spark: SparkSession, d: str) -> DataFrame:
    det = view(spark, d, "fx_det").select("plate_id", F.col("det_seq").alias("detection_id"), F.col("w").alias("bbox_width_px"), F.col("h").alias("bbox_height_px"), F.round(F.col("w") * 8.666 / 1000, 6).alias("length_mm"), F.col("conf").alias("confidence"), "class", F.lit("fast").alias("method"))
    rows = tables.measurement_rows(det, "mm", "plate_id")
    return rows.select("plate_id", "detection_id", "bbox_width_px", "bbox_height_px", "length_mm", "confidence", "class", "method", F.lit(len(rows.columns) - 1).alias("n_columns"))


@query("WITH kept AS (" + _nms_sql(0.5, "true") + ")" + (duck("fx_plate", "fx_det") + _grid_sql(256, 64)).replace("WITH RECURSIVE", ",", 1) + " SELECT p.plate_id, (SELECT count(*) FROM tiles t WHERE t.plate_id = p.plate_id) AS num_tiles, (SELECT count(*) FROM fx_det f WHERE f.plate_id = p.plate_id) AS before, (SELECT count(*) FROM kept f WHERE f.plate_id = p.plate_id) AS after, CAST(p.plate_id AS VARCHAR) AS image, width FROM fx_plate p")
def s10_run_metadata(spark: SparkSession, d: str) -> DataFrame:
    # numbering detections sorts and shuffles them, so they are written once for all that looks at them
    plates, det = view(spark, d, "fx_plate"), suppress.cut_lineage(view(spark, d, "fx_det").select("plate_id", "det_seq", "x1", "y1", "x2", "y2", "conf"))
    counts = summaries.nms_counts(det, suppress.nms_global(det), tiles.tile_grid(plates, 256, 64))
    doc = tables.run_metadata(plates, counts, 256, 64, 0.6, 0.5)
    parsed = F.from_json("json", "image string, image_size array<int>, num_tiles long, detections_before_nms long, detections_after_nms long")
    return doc.select("plate_id", parsed.alias("j")).select("plate_id", F.col("j.num_tiles").alias("num_tiles"), F.col("j.detections_before_nms").alias("before"), F.col("j.detections_after_nms").alias("after"), F.col("j.image").alias("image"), F.col("j.image_size")[0].alias("width"))


@query(duck("fx_plate") + ", l AS (SELECT list_sort(list(image_name)) AS images, count(*) AS num_plates FROM fx_plate) SELECT unnest(images) AS image, num_plates FROM l")
def s11_batch_config(spark: SparkSession, d: str) -> DataFrame:
    doc = tables.batch_config(view(spark, d, "fx_plate"), "model", 8.666, "cpu")
    return doc.select(F.from_json("json", "images array<string>, num_plates long").alias("j")).select(F.explode("j.images").alias("image"), "j.num_plates")


@query(duck("fx_plate", "fx_roi") + _ROI_TILES + " SELECT lab.plate_id, tile_id, x_off AS offset_x, y_off AS offset_y, coalesce(split_assigned, 'test') AS split, count(*) AS num_annotations FROM lab JOIN fx_plate p ON lab.plate_id = p.plate_id GROUP BY ALL")
def s13_tile_metadata(spark: SparkSession, d: str) -> DataFrame:
    splits = view(spark, d, "fx_plate").select("plate_id", F.col("split_assigned").alias("split")).filter("split IS NOT NULL")
    rows = labels.assign_split(roi_tiles(spark, d), splits).withColumn("tile_name", tiles.names()["tile_name"])
    kind = "map<string, struct<tile_id: int, offset_x: int, offset_y: int, split: string, num_annotations: long>>"
    return tables.tile_metadata(rows, 256).select("plate_id", F.explode(F.from_json("json", kind)).alias("name", "t")).select("plate_id", "t.*")


@query(duck("fx_det") + " SELECT concat(plate_id, '-', det_seq) AS id, plate_id AS image_id, x1 AS x, w, w * h AS area, conf AS score FROM fx_det")
def s14_coco_annotations(spark: SparkSession, d: str) -> DataFrame:
    return tables.coco_annotations(view(spark, d, "fx_det")).select("id", "image_id", F.col("bbox")[0].alias("x"), F.col("bbox")[2].alias("w"), "area", "score")


@query(
    duck("fx_plate", "fx_roi")
    + _ROI_TILES
    + """, c AS (SELECT plate_id, tile_id, greatest(0, x - x_off) AS a, greatest(0, y - y_off) AS b, least(256, x + w - x_off) AS c, least(256, y + h - y_off) AS d FROM lab),
    n AS (SELECT plate_id, tile_id, list_transform([(a + c) / 512.0::DOUBLE, (b + d) / 512.0::DOUBLE, (c - a) / 256.0::DOUBLE, (d - b) / 256.0::DOUBLE], lambda v: printf('%.6f', floor(v * 1000000 + 0.5) / 1000000)) AS v FROM c)
    SELECT plate_id, printf('%s_tile_%04d', CAST(plate_id AS VARCHAR), tile_id) AS tile_name, array_to_string(list_sort(list('0 ' || array_to_string(v, ' '))), chr(10)) AS body FROM n GROUP BY plate_id, tile_id"""
)
def s12_yolo_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = tiles.global_to_tile(roi_tiles(spark, d), 256).withColumn("tile_name", tiles.names()["tile_name"])
    return tables.yolo_labels(rows, "plate_id", "tile_name")


@query("SELECT count(DISTINCT user_id) AS completed, 1000000 AS total, CAST(floor(count(DISTINCT user_id) * 100 / 1000000.0) AS BIGINT) AS percent FROM events")
def m02_progress(spark: SparkSession, d: str) -> DataFrame:
    return streams.progress(events(spark, d), 1_000_000, "user_id")


@query(
    """WITH e AS (SELECT user_id, count(*) AS n, max(epoch_ms(ts)) AS last FROM events GROUP BY user_id), w AS (SELECT max(epoch_ms(ts)) - 600000 AS mark FROM events)
    SELECT CAST(user_id AS VARCHAR) AS plate_id, 'open' AS status, n AS detections, 1::BIGINT AS updates FROM e
    UNION ALL SELECT CAST(user_id AS VARCHAR), 'closed', n, 1 FROM e, w WHERE last + 600000 < mark"""
)
def m02_plate_states(spark: SparkSession, d: str) -> DataFrame:
    """The events as one arrival: every plate opens, and those that the watermark has passed by ten minutes close."""
    path, out = folder(spark, "arrivals"), folder(spark, "states")
    events(spark, d).select("user_id", "ts").repartition(1).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    states = streams.plate_states(stream, key="user_id", time="ts").writeStream.outputMode("update")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    states.foreachBatch(write).option("checkpointLocation", folder(spark, "states-progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


@query('SELECT date_trunc(\'hour\', ts) AS start, date_trunc(\'hour\', ts) + INTERVAL 1 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS organisms FROM events GROUP BY 1, 2')
def m03_throughput(spark: SparkSession, d: str) -> DataFrame:
    return rounded(streams.throughput(events(spark, d)), "organisms", digits=4)


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS n, round(sum(value), 4) AS organisms FROM s GROUP BY user_id, k"""
)
def m03_sessions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(streams.sessions(events(spark, d)), "organisms", digits=4)


@query("SELECT DISTINCT user_id, event_type FROM events")
def m04_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return streams.stream_dedup(events(spark, d), "user_id", "event_type").select("user_id", "event_type")


@query(duck("fx_gray") + " SELECT plate_id, round(avg(v), 6) AS mean_value, round(1 / (1 + exp(-(avg(v) - 128) / 10)), 6) AS p FROM fx_gray GROUP BY plate_id")
def d02_score_crops(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    crops = view(spark, d, "fx_gray").groupBy("plate_id").agg(F.avg("v").alias("mean_value"))
    return rounded(jobs.score_crops(crops, lambda v: 1 / (1 + np.exp(-(v - 128) / 10)), "mean_value"), "mean_value", "p")


def stub_detector(batches):
    """Two boxes a tile that depend on its place, for plates that need no model."""
    for t in batches:
        for k in (0, 1):
            x, y = (t["tile_id"] * 37 + k * 11) % 150, (t["tile_id"] * 53 + k * 7) % 150
            yield pd.DataFrame({"plate_id": t["plate_id"], "tile_id": t["tile_id"].astype("int32"), "x1": x * 1.0, "y1": y * 1.0, "x2": x + 60.0, "y2": y + 50.0, "conf": 0.5 + (t["tile_id"] * 7 + k * 3 + t["plate_id"]) % 50 / 100.0, "class": 0})


_FOUND = (
    duck("fx_plate")
    + _grid_sql(256, 64)
    + """, k AS (SELECT t.*, k FROM tiles t, (SELECT unnest([0, 1]) AS k)),
    fx_det AS (SELECT plate_id, tile_id, (tile_id::BIGINT << 32) + k AS det_seq, ((tile_id * 37 + k * 11) % 150 + x_off)::DOUBLE AS x1, ((tile_id * 53 + k * 7) % 150 + y_off)::DOUBLE AS y1, ((tile_id * 37 + k * 11) % 150 + x_off + 60)::DOUBLE AS x2,
      ((tile_id * 53 + k * 7) % 150 + y_off + 50)::DOUBLE AS y2, 60.0::DOUBLE AS w, 50.0::DOUBLE AS h, 0.5::DOUBLE + CAST((tile_id * 7 + k * 3 + plate_id) % 50 AS DOUBLE) / 100.0::DOUBLE AS conf, 0 AS class FROM k WHERE 0.5::DOUBLE + CAST((tile_id * 7 + k * 3 + plate_id) % 50 AS DOUBLE) / 100.0::DOUBLE >= 0.6)"""
)


@query(_nms_sql(0.5, "true").replace(duck("fx_det"), _FOUND, 1).replace("SELECT plate_id, det_seq, conf FROM fx_det WHERE", "SELECT plate_id, tile_id, det_seq, x1, y1, x2, y2, conf FROM fx_det WHERE", 1))
def x01_detect_tiled(spark: SparkSession, d: str) -> DataFrame:
    return jobs.detect_tiled(view(spark, d, "fx_plate"), stub_detector, 256, 64)[0].select("plate_id", "tile_id", "det_seq", "x1", "y1", "x2", "y2", "conf")


@query(
    "WITH k AS ("
    + _nms_sql(0.5, "true").replace("WITH RECURSIVE fx_det AS (", "WITH RECURSIVE all_det AS (", 1).replace("), pr AS", "), fx_det AS (SELECT * FROM all_det WHERE conf >= 0.6), pr AS", 1).replace("SELECT plate_id, det_seq, conf FROM fx_det", "SELECT * FROM fx_det", 1)
    + """), p AS (SELECT plate_id, greatest(w, h) * 8.666 AS l, least(w, h) * 8.666 AS w, w * h * pow(8.666, 2) AS a FROM k)
    SELECT plate_id, count(*) AS organisms, round(avg(l), 3) AS mean_length, round(quantile_cont(w, 0.5), 3) AS median_width, round(avg(a), 2) AS mean_area FROM p GROUP BY plate_id"""
)
def x09_detection_summary(spark: SparkSession, d: str) -> DataFrame:
    s = jobs.detection_summary(spark, d).select("plate_id", "organisms", F.round("mean_length", 3).alias("mean_length"), F.round("median_width", 3).alias("median_width"), F.round("mean_area", 2).alias("mean_area"))
    return s


def failing_detector(batches):
    """Boxes of 8x8 pixels by the tile's place; none for every fourth plate, and an error at the one after it."""
    for t in batches:
        bad = t.loc[t["plate_id"] % 4 == 3, "plate_id"]
        if len(bad):
            raise ValueError(f"no model for plate {bad.min()}")
        t = t[t["plate_id"] % 4 != 2]
        for k in (0, 1):
            x, y = (t["tile_id"] * 7 + k * 2) % 20, (t["tile_id"] * 5 + k) % 20
            yield pd.DataFrame({"plate_id": t["plate_id"], "tile_id": t["tile_id"].astype("int32"), "x1": x * 1.0, "y1": y * 1.0, "x2": x + 8.0, "y2": y + 8.0, "conf": 0.6 + (t["tile_id"] * 7 + k * 3 + t["plate_id"]) % 40 / 100.0, "class": 0})


_BATCH_FOUND = (
    duck("fx_gray")
    + ", gp AS (SELECT DISTINCT plate_id, 80 AS width, 40 AS height FROM fx_gray WHERE plate_id IN (SELECT s_suppkey FROM supplier))"
    + _grid_sql(32, 8).replace("fx_plate", "gp")
    + """, k AS (SELECT t.*, k FROM tiles t, (SELECT unnest([0, 1]) AS k) WHERE plate_id % 4 < 2),
    fx_det AS (SELECT plate_id, tile_id, (tile_id::BIGINT << 32) + k AS det_seq, ((tile_id * 7 + k * 2) % 20 + x_off)::DOUBLE AS x1, ((tile_id * 5 + k) % 20 + y_off)::DOUBLE AS y1, ((tile_id * 7 + k * 2) % 20 + x_off + 8)::DOUBLE AS x2,
      ((tile_id * 5 + k) % 20 + y_off + 8)::DOUBLE AS y2, 8.0::DOUBLE AS w, 8.0::DOUBLE AS h, 0.6::DOUBLE + CAST((tile_id * 7 + k * 3 + plate_id) % 40 AS DOUBLE) / 100.0::DOUBLE AS conf, 0 AS class FROM k)"""
)


@query(
    "WITH kept AS ("
    + _nms_sql(0.5, "true").replace(duck("fx_det"), _BATCH_FOUND, 1)
    + """), c AS (SELECT plate_id, count(*) AS n FROM kept GROUP BY plate_id), r AS (SELECT DISTINCT vec_id // 50 AS plate_id FROM embeddings)
    SELECT s_suppkey AS plate_id, coalesce(n, 0) AS organisms, CASE WHEN r.plate_id IS NULL THEN 'missing' WHEN s_suppkey % 4 = 3 THEN 'failed' WHEN n IS NULL THEN 'empty' ELSE 'ok' END AS status,
      CASE WHEN r.plate_id IS NOT NULL AND s_suppkey % 4 = 3 THEN concat('ValueError: no model for plate ', s_suppkey) END AS error FROM supplier LEFT JOIN r ON r.plate_id = s_suppkey LEFT JOIN c ON c.plate_id = s_suppkey"""
)
def x09_batch_plates(spark: SparkSession, d: str) -> DataFrame:
    """All suppliers' plates; most have no raster, and the model fails at every fourth."""
    catalog = view(spark, d, "fx_plate").select("plate_id", F.lit(80).alias("width"), F.lit(40).alias("height"))
    px = view(spark, d, "fx_gray").withColumn("v", F.col("v") / 255)
    summary, _, _ = jobs.batch_plates(catalog, px, failing_detector, F.lit(8.666), 32, 8, 0.6, 0.5, pad=3, block=7, min_size=3)
    return summary.select("plate_id", "organisms", "status", "error")


@query(duck("fx_plate", "fx_roi") + _ROI_TILES + " SELECT lab.plate_id, roi_id, printf('%s_tile_%04d', CAST(lab.plate_id AS VARCHAR), tile_id) AS tile_name, coalesce(split_assigned, 'test') AS split FROM lab JOIN fx_plate p ON lab.plate_id = p.plate_id")
def x10_build_tiled_dataset(spark: SparkSession, d: str) -> DataFrame:
    plates = view(spark, d, "fx_plate")
    splits = plates.select("plate_id", F.col("split_assigned").alias("split")).filter("split IS NOT NULL")
    return jobs.build_tiled_dataset(view(spark, d, "fx_roi"), plates, splits, 256, 64).select("plate_id", "roi_id", "tile_name", "split")


@query(
    duck("fx_crops", "fx_ids")
    + """, u AS (SELECT crop_path AS path, 1 AS label FROM fx_crops WHERE is_collembola = 1 UNION SELECT concat('gt/', id_collembole, '.png'), 1 FROM fx_ids UNION SELECT crop_path, 0 FROM fx_crops WHERE is_collembola = 0),
    r AS (SELECT *, row_number() OVER (ORDER BY md5(concat('42|', path, '|', label)), path, label) AS n, count(*) OVER () AS c FROM u) SELECT path, label, CASE WHEN n <= floor(c * 0.2) THEN 'val' ELSE 'train' END AS split FROM r"""
)
def x11_build_label_dataset(spark: SparkSession, d: str) -> DataFrame:
    crops = view(spark, d, "fx_crops")
    return jobs.build_label_dataset(crops, view(spark, d, "fx_ids"), crops, "id_collembole")


@query()
def x03_measure_from_masks(spark: SparkSession, d: str) -> DataFrame:
    """Masks are the foreground of the 64x50 grid; a box is a 16x10 cell of it."""
    mask = view(spark, d, "fx_mask").withColumn("det_seq", F.floor(F.col("x") / 16) + 4 * F.floor(F.col("y") / 10))
    from ..operators import raster

    runs = raster.to_runs(mask.select(F.struct("plate_id", "det_seq").alias("plate_id"), "x", "y")).select("plate_id.plate_id", "plate_id.det_seq", "y", "x0", "x1")
    boxes = mask.select("plate_id").distinct().select("plate_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(20).cast("bigint"))).alias("det_seq"))
    x, y = F.col("det_seq") % 4 * 16, F.floor(F.col("det_seq") / 4) * 10
    boxes = boxes.select("plate_id", "det_seq", x.alias("x1"), y.alias("y1"), (x + 16).alias("x2"), (y + 10).alias("y2"))
    out = jobs.measure_from_masks(boxes, runs, F.lit(8.666))
    return rounded(out.select("plate_id", "det_seq", "mask_available", "area", "major", "minor", "solidity", "perimeter", "length_um"), "major", "minor", "solidity", "perimeter", "length_um", digits=4)


@query(
    duck("fx_det")
    + """ SELECT plate_id, det_seq, CASE WHEN det_seq % 3 > 0 THEN w * 10 ELSE greatest(w, h) END AS major, CASE WHEN det_seq % 3 > 0 THEN h ELSE least(w, h) END AS minor,
    CASE WHEN det_seq % 3 > 0 THEN 7.0 ELSE w * h END AS area, CASE WHEN det_seq % 3 > 0 THEN 5.0 ELSE 2 * (w + h) END AS perimeter, det_seq % 3 > 0 AS mask_available FROM fx_det"""
)
def p18_bbox_fallback(spark: SparkSession, d: str) -> DataFrame:
    has = F.col("det_seq") % 3 > 0
    det = view(spark, d, "fx_det").select("plate_id", "det_seq", "x1", "y1", "x2", "y2", F.when(has, F.col("w") * 10).alias("major"), F.when(has, F.col("h")).alias("minor"), F.when(has, 7.0).alias("area"), F.when(has, 5.0).alias("perimeter"), F.when(has, 0.5).alias("eccentricity"), F.when(has, 0.9).alias("solidity"))
    return jobs.with_fallback(det).select("plate_id", "det_seq", "major", "minor", "area", "perimeter", "mask_available")


@query(
    duck("fx_gray")
    + """, b AS (SELECT DISTINCT plate_id, k FROM fx_gray, range(0, 40) t(k)) SELECT b.plate_id, k, round(avg(v), 6) AS mean_value, count(*) AS n_pixels FROM b JOIN fx_gray g ON b.plate_id = g.plate_id AND g.x >= k * 2 AND g.x < k * 2 + 9 AND g.y >= k AND g.y < k + 5 GROUP BY ALL"""
)
def r16_region_mean(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import raster

    px = view(spark, d, "fx_gray")
    k = F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k")
    boxes = px.select("plate_id").distinct().select("plate_id", k).select("plate_id", F.col("k").cast("long").alias("k"), (F.col("k") * 2).alias("px1"), F.col("k").alias("py1"), (F.col("k") * 2 + 9).alias("px2"), (F.col("k") + 5).alias("py2"))
    return rounded(raster.region_mean(boxes, px, "k"), "mean_value")
