"""Goldens and edge cases of the library's operators."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from platelens.functions import geometry as G
from platelens.operators import evaluate, filters, labels, raster, spatial, summaries, suppress, tiles
from platelens.plans import jobs
from platelens.sources import tables
from platelens.streaming import streams


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, *map(float, b), float(c)) for i, (b, c) in enumerate(rows)], "plate_id long, det_seq long, x1 double, y1 double, x2 double, y2 double, conf double").withColumn("w", F.col("x2") - F.col("x1")).withColumn("h", F.col("y2") - F.col("y1"))


def kept(df):
    return sorted(r.det_seq for r in df.collect())


def test_tile_grids(spark):
    plate = spark.createDataFrame([(1, 10408, 10338), (2, 500, 300)], "plate_id long, width int, height int")
    got = tiles.tile_grid(plate).collect()
    big = [r for r in got if r.plate_id == 1]
    assert len(big) == 100 and max(r.x_off for r in big) == 9128 and max(r.y_off for r in big) == 9058
    assert [(r.tile_id, r.x_off, r.y_off, r.x_end, r.y_end) for r in got if r.plate_id == 2] == [(0, 0, 0, 500, 300)]
    assert tiles.tile_grid(plate, mode="ragged").filter("plate_id = 1").count() == 11 * 11
    with pytest.raises(ValueError):
        tiles.tile_grid(plate, mode="other")


def test_roi_on_tile_edges(spark):
    plate = spark.createDataFrame([(1, 2304, 1280)], "plate_id long, width int, height int")
    rois = spark.createDataFrame([(1, i, x, 0, w, 10) for i, (x, w) in enumerate([(1251, 100), (1250, 100), (10, 0)])], "plate_id long, roi_id long, x long, y long, w long, h long")
    got = {(r.roi_id, r.tile_id) for r in tiles.roi_tile_join(rois, plate).collect()}
    assert got == {(0, 1), (1, 0), (1, 1)}  # 29 and 30 of 100 pixels in the first tile; no area


def test_suppression_rules(spark):
    far = [((0, 0, 0, 0), 0.5), ((900, 900, 900, 900), 0.6), ((10, 10, 10, 10), 0.6)]
    assert kept(suppress.nms_global(boxes(spark, far))) == [2]
    assert kept(suppress.nms_proposals(boxes(spark, far))) == [0, 1, 2]
    half = [((0, 0, 10, 10), 0.9), ((0, 0, 10, 20), 0.8)]  # IoU exactly 0.5
    assert kept(suppress.nms_global(boxes(spark, half))) == [0, 1]
    assert kept(suppress.dedup_keep_larger(boxes(spark, half), 0.5)) == [1]
    equal = [((0, 0, 10, 10), 0.7), ((1, 0, 11, 10), 0.7)]
    assert kept(suppress.nms_global(boxes(spark, equal))) == [1]
    assert kept(suppress.nms_proposals(boxes(spark, equal))) == [0]
    chain = [((i * 3, 0, i * 3 + 10, 10), 1 - i / 100) for i in range(12)]
    order, want = sorted(range(12), key=lambda i: -chain[i][1]), []
    for i in order:
        if all(not overlap(chain[i][0], chain[j][0]) > 0.5 for j in want):
            want.append(i)
    assert kept(suppress.nms_global(boxes(spark, chain))) == sorted(want)
    mixed = [((0, 0, 1000, 1000), 0.5), ((1, 1, 1000, 1000), 0.9), ((5, 5, 9, 9), 0.3), ((5, 5, 9, 10), 0.4)]
    assert kept(suppress.nms_global(boxes(spark, mixed), mixed_sizes=True)) == [1, 3]
    assert spatial.iou_pairs(boxes(spark, mixed), 0.0, mixed_sizes=True).count() == 6


def overlap(a, b):
    common = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return common / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common)


def rectangle(spark, w, h):
    return spark.createDataFrame([(1, x, y) for x in range(w) for y in range(h)], "plate_id long, x int, y int")


@pytest.mark.parametrize("w,h", [(200, 20), (20, 200)])
def test_rectangle_measures(spark, w, h):
    px = rectangle(spark, w, h)
    runs = raster.to_runs(px)
    r = raster.region_props(runs, "plate_id").first()
    assert (round(r.major, 2), round(r.minor, 2), r.area) == (230.94, 23.07, 4000)
    s = raster.solidity(runs, "plate_id").first()
    assert s.hull_area == 4000 and s.solidity == 1
    assert raster.perimeter(px, "plate_id").first().perimeter == 2 * (w - 1) + 2 * (h - 1)


def test_hull_of_concave_shapes(spark):
    shape = [(x, y) for y in range(6) for x in range(6) if y < 2 or x < 2] + [(9, 3)]
    px = spark.createDataFrame([(1, x, y) for x, y in shape], "plate_id long, x int, y int")
    corners = sorted({(x + i, y + j) for x, y in shape for i in (0, 1) for j in (0, 1)})

    def chain(points):
        out = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = chain(corners) + chain(corners[::-1])
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1]))) / 2
    assert raster.solidity(raster.to_runs(px), "plate_id").first().hull_area == pytest.approx(area)


def test_units_and_filters(spark):
    one = spark.range(1)
    r = one.select(G.um_per_pixel(F.lit(10), F.lit(1167)).alias("u"), G.volume_cylinder(F.lit(1960.89), F.lit(673.99)).alias("v"), G.um_per_pixel(F.lit(10), F.lit(0)).alias("n")).first()
    assert round(r.u, 3) == 8.569 and r.v == pytest.approx(6.99597e8, rel=1e-5) and r.n is None
    reasons = spark.createDataFrame([(None, 100.0, 20.0, 0.9, 0.9), (500, 100.0, 20.0, 0.9, 0.95)], "area long, major double, minor double, solidity double, eccentricity double").select(filters.morphology_reason().alias("r"))
    assert [x.r for x in reasons.collect()] == ["area", None]


def test_matching_and_scores(spark):
    det = boxes(spark, [((0, 0, 10, 10), 0.9), ((0, 0, 10, 11), 0.8), ((50, 50, 60, 60), 0.7)])
    gt = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.0, 1.0, 10.0, 11.0)], "plate_id long, gt_id long, x1 double, y1 double, x2 double, y2 double")
    m = evaluate.match_ground_truth(det, gt)
    assert sorted((r.det_seq, r.gt_id) for r in m.collect()) == [(0, 0), (1, 1)]
    total = evaluate.precision_recall_f1(det, gt, m).filter("plate_id IS NULL").first()
    assert (total.tp, total.fp, total.fn) == (2, 1, 0)
    assert evaluate.average_precision(det, gt, m).first().ap == 1.0


def test_empty_plate_and_missing_foreground(spark):
    catalog = spark.createDataFrame([(1,), (2,)], "plate_id long")
    rows = spark.createDataFrame([(1, 2.0, 1.0, 3.0)], "plate_id long, length_um double, width_um double, volume_um3 double")
    assert {tuple(r) for r in summaries.batch_summary(catalog, rows).collect()} == {(1, 1, 2.0, 1.0, 3.0, "ok"), (2, 0, 0.0, 0.0, 0.0, "empty")}
    flat = spark.createDataFrame([(1, x, y, 0.5) for x in range(20) for y in range(20)], "plate_id long, x int, y int, v double")
    plates = spark.createDataFrame([(1, 20, 20)], "plate_id long, width int, height int")
    r = jobs.measure_fast(boxes(spark, [((2, 2, 12, 8), 0.9)]), flat, plates, F.lit(8.666), pad=2, block=5, min_size=2).first()
    assert r.method == "no_contour_fallback" and r.eccentricity == 0 and r.area == 60


def test_label_columns(spark):
    df = spark.createDataFrame([(1, "a", 1)], "id long, crop string, label int")
    assert df.select(labels.resolve_path(df, "d").alias("p")).first().p == "d/a"
    with pytest.raises(ValueError):
        labels.resolve_path(spark.range(1).withColumnRenamed("id", "x"))
    with pytest.raises(ValueError):
        labels.resolve_label(spark.range(1))


def test_ingest_and_discover(spark, tmp_path):
    (tmp_path / "ROI_k1").mkdir()
    (tmp_path / "ROI_k1" / "a.zip").write_bytes(b"1,2,3,4")
    (tmp_path / "ROI_k1" / "b.zip").write_bytes(b"bad")
    (tmp_path / "ROI_k1" / "p.JPG").write_bytes(b"x")

    def decode(data):
        left, top, width, height = map(int, data.decode().split(","))
        yield {"name": "r", "left": left, "top": top, "width": width, "height": height}
        yield {"name": "q", "left": left}

    good, lacking, bad = tables.ingest_rois(spark, [f"{tmp_path}/ROI_k1/*.zip"], decode)
    assert [(r.x, r.y, r.w, r.h, r.roi_type) for r in good.collect()] == [(1, 2, 3, 4, "unknown")]
    assert lacking.count() == 1 and bad.count() == 1
    found = tables.discover_annotations(tables.plate_catalog(spark, [f"{tmp_path}/ROI_k1"])).first()
    assert found.plate_id == "k1" and found.roi_path.endswith("a.zip") and found.image_path.endswith("p.JPG")


def test_detection_files_and_stream(spark, tmp_path):
    det = boxes(spark, [((0, 0, 10, 10), 0.9), ((0, 0, 10, 10), 0.8), ((50, 50, 60, 60), 0.7)]).withColumn("class", F.lit(0))
    tables.detection_rows(det).coalesce(1).write.option("header", True).csv(f"{tmp_path}/out")
    (tmp_path / "in").mkdir()
    next((tmp_path / "out").glob("part*.csv")).rename(tmp_path / "in" / "k1_detections.csv")
    assert tables.read_detections(spark, f"{tmp_path}/in").select("image_id").distinct().first().image_id == "k1"
    q = streams.suppress_arrivals(streams.stream_detections(spark, f"{tmp_path}/in"), f"{tmp_path}/kept", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert sorted(r.conf for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == [0.7, 0.9]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/events")
    q = streams.throughput(stream, watermark="3650 days").writeStream.outputMode("complete").format("memory").queryName("rate").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (str(r.start), r.n, round(r.organisms, 3))
    assert sorted(map(key, spark.sql("SELECT * FROM rate").collect())) == sorted(map(key, streams.throughput(rows).collect()))


def test_user_models(spark):
    plates = spark.createDataFrame([(1, 100, 100), (2, 100, 100)], "plate_id long, width int, height int")

    def model(batches):
        for t in batches:
            yield pd.DataFrame({"plate_id": t["plate_id"], "tile_id": t["tile_id"].astype("int32"), "x1": 1.0, "y1": 1.0, "x2": 9.0, "y2": 9.0, "conf": 0.9, "class": 0})

    found, counts = jobs.detect_tiled(plates, model, 60, 20)
    assert found.count() == 8 and {(r.num_tiles, r.before, r.after) for r in counts.collect()} == {(4, 4, 4)}


def test_boxes_of_any_size_meet_once(spark):
    rows = [(1, i, float(i * 7 % 90), float(i * 11 % 80), 10.0 + i % 5, 8.0) for i in range(60)]
    rows += [(1, 100, 0.0, 0.0, 2e6, 2e6), (1, 101, 5.0, 5.0, 2e6, 2e6), (1, 102, 50.0, 40.0, 0.0, 0.0), (1, 103, 10.0, 10.0, 700.0, 3.0), (2, 104, 0.0, 0.0, 5e9, 5e9)]
    boxes = spark.createDataFrame([(p, s, x, y, x + w, y + h) for p, s, x, y, w, h in rows], "plate_id int, det_seq int, x1 double, y1 double, x2 double, y2 double")
    got = [(r.det_seq, r.r_det_seq) for r in spatial.box_pairs(boxes, boxes, cell=4).collect()]
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] <= b[2] + b[4] and b[2] <= a[2] + a[4] and a[3] <= b[3] + b[5] and b[3] <= a[3] + a[5]}
    assert len(got) == len(set(got)) and set(got) == want


def test_equal_boxes_of_one_tile_collapse(spark):
    def model(batches):
        for b in batches:
            for conf in (0.9, 0.9, 0.7):
                yield pd.DataFrame({"plate_id": b["plate_id"], "tile_id": b["tile_id"].astype("int32"), "x1": 3.0, "y1": 4.0, "x2": 20.0, "y2": 30.0, "conf": conf, "class": 0})

    plates = spark.createDataFrame([(1, 100, 100)], "plate_id int, width int, height int")
    kept, counts = jobs.detect_tiled(plates, model, 100, 20)
    assert [(r.det_seq, r.conf) for r in kept.collect()] == [(1, 0.9)]  # of equal confidences the later one wins
    assert [(r.before, r.after) for r in counts.collect()] == [(3, 1)]
