"""What is written goes by the rows and not by the number of plates."""

import pandas as pd
from pyspark.sql import functions as F

from platelens.fixtures import view
from platelens.plans.io_queries import stub_segmenter
from platelens.sources import tables
from platelens.streaming import streams


def boxes(spark, plates=300):
    side = [F.lit(v).cast("double").alias(c) for c, v in (("x1", 1), ("y1", 2), ("x2", 5), ("y2", 9))]
    return spark.range(2 * plates).select((F.col("id") % plates).alias("image_id"), *side, (F.col("id") / 1000).alias("conf"), F.lit(0).alias("class")).repartition(4)


def files(path):
    return [p for p in path.rglob("*.csv")]


def test_files_hold_many_images(spark, tmp_path):
    tables.write_detections(boxes(spark), str(tmp_path / "det"), together=True)
    assert len(files(tmp_path / "det")) <= 4
    back = tables.read_detections(spark, str(tmp_path / "det"), together=True)
    assert {(r.image_id, r.n, r.h) for r in back.groupBy("image_id").agg(F.count("*").alias("n"), F.max("height").alias("h")).collect()} == {(str(i), 2, 7.0) for i in range(300)}
    tables.write_measurements(boxes(spark).withColumn("area_px", F.lit(3.0)), str(tmp_path / "meas"), "um", together=True)
    assert len(files(tmp_path / "meas")) <= 4
    assert files(tmp_path / "meas")[0].read_text().splitlines()[0].split(",") == ["image_id", *tables.measurement_columns("um")]


def test_a_stream_of_files_of_many_plates(spark, tmp_path):
    tables.write_detections(boxes(spark, 20).repartition("image_id").sortWithinPartitions("image_id", "conf"), str(tmp_path / "in"), together=True)
    streams.suppress_arrivals(streams.stream_detections(spark, str(tmp_path / "in"), together=True), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "out")).select("plate_id", "conf").collect()
    assert {(r.plate_id, r.conf) for r in kept} == {(str(i), (i + 20) / 1000) for i in range(20)}  # the stronger of two equal boxes


def test_archives_are_decoded_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text("bad" if k == 2 else f"{k}/a\n{k}/b")
    log = str(tmp_path / "log")

    def decode(content):
        with open(log, "a") as f:
            f.write("x")
        return [{"name": n, "left": 1, "top": 2, "width": None if n.endswith("b") else 3, "height": 4} for n in content.decode().splitlines() if n.split("/")[1]]

    good, lacking, errors = tables.ingest_rois(spark, [f"{tmp_path}/in/*.txt"], decode)
    assert {r.roi_name for r in good.collect()} == {"0/a", "1/a"} and {r.name for r in lacking.collect()} == {"0/b", "1/b"} and errors.count() == 1
    assert len(open(log).read()) == 3


def test_pixels_of_a_scene_are_not_shuffled(spark):
    px = view(spark, "/root/testdata/sf0.001", "fx_scene")
    plan = px._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    per = px.groupBy("plate_id").agg(F.count("*").alias("n"), F.countDistinct("x", "y").alias("d")).collect()
    assert per and all(r.n == r.d == 64 * 48 for r in per)


def test_stub_masks_are_every_other_line():
    b = pd.DataFrame({"plate_id": [1, 1, 2], "det_seq": [0, 1, 0], "x1": [2.0, 5.0, 1.0], "y1": [3.0, 4.0, 7.0], "x2": [6.0, 8.0, 2.0], "y2": [8.0, 4.0, 9.0]})
    (out,) = stub_segmenter(iter([b]))
    assert out.values.tolist() == [[1, 0, 3, 2, 5], [1, 0, 5, 2, 5], [1, 0, 7, 2, 5], [2, 0, 7, 1, 1]]


def test_perimeters_go_by_bands(spark):
    """Regions over several bands against plain loops; no pixel is joined with its neighbours."""
    import random

    from platelens.operators import raster
    from tests.plain_rasters import perimeter

    rng, parts = random.Random(3), {}
    for k in range(6):
        parts[k] = {(rng.randrange(-3, 40) + 900 * (k % 2), rng.randrange(-5, 200)) for _ in range(6000)}
    rows = [(k, x, y) for k, p in parts.items() for x, y in p]
    found = raster.perimeter(spark.createDataFrame(rows, "k int, x int, y int").repartition(3), "k")
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.k: round(r.perimeter, 6) for r in found.collect()} == {k: round(perimeter(p), 6) for k, p in parts.items()}


def test_run_metadata_numbers_detections_once(spark):
    from platelens.plans.job_queries import s10_run_metadata

    plan = s10_run_metadata(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan  # detections are read as written, not made of lineitem again
