"""Queries over the proposal, measurement and analysis jobs. Their rasters are the 80x40 ones of fx_gray, so sizes
are small where the jobs' defaults fit plates of 10,000 pixels a side."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import duck, view
from ..operators import raster as R
from ..operators.components import cut_lineage
from . import jobs
from .io_queries import stub_segmenter
from .raster_queries import _BOX, gray_plates
from .registry import query, rounded


@query()
def r10_edges(spark: SparkSession, d: str) -> DataFrame:
    return R.edges(view(spark, d, "fx_gray"))


@query(
    duck("fx_gray")
    + f""", b AS ({_BOX}), maps AS (SELECT g.plate_id, x, y, v::DOUBLE AS a, m AS b, sqrt(greatest(0, q - m * m)) AS c FROM fx_gray g JOIN b USING (plate_id, x, y)),
  n AS (SELECT plate_id, x, y, 0.5::DOUBLE * (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) + 0.3::DOUBLE * (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) + 0.2::DOUBLE * (c - min(c) OVER w) / (max(c) OVER w - min(c) OVER w) AS v FROM maps WINDOW w AS (PARTITION BY plate_id))
  SELECT plate_id, x, y, CAST(trunc(round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 255, 6)) AS INT) AS v FROM n WINDOW w AS (PARTITION BY plate_id)"""
)
def r16_saliency(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "fx_gray")
    maps = R.local_std(R.local_mean(px, 7, name="b"), 7).select("plate_id", "x", "y", F.col("v").cast("double").alias("a"), "b", F.col("local_std").alias("c"))
    return R.saliency(maps, {"a": 0.5, "b": 0.3, "c": 0.2})


@query(
    duck("fx_gray")
    + """, k AS (SELECT unnest(range(-3, 4)) AS d, exp(-(d * d) / (2 * 1.5 * 1.5)) AS w),
  row AS (SELECT g.plate_id, g.x, g.y, sum(h.v * k.w) AS s, sum(k.w) AS w FROM fx_gray g JOIN k ON true JOIN fx_gray h ON h.plate_id = g.plate_id AND h.y = g.y AND h.x = g.x + k.d GROUP BY ALL)
  SELECT r.plate_id, r.x, r.y, round(sum(q.s * k.w) / sum(q.w * k.w), 6) AS local_mean FROM row r JOIN k ON true JOIN row q ON q.plate_id = r.plate_id AND q.x = r.x AND q.y = r.y + k.d GROUP BY ALL"""
)
def r08_gaussian_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.local_mean(view(spark, d, "fx_gray"), 7, "gaussian", 1.5).select("plate_id", "x", "y", "local_mean"), "local_mean")


@query(duck("fx_gray") + " SELECT plate_id, x, y FROM fx_gray WHERE v > 140")
def r06_threshold_fixed(spark: SparkSession, d: str) -> DataFrame:
    return R.threshold(view(spark, d, "fx_gray"), "fixed", value=140)


_SQUARE = "SELECT a.plate_id, a.x, a.y, {f}(b.v) AS v FROM {t} a JOIN {t} b ON a.plate_id = b.plate_id AND b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 GROUP BY ALL"


@query(duck("fx_gray") + ", d AS (" + _SQUARE.format(f="max", t="fx_gray") + "), e AS (" + _SQUARE.format(f="min", t="d") + ") SELECT g.plate_id, g.x, g.y, e.v - g.v AS v FROM fx_gray g JOIN e USING (plate_id, x, y)")
def r05_blackhat(spark: SparkSession, d: str) -> DataFrame:
    return R.morphology(view(spark, d, "fx_gray"), "blackhat", 2)


@query(duck("fx_gray") + ", e AS (" + _SQUARE.format(f="min", t="fx_gray") + "), d AS (" + _SQUARE.format(f="max", t="e") + ") SELECT g.plate_id, g.x, g.y, greatest(0, g.v - d.v) AS v FROM fx_gray g JOIN d USING (plate_id, x, y)")
def r05_opening(spark: SparkSession, d: str) -> DataFrame:
    return R.subtract_background(view(spark, d, "fx_gray"), "opening", 2)


_CROSS = "SELECT a.plate_id, a.x, a.y, {f}(b.v) AS v FROM {t} a JOIN {t} b ON a.plate_id = b.plate_id AND abs(b.x - a.x) + abs(b.y - a.y) <= 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL"


@query(
    duck("fx_gray")
    + ", m AS (SELECT plate_id, x, y, CASE WHEN v > 140 THEN 1 ELSE 0 END AS v FROM fx_gray), d AS ("
    + _CROSS.format(f="max", t="m")
    + "), e AS ("
    + _CROSS.format(f="min", t="d")
    + ") SELECT plate_id, x, y FROM e WHERE v = 1"
)
def r05_close_mask(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "fx_gray")
    return R.close_mask(R.threshold(px, "fixed", value=140), px, 1)


@query()
def r17_blob_log(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "fx_gray").withColumn("v", F.col("v") / 255)
    return rounded(R.blob_log(px, [1.0, 1.6, 2.5]), "response")


def gray_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Detections in the rasters' coordinates, of plates that have a raster."""
    det = view(spark, d, "fx_det").join(gray_plates(spark, d).select("plate_id").hint("merge"), "plate_id", "left_semi")
    x, y = F.floor(F.col("x1") / 13), F.floor(F.col("y1") / 26)
    return det.select("plate_id", "det_seq", x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 4).cast("double").alias("x2"), (y + 4).cast("double").alias("y2"))


@query()
def x02_measure_fast(spark: SparkSession, d: str) -> DataFrame:
    px = view(spark, d, "fx_gray").withColumn("v", F.col("v") / 255)
    out = jobs.measure_fast(gray_boxes(spark, d), px, gray_plates(spark, d), F.lit(8.666 / 1000), pad=3, block=7, min_size=3)
    return rounded(out.select("plate_id", "det_seq", "area", "major", "minor", "solidity", "perimeter", "length_mm", "method"), "major", "minor", "solidity", "perimeter", "length_mm", digits=4)


# regions of the crops: masks by separable Gaussian sums inside each crop, components by reachability between runs
_REGIONS = """, b AS (SELECT plate_id, det_seq, CAST(floor(x1 / 13) AS BIGINT) AS a, CAST(floor(y1 / 26) AS BIGINT) AS c FROM fx_det WHERE plate_id IN (SELECT plate_id FROM fx_gray)),
  cr AS (SELECT b.plate_id, det_seq, x, y, v / 255.0::DOUBLE AS v FROM b JOIN fx_gray g ON g.plate_id = b.plate_id AND x >= greatest(0, a - 3) AND x < least(80, a + 7) AND y >= greatest(0, c - 3) AND y < least(40, c + 7)),
  ax AS (SELECT g.plate_id, g.det_seq, g.x, g.y, g.v, sum(n.v * exp(-pow(n.x - g.x, 2) / 2.0::DOUBLE)) AS s, sum(exp(-pow(n.x - g.x, 2) / 2.0::DOUBLE)) AS w
    FROM cr g JOIN cr n ON n.plate_id = g.plate_id AND n.det_seq = g.det_seq AND n.y = g.y AND abs(n.x - g.x) <= 3 GROUP BY ALL),
  gm AS (SELECT g.plate_id, g.det_seq, g.x, g.y, g.v, sum(n.s * exp(-pow(n.y - g.y, 2) / 2.0::DOUBLE)) / sum(n.w * exp(-pow(n.y - g.y, 2) / 2.0::DOUBLE)) AS m
    FROM ax g JOIN ax n ON n.plate_id = g.plate_id AND n.det_seq = g.det_seq AND n.x = g.x AND abs(n.y - g.y) <= 3 GROUP BY ALL),
  dark AS (SELECT plate_id, det_seq, x, y FROM gm WHERE v < m - 0.02::DOUBLE),
  isl AS (SELECT *, x - row_number() OVER (PARTITION BY plate_id, det_seq, y ORDER BY x) AS g FROM dark),
  runs AS (SELECT plate_id, det_seq, y, min(x) AS x0, max(x) AS x1 FROM isl GROUP BY plate_id, det_seq, y, g),
  e AS (SELECT a.plate_id, a.det_seq, a.y AS ay, a.x0 AS ax, b.y AS by_, b.x0 AS bx FROM runs a JOIN runs b ON a.plate_id = b.plate_id AND a.det_seq = b.det_seq AND a.y = b.y + 1 AND a.x0 <= b.x1 + 1 AND a.x1 + 1 >= b.x0),
  ways AS (SELECT * FROM e UNION ALL SELECT plate_id, det_seq, by_, bx, ay, ax FROM e),
  reach AS (SELECT plate_id, det_seq, y AS sy, x0 AS sx, y, x0 FROM runs UNION SELECT r.plate_id, r.det_seq, r.sy, r.sx, b.by_, b.bx FROM reach r JOIN ways b ON r.plate_id = b.plate_id AND r.det_seq = b.det_seq AND r.y = b.ay AND r.x0 = b.ax),
  lab AS (SELECT plate_id, det_seq, sy AS y, sx AS x0, min(y * 1000 + x0) AS label FROM reach GROUP BY plate_id, det_seq, sy, sx),
  full_ AS (SELECT runs.*, lab.label FROM runs JOIN lab USING (plate_id, det_seq, y, x0)),
  best AS (SELECT plate_id, det_seq, label FROM (SELECT plate_id, det_seq, label, sum(x1 - x0 + 1) AS area FROM full_ GROUP BY ALL) WHERE area >= 3 QUALIFY row_number() OVER (PARTITION BY plate_id, det_seq ORDER BY area DESC, label) = 1),
  px AS (SELECT plate_id, det_seq, unnest(range(x0, x1 + 1)) AS x, y FROM full_ JOIN best USING (plate_id, det_seq, label)),
  mo AS (SELECT plate_id, det_seq, count(*) AS area, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS vxy FROM px GROUP BY ALL),
  la AS (SELECT *, (vx + vy) / 2 + sqrt(pow(vx - vy, 2) / 4 + vxy * vxy) AS l1, greatest(0, (vx + vy) / 2 - sqrt(pow(vx - vy, 2) / 4 + vxy * vxy)) AS l2 FROM mo),
  nb AS (SELECT p.plate_id, p.det_seq, p.x, p.y, count(n.x) AS n FROM px p LEFT JOIN px n ON n.plate_id = p.plate_id AND n.det_seq = p.det_seq AND abs(p.x - n.x) + abs(p.y - n.y) = 1 GROUP BY ALL),
  bd AS (SELECT * FROM nb WHERE n < 4),
  code AS (SELECT p.plate_id, p.det_seq, p.x, p.y, 1 + 2 * count(*) FILTER (abs(p.x - q.x) + abs(p.y - q.y) = 1) + 10 * count(*) FILTER (abs(p.x - q.x) = 1 AND abs(p.y - q.y) = 1) AS k
    FROM bd p LEFT JOIN bd q ON p.plate_id = q.plate_id AND p.det_seq = q.det_seq AND abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 AND NOT (p.x = q.x AND p.y = q.y) GROUP BY ALL),
  per AS (SELECT plate_id, det_seq, sum(CASE WHEN k IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN k IN (21, 33) THEN sqrt(2) WHEN k IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS perimeter FROM code GROUP BY ALL)
  SELECT b.plate_id, b.det_seq, coalesce(area, 16)::DOUBLE AS area, round(coalesce(4 * sqrt(l1), 4), 4) AS major, round(coalesce(4 * sqrt(CASE WHEN l2 < 1e-9 THEN 0 ELSE l2 END), 4), 4) AS minor, round(coalesce(perimeter, 16), 4) AS perimeter,
    round(coalesce(4 * sqrt(l1), 4) * 8.666, 3) AS length_mm, CASE WHEN area IS NULL THEN 'no_contour_fallback' ELSE 'fast' END AS method FROM b LEFT JOIN la USING (plate_id, det_seq) LEFT JOIN per USING (plate_id, det_seq)"""


@query(duck("fx_det", "fx_gray") + _REGIONS)
def x02_measured_regions(spark: SparkSession, d: str) -> DataFrame:
    """What SQL can measure of x02's regions: all but the hulls."""
    px = view(spark, d, "fx_gray").withColumn("v", F.col("v") / 255)
    out = jobs.measure_fast(gray_boxes(spark, d), px, gray_plates(spark, d), F.lit(8666.0), pad=3, block=7, min_size=3)
    return rounded(rounded(out.select("plate_id", "det_seq", "area", "major", "minor", "perimeter", "length_mm", "method"), "major", "minor", "perimeter", digits=4), "length_mm", digits=3)


def scene(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(pixels, plates) of the rasters with separate objects."""
    px = cut_lineage(view(spark, d, "fx_scene"))
    return px, cut_lineage(px.groupBy("plate_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")))


@query(duck("fx_scene") + " SELECT plate_id, x, y, v FROM fx_scene")
def s03_scene(spark: SparkSession, d: str) -> DataFrame:
    """The raster that the proposal queries work on."""
    return scene(spark, d)[0]


@query()
def x04_propose_cv(spark: SparkSession, d: str) -> DataFrame:
    found = jobs.propose_cv(*scene(spark, d), background=9, min_size=6, areas=(6, 3000))
    return rounded(found.select("plate_id", "rank", "area", "eccentricity", "solidity", "conf", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"), "eccentricity", "solidity", "conf")


@query()
def x05_propose_cv_fast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(jobs.propose_cv_fast(*scene(spark, d), background=9, scale=4.5, preset="any", ring=4, shrink=0, min_size=3, min_eccentricity=0.3), "eccentricity", "conf")


@query()
def x06_propose_multifeature(spark: SparkSession, d: str) -> DataFrame:
    found = jobs.propose_multifeature(*scene(spark, d), threshold=110, ring=4, shrink=0, min_size=6, close=1, times=1, min_area=4, min_expanded=20)
    return rounded(found.select("plate_id", "rank", "x1", "y1", "x2", "y2", "area", "eccentricity", "conf"), "eccentricity", "conf")


@query()
def x07_propose_blob(spark: SparkSession, d: str) -> DataFrame:
    found = jobs.propose_blob(view(spark, d, "fx_gray"), gray_plates(spark, d), [1.0, 1.6, 2.5], ring=4, shrink=2, min_area=9)
    return rounded(found.select("plate_id", "rank", "x", "y", "sigma", "x1", "y1", "x2", "y2", "conf"), "conf")


def stub_classifier(v):
    return 1 / (1 + np.exp(-(v - 125) / 5))


_ORGANISMS = """, b AS (SELECT d.plate_id, d.det_seq, CAST(floor(x1 / 13) AS BIGINT) AS a, CAST(floor(y1 / 26) AS BIGINT) AS c FROM fx_det d WHERE d.plate_id IN (SELECT plate_id FROM fx_gray)),
  med AS (SELECT plate_id, quantile_cont(v, 0.5) AS m FROM fx_gray GROUP BY plate_id),
  px AS (SELECT plate_id, x, y, CASE WHEN m < 45 THEN CAST(trunc(greatest(0, least(255, v + 50 - m))) AS INT) ELSE v END AS v FROM fx_gray JOIN med USING (plate_id)),
  f AS (SELECT b.plate_id, det_seq, a, c, avg(v) AS mean FROM b JOIN px ON px.plate_id = b.plate_id AND x >= greatest(0, a - 3) AND x < least(80, a + 7) AND y >= greatest(0, c - 3) AND y < least(40, c + 7) GROUP BY ALL)
  SELECT plate_id, det_seq, a AS x1, c AS y1, round(1 / (1 + exp(-(mean - 125) / 5)), 6) AS p, 8 AS area, row_number() OVER (PARTITION BY plate_id ORDER BY det_seq) - 1 AS organism_id FROM f WHERE 1 / (1 + exp(-(mean - 125) / 5)) >= 0.6"""


@query(duck("fx_det", "fx_gray") + _ORGANISMS)
def x08_analyze_plates(spark: SparkSession, d: str) -> DataFrame:
    """Every box's mask is every other of its lines, 8 pixels, so all that the classifier accepts pass the filter."""
    limits = {"areas": (8, 8), "majors": (1, 50), "minors": (1, 50), "ratios": (0, 1), "min_solidity": 0.1, "min_eccentricity": 0.0}
    found = jobs.analyze_plates(view(spark, d, "fx_gray"), gray_plates(spark, d), gray_boxes(spark, d), stub_classifier, stub_segmenter, t=0.6, pad=3, **limits)
    return rounded(found.select("plate_id", "det_seq", F.col("x1").cast("long").alias("x1"), F.col("y1").cast("long").alias("y1"), "p", F.col("area").cast("long").alias("area"), "organism_id"), "p")
