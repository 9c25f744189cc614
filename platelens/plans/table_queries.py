"""Queries over boxes, measurements and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import duck, view
from ..functions import geometry as G
from ..operators import evaluate, filters, labels, spatial, summaries, suppress, tiles
from ..operators.components import cut_lineage
from .registry import query, rounded

_GRID = """
, ax AS (SELECT plate_id, width, height,
  CASE WHEN width <= {s} THEN 1 ELSE CAST(ceil((width - {s}) / {st}.0) AS INT) + 1 END AS nx,
  CASE WHEN height <= {s} THEN 1 ELSE CAST(ceil((height - {s}) / {st}.0) AS INT) + 1 END AS ny FROM fx_plate),
tiles AS (SELECT plate_id, r * nx + c AS tile_id, greatest(0, least(c * {st}, width - {s})) AS x_off, greatest(0, least(r * {st}, height - {s})) AS y_off,
  least(greatest(0, least(c * {st}, width - {s})) + {s}, width) AS x_end, least(greatest(0, least(r * {st}, height - {s})) + {s}, height) AS y_end
  FROM (SELECT *, unnest(range(0, ny)) AS r FROM ax) JOIN (SELECT plate_id AS p2, unnest(range(0, nx)) AS c FROM ax) ON plate_id = p2)"""


def _grid_sql(size: int, overlap: int) -> str:
    return _GRID.format(s=size, st=size - overlap)


@query(duck("fx_plate") + _grid_sql(256, 64) + " SELECT plate_id, tile_id, x_off, y_off, x_end, y_end FROM tiles")
def p02_tile_grid(spark: SparkSession, d: str) -> DataFrame:
    return tiles.tile_grid(view(spark, d, "fx_plate"), 256, 64).select("plate_id", "tile_id", "x_off", "y_off", "x_end", "y_end")


@query(
    duck("fx_plate")
    + """, s AS (SELECT plate_id, width, height, list_sort(list_distinct(list_concat(range(0, greatest(1, width - 300 + 1), 200), [greatest(0, width - 300)]))) AS xs,
      list_sort(list_distinct(list_concat(range(0, greatest(1, height - 300 + 1), 200), [greatest(0, height - 300)]))) AS ys FROM fx_plate)
    SELECT plate_id, r * len(xs) + c AS tile_id, xs[c + 1] AS x_off, ys[r + 1] AS y_off, least(xs[c + 1] + 300, width) AS x_end, least(ys[r + 1] + 300, height) AS y_end
    FROM (SELECT *, unnest(range(0, len(ys))) AS r FROM s) JOIN (SELECT plate_id AS p2, unnest(range(0, len(xs))) AS c FROM s) ON plate_id = p2"""
)
def p03_tile_grid_cover(spark: SparkSession, d: str) -> DataFrame:
    return tiles.tile_grid(view(spark, d, "fx_plate"), 300, 100, "cover").select("plate_id", "tile_id", "x_off", "y_off", "x_end", "y_end")


@query(
    duck("fx_plate")
    + """ SELECT plate_id, r * 6 + c AS tile_id, c * 200 AS x_off, r * 200 AS y_off, least(c * 200 + 300, width) AS x_end, least(r * 200 + 300, height) AS y_end
    FROM fx_plate, range(0, 6) a(r), range(0, 6) b(c)"""
)
def p04_tile_grid_ragged(spark: SparkSession, d: str) -> DataFrame:
    return tiles.tile_grid(view(spark, d, "fx_plate"), 300, 100, "ragged").select("plate_id", "tile_id", "x_off", "y_off", "x_end", "y_end")


_ROI_TILES = _grid_sql(256, 64) + """, hit AS (SELECT r.*, t.tile_id, t.x_off, t.y_off, t.x_end, t.y_end,
  least(r.x + r.w, t.x_end) - greatest(r.x, t.x_off) AS ow, least(r.y + r.h, t.y_end) - greatest(r.y, t.y_off) AS oh
  FROM fx_roi r JOIN tiles t ON r.plate_id = t.plate_id WHERE r.w > 0 AND r.h > 0),
 lab AS (SELECT * FROM hit WHERE ow > 0 AND oh > 0 AND ow * oh >= 0.3 * (w * h))"""


def roi_tiles(spark: SparkSession, d: str) -> DataFrame:
    return tiles.roi_tile_join(view(spark, d, "fx_roi"), view(spark, d, "fx_plate"), 256, 64)


@query(duck("fx_plate", "fx_roi") + _ROI_TILES + " SELECT plate_id, roi_id, tile_id, x_off, y_off FROM lab")
def j01_roi_tile_join(spark: SparkSession, d: str) -> DataFrame:
    return roi_tiles(spark, d).select("plate_id", "roi_id", "tile_id", "x_off", "y_off")


@query(
    duck("fx_plate", "fx_roi")
    + _ROI_TILES
    + """, c AS (SELECT plate_id, roi_id, tile_id, greatest(0, x - x_off) AS a, greatest(0, y - y_off) AS b, least(256, x + w - x_off) AS c, least(256, y + h - y_off) AS d FROM lab)
    SELECT plate_id, roi_id, tile_id, round((a + c) / 2.0 / 256, 6) AS bx, round((b + d) / 2.0 / 256, 6) AS by, round((c - a) / 256.0, 6) AS bw, round((d - b) / 256.0, 6) AS bh FROM c"""
)
def p06_global_to_tile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tiles.global_to_tile(roi_tiles(spark, d), 256).select("plate_id", "roi_id", "tile_id", "bx", "by", "bw", "bh"), "bx", "by", "bw", "bh")


@query(
    duck("fx_plate", "fx_det")
    + _grid_sql(256, 64)
    + """ SELECT b.plate_id, b.det_seq, b.x1 % 100 + t.x_off AS x1, b.y1 % 100 + t.y_off AS y1, b.x2 % 100 + t.x_off AS x2, b.y2 % 100 + t.y_off AS y2
    FROM fx_det b JOIN tiles t ON b.plate_id = t.plate_id AND b.det_seq % 30 = t.tile_id"""
)
def p05_tile_to_global(spark: SparkSession, d: str) -> DataFrame:
    det = view(spark, d, "fx_det").withColumn("tile_id", F.col("det_seq") % 30).withColumns({c: F.col(c) % 100 for c in ("x1", "y1", "x2", "y2")})
    return tiles.tile_to_global(det, tiles.tile_grid(view(spark, d, "fx_plate"), 256, 64)).select("plate_id", "det_seq", "x1", "y1", "x2", "y2")


@query(duck("fx_det") + " SELECT plate_id, det_seq, x1 AS x, y1 AS y, x2 - x1 AS width, y2 - y1 AS height, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM fx_det")
def p07_box_convert(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_det").select("plate_id", "det_seq", *G.xyxy_to_xywh(), *G.centroid())


@query(duck("fx_det") + " SELECT plate_id, det_seq, CAST(greatest(0, trunc(x1 + 0.7) - 20) AS INT) AS px1, CAST(greatest(0, trunc(y1 + 0.7) - 20) AS INT) AS py1, CAST(least(1024, trunc(x2) + 20) AS INT) AS px2, CAST(least(1024, trunc(y2) + 20) AS INT) AS py2 FROM fx_det")
def p08_pad_clip(spark: SparkSession, d: str) -> DataFrame:
    det = view(spark, d, "fx_det").withColumn("x1", F.col("x1") + 0.7).withColumn("y1", F.col("y1") + 0.7)
    return det.select("plate_id", "det_seq", *G.pad_clip(20, 1024, 1024))


@query(
    duck("fx_det")
    + """, s AS (SELECT plate_id, det_seq, x1, y1, w, h, trunc(w * 4.5) AS sw, trunc(h * 4.5) AS sh FROM fx_det),
    t AS (SELECT *, greatest(0, trunc(x1 + w / 2 - sw / 2)) AS sx, greatest(0, trunc(y1 + h / 2 - sh / 2)) AS sy FROM s)
    SELECT plate_id, det_seq, CAST(sx AS INT) AS sx, CAST(sy AS INT) AS sy, CAST(least(sw, 1024 - sx) AS INT) AS sw, CAST(least(sh, 1024 - sy) AS INT) AS sh FROM t"""
)
def p09_scale_clip(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_det").select("plate_id", "det_seq", F.col("x1").alias("x"), F.col("y1").alias("y"), "w", "h").select("plate_id", "det_seq", *G.scale_clip(4.5, 1024, 1024))


@query(duck("fx_det") + " SELECT plate_id, det_seq, CAST(round_even(x1 / 0.4, 0) AS INT) AS x, CAST(round_even(w / 0.4, 0) AS INT) AS w FROM fx_det")
def p10_rescale_boxes(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_det").select("plate_id", "det_seq", G.rescale("x1", 0.4).alias("x"), G.rescale("w", 0.4).alias("w"))


@query(
    duck("fx_det", "fx_meas")
    + """ SELECT plate_id, l_orderkey, l_linenumber, round(CASE WHEN minor_px > 0 THEN sqrt(1 - pow(least(major_px, minor_px) / greatest(major_px, minor_px), 2)) ELSE 0.5 END, 6) AS aspect_ecc,
    round(CASE WHEN area_px < 5 THEN 0.5 WHEN major_px > 0 THEN sqrt(1 - pow(least(1.0, minor_px / major_px), 2)) ELSE 0 END, 6) AS axis_ecc FROM fx_meas"""
)
def p11_p12_eccentricity(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "fx_meas")
    return rounded(m.select("plate_id", "l_orderkey", "l_linenumber", G.aspect_eccentricity("major_px", "minor_px").alias("aspect_ecc"), G.axis_eccentricity("major_px", "minor_px", "area_px").alias("axis_ecc")), "aspect_ecc", "axis_ecc")


@query(
    duck("fx_meas")
    + """ SELECT plate_id, l_orderkey, l_linenumber, round(area_px / (major_px * minor_px), 6) AS extent, round(CASE WHEN least(major_px, minor_px) > 0 THEN greatest(major_px, minor_px) / least(major_px, minor_px) ELSE 999 END, 6) AS aspect,
    round(CASE WHEN area_px % 3 > 0 THEN area_px / (area_px % 3 * 1000.0) ELSE 0 END, 6) AS solidity, round(minor_px / major_px, 6) AS axis_ratio FROM fx_meas"""
)
def p13_shape_ratios(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "fx_meas").withColumn("bbox", F.col("major_px") * F.col("minor_px")).withColumn("hull", F.col("area_px") % 3 * 1000.0)
    return rounded(m.select("plate_id", "l_orderkey", "l_linenumber", *G.shape_ratios("area_px", "bbox", "major_px", "minor_px", "hull", "major_px", "minor_px")), "extent", "aspect", "solidity", "axis_ratio")


@query(
    duck("fx_meas")
    + """ SELECT plate_id, l_orderkey, l_linenumber, round(0.25 + 0.5 * solidity, 6) AS shape, round(least(1.0, area_px / 20000.0), 6) AS fill, round(least(1.0, minor_px / 100), 6) AS blob, round(major_px / 255, 6) AS saliency,
    coalesce(CASE WHEN l_linenumber > 3 THEN solidity END, 0.9) AS given FROM fx_meas"""
)
def p14_proposal_confidence(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "fx_meas").withColumn("ecc", F.lit(0.5)).withColumn("bbox", F.lit(20000.0)).withColumn("top", F.lit(100)).withColumn("s", F.when(F.col("l_linenumber") > 3, F.col("solidity")))
    c = G.proposal_confidence
    out = m.select("plate_id", "l_orderkey", "l_linenumber", c("shape", eccentricity="ecc", solidity="solidity").alias("shape"), c("fill", area="area_px", bbox_area="bbox").alias("fill"), c("blob", radius="minor_px", max_sigma="top").alias("blob"), c("saliency", mean="major_px").alias("saliency"), c("given", score="s").alias("given"))
    return rounded(out, "shape", "fill", "blob", "saliency")


@query("SELECT p_partkey, round(CASE WHEN p_size % 7 > 0 THEN 10 * 1000.0 / (p_size % 7 * 100) END, 6) AS um_per_pixel FROM part WHERE p_size % 7 > 0")
def p15_calibrate(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    out = p.select("p_partkey", G.um_per_pixel(F.lit(10), F.col("p_size") % 7 * 100).alias("um_per_pixel")).filter("um_per_pixel IS NOT NULL")
    return rounded(out, "um_per_pixel")


@query(
    duck("fx_meas")
    + """, p AS (SELECT *, major_px * 8.666 AS l, minor_px * 8.666 AS w FROM fx_meas)
    SELECT plate_id, l_orderkey, l_linenumber, round(l, 4) AS length_um, round(w, 4) AS width_um, round(area_px * pow(8.666, 2), 3) AS area_um2, round(l / 1000, 6) AS length_mm,
    round(pi() * pow(w / 2000, 2) * l / 1000, 6) AS volume_mm3, round(4.0 / 3 * pi() * (l / 2000) * pow(w / 2000, 2), 6) AS spheroid_mm3 FROM p"""
)
def p16_to_physical(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "fx_meas")
    out = m.select("plate_id", "l_orderkey", "l_linenumber", *G.to_physical(F.lit(8.666), "um"), *G.to_physical(F.lit(8.666), "mm"))
    out = out.withColumn("spheroid_mm3", G.volume_spheroid("length_mm", "width_mm"))
    out = rounded(rounded(rounded(out, "length_um", "width_um", digits=4), "area_um2", digits=3), "length_mm", "volume_mm3", "spheroid_mm3")
    return out.select("plate_id", "l_orderkey", "l_linenumber", "length_um", "width_um", "area_um2", "length_mm", "volume_mm3", "spheroid_mm3")


@query(
    duck("fx_det")
    + """ SELECT plate_id, det_seq, CASE WHEN conf >= 0.99 THEN 'green' WHEN conf >= 0.98 THEN 'yellow' ELSE 'orange' END AS band,
    CASE WHEN w * 50 < 1200 THEN 'low' ELSE 'high' END AS half, CASE WHEN w * 40 < 500 THEN 'small' WHEN w * 40 <= 1500 THEN 'medium' ELSE 'large' END AS size_class,
    CAST(greatest(0, y1 - 3) AS INT) AS label_y, CASE WHEN conf >= 0.9 THEN printf('%d:%.2f', det_seq, conf) END AS label FROM fx_det"""
)
def p17_annotations(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("conf") >= 0.9, F.concat(F.col("det_seq").cast("string"), F.lit(":"), F.format_number("conf", 2)))
    half = F.when(F.col("w") * 50 < 1200, "low").otherwise("high")
    return view(spark, d, "fx_det").select("plate_id", "det_seq", G.band("conf").alias("band"), half.alias("half"), G.size_class(F.col("w") * 40).alias("size_class"), F.greatest(F.lit(0.0), F.col("y1") - 3).cast("int").alias("label_y"), label.alias("label"))


@query("SELECT page_id, printf('%s_tile_%04d', CAST(page_id AS VARCHAR), page_id % 90) AS tile_name, concat(regexp_replace(CAST(page_id AS VARCHAR), '\\.[^.]*$', ''), '_measurements') AS output_name FROM pages")
def p20_names(spark: SparkSession, d: str) -> DataFrame:
    n = tiles.names("page_id")
    return spark.read.parquet(f"{d}/pages.parquet").withColumn("tile_id", F.col("page_id") % 90).select("page_id", n["tile_name"].alias("tile_name"), n["output_name"].alias("output_name"))


@query(duck("fx_det") + " SELECT plate_id, det_seq, conf FROM fx_det WHERE conf >= 0.6")
def f01_min_confidence(spark: SparkSession, d: str) -> DataFrame:
    return filters.min_confidence(view(spark, d, "fx_det")).select("plate_id", "det_seq", "conf")


@query(duck("fx_det") + " SELECT plate_id, det_seq FROM fx_det WHERE conf > 0.4 AND x2 - x1 > 30 AND x2 - x1 < 300 AND y2 - y1 > 30 AND y2 - y1 < 300")
def f02_box_size_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.box_size_filter(view(spark, d, "fx_det")).select("plate_id", "det_seq")


@query(duck("fx_meas") + " SELECT plate_id, l_orderkey, l_linenumber, area_px FROM fx_meas WHERE area_px BETWEEN 1500 AND 100000")
def f03_area_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.area_filter(view(spark, d, "fx_meas"), "blob", "area_px").select("plate_id", "l_orderkey", "l_linenumber", "area_px")


_REASON = """, e AS (SELECT *, CASE WHEN major_px > 0 THEN sqrt(1 - pow(least(1.0, minor_px / major_px), 2)) ELSE 0 END AS ecc FROM fx_meas),
    r AS (SELECT *, CASE WHEN area_px NOT BETWEEN 200 AND 20000 THEN 'area' WHEN major_px NOT BETWEEN 40 AND 600 THEN 'major' WHEN minor_px NOT BETWEEN 6 AND 250 THEN 'minor'
      WHEN solidity < 0.60 THEN 'solidity' WHEN ecc < 0.86 THEN 'eccentricity' WHEN minor_px / major_px NOT BETWEEN 0.08 AND 0.65 THEN 'axis_ratio' END AS reason FROM e)"""


def measured(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_meas").withColumn("ecc", G.axis_eccentricity("major_px", "minor_px"))


@query(duck("fx_meas") + _REASON + " SELECT plate_id, l_orderkey, l_linenumber, reason FROM r")
def f04_morphology_filter(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d).select("plate_id", "l_orderkey", "l_linenumber", filters.morphology_reason("area_px", "major_px", "minor_px", "solidity", "ecc").alias("reason"))


@query(duck("fx_meas") + _REASON + " SELECT plate_id, l_orderkey, l_linenumber FROM r WHERE area_px BETWEEN 200 AND 20000 AND ecc BETWEEN 0.70 AND 0.999 AND solidity >= 0.5")
def f05_contour_filter(spark: SparkSession, d: str) -> DataFrame:
    m = measured(spark, d).withColumnsRenamed({"area_px": "area", "ecc": "eccentricity"})
    return filters.contour_filter(m).select("plate_id", "l_orderkey", "l_linenumber")


@query(
    duck("fx_meas")
    + """, k AS (SELECT plate_id, coalesce(area_px >= 10 AND solidity >= 0.2 AND major_px / minor_px <= 5 AND solidity >= 0.3 AND area_px * 2 BETWEEN 2500 AND 100000, false) AS ok FROM fx_meas)
    SELECT plate_id, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected FROM k GROUP BY plate_id"""
)
def f06_shape_filter(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "fx_meas").select("plate_id", "area_px", "solidity", (F.col("major_px") / F.col("minor_px")).alias("aspect"), (F.col("area_px") * 2).alias("expanded_area"))
    return filters.shape_filter_counts(m, area="area_px", extent="solidity")


@query(duck("fx_det") + " SELECT plate_id, det_seq FROM fx_det WHERE pow((x1 + x2) / 2 - 512, 2) + pow((y1 + y2) / 2 - 512, 2) <= pow(441, 2)")
def f07_inside_plate(spark: SparkSession, d: str) -> DataFrame:
    det = view(spark, d, "fx_det").select("plate_id", "det_seq", *G.centroid())
    return filters.inside_plate(det, 512, 512, 491, x="cx", y="cy").select("plate_id", "det_seq")


@query(duck("fx_det") + " SELECT plate_id, min(x1) AS min_x1, min(y1) AS min_y1, max(x2) AS max_x2, max(y2) AS max_y2, count(*) FILTER (x1 < 0 OR y1 < 0 OR x2 > 1000 OR y2 > 1000) AS outside FROM fx_det GROUP BY plate_id")
def f08_box_bounds_check(spark: SparkSession, d: str) -> DataFrame:
    return filters.box_bounds_check(view(spark, d, "fx_det"), width=1000, height=1000)


_PAIRS = """, pr AS (SELECT a.plate_id, a.det_seq, b.det_seq AS r_det_seq, a.conf, b.conf AS r_conf,
  greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS common, a.w * a.h + b.w * b.h AS total
  FROM fx_det a JOIN fx_det b ON a.plate_id = b.plate_id AND a.det_seq < b.det_seq AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2)"""


@query(duck("fx_det") + _PAIRS + " SELECT plate_id, det_seq, r_det_seq, round(common / (total - common), 6) AS iou FROM pr WHERE common / (total - common) > 0.5")
def j02_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.iou_pairs(view(spark, d, "fx_det"), 0.5), "iou")


@query(duck("fx_det") + _PAIRS + " SELECT plate_id, det_seq, r_det_seq, round(common / (total - common), 6) AS iou FROM pr WHERE common / (total - common) >= 0.25")
def j02_iou_pairs_mixed_sizes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.iou_pairs(view(spark, d, "fx_det"), 0.25, strict=False, cell=4, mixed_sizes=True), "iou")


def crops(det: DataFrame, gray: DataFrame) -> DataFrame:
    """Pixels and their sum in the padded crop of each box, scaled to the gray raster."""
    a, c = (F.col("x1") / 13).cast("int"), (F.col("y1") / 26).cast("int")
    boxes = det.select("plate_id", "det_seq", a.alias("x1"), c.alias("y1"), (a + 4).alias("x2"), (c + 4).alias("y2")).select("plate_id", "det_seq", *G.pad_clip(2, 80, 40))
    return spatial.crop_join(boxes, gray).groupBy("plate_id", "det_seq").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query(
    duck("fx_det", "fx_gray")
    + """, b AS (SELECT plate_id, det_seq, CAST(trunc(x1 / 13) AS INT) AS a, CAST(trunc(y1 / 26) AS INT) AS c FROM fx_det WHERE det_seq < 40)
    SELECT b.plate_id, det_seq, count(*) AS n, sum(v) AS total FROM b JOIN fx_gray g ON b.plate_id = g.plate_id AND g.x >= greatest(0, a - 2) AND g.x < least(80, a + 6) AND g.y >= greatest(0, c - 2) AND g.y < least(40, c + 6) GROUP BY b.plate_id, det_seq"""
)
def j03_crop_join(spark: SparkSession, d: str) -> DataFrame:
    return crops(view(spark, d, "fx_det").filter("det_seq < 40"), view(spark, d, "fx_gray"))


@query(
    duck("fx_det", "fx_gray")
    + """, b AS (SELECT plate_id, det_seq, CAST(trunc(x1 / 13) AS INT) AS a, CAST(trunc(y1 / 26) AS INT) AS c FROM fx_det)
    SELECT b.plate_id, det_seq, count(*) AS n, sum(v) AS total FROM b JOIN fx_gray g ON b.plate_id = g.plate_id AND g.x >= greatest(0, a - 2) AND g.x < least(80, a + 6) AND g.y >= greatest(0, c - 2) AND g.y < least(40, c + 6) GROUP BY b.plate_id, det_seq"""
)
def j03_crop_join_all(spark: SparkSession, d: str) -> DataFrame:
    return crops(view(spark, d, "fx_det"), view(spark, d, "fx_gray"))


@query(duck("fx_plate") + " SELECT plate_id, coalesce(split_assigned, 'test') AS split FROM fx_plate")
def j04_assign_split(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "fx_plate")
    return labels.assign_split(p.select("plate_id"), p.select("plate_id", F.col("split_assigned").alias("split")).filter("split IS NOT NULL"))


def with_measurements(det: DataFrame, measured: DataFrame) -> DataFrame:
    left = det.select("plate_id", F.col("det_seq").alias("detection_id"), F.col("conf").alias("confidence"))
    right = measured.select("plate_id", F.col("det_seq").alias("detection_id"), (F.col("w") * 8.666).alias("length_um"), F.round("conf", 1).alias("confidence"))
    return labels.join_measurements(left, right)


@query(
    duck("fx_det")
    + """, a AS (SELECT plate_id, det_seq AS detection_id, conf AS confidence_det FROM fx_det), b AS (SELECT plate_id, det_seq AS detection_id, w * 8.666 AS length_um, round(conf, 1) AS confidence_meas FROM fx_det WHERE det_seq % 2 = 0)
    SELECT a.plate_id, a.detection_id, confidence_det, length_um, confidence_meas FROM a JOIN b ON a.plate_id = b.plate_id AND a.detection_id = b.detection_id"""
)
def j05_join_measurements(spark: SparkSession, d: str) -> DataFrame:
    det = view(spark, d, "fx_det")
    return with_measurements(det, det.filter("det_seq % 2 = 0"))


@query(
    duck("fx_det")
    + """, a AS (SELECT plate_id, det_seq AS detection_id, conf AS confidence_det FROM fx_det), b AS (SELECT plate_id, det_seq AS detection_id, w * 8.666 AS length_um, round(conf, 1) AS confidence_meas FROM fx_det)
    SELECT a.plate_id, a.detection_id, confidence_det, length_um, confidence_meas FROM a JOIN b ON a.plate_id = b.plate_id AND a.detection_id = b.detection_id"""
)
def j05_join_measurements_all(spark: SparkSession, d: str) -> DataFrame:
    det = view(spark, d, "fx_det")
    return with_measurements(det, det)


@query(duck("fx_plate", "fx_det") + " SELECT d.plate_id, det_seq, round(w * coalesce(um_per_pixel, 8.666), 6) AS length_um FROM fx_det d LEFT JOIN fx_plate p ON d.plate_id = p.plate_id")
def j06_with_calibration(spark: SparkSession, d: str) -> DataFrame:
    det = view(spark, d, "fx_det").select("plate_id", "det_seq", "w")
    return labels.with_calibration(det, view(spark, d, "fx_plate")).select("plate_id", "det_seq", F.round(F.col("w") * F.col("um_per_pixel"), 6).alias("length_um"))


@query(duck("fx_plate", "fx_det") + " SELECT plate_id, 'missing' AS status FROM fx_plate WHERE plate_id NOT IN (SELECT plate_id FROM fx_det WHERE conf > 0.97 AND w > 38) UNION ALL SELECT plate_id, 'present' FROM fx_plate WHERE plate_id IN (SELECT plate_id FROM fx_det WHERE conf > 0.97 AND w > 38)")
def j07_missing_images(spark: SparkSession, d: str) -> DataFrame:
    plates, found = view(spark, d, "fx_plate").select("plate_id"), view(spark, d, "fx_det").filter("conf > 0.97 AND w > 38")
    return labels.missing_images(plates, found).withColumn("status", F.lit("missing")).unionByName(labels.present_images(plates, found).withColumn("status", F.lit("present")))


def _nms_sql(t: float, tie: str) -> str:
    """Greedy suppression as a recursion over each plate's boxes by rank, carrying what was kept."""
    return (
        duck("fx_det")
        + _PAIRS
        + f""", ov AS (SELECT * FROM pr WHERE common / (total - common) > {t}),
    edge AS (SELECT plate_id, CASE WHEN r_conf > conf OR (r_conf = conf AND {tie}) THEN r_det_seq ELSE det_seq END AS strong, CASE WHEN r_conf > conf OR (r_conf = conf AND {tie}) THEN det_seq ELSE r_det_seq END AS weak FROM ov),
    st AS (SELECT plate_id, weak, list(strong) AS strongs FROM edge GROUP BY ALL),
    touched AS (SELECT plate_id, strong AS det_seq FROM edge UNION SELECT plate_id, weak FROM edge),
    rk AS (SELECT t.plate_id, t.det_seq, row_number() OVER (PARTITION BY t.plate_id ORDER BY d.conf DESC, {'t.det_seq DESC' if tie == 'true' else 't.det_seq'}) AS k, s.strongs FROM touched t JOIN fx_det d USING (plate_id, det_seq) LEFT JOIN st s ON s.plate_id = t.plate_id AND s.weak = t.det_seq),
    walk AS (SELECT plate_id, 0::BIGINT AS k, []::BIGINT[] AS kept FROM (SELECT DISTINCT plate_id FROM rk)
      UNION ALL SELECT w.plate_id, w.k + 1, CASE WHEN r.strongs IS NOT NULL AND list_has_any(w.kept, r.strongs) THEN w.kept ELSE list_append(w.kept, r.det_seq) END FROM walk w JOIN rk r ON r.plate_id = w.plate_id AND r.k = w.k + 1),
    fin AS (SELECT plate_id, unnest(arg_max(kept, k)) AS det_seq FROM walk GROUP BY plate_id)
    SELECT plate_id, det_seq, conf FROM fx_det WHERE (plate_id, det_seq) IN (SELECT plate_id, det_seq FROM fin) OR (plate_id, det_seq) NOT IN (SELECT plate_id, det_seq FROM touched)"""
    )


@query(_nms_sql(0.5, "true"))
def a01_nms_global(spark: SparkSession, d: str) -> DataFrame:
    return suppress.nms_global(view(spark, d, "fx_det")).select("plate_id", "det_seq", "conf")


@query(_nms_sql(0.3, "false"))
def a02_nms_proposals(spark: SparkSession, d: str) -> DataFrame:
    return suppress.nms_proposals(view(spark, d, "fx_det")).select("plate_id", "det_seq", "conf")


@query(
    duck("fx_det")
    + """, walk AS (SELECT plate_id, 0::BIGINT AS k, []::STRUCT(i BIGINT, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE)[] AS kept FROM (SELECT DISTINCT plate_id FROM fx_det)
      UNION ALL SELECT plate_id, k + 1, CASE WHEN pos IS NULL OR pos = 0 THEN list_append(kept, me) WHEN (me.c - me.a) * (me.d - me.b) > (kept[pos].c - kept[pos].a) * (kept[pos].d - kept[pos].b) THEN list_concat(list_append(kept[:pos - 1], me), kept[pos + 1:]) ELSE kept END
      FROM (SELECT w.plate_id, w.k, w.kept, {'i': b.det_seq, 'a': b.x1, 'b': b.y1, 'c': b.x2, 'd': b.y2} AS me,
        list_position(list_transform(w.kept, lambda e: greatest(0, least(e.c, b.x2) - greatest(e.a, b.x1)) * greatest(0, least(e.d, b.y2) - greatest(e.b, b.y1)) >= 0.7 * ((e.c - e.a) * (e.d - e.b) + b.w * b.h - greatest(0, least(e.c, b.x2) - greatest(e.a, b.x1)) * greatest(0, least(e.d, b.y2) - greatest(e.b, b.y1)))), true) AS pos
        FROM walk w JOIN fx_det b ON b.plate_id = w.plate_id AND b.det_seq = w.k))
    SELECT plate_id, unnest(arg_max(kept, k)).i AS det_seq FROM walk GROUP BY plate_id"""
)
def a03_dedup_keep_larger(spark: SparkSession, d: str) -> DataFrame:
    return suppress.dedup_keep_larger(view(spark, d, "fx_det"), 0.7).select("plate_id", "det_seq")


_MATCH = """, cand AS (SELECT d.plate_id, d.det_seq, g.gt_id, d.conf,
    greatest(0, least(d.x2, g.x2) - greatest(d.x1, g.x1)) * greatest(0, least(d.y2, g.y2) - greatest(d.y1, g.y1)) AS common, d.w * d.h + (g.x2 - g.x1) * (g.y2 - g.y1) AS total
    FROM fx_det d JOIN fx_gt g ON d.plate_id = g.plate_id AND d.x1 < g.x2 AND g.x1 < d.x2 AND d.y1 < g.y2 AND g.y1 < d.y2),
  ok AS (SELECT *, common / (total - common) AS iou FROM cand WHERE common / (total - common) >= 0.5),
  per AS (SELECT plate_id, det_seq, conf, list(gt_id ORDER BY iou DESC, gt_id) AS gts FROM ok GROUP BY ALL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY plate_id ORDER BY conf DESC, det_seq DESC) AS k FROM per),
  walk AS (SELECT plate_id, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS det_seq, NULL::BIGINT AS gt_id FROM (SELECT DISTINCT plate_id FROM rk)
    UNION ALL SELECT plate_id, k, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, det_seq, pick FROM (SELECT w.plate_id, r.k, w.taken, r.det_seq, list_filter(r.gts, lambda e: NOT list_contains(w.taken, e))[1] AS pick FROM walk w JOIN rk r ON r.plate_id = w.plate_id AND r.k = w.k + 1)),
  m AS (SELECT plate_id, det_seq, gt_id FROM walk WHERE gt_id IS NOT NULL)"""


@query(duck("fx_det", "fx_gt") + _MATCH + " SELECT plate_id, det_seq, gt_id FROM m")
def j08_match_ground_truth(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.match_ground_truth(*_boxes(spark, d)).select("plate_id", "det_seq", "gt_id")


_RATES = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
    round(CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""


def _boxes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Detections, numbered once and written, and ground truth made of them."""
    det = cut_lineage(view(spark, d, "fx_det").select("plate_id", "det_seq", "x1", "y1", "x2", "y2", "conf"))
    return det, view(spark, d, "fx_gt", fx_det=det)


def _matched(spark: SparkSession, d: str):
    det, gt = _boxes(spark, d)
    return det, gt, evaluate.match_ground_truth(det, gt)


@query(
    duck("fx_det", "fx_gt")
    + _MATCH
    + """, f AS (SELECT plate_id, ((plate_id, det_seq) IN (SELECT plate_id, det_seq FROM m))::INT AS tp, ((plate_id, det_seq) NOT IN (SELECT plate_id, det_seq FROM m))::INT AS fp, 0 AS fn FROM fx_det
      UNION ALL SELECT plate_id, 0, 0, ((plate_id, gt_id) NOT IN (SELECT plate_id, gt_id FROM m))::INT FROM fx_gt),
    s AS (SELECT plate_id, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM f GROUP BY ROLLUP (plate_id)) SELECT plate_id, tp, fp, fn, """
    + _RATES
    + " FROM s"
)
def a10_precision_recall_f1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.precision_recall_f1(*_matched(spark, d)), "precision", "recall", "f1")


@query(
    duck("fx_det", "fx_gt")
    + _MATCH
    + """, f AS (SELECT d.conf, (m.gt_id IS NOT NULL) AS hit FROM fx_det d LEFT JOIN m USING (plate_id, det_seq)),
    s AS (SELECT t AS threshold, count(*) FILTER (conf >= t AND hit) AS tp, count(*) FILTER (conf >= t AND NOT hit) AS fp, (SELECT count(*) FROM fx_gt) - count(*) FILTER (conf >= t AND hit) AS fn FROM f, (SELECT unnest([0.25, 0.6, 0.9, 0.99]::DOUBLE[]) AS t) GROUP BY t) SELECT threshold, tp, fp, fn, """
    + _RATES
    + " FROM s"
)
def a12_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.threshold_sweep(*_matched(spark, d), [0.25, 0.6, 0.9, 0.99]), "precision", "recall", "f1")


@query(
    duck("fx_det", "fx_gt")
    + _MATCH
    + """, f AS (SELECT d.plate_id, d.det_seq, d.conf, (m.gt_id IS NOT NULL)::INT AS tp FROM fx_det d LEFT JOIN m USING (plate_id, det_seq)),
    r AS (SELECT *, row_number() OVER (ORDER BY conf DESC, plate_id, det_seq) AS n, sum(tp) OVER (ORDER BY conf DESC, plate_id, det_seq ROWS UNBOUNDED PRECEDING) AS hits FROM f),
    p AS (SELECT n, tp, max(hits / n) OVER (ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS env FROM r)
    SELECT round(sum(env) FILTER (tp = 1) / (SELECT count(*) FROM fx_gt), 6) AS ap FROM p"""
)
def a11_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.average_precision(*_matched(spark, d)), "ap")


_PHYS = ", ph AS (SELECT plate_id, major_px * 8.666 AS l, minor_px * 8.666 AS w, area_px * pow(8.666, 2) AS a, pi() * pow(minor_px * 8.666 / 2, 2) * (major_px * 8.666) AS v FROM fx_meas)"


def physical(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_meas").select("plate_id", *G.to_physical(F.lit(8.666), "um"))


# the ten thresholds' matches in one recursion: a threshold and plate take the place of a plate
_MATCH_AT = """, cand AS (SELECT d.plate_id, d.det_seq, g.gt_id, d.conf,
    greatest(0, least(d.x2, g.x2) - greatest(d.x1, g.x1)) * greatest(0, least(d.y2, g.y2) - greatest(d.y1, g.y1)) AS common, d.w * d.h + (g.x2 - g.x1) * (g.y2 - g.y1) AS total
    FROM fx_det d JOIN fx_gt g ON d.plate_id = g.plate_id AND d.x1 < g.x2 AND g.x1 < d.x2 AND d.y1 < g.y2 AND g.y1 < d.y2),
  ts AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::DOUBLE[]) AS t),
  ok AS (SELECT *, common / (total - common) AS iou FROM cand JOIN ts ON common / (total - common) >= t),
  per AS (SELECT t, plate_id, det_seq, conf, list(gt_id ORDER BY iou DESC, gt_id) AS gts FROM ok GROUP BY ALL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY t, plate_id ORDER BY conf DESC, det_seq DESC) AS k FROM per),
  walk AS (SELECT t, plate_id, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS det_seq, NULL::BIGINT AS gt_id FROM (SELECT DISTINCT t, plate_id FROM rk)
    UNION ALL SELECT t, plate_id, k, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, det_seq, pick FROM (SELECT w.t, w.plate_id, r.k, w.taken, r.det_seq, list_filter(r.gts, lambda e: NOT list_contains(w.taken, e))[1] AS pick FROM walk w JOIN rk r ON r.t = w.t AND r.plate_id = w.plate_id AND r.k = w.k + 1)),
  m AS (SELECT t, plate_id, det_seq, gt_id FROM walk WHERE gt_id IS NOT NULL),
  f AS (SELECT ts.t, d.plate_id, d.det_seq, d.conf, (m.gt_id IS NOT NULL)::INT AS tp FROM ts CROSS JOIN fx_det d LEFT JOIN m ON m.t = ts.t AND m.plate_id = d.plate_id AND m.det_seq = d.det_seq),
  r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY conf DESC, plate_id, det_seq) AS n, sum(tp) OVER (PARTITION BY t ORDER BY conf DESC, plate_id, det_seq ROWS UNBOUNDED PRECEDING) AS hits FROM f),
  p AS (SELECT t, n, tp, max(hits / n) OVER (PARTITION BY t ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS env FROM r),
  aps AS (SELECT t, coalesce(sum(env) FILTER (tp = 1), 0) / (SELECT count(*) FROM fx_gt) AS ap FROM p GROUP BY t)"""
_THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


@query(duck("fx_det", "fx_gt") + _MATCH_AT + " SELECT round(max(ap) FILTER (t = 0.5), 6) AS ap50, round(avg(ap), 6) AS ap50_95 FROM aps")
def a11_map(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.mean_average_precision(*_boxes(spark, d)), "ap50", "ap50_95")


@query(duck("fx_det", "fx_gt") + _MATCH_AT + " SELECT t AS threshold, round(ap, 6) AS ap FROM aps")
def a11_average_precisions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.average_precisions(*_boxes(spark, d), _THRESHOLDS), "ap")


@query(
    duck("fx_meas")
    + _PHYS
    + """ SELECT count(*) AS organisms, round(quantile_cont(l, 0.5), 3) AS median_length, round(quantile_cont(w, 0.5), 3) AS median_width, round(quantile_cont(a, 0.5), 1) AS median_area, round(quantile_cont(v, 0.5) / 1e9, 4) AS median_volume FROM ph"""
)
def a06_overall_medians(spark: SparkSession, d: str) -> DataFrame:
    s = summaries.measurement_summary(physical(spark, d), key=None).withColumn("median_volume", F.col("median_volume") / 1e9)
    return rounded(rounded(rounded(s, "median_length", "median_width", digits=3), "median_area", digits=1), "median_volume", digits=4).select("organisms", "median_length", "median_width", "median_area", "median_volume")


@query(duck("fx_roi") + " SELECT plate_id, count(*) AS n FROM fx_roi GROUP BY plate_id")
def a04_roi_counts(spark: SparkSession, d: str) -> DataFrame:
    return summaries.roi_counts(view(spark, d, "fx_roi"))


@query(duck("fx_roi") + ", t AS (SELECT roi_type, count(*) AS n FROM fx_roi GROUP BY roi_type) SELECT roi_type, n, (SELECT count(*) FROM fx_roi) AS rois, (SELECT count(DISTINCT plate_id) FROM fx_roi) AS plates FROM t")
def a04_roi_type_counts(spark: SparkSession, d: str) -> DataFrame:
    rois = view(spark, d, "fx_roi")
    return summaries.roi_counts(rois, "roi_type").crossJoin(summaries.roi_totals(rois))


@query(
    duck("fx_plate", "fx_roi")
    + _ROI_TILES
    + """, l AS (SELECT lab.plate_id, tile_id, coalesce(split_assigned, 'test') AS split FROM lab JOIN fx_plate p ON lab.plate_id = p.plate_id), c AS (SELECT split, count(DISTINCT (plate_id, tile_id)) AS tiles, count(*) AS annotations FROM l GROUP BY split)
    SELECT s.split, coalesce(tiles, 0) AS tiles, coalesce(annotations, 0) AS annotations FROM (SELECT unnest(['train', 'val', 'test', 'extra']) AS split) s LEFT JOIN c ON c.split = s.split"""
)
def a05_dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "fx_plate").select("plate_id", F.col("split_assigned").alias("split")).filter("split IS NOT NULL")
    return summaries.dataset_stats(labels.assign_split(roi_tiles(spark, d), p), ["train", "val", "test", "extra"])


_SUMMARY = ("mean_length", "median_length", "min_length", "max_length", "mean_width", "median_width", "mean_area", "median_area", "mean_volume", "median_volume", "total_volume")


@query(
    duck("fx_meas")
    + _PHYS
    + """ SELECT plate_id, count(*) AS organisms, round(avg(l), 3) AS mean_length, round(quantile_cont(l, 0.5), 3) AS median_length, round(min(l), 3) AS min_length, round(max(l), 3) AS max_length, round(avg(w), 3) AS mean_width, round(quantile_cont(w, 0.5), 3) AS median_width,
    round(avg(a), 1) AS mean_area, round(quantile_cont(a, 0.5), 1) AS median_area, round(avg(v) / 1e9, 4) AS mean_volume, round(quantile_cont(v, 0.5) / 1e9, 4) AS median_volume, round(sum(v) / 1e9, 3) AS total_volume FROM ph GROUP BY ROLLUP (plate_id)"""
)
def a06_measurement_summary(spark: SparkSession, d: str) -> DataFrame:
    s = summaries.measurement_summary(physical(spark, d), overall=True)
    s = s.withColumns({c: F.col(c) / 1e9 for c in ("mean_volume", "median_volume", "total_volume")})
    s = rounded(s, *_SUMMARY[:6], digits=3)
    return rounded(rounded(rounded(s, "mean_area", "median_area", digits=1), "mean_volume", "median_volume", digits=4), "total_volume", digits=3)


def plate_batch(plates: DataFrame, measurements: DataFrame) -> DataFrame:
    s = summaries.batch_summary(plates, measurements)
    return rounded(s.withColumn("avg_volume", F.round(F.col("avg_volume_um3") / 1e9, 4)).drop("avg_volume_um3"), "avg_length_um", "avg_width_um", digits=3)


@query(
    duck("fx_meas", "fx_plate")
    + _PHYS
    + """, p AS (SELECT plate_id, count(*) AS n, avg(l) AS l, avg(w) AS w, avg(v) / 1e9 AS v FROM ph WHERE plate_id % 4 <> 0 GROUP BY plate_id)
    SELECT f.plate_id, coalesce(n, 0) AS organisms, round(coalesce(l, 0), 3) AS avg_length_um, round(coalesce(w, 0), 3) AS avg_width_um, round(coalesce(v, 0), 4) AS avg_volume, CASE WHEN n IS NULL THEN 'empty' ELSE 'ok' END AS status FROM fx_plate f LEFT JOIN p ON f.plate_id = p.plate_id"""
)
def a07_batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return plate_batch(view(spark, d, "fx_plate"), physical(spark, d).filter("plate_id % 4 <> 0"))


@query(
    duck("fx_meas", "fx_plate")
    + _PHYS
    + """, p AS (SELECT plate_id, count(*) AS n, avg(l) AS l, avg(w) AS w, avg(v) / 1e9 AS v FROM ph GROUP BY plate_id)
    SELECT f.plate_id, coalesce(n, 0) AS organisms, round(coalesce(l, 0), 3) AS avg_length_um, round(coalesce(w, 0), 3) AS avg_width_um, round(coalesce(v, 0), 4) AS avg_volume, CASE WHEN n IS NULL THEN 'empty' ELSE 'ok' END AS status FROM fx_plate f LEFT JOIN p ON f.plate_id = p.plate_id"""
)
def a07_batch_summary_all(spark: SparkSession, d: str) -> DataFrame:
    return plate_batch(view(spark, d, "fx_plate"), physical(spark, d))


@query(duck("fx_det", "fx_plate") + _grid_sql(256, 64) + " SELECT p.plate_id, (SELECT count(*) FROM tiles t WHERE t.plate_id = p.plate_id) AS num_tiles, (SELECT count(*) FROM fx_det f WHERE f.plate_id = p.plate_id) AS before, (SELECT count(*) FROM fx_det f WHERE f.plate_id = p.plate_id AND conf >= 0.6) AS after FROM fx_plate p")
def a08_nms_counts(spark: SparkSession, d: str) -> DataFrame:
    det = view(spark, d, "fx_det")
    return summaries.nms_counts(det, filters.min_confidence(det), tiles.tile_grid(view(spark, d, "fx_plate"), 256, 64))


@query(
    duck("fx_gray", "fx_rgb")
    + """, l AS (SELECT plate_id, 'r' AS c, r::DOUBLE AS v FROM fx_rgb UNION ALL SELECT plate_id, 'g', g FROM fx_rgb UNION ALL SELECT plate_id, 'b', b FROM fx_rgb)
    SELECT plate_id, quantile_cont(v, 0.5) AS median, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max, round(avg(v) FILTER (c = 'r'), 6) AS mean_r, round(avg(v) FILTER (c = 'g'), 6) AS mean_g, round(avg(v) FILTER (c = 'b'), 6) AS mean_b FROM l GROUP BY plate_id"""
)
def a09_brightness_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.brightness_stats(view(spark, d, "fx_rgb")), "mean", "std", "mean_r", "mean_g", "mean_b")


@query(duck("fx_det") + " SELECT plate_id, det_seq, row_number() OVER (PARTITION BY plate_id ORDER BY conf DESC, det_seq DESC) - 1 AS detection_id FROM fx_det")
def w01_assign_detection_id(spark: SparkSession, d: str) -> DataFrame:
    return summaries.assign_detection_id(view(spark, d, "fx_det")).select("plate_id", "det_seq", F.col("detection_id").cast("long").alias("detection_id"))


@query(duck("fx_det") + " SELECT plate_id, det_seq, row_number() OVER (PARTITION BY plate_id ORDER BY det_seq) - 1 AS organism_id, 'accepted' AS mode FROM fx_det WHERE conf >= 0.9 UNION ALL SELECT * FROM (SELECT plate_id, det_seq, row_number() OVER (PARTITION BY plate_id ORDER BY det_seq) - 1, 'proposal' FROM fx_det QUALIFY conf >= 0.9)")
def w02_assign_organism_id(spark: SparkSession, d: str) -> DataFrame:
    det, ok = view(spark, d, "fx_det"), F.col("conf") >= 0.9
    both = [summaries.assign_organism_id(det, ok, m).select("plate_id", "det_seq", F.col("organism_id").cast("long").alias("organism_id"), F.lit(m).alias("mode")) for m in ("accepted", "proposal")]
    return both[0].unionByName(both[1])


@query("SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS dir, min(url) AS url FROM pages GROUP BY 1")
def w03_first_per_group(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet").withColumn("dir", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    return summaries.first_per_group(pages, "dir", "url")


@query(duck("fx_det") + """, r AS (SELECT plate_id, det_seq, row_number() OVER (ORDER BY md5(concat('42|', plate_id, '|', det_seq)), plate_id, det_seq) AS n, count(*) OVER () AS c FROM fx_det) SELECT plate_id, det_seq, CASE WHEN n <= floor(c * 0.2) THEN 'val' ELSE 'train' END AS split FROM r""")
def w04_shuffle_split(spark: SparkSession, d: str) -> DataFrame:
    return summaries.shuffle_split(view(spark, d, "fx_det"), "plate_id", "det_seq").select("plate_id", "det_seq", "split")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 5")
def w05_recent(spark: SparkSession, d: str) -> DataFrame:
    return summaries.recent(spark.read.parquet(f"{d}/events.parquet"), 5, "ts", "event_id").select("event_id")


@query(duck("fx_det") + """, s AS (SELECT plate_id, det_seq, CASE WHEN w * 40 < 500 THEN 'small' WHEN w * 40 <= 1500 THEN 'medium' ELSE 'large' END AS size_class FROM fx_det) SELECT plate_id, det_seq, size_class FROM s QUALIFY row_number() OVER (PARTITION BY size_class ORDER BY md5(concat('42|', plate_id, '|', det_seq)), plate_id, det_seq) <= 50""")
def w06_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    det = view(spark, d, "fx_det").withColumn("size_class", G.size_class(F.col("w") * 40))
    return summaries.stratified_sample(det, 50, "size_class", "plate_id", "det_seq").select("plate_id", "det_seq", "size_class")


@query(
    duck("fx_ticks")
    + """, g AS (SELECT image_id, pos - lag(pos) OVER (PARTITION BY image_id ORDER BY pos) AS gap FROM fx_ticks), s AS (SELECT image_id, count(gap) AS gaps, avg(gap) AS m, stddev_pop(gap) / avg(gap) AS v FROM g GROUP BY image_id)
    SELECT image_id, gaps, round(m, 6) AS mean_gap, round(v, 6) AS variation, coalesce(gaps > 0 AND v < 0.15, false) AS valid, round(CASE WHEN gaps > 0 AND v < 0.15 THEN 5000 / m ELSE 8.666 END, 6) AS um_per_pixel FROM s"""
)
def w07_ruler_from_ticks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summaries.ruler_from_ticks(view(spark, d, "fx_ticks")), "mean_gap", "variation", "um_per_pixel")


@query(duck("fx_det") + " SELECT plate_id, det_seq, row_number() OVER (PARTITION BY plate_id ORDER BY conf DESC, det_seq) - 1 AS rank FROM fx_det QUALIFY rank < 10")
def t01_rank_proposals(spark: SparkSession, d: str) -> DataFrame:
    return summaries.top_per_group(view(spark, d, "fx_det"), 10).select("plate_id", "det_seq", F.col("rank").cast("long").alias("rank"))


@query(duck("fx_crops", "fx_ids") + " SELECT crop_path AS path, 1 AS label FROM fx_crops WHERE is_collembola = 1 UNION SELECT concat('gt/', id_collembole, '.png'), 1 FROM fx_ids UNION SELECT crop_path, 0 FROM fx_crops WHERE is_collembola = 0")
def u01_unify_labels(spark: SparkSession, d: str) -> DataFrame:
    crops = view(spark, d, "fx_crops")
    return labels.unify_labels(crops, view(spark, d, "fx_ids"), crops, "id_collembole")


@query(duck("fx_plate") + " SELECT plate_id FROM fx_plate WHERE split_assigned IS NULL")
def u02_test_plates(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "fx_plate")
    return labels.test_plates(p, p.filter("split_assigned = 'train'"), p.filter("split_assigned = 'val'"))


@query(duck("fx_crops") + " SELECT crop_path AS path, is_collembola AS label FROM fx_crops")
def p01_resolve_column(spark: SparkSession, d: str) -> DataFrame:
    crops = view(spark, d, "fx_crops")
    return crops.select(labels.resolve_path(crops).alias("path"), labels.resolve_label(crops).alias("label"))


@query(
    duck("fx_gray", "fx_rgb")
    + """ SELECT plate_id, x, y, CAST(floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5::DOUBLE) AS INT) AS luma, round((0.2125::DOUBLE * r + 0.7154::DOUBLE * g + 0.0721::DOUBLE * b) / 255, 6) AS unit, round((r / 255 - 0.485::DOUBLE) / 0.229::DOUBLE, 6) AS r_norm FROM fx_rgb"""
)
def p21_p22_to_gray(spark: SparkSession, d: str) -> DataFrame:
    rgb = view(spark, d, "fx_rgb").withColumns({c: F.col(c).cast("double") for c in "rgb"})
    return rounded(rgb.select("plate_id", "x", "y", G.gray().alias("luma"), G.gray("skimage").alias("unit"), G.normalize_channels()[0]), "unit", "r_norm")
