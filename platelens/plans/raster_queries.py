"""Queries over masks and rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import duck, view
from ..operators import raster as R
from ..operators.components import cut_lineage
from .registry import query, rounded

_RUNS = """, isl AS (SELECT plate_id, y, x, x - row_number() OVER (PARTITION BY plate_id, y ORDER BY x) AS g FROM fx_mask),
  runs AS (SELECT plate_id, y, min(x) AS x0, max(x) AS x1 FROM isl GROUP BY plate_id, y, g)"""
_LABELS = """, e AS (SELECT a.plate_id, a.y AS ay, a.x0 AS ax, b.y AS by_, b.x0 AS bx FROM runs a JOIN runs b ON a.plate_id = b.plate_id AND a.y = b.y + 1 AND a.x0 <= b.x1 + {k} AND a.x1 + {k} >= b.x0),
  ways AS (SELECT * FROM e UNION ALL SELECT plate_id, by_, bx, ay, ax FROM e),
  reach AS (SELECT plate_id, y AS sy, x0 AS sx, y, x0 FROM runs UNION SELECT r.plate_id, r.sy, r.sx, b.by_, b.bx FROM reach r JOIN ways b ON r.plate_id = b.plate_id AND r.y = b.ay AND r.x0 = b.ax),
  lab AS (SELECT plate_id, sy AS y, sx AS x0, min(y * 1000 + x0) AS label FROM reach GROUP BY plate_id, sy, sx),
  full_ AS (SELECT runs.*, lab.label FROM runs JOIN lab USING (plate_id, y, x0)),
  sizes AS (SELECT plate_id, label, sum(x1 - x0 + 1)::BIGINT AS area FROM full_ GROUP BY ALL)"""
_SIZE = "SELECT DISTINCT plate_id, 80 AS width, 40 AS height FROM fx_gray"
# the last plate may be smaller than the others, and ragged
_SIZES = ", sz AS (SELECT plate_id, max(x) + 1 AS width, max(y) + 1 AS height FROM fx_gray GROUP BY plate_id)"
_CIRCLES = _SIZES + ", ci AS (SELECT plate_id, width // 2 AS cx, height // 2 AS cy, CAST(trunc(least(width, height) * 0.48::DOUBLE) AS INT) AS radius FROM sz)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    return R.to_runs(view(spark, d, "fx_mask"))


def flat_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.col("label.y") * 1000 + F.col("label.x0"))


def gray_plates(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_gray").groupBy("plate_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


@query(duck("fx_mask") + _RUNS + " SELECT plate_id, y, x0, x1 FROM runs")
def s03_to_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d)


@query(duck("fx_mask") + _RUNS + _LABELS.format(k=0) + " SELECT plate_id, y, x0, label FROM full_")
def r11_components_4(spark: SparkSession, d: str) -> DataFrame:
    return flat_label(R.label_runs(runs(spark, d), 4)).select("plate_id", "y", "x0", "label")


@query(duck("fx_mask") + _RUNS + _LABELS.format(k=1) + " SELECT plate_id, y, x0, label FROM full_")
def r11_components_8(spark: SparkSession, d: str) -> DataFrame:
    return flat_label(R.label_runs(runs(spark, d), 8)).select("plate_id", "y", "x0", "label")


@query(duck("fx_mask") + _RUNS + _LABELS.format(k=1) + " SELECT f.plate_id, y, x0, x1 FROM full_ f JOIN sizes s USING (plate_id, label) WHERE area >= 5")
def r12_remove_small_objects(spark: SparkSession, d: str) -> DataFrame:
    return R.remove_small_objects(R.label_runs(runs(spark, d), 8), 5).select("plate_id", "y", "x0", "x1")


@query(duck("fx_mask") + _RUNS + _LABELS.format(k=1) + ", best AS (SELECT plate_id, label FROM sizes QUALIFY row_number() OVER (PARTITION BY plate_id ORDER BY area DESC, label) = 1) SELECT f.plate_id, y, x0, x1 FROM full_ f JOIN best USING (plate_id, label)")
def r12_largest_component(spark: SparkSession, d: str) -> DataFrame:
    return R.largest_component(R.label_runs(runs(spark, d), 8)).select("plate_id", "y", "x0", "x1")


@query(
    duck("fx_mask")
    + """, dense AS (SELECT plate_id, x, y FROM (SELECT DISTINCT plate_id FROM fx_mask) p, range(0, 64) a(x), range(0, 50) b(y)),
  pix AS (SELECT * FROM fx_mask WHERE (x * 7 + y * 3) % 4 > 0 UNION SELECT plate_id, x, y FROM dense WHERE x % 4 = 0 OR y % 4 = 0),
  bg AS (SELECT plate_id, x, y FROM (SELECT DISTINCT plate_id FROM fx_mask) p, range(-1, 65) a(x), range(-1, 51) b(y) EXCEPT SELECT plate_id, x, y FROM pix),
  isl AS (SELECT plate_id, y, x, x - row_number() OVER (PARTITION BY plate_id, y ORDER BY x) AS g FROM bg),
  runs AS (SELECT plate_id, y, min(x) AS x0, max(x) AS x1 FROM isl GROUP BY plate_id, y, g)"""
    + _LABELS.format(k=0)
    + """, out_ AS (SELECT plate_id, x, y FROM pix UNION SELECT f.plate_id, unnest(range(x0, x1 + 1)), y FROM full_ f JOIN sizes USING (plate_id, label) WHERE area < 5 AND label >= 0)
  SELECT plate_id, count(*) AS pixels, sum(x * 31 + y * 17)::BIGINT AS checksum FROM out_ GROUP BY plate_id"""
)
def r12_remove_small_holes(spark: SparkSession, d: str) -> DataFrame:
    mask = view(spark, d, "fx_mask")
    plates = mask.groupBy("plate_id").agg(F.lit(64).alias("width"), F.lit(50).alias("height"))
    grid = plates.select("plate_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(63).cast("bigint"))).alias("x")).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(49).cast("bigint"))).alias("y")).filter("x % 4 = 0 OR y % 4 = 0")
    pix = mask.filter("(x * 7 + y * 3) % 4 > 0").unionByName(grid).distinct()
    full = R.to_pixels_of(R.remove_small_holes(R.to_runs(pix), plates, 5))
    return full.groupBy("plate_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col("x") * 31 + F.col("y") * 17).alias("checksum"))


@query(
    duck("fx_mask")
    + _RUNS
    + _LABELS.format(k=1)
    + """, px AS (SELECT f.plate_id, label, unnest(range(x0, x1 + 1))::DOUBLE AS x, y::DOUBLE AS y FROM full_ f JOIN sizes USING (plate_id, label) WHERE area >= 10),
  m AS (SELECT plate_id, label, count(*) AS area, avg(x) AS cx, avg(y) AS cy, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS vxy, min(x) AS a, min(y) AS b, max(x) + 1 AS c, max(y) + 1 AS d FROM px GROUP BY ALL),
  g AS (SELECT *, (vx + vy) / 2 + sqrt(pow(vx - vy, 2) / 4 + vxy * vxy) AS l1, greatest(0, (vx + vy) / 2 - sqrt(pow(vx - vy, 2) / 4 + vxy * vxy)) AS l2 FROM m)
  SELECT plate_id, label, area, CAST(a AS BIGINT) AS bbox_x1, CAST(b AS BIGINT) AS bbox_y1, CAST(c AS BIGINT) AS bbox_x2, CAST(d AS BIGINT) AS bbox_y2, round(cx, 4) AS centroid_x, round(cy, 4) AS centroid_y,
    round(4 * sqrt(l1), 4) AS major, round(4 * sqrt(CASE WHEN l2 < 1e-9 THEN 0 ELSE l2 END), 4) AS minor, round(CASE WHEN l1 > 0 THEN sqrt(1 - CASE WHEN l2 < 1e-9 THEN 0 ELSE l2 END / l1) ELSE 0 END, 4) AS eccentricity FROM g"""
)
def r13_region_props(spark: SparkSession, d: str) -> DataFrame:
    labelled = flat_label(R.remove_small_objects(R.label_runs(runs(spark, d), 8), 10))
    return rounded(R.region_props(labelled, "plate_id", "label"), "centroid_x", "centroid_y", "major", "minor", "eccentricity", digits=4)


@query(
    duck("fx_mask")
    + """, nb AS (SELECT m.plate_id, m.x, m.y, count(n.x) AS n FROM fx_mask m LEFT JOIN fx_mask n ON m.plate_id = n.plate_id AND abs(m.x - n.x) + abs(m.y - n.y) = 1 GROUP BY ALL),
  bd AS (SELECT plate_id, x, y FROM nb WHERE n < 4),
  code AS (SELECT a.plate_id, a.x, a.y, 1 + 2 * count(*) FILTER (abs(a.x - b.x) + abs(a.y - b.y) = 1) + 10 * count(*) FILTER (abs(a.x - b.x) = 1 AND abs(a.y - b.y) = 1) AS k FROM bd a LEFT JOIN bd b ON a.plate_id = b.plate_id AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY ALL)
  SELECT plate_id, round(sum(CASE WHEN k IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN k IN (21, 33) THEN sqrt(2) WHEN k IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END), 4) AS perimeter FROM code GROUP BY plate_id"""
)
def r14_perimeter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.perimeter(view(spark, d, "fx_mask"), "plate_id"), "perimeter", digits=4)


@query()
def r15_solidity(spark: SparkSession, d: str) -> DataFrame:
    labelled = flat_label(R.remove_small_objects(R.label_runs(runs(spark, d), 8), 10))
    return rounded(R.solidity(labelled, "plate_id", "label"), "hull_area", "solidity", digits=4)


@query(duck("fx_gray") + ", m AS (SELECT plate_id, quantile_cont(v, 0.5) AS m FROM fx_gray GROUP BY plate_id) SELECT g.plate_id, x, y, CASE WHEN m < 128 THEN CAST(greatest(0, least(255, trunc(v + (140 - m)))) AS INT) ELSE v END AS v FROM fx_gray g JOIN m ON g.plate_id = m.plate_id")
def r01_normalize_brightness(spark: SparkSession, d: str) -> DataFrame:
    return R.normalize_brightness(view(spark, d, "fx_gray"), 140, 128)


@query(
    duck("fx_gray")
    + _CIRCLES
    + """, p AS (SELECT plate_id, s.side, CAST(trunc(cx + (radius + s.r) * cos(a * 2 * pi() / 36)) AS INT) AS x, CAST(trunc(cy + (radius + s.r) * sin(a * 2 * pi() / 36)) AS INT) AS y FROM ci, range(0, 36) t(a), (SELECT unnest(['in', 'out']) AS side, unnest([-4, 4]) AS r) s),
  c AS (SELECT p.plate_id, abs(quantile_cont(v, 0.5) FILTER (side = 'in') - quantile_cont(v, 0.5) FILTER (side = 'out')) AS contrast FROM p JOIN fx_gray g ON p.plate_id = g.plate_id AND p.x = g.x AND p.y = g.y GROUP BY p.plate_id)
  SELECT plate_id, CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy, radius, contrast, coalesce(contrast < 10, true) AS low_contrast FROM ci LEFT JOIN c USING (plate_id)"""
)
def r02_plate_circle(spark: SparkSession, d: str) -> DataFrame:
    return R.plate_circle(view(spark, d, "fx_gray"), gray_plates(spark, d), ring=4)


@query(
    duck("fx_gray")
    + _CIRCLES
    + """, b AS (SELECT plate_id, v FROM fx_gray WHERE y = 0 UNION ALL SELECT plate_id, v FROM fx_gray JOIN sz USING (plate_id) WHERE y = height - 1 UNION ALL SELECT plate_id, v FROM fx_gray WHERE x = 0 UNION ALL SELECT plate_id, v FROM fx_gray JOIN sz USING (plate_id) WHERE x = width - 1),
  m AS (SELECT plate_id, CAST(trunc(quantile_cont(v, 0.5)) AS INT) AS m FROM b GROUP BY plate_id)
  SELECT g.plate_id, x, y, CASE WHEN pow(x - cx, 2) + pow(y - cy, 2) > radius * radius THEN m ELSE v END AS v FROM fx_gray g JOIN m ON g.plate_id = m.plate_id JOIN ci ON ci.plate_id = g.plate_id"""
)
def r03_mask_plate(spark: SparkSession, d: str) -> DataFrame:
    px, plates = view(spark, d, "fx_gray"), gray_plates(spark, d)
    return R.mask_plate(px, R.plate_circle(px, plates, ring=4), plates).select("plate_id", "x", "y", "v")


@query(
    duck("fx_gray")
    + _SIZES
    + """, ti AS (SELECT plate_id, CAST(ceil(width / 4.0::DOUBLE) AS INT) AS tw, CAST(ceil(height / 4.0::DOUBLE) AS INT) AS th, width, height FROM sz),
  h AS (SELECT plate_id, x // tw AS tx, y // th AS ty, v, count(*) AS n FROM fx_gray JOIN ti USING (plate_id) GROUP BY ALL),
  c AS (SELECT plate_id, tx, ty, sum(n) AS pixels, greatest(1, CAST(trunc(2.0::DOUBLE * sum(n) / 256) AS BIGINT)) AS lim FROM h GROUP BY ALL),
  e AS (SELECT plate_id, tx, ty, pixels, lim, sum(greatest(0, n - lim)) AS ex FROM h JOIN c USING (plate_id, tx, ty) GROUP BY ALL),
  f AS (SELECT e.plate_id, e.tx, e.ty, e.pixels, k.v, least(coalesce(h.n, 0), e.lim) + e.ex // 256 + (k.v < e.ex % 256)::INT AS n FROM e CROSS JOIN range(0, 256) k(v) LEFT JOIN h ON h.plate_id = e.plate_id AND h.tx = e.tx AND h.ty = e.ty AND h.v = k.v),
  lut AS (SELECT plate_id, tx, ty, v, floor((sum(n) OVER (PARTITION BY plate_id, tx, ty ORDER BY v))::DOUBLE * 255 / pixels + 0.5::DOUBLE) AS o FROM f),
  q AS (SELECT plate_id, x, y, v, (x + 0.5::DOUBLE) / tw - 0.5::DOUBLE AS fx, (y + 0.5::DOUBLE) / th - 0.5::DOUBLE AS fy, CAST(ceil(width / tw::DOUBLE) AS INT) - 1 AS lx, CAST(ceil(height / th::DOUBLE) AS INT) - 1 AS ly FROM fx_gray JOIN ti USING (plate_id)),
  s AS (SELECT plate_id, x, y, v, greatest(0, least(lx, CAST(floor(fx) AS INT) + i)) AS tx, greatest(0, least(ly, CAST(floor(fy) AS INT) + j)) AS ty,
    CASE WHEN i = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END * CASE WHEN j = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END AS w FROM q, range(0, 2) a(i), range(0, 2) b(j))
  SELECT s.plate_id, x, y, CAST(floor(round(sum(w * o) / sum(w), 6) + 0.5::DOUBLE) AS INT) AS v FROM s JOIN lut l ON l.plate_id = s.plate_id AND l.tx = s.tx AND l.ty = s.ty AND l.v = s.v GROUP BY s.plate_id, x, y"""
)
def r04_clahe(spark: SparkSession, d: str) -> DataFrame:
    return R.clahe(view(spark, d, "fx_gray"), gray_plates(spark, d), 2.0, 4)


def _window(f: str, k: int, src: str, out: str) -> str:
    return f"""{out}x AS (SELECT plate_id, x, y, {f}(v) OVER (PARTITION BY plate_id, y ORDER BY x RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS v FROM {src}),
  {out} AS (SELECT plate_id, x, y, {f}(v) OVER (PARTITION BY plate_id, x ORDER BY y RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS v FROM {out}x)"""


@query(duck("fx_gray") + ", " + _window("min", 2, "fx_gray", "e") + ", " + _window("max", 2, "e", "o") + " SELECT g.plate_id, g.x, g.y, g.v - o.v AS v FROM fx_gray g JOIN o USING (plate_id, x, y)")
def r05_tophat(spark: SparkSession, d: str) -> DataFrame:
    return R.subtract_background(view(spark, d, "fx_gray"), "tophat", 2, gaps="lines")


@query(duck("fx_gray") + ", " + _window("max", 2, "fx_gray", "a") + ", " + _window("min", 2, "a", "b") + " SELECT plate_id, x, y, v FROM b")
def r05_close(spark: SparkSession, d: str) -> DataFrame:
    return R.morphology(view(spark, d, "fx_gray"), "close", 2, gaps="lines")


@query(duck("fx_gray") + " SELECT a.plate_id, a.x, a.y, max(b.v) AS v FROM fx_gray a JOIN fx_gray b ON a.plate_id = b.plate_id AND b.x BETWEEN a.x - 3 AND a.x + 3 AND b.y BETWEEN a.y - 3 AND a.y + 3 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 9 GROUP BY ALL")
def r05_dilate_ellipse(spark: SparkSession, d: str) -> DataFrame:
    return R.morphology_ellipse(view(spark, d, "fx_gray"), "dilate", 3)


@query(
    duck("fx_gray")
    + """, h AS (SELECT plate_id, v, count(*) AS n FROM fx_gray GROUP BY ALL),
  c AS (SELECT plate_id, v, sum(n) OVER w AS n0, sum(n * v) OVER w AS s0, sum(n) OVER p AS n, sum(n * v) OVER p AS s FROM h WINDOW w AS (PARTITION BY plate_id ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY plate_id)),
  q AS (SELECT plate_id, v, CASE WHEN n > n0 THEN round(n0 * (n - n0) * pow(s0 / n0 - (s - s0) / (n - n0), 2), 3) ELSE 0 END AS q FROM c),
  t AS (SELECT plate_id, v AS threshold FROM q QUALIFY row_number() OVER (PARTITION BY plate_id ORDER BY q DESC, v) = 1)
  SELECT g.plate_id, x, y FROM fx_gray g JOIN t ON g.plate_id = t.plate_id WHERE v > threshold"""
)
def r06_threshold_otsu(spark: SparkSession, d: str) -> DataFrame:
    return R.threshold(view(spark, d, "fx_gray"), "otsu")


_GAUSS = """, ax AS (SELECT g.plate_id, g.x, g.y, sum(b.v * exp(-pow(b.x - g.x, 2) / (2 * pow({s}, 2)))) AS sv, sum(exp(-pow(b.x - g.x, 2) / (2 * pow({s}, 2)))) AS sw FROM fx_gray g JOIN fx_gray b ON g.plate_id = b.plate_id AND g.y = b.y AND abs(b.x - g.x) <= {k} GROUP BY ALL),
  gm AS (SELECT a.plate_id, a.x, a.y, sum(b.sv * exp(-pow(b.y - a.y, 2) / (2 * pow({s}, 2)))) / sum(b.sw * exp(-pow(b.y - a.y, 2) / (2 * pow({s}, 2)))) AS m FROM ax a JOIN ax b ON a.plate_id = b.plate_id AND a.x = b.x AND abs(b.y - a.y) <= {k} GROUP BY ALL)"""


@query(duck("fx_gray") + _GAUSS.format(k=5, s="(0.3 * 4 + 0.8)") + " SELECT plate_id, x, y FROM fx_gray g JOIN gm USING (plate_id, x, y) WHERE v > m - 2")
def r06_threshold_adaptive(spark: SparkSession, d: str) -> DataFrame:
    return R.threshold(view(spark, d, "fx_gray"), "adaptive", block=11)


@query(duck("fx_gray") + _GAUSS.format(k=5, s="(10 / 6.0)") + " SELECT plate_id, x, y FROM fx_gray g JOIN gm USING (plate_id, x, y) WHERE v / 255.0::DOUBLE < m / 255.0::DOUBLE - 0.02::DOUBLE")
def r07_local_threshold_mask(spark: SparkSession, d: str) -> DataFrame:
    return R.local_threshold_mask(view(spark, d, "fx_gray").withColumn("v", F.col("v") / 255), 11)


_BOX = "SELECT plate_id, x, y, avg(b.v) AS m, avg(b.v * b.v) AS q FROM (SELECT a.plate_id, a.x, a.y, b.v FROM fx_gray a JOIN fx_gray b ON a.plate_id = b.plate_id AND b.x BETWEEN a.x - 3 AND a.x + 3 AND b.y BETWEEN a.y - 3 AND a.y + 3) b GROUP BY ALL"


@query(duck("fx_gray") + f", b AS ({_BOX}) SELECT plate_id, x, y, round(m, 6) AS local_mean FROM b")
def r08_local_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.local_mean(view(spark, d, "fx_gray"), 7).select("plate_id", "x", "y", "local_mean"), "local_mean")


@query(duck("fx_gray") + f", b AS ({_BOX}) SELECT plate_id, x, y, round(sqrt(greatest(0, q - m * m)), 4) AS local_std FROM b")
def r09_local_std(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.local_std(view(spark, d, "fx_gray"), 7).select("plate_id", "x", "y", "local_std"), "local_std", digits=4)


# the image with a frame of three pixels in which it is mirrored, edge pixels included
_MIRRORED = _SIZES + """, mx AS (SELECT plate_id, p AS x, CASE WHEN m < width THEN m ELSE 2 * width - 1 - m END AS sx FROM (SELECT plate_id, width, p, ((p % (2 * width)) + 2 * width) % (2 * width) AS m FROM (SELECT plate_id, width, unnest(range(-3, width + 3)) AS p FROM sz))),
  my AS (SELECT plate_id, p AS y, CASE WHEN m < height THEN m ELSE 2 * height - 1 - m END AS sy FROM (SELECT plate_id, height, p, ((p % (2 * height)) + 2 * height) % (2 * height) AS m FROM (SELECT plate_id, height, unnest(range(-3, height + 3)) AS p FROM sz))),
  mir AS (SELECT g.plate_id, mx.x, my.y, v FROM fx_gray g JOIN mx ON mx.plate_id = g.plate_id AND mx.sx = g.x JOIN my ON my.plate_id = g.plate_id AND my.sy = g.y),
  win AS (SELECT a.plate_id, a.x, a.y, avg(b.v) AS m, avg(b.v * b.v) AS q, max(b.v) AS hi, min(b.v) AS lo,
    max(b.v) FILTER (pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 9) AS disc FROM fx_gray a JOIN mir b ON a.plate_id = b.plate_id AND b.x BETWEEN a.x - 3 AND a.x + 3 AND b.y BETWEEN a.y - 3 AND a.y + 3 GROUP BY ALL)"""


@query(duck("fx_gray") + _MIRRORED + " SELECT plate_id, x, y, round(m, 6) AS local_mean, round(sqrt(greatest(0, q - m * m)), 4) AS local_std FROM win")
def r08_r09_reflected(spark: SparkSession, d: str) -> DataFrame:
    rule = {"border": "reflect", "plates": gray_plates(spark, d)}
    means = R.local_mean(view(spark, d, "fx_gray"), 7, **rule)
    return rounded(rounded(R.local_std(means, 7, **rule).select("plate_id", "x", "y", "local_mean", "local_std"), "local_mean"), "local_std", digits=4)


@query(duck("fx_gray") + _MIRRORED + " SELECT plate_id, x, y, hi AS dilated, lo AS eroded, disc FROM win")
def r05_reflected(spark: SparkSession, d: str) -> DataFrame:
    px, rule = view(spark, d, "fx_gray"), {"border": "reflect", "plates": gray_plates(spark, d)}
    both = R.erode(R.dilate(px.withColumn("dilated", F.col("v")).withColumn("eroded", F.col("v")), 3, "dilated", **rule), 3, "eroded", **rule)
    disc = R.morphology_ellipse(px, "dilate", 3, **rule).withColumnRenamed("v", "disc")
    return both.drop("v").join(disc.hint("merge"), ["plate_id", "x", "y"])


@query(
    duck("fx_gray")
    + """, k AS (SELECT unnest(range(-40, 41)) AS d, exp(-(d * d) / (2.0::DOUBLE * 12 * 12)) AS w),
  row AS (SELECT g.plate_id, g.x, g.y, sum(h.v * k.w) AS s, sum(k.w) AS w FROM fx_gray g JOIN fx_gray h ON h.plate_id = g.plate_id AND h.y = g.y AND abs(h.x - g.x) <= 40 JOIN k ON k.d = h.x - g.x GROUP BY ALL)
  SELECT r.plate_id, r.x, r.y, round(sum(q.s * k.w) / sum(q.w * k.w), 6) AS local_mean FROM row r JOIN row q ON q.plate_id = r.plate_id AND q.x = r.x AND abs(q.y - r.y) <= 40 JOIN k ON k.d = q.y - r.y GROUP BY ALL"""
)
def r08_gaussian_wide(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.local_mean(view(spark, d, "fx_gray"), 81, "gaussian", 12).select("plate_id", "x", "y", "local_mean"), "local_mean")


@query(
    duck("fx_gray")
    + """, n AS (SELECT g.plate_id, g.x, g.y, sum(b.v * (b.x - g.x) * (2 - abs(b.y - g.y)))::BIGINT AS gx, sum(b.v * (b.y - g.y) * (2 - abs(b.x - g.x)))::BIGINT AS gy, count(*) AS c FROM fx_gray g JOIN fx_gray b ON g.plate_id = b.plate_id AND b.x BETWEEN g.x - 1 AND g.x + 1 AND b.y BETWEEN g.y - 1 AND g.y + 1 GROUP BY ALL)
  SELECT plate_id, x, y, gx, gy FROM n WHERE c = 9"""
)
def r10_gradient(spark: SparkSession, d: str) -> DataFrame:
    return R.gradient(view(spark, d, "fx_gray")).select("plate_id", "x", "y", F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"))


@query(
    duck("fx_gray")
    + _SIZES
    + """, sc AS (SELECT plate_id, width, height, CASE WHEN greatest(width, height) > 32 THEN 32::DOUBLE / greatest(width, height) ELSE 1.0::DOUBLE END AS s FROM sz),
  nw AS (SELECT plate_id, width, height, greatest(1, round_even(width * s, 0)) AS w, greatest(1, round_even(height * s, 0)) AS h FROM sc)
  SELECT plate_id, CAST(floor(x * w / width) AS INT) AS x, CAST(floor(y * h / height) AS INT) AS y, round(avg(v), 6) AS v FROM fx_gray JOIN nw USING (plate_id) GROUP BY ALL"""
)
def r18_downscale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.downscale(view(spark, d, "fx_gray"), gray_plates(spark, d), 32), "v")


@query(
    duck("fx_gray")
    + f""", p AS ({_SIZE}), b AS (SELECT x * 25 + 20 AS cx, y * 25 + 20 AS cy, x, y, 4.0 + v % 20 AS sigma, plate_id FROM fx_gray),
  c AS (SELECT plate_id, x, y, greatest(0, cx - trunc(sigma * sqrt(2) * 2.5)) AS x1, greatest(0, cy - trunc(sigma * sqrt(2) * 2.5)) AS y1, least(2000, cx + trunc(sigma * sqrt(2) * 2.5)) AS x2, least(1000, cy + trunc(sigma * sqrt(2) * 2.5)) AS y2 FROM b)
  SELECT plate_id, x, y, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, CAST(x2 AS INT) AS x2, CAST(y2 AS INT) AS y2 FROM c WHERE (x2 - x1) * (y2 - y1) BETWEEN 1500 AND 100000"""
)
def p19_blob_to_box(spark: SparkSession, d: str) -> DataFrame:
    g = view(spark, d, "fx_gray")
    blobs = g.select("plate_id", F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("x") * 25 + 20).alias("x"), (F.col("y") * 25 + 20).alias("y"), (F.col("v") % 20 + 4.0).alias("sigma"))
    plates = g.groupBy("plate_id").agg(F.lit(2000).alias("width"), F.lit(1000).alias("height"))
    return R.blob_to_box(blobs, plates).select("plate_id", F.col("ox").alias("x"), F.col("oy").alias("y"), "x1", "y1", "x2", "y2")
