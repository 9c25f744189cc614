"""Row filters of detections and proposals. The defaults are the pipelines' own settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Area presets (min, max) in pixels.
AREA_PRESETS = {"any": (200, 100_000), "detect": (1000, 100_000), "blob": (1500, 100_000), "feature": (2500, 100_000)}


def min_confidence(df: DataFrame, t: float = 0.6, column: str = "conf") -> DataFrame:
    return df.filter(F.col(column) >= t)


def box_size_filter(df: DataFrame, conf: float = 0.4, low: float = 30, high: float = 300) -> DataFrame:
    """Confidence above conf, sides strictly between low and high."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return df.filter((F.col("conf") > conf) & (w > low) & (w < high) & (h > low) & (h < high))


def area_filter(df: DataFrame, preset: str = "any", column: str = "area") -> DataFrame:
    return df.filter(F.col(column).between(*AREA_PRESETS[preset]))


def morphology_reason(
    area="area", major="major", minor="minor", solidity="solidity", eccentricity="eccentricity", min_eccentricity: float = 0.86,
    areas=(200, 20_000), majors=(40, 600), minors=(6, 250), min_solidity: float = 0.60, ratios=(0.08, 0.65),
) -> Column:
    """Why a measured object is rejected, null if it isn't; a missing measurement counts as 0. Ranges hold both ends."""
    v = {k: F.coalesce(F.col(c), F.lit(0)) for k, c in (("area", area), ("major", major), ("minor", minor), ("solidity", solidity), ("ecc", eccentricity))}
    ratio = F.when(v["major"] > 0, v["minor"] / v["major"]).otherwise(1.0)
    return (
        F.when(~v["area"].between(*areas), "area")
        .when(~v["major"].between(*majors), "major")
        .when(~v["minor"].between(*minors), "minor")
        .when(v["solidity"] < min_solidity, "solidity")
        .when(v["ecc"] < min_eccentricity, "eccentricity")
        .when(~ratio.between(*ratios), "axis_ratio")
    )


def morphology_filter(df: DataFrame, **options) -> DataFrame:
    return df.filter(morphology_reason(**options).isNull())


def contour_filter(df: DataFrame, areas=(200, 20_000)) -> DataFrame:
    return df.filter(F.col("area").between(*areas) & F.col("eccentricity").between(0.70, 0.999) & (F.col("solidity") >= 0.50))


def shape_keep(area="area", extent="extent", aspect="aspect", solidity="solidity", expanded="expanded_area", min_area: float = 10, min_expanded: float = 2500, max_expanded: float = 100_000) -> Column:
    return (F.col(area) >= min_area) & (F.col(extent) >= 0.2) & (F.col(aspect) <= 5) & (F.col(solidity) >= 0.3) & F.col(expanded).between(min_expanded, max_expanded)


def shape_filter_counts(df: DataFrame, key: str = "plate_id", **columns) -> DataFrame:
    """Accepted and rejected rows per image."""
    ok = F.coalesce(shape_keep(**columns), F.lit(False))
    return df.groupBy(key).agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


def inside_plate(df: DataFrame, cx, cy, radius, shrink: float = 50, x: str = "x", y: str = "y") -> DataFrame:
    """Rows within the circle, shrunk by `shrink` to 10 at least; circle by column or number."""
    c = lambda v: F.col(v) if isinstance(v, str) else F.lit(v)
    r = F.greatest(F.lit(10), c(radius) - shrink)
    dx, dy = F.col(x) - c(cx), F.col(y) - c(cy)
    return df.filter(dx * dx + dy * dy <= r * r)


def box_bounds_check(df: DataFrame, key: str = "plate_id", width: int = 1024, height: int = 1024) -> DataFrame:
    out = (F.col("x1") < 0) | (F.col("y1") < 0) | (F.col("x2") > width) | (F.col("y2") > height)
    return df.groupBy(key).agg(F.min("x1").alias("min_x1"), F.min("y1").alias("min_y1"), F.max("x2").alias("max_x2"), F.max("y2").alias("max_y2"), F.count_if(out).alias("outside"))
