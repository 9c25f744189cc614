"""Boxes, shapes and units as column expressions. Columns may be given by name."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str | float | int) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def overlap_area(a: str = "", b: str = "r_") -> Column:
    """Area that boxes (x1, y1, x2, y2), prefixed a and b, have in common."""
    w = F.least(f"{a}x2", f"{b}x2") - F.greatest(f"{a}x1", f"{b}x1")
    h = F.least(f"{a}y2", f"{b}y2") - F.greatest(f"{a}y1", f"{b}y1")
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def box_area(p: str = "") -> Column:
    return (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))


def iou(a: str = "", b: str = "r_") -> Column:
    """Intersection over union; null where the union is empty."""
    both = overlap_area(a, b)
    union = box_area(a) + box_area(b) - both
    return F.when(union > 0, both / union)


def xyxy_to_xywh(p: str = "") -> list[Column]:
    return [F.col(f"{p}x1").alias("x"), F.col(f"{p}y1").alias("y"), (F.col(f"{p}x2") - F.col(f"{p}x1")).alias("width"), (F.col(f"{p}y2") - F.col(f"{p}y1")).alias("height")]


def centroid(p: str = "") -> list[Column]:
    return [((F.col(f"{p}x1") + F.col(f"{p}x2")) / 2).alias("cx"), ((F.col(f"{p}y1") + F.col(f"{p}y2")) / 2).alias("cy")]


def pad_clip(pad: int, width, height) -> list[Column]:
    """The box truncated to integers, widened by pad and clipped to the image: px1, py1, px2, py2."""
    whole = lambda c: F.col(c).cast("int")
    return [
        F.greatest(F.lit(0), whole("x1") - pad).alias("px1"),
        F.greatest(F.lit(0), whole("y1") - pad).alias("py1"),
        F.least(col(width).cast("int"), whole("x2") + pad).alias("px2"),
        F.least(col(height).cast("int"), whole("y2") + pad).alias("py2"),
    ]


def scale_clip(factor: float, width, height) -> list[Column]:
    """The box (x, y, w, h) scaled about its centre: sx, sy, sw, sh. A corner that leaves the image moves to
    its edge without narrowing the box; size is cut at the far edge only."""
    sw, sh = (F.col("w") * factor).cast("int"), (F.col("h") * factor).cast("int")
    sx = F.greatest(F.lit(0), (F.col("x") + F.col("w") / 2 - sw / 2).cast("int"))
    sy = F.greatest(F.lit(0), (F.col("y") + F.col("h") / 2 - sh / 2).cast("int"))
    return [sx.alias("sx"), sy.alias("sy"), F.least(sw, col(width).cast("int") - sx).alias("sw"), F.least(sh, col(height).cast("int") - sy).alias("sh")]


def rescale(c, scale: float) -> Column:
    """Back from an image that was scaled by `scale`, rounded half to even."""
    return F.bround(col(c) / scale, 0).cast("int")


def aspect_eccentricity(w="w", h="h") -> Column:
    """sqrt(1 - (short / long)^2) of a box; 0.5 for one without height."""
    ratio = F.least(col(w), col(h)) / F.greatest(col(w), col(h))
    return F.when(col(h) > 0, F.sqrt(1 - ratio * ratio)).otherwise(0.5)


def axis_eccentricity(major="major", minor="minor", points=None) -> Column:
    """sqrt(1 - (minor / major)^2); 0 without a major axis, 0.5 for fewer than five points."""
    ratio = F.least(F.lit(1.0), col(minor) / col(major))
    value = F.when(col(major) > 0, F.sqrt(1 - ratio * ratio)).otherwise(0.0)
    return value if points is None else F.when(col(points) < 5, 0.5).otherwise(value)


def shape_ratios(area="area", bbox_area="bbox_area", w="w", h="h", hull="hull", major="major", minor="minor") -> list[Column]:
    long, short = F.greatest(col(w), col(h)), F.least(col(w), col(h))
    return [
        F.when(col(bbox_area) > 0, col(area) / col(bbox_area)).otherwise(0.0).alias("extent"),
        F.when(short > 0, long / short).otherwise(999.0).alias("aspect"),
        F.when(col(hull) > 0, col(area) / col(hull)).otherwise(0.0).alias("solidity"),
        F.when(col(major) > 0, col(minor) / col(major)).otherwise(1.0).alias("axis_ratio"),
    ]


def proposal_confidence(kind: str, **columns) -> Column:
    """shape(eccentricity, solidity), fill(area, bbox_area), blob(radius, max_sigma), saliency(mean), given(score)."""
    c = {k: col(v) for k, v in columns.items()}
    if kind == "shape":
        return 0.5 * c["eccentricity"] + 0.5 * c["solidity"]
    if kind == "fill":
        return F.least(F.lit(1.0), c["area"] / c["bbox_area"])
    if kind == "blob":
        return F.least(F.lit(1.0), c["radius"] / c["max_sigma"])
    if kind == "saliency":
        return c["mean"] / 255
    if kind == "given":
        return F.coalesce(c["score"], F.lit(0.9))
    raise ValueError(f"no such kind of confidence: {kind}")


def um_per_pixel(ruler_mm, ruler_px) -> Column:
    """Calibration of a ruler; null for a ruler of no length."""
    return F.when(col(ruler_px) > 0, col(ruler_mm) * 1000 / col(ruler_px))


def volume_cylinder(length, width) -> Column:
    return F.lit(math.pi) * F.pow(col(width) / 2, F.lit(2)) * col(length)


def volume_spheroid(length, width) -> Column:
    return F.lit(4 / 3 * math.pi) * (col(length) / 2) * F.pow(col(width) / 2, F.lit(2))


def to_physical(scale, unit: str = "um", major="major_px", minor="minor_px", area="area_px") -> list[Column]:
    """length, width, area and cylinder volume in micrometres or millimetres; scale is µm per pixel."""
    k = {"um": 1.0, "mm": 1000.0}[unit]
    length, width = col(major) * col(scale) / k, col(minor) * col(scale) / k
    return [
        length.alias(f"length_{unit}"),
        width.alias(f"width_{unit}"),
        (col(area) * F.pow(col(scale) / k, F.lit(2))).alias(f"area_{unit}2"),
        volume_cylinder(length, width).alias(f"volume_{unit}3"),
    ]


def band(p) -> Column:
    return F.when(col(p) >= 0.99, "green").when(col(p) >= 0.98, "yellow").otherwise("orange")


def size_class(length_um) -> Column:
    return F.when(col(length_um) < 500, "small").when(col(length_um) <= 1500, "medium").otherwise("large")


def gray(weights: str = "opencv", r="r", g="g", b="b") -> Column:
    """Luma: 'opencv' on 0-255, rounded; 'skimage' on 0-1."""
    if weights == "opencv":
        return F.floor(0.299 * col(r) + 0.587 * col(g) + 0.114 * col(b) + 0.5).cast("int")
    if weights == "skimage":
        return (0.2125 * col(r) + 0.7154 * col(g) + 0.0721 * col(b)) / 255
    raise ValueError(f"no such weights: {weights}")


# Channel means and deviations of the usual image classifiers.
CHANNEL_MEAN = {"r": 0.485, "g": 0.456, "b": 0.406}
CHANNEL_STD = {"r": 0.229, "g": 0.224, "b": 0.225}


def normalize_channels() -> list[Column]:
    return [((F.col(c) / 255 - CHANNEL_MEAN[c]) / CHANNEL_STD[c]).alias(f"{c}_norm") for c in ("r", "g", "b")]
