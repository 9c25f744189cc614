"""Spatial joins by grid buckets: an equality join on (image, cell), then the exact test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou


def _cell_range(low: Column, high: Column, cell: int) -> Column:
    return F.sequence(F.floor(low / cell).cast("int"), F.floor(high / cell).cast("int"))


def _size_class(x1: str, y1: str, x2: str, y2: str, cell: int) -> Column:
    """Boxes of more than half a cell a side get larger cells, twice as large a class, so that no box touches more
    than four cells of its class, and most touch one or two."""
    side = F.greatest(F.col(x2) - F.col(x1), F.col(y2) - F.col(y1), F.lit(1))
    return F.greatest(F.lit(0), F.ceil(F.log2(2 * side / cell))).cast("int")


def box_pairs(left: DataFrame, right: DataFrame, key: str = "plate_id", cell: int = 64) -> DataFrame:
    """Pairs of boxes of one image that touch; right's columns (but for key) get the prefix r_. Boxes meet in the
    cells of the larger one's size class: larger ones are spread over the cells of their own class only, smaller
    ones over those of each class above theirs, in two joins by (image, class, cell). So a class's cells hold the
    pairs of its own boxes and no pairs of smaller ones. The classes are those that occur, one number for each
    doubling of the size. A pair that shares several cells is emitted in the cell of its common top-left corner."""
    names = ("x1", "y1", "x2", "y2")
    a = left.withColumn("__class", _size_class(*names, cell))
    b = right.select(key, *(F.col(c).alias(f"r_{c}") for c in right.columns if c != key))
    b = b.withColumn("__r_class", _size_class(*(f"r_{c}" for c in names), cell))
    found = a.select("__class").union(b.select("__r_class")).distinct().collect()  # a few dozen numbers
    classes = F.array(*(F.lit(k) for k in sorted(r[0] for r in found if r[0] is not None))).cast("array<int>")
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("__grid"))

    def spread(df: DataFrame, prefix: str, own: str, grid: Column) -> DataFrame:
        out = df.withColumn("__grid", grid).drop(own)
        cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(prefix + lo) / size).cast("long"), F.floor(F.col(prefix + hi) / size).cast("long")))
        return out.withColumn("__cx", cells("x1", "x2")).withColumn("__cy", cells("y1", "y2"))

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        corner_x, corner_y = F.greatest("x1", "r_x1"), F.greatest("y1", "r_y1")
        return (
            x.join(y.hint("merge"), [key, "__grid", "__cx", "__cy"])  # generators' sizes are unknown to Spark
            .filter((F.floor(corner_x / size) == F.col("__cx")) & (F.floor(corner_y / size) == F.col("__cy")))
            .filter((corner_x <= F.least("x2", "r_x2")) & (corner_y <= F.least("y2", "r_y2")))
            .drop("__grid", "__cx", "__cy")
        )

    larger_left = meet(spread(a, "", "__class", F.col("__class")), spread(b, "r_", "__r_class", F.explode(F.filter(classes, lambda k: k >= F.col("__r_class")))))
    # the least class has no smaller boxes
    upper = b.filter(F.col("__r_class") > F.array_min(classes))
    larger_right = meet(spread(a, "", "__class", F.explode(F.filter(classes, lambda k: k > F.col("__class")))), spread(upper, "r_", "__r_class", F.col("__r_class")))
    return larger_left.unionByName(larger_right)


def fixed_pairs(left: DataFrame, right: DataFrame, key: str, cell: int) -> DataFrame:
    """As box_pairs for boxes of about one size: one grid, at most four cells a box of up to `cell` a side."""

    def spread(df: DataFrame) -> DataFrame:
        return df.withColumn("__cx", F.explode(_cell_range(F.col("x1"), F.col("x2"), cell))).withColumn("__cy", F.explode(_cell_range(F.col("y1"), F.col("y2"), cell)))

    a = spread(left)
    b = spread(right)
    b = b.select(key, "__cx", "__cy", *(F.col(c).alias(f"r_{c}") for c in right.columns if c != key))
    corner_x, corner_y = F.greatest("x1", "r_x1"), F.greatest("y1", "r_y1")
    return (
        a.join(b.hint("merge"), [key, "__cx", "__cy"])  # generators' sizes are unknown to Spark
        .filter((F.floor(corner_x / cell) == F.col("__cx")) & (F.floor(corner_y / cell) == F.col("__cy")))
        .filter((corner_x <= F.least("x2", "r_x2")) & (corner_y <= F.least("y2", "r_y2")))
        .drop("__cx", "__cy")
    )


def iou_pairs(boxes: DataFrame, t: float = 0.5, strict: bool = True, key: str = "plate_id", seq: str = "det_seq", cell: int = 64, mixed_sizes: bool = False) -> DataFrame:
    """Pairs (seq < r_seq) of one image with IoU above t (at least t unless strict). mixed_sizes: boxes of
    very different sizes, for which each size class gets its own grid."""
    b = boxes.select(key, seq, "x1", "y1", "x2", "y2")
    pairs = (box_pairs if mixed_sizes else fixed_pairs)(b, b, key, cell).filter(F.col(seq) < F.col(f"r_{seq}"))
    value = F.coalesce(iou(), F.lit(0.0))
    return pairs.select(key, seq, f"r_{seq}", value.alias("iou")).filter(F.col("iou") > t if strict else F.col("iou") >= t)


def crop_join(boxes: DataFrame, pixels: DataFrame, key: str = "plate_id", cell: int = 32) -> DataFrame:
    """Pixels (x, y, ...) inside each integer box [px1, px2) x [py1, py2): cells of boxes meet cells of pixels."""
    spread = boxes.withColumn("__cx", F.explode(_cell_range(F.col("px1"), F.greatest("px1", F.col("px2") - 1), cell))).withColumn("__cy", F.explode(_cell_range(F.col("py1"), F.greatest("py1", F.col("py2") - 1), cell)))
    keyed = pixels.withColumn("__cx", F.floor(F.col("x") / cell).cast("int")).withColumn("__cy", F.floor(F.col("y") / cell).cast("int"))
    inside = (F.col("x") >= F.col("px1")) & (F.col("x") < F.col("px2")) & (F.col("y") >= F.col("py1")) & (F.col("y") < F.col("py2"))
    return spread.join(keyed.hint("merge"), [key, "__cx", "__cy"]).filter(inside).drop("__cx", "__cy")
