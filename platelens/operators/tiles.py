"""Tile grids over images, and the way between tile and image coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _starts(dim: Column, size: int, overlap: int, mode: str) -> Column:
    """Array of the tiles' first pixels along one axis."""
    stride, dim = size - overlap, dim.cast("int")
    zero = F.lit(0)
    if mode == "shift":  # as many as reach the edge, the last one moved inwards
        n = F.when(dim <= size, 1).otherwise((F.ceil((dim - size) / stride) + 1).cast("int"))
        return F.transform(F.sequence(zero, n - 1), lambda k: F.greatest(zero, F.least(k * stride, dim - size)))
    if mode == "cover":  # whole strides, and one more at the edge where that is uncovered
        last = F.greatest(zero, dim - size)
        regular = F.sequence(zero, last, F.lit(stride))
        return F.array_sort(F.array_union(regular, F.array(last)))
    if mode == "ragged":  # every stride, tiles cut off at the edge
        return F.sequence(zero, F.greatest(zero, dim - 1), F.lit(stride))
    raise ValueError(f"no such grid: {mode}")


def tile_grid(plates: DataFrame, size: int = 1280, overlap: int = 256, mode: str = "shift") -> DataFrame:
    """Tiles (tile_id, x_off, y_off, x_end, y_end) of each row with width and height, numbered row by row."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than the tile's size")
    axes = plates.withColumn("__xs", _starts(F.col("width"), size, overlap, mode)).withColumn("__ys", _starts(F.col("height"), size, overlap, mode))
    rows = axes.select("*", F.posexplode("__ys").alias("__row", "y_off")).select("*", F.posexplode("__xs").alias("__col", "x_off"))
    return rows.select(
        *plates.columns,
        (F.col("__row") * F.size("__xs") + F.col("__col")).alias("tile_id"),
        "x_off",
        "y_off",
        F.least(F.col("x_off") + size, F.col("width").cast("int")).alias("x_end"),
        F.least(F.col("y_off") + size, F.col("height").cast("int")).alias("y_end"),
    )


def tile_to_global(boxes: DataFrame, tiles: DataFrame, key: str = "plate_id") -> DataFrame:
    """Boxes of tiles in image coordinates; joined by (key, tile_id)."""
    offsets = tiles.select(key, "tile_id", "x_off", "y_off")
    moved = boxes.join(offsets.hint("merge"), [key, "tile_id"])  # a generator's size is unknown to Spark
    for c, off in (("x1", "x_off"), ("y1", "y_off"), ("x2", "x_off"), ("y2", "y_off")):
        moved = moved.withColumn(c, F.col(c) + F.col(off))
    return moved.drop("x_off", "y_off")


def _covering(start: Column, end: Column, dim: Column, size: int, overlap: int) -> Column:
    """Array of tile numbers on one axis ('shift' grid) whose tiles may overlap [start, end): those whose
    regular place does, and the last one, which lies further inwards than its number says."""
    stride = size - overlap
    n = F.when(dim <= size, 1).otherwise((F.ceil((dim - size) / stride) + 1).cast("int"))
    lo = F.greatest(F.lit(0), F.floor((start - size) / stride).cast("int") + 1)
    hi = F.least(n - 1, F.floor((end - 1e-9) / stride).cast("int"))
    regular = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    return F.array_union(regular, F.array(n - 1))


def roi_tile_join(rois: DataFrame, plates: DataFrame, size: int = 1280, overlap: int = 256, min_ratio: float = 0.3, key: str = "plate_id") -> DataFrame:
    """ROIs (x, y, w, h) with each tile that holds at least min_ratio of their area. Candidate tiles follow
    from the ROI's place, so plates are joined by key and tiles by (key, tile_id): no comparison of all with
    all. ROIs without area are dropped."""
    sized = rois.filter("w > 0 AND h > 0").join(plates.select(key, F.col("width").alias("__w"), F.col("height").alias("__h")), key)
    stride = size - overlap
    columns = F.when(F.col("__w") <= size, 1).otherwise((F.ceil((F.col("__w") - size) / stride) + 1).cast("int"))
    spread = (
        sized.withColumn("__col", F.explode(_covering(F.col("x"), F.col("x") + F.col("w"), F.col("__w"), size, overlap)))
        .withColumn("__row", F.explode(_covering(F.col("y"), F.col("y") + F.col("h"), F.col("__h"), size, overlap)))
        .withColumn("tile_id", F.col("__row") * columns + F.col("__col"))
        .drop("__col", "__row", "__w", "__h")
    )
    tiles = tile_grid(plates.select(key, "width", "height"), size, overlap).drop("width", "height")
    x = F.least(F.col("x") + F.col("w"), F.col("x_end")) - F.greatest("x", "x_off")
    y = F.least(F.col("y") + F.col("h"), F.col("y_end")) - F.greatest("y", "y_off")
    # both sides come from generators, whose size Spark cannot tell
    return spread.join(tiles.hint("merge"), [key, "tile_id"]).filter((x > 0) & (y > 0) & (x * y / (F.col("w") * F.col("h")) >= min_ratio))


def global_to_tile(rows: DataFrame, size: int = 1280) -> DataFrame:
    """Adds the normalised label (bx, by, bw, bh: centre and size in tile units) of ROIs joined with tiles,
    clipped to the tile."""
    x1 = F.greatest(F.lit(0), F.col("x") - F.col("x_off"))
    y1 = F.greatest(F.lit(0), F.col("y") - F.col("y_off"))
    x2 = F.least(F.lit(size), F.col("x") + F.col("w") - F.col("x_off"))
    y2 = F.least(F.lit(size), F.col("y") + F.col("h") - F.col("y_off"))
    return rows.select("*", ((x1 + x2) / 2 / size).alias("bx"), ((y1 + y2) / 2 / size).alias("by"), ((x2 - x1) / size).alias("bw"), ((y2 - y1) / size).alias("bh"))


def names(image: str = "plate_id") -> dict[str, Column]:
    """tile_name, output_name and plate_name columns of an image column."""
    c = F.col(image).cast("string")
    return {
        "tile_name": F.format_string("%s_tile_%04d", c, F.col("tile_id")),
        "output_name": F.concat(F.regexp_replace(c, r"\.[^.]*$", ""), F.lit("_measurements")),
        "plate_name": F.regexp_replace(c, "^ROI_", ""),
    }
