"""Raster operators over pixel tables (plate_id, x, y, value): window frames per row and per column of the
image, so a partition is one line and never a whole image."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .blocks import closing, edges_and_variances, hull_areas, in_blocks, made_in_blocks, square_extrema, thin_edges, tile_tables
from .components import connected_components, cut_lineage
from .crops import border_codes
from .lines import along, block_components, running, running_ellipse, smoothed, summed, within

KEY = "plate_id"


def with_images(px: DataFrame, images: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """px joined to a table of a row an image, which is broadcast while it has at most broadcast_rows rows."""
    written = cut_lineage(images)
    return px.join(written.hint("broadcast" if written.count() <= broadcast_rows else "merge"), KEY)


def normalize_brightness(px: DataFrame, target: float = 50, threshold: float = 45, auto: bool = True) -> DataFrame:
    """Shift images whose median is below threshold (all, unless auto) to the target median."""
    med = px.groupBy(KEY).agg(F.percentile("v", 0.5).alias("__m"))
    shifted = F.greatest(F.lit(0), F.least(F.lit(255), (F.col("v") + (target - F.col("__m"))).cast("int")))
    apply = (F.col("__m") < threshold) if auto else F.lit(True)
    return px.join(med.hint("merge"), KEY).withColumn("v", F.when(apply, shifted).otherwise(F.col("v"))).drop("__m")


def plate_circle(px: DataFrame, plates: DataFrame, ratio: float = 0.48, ring: int = 100, angles: int = 36, min_contrast: float = 10) -> DataFrame:
    """cx, cy, radius of the centred plate and how much the medians of the gray values differ between points
    `ring` inside and outside its rim; points off the image don't count."""
    base = plates.select(KEY, F.floor(F.col("width") / 2).cast("int").alias("cx"), F.floor(F.col("height") / 2).cast("int").alias("cy"), (F.least("width", "height") * ratio).cast("int").alias("radius"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("a")
    points = base.select("*", steps).select("*", F.explode(F.array(F.struct(F.lit("in").alias("side"), (F.col("radius") - ring).alias("r")), F.struct(F.lit("out").alias("side"), (F.col("radius") + ring).alias("r")))).alias("p"))
    theta = F.col("a") * (2 * math.pi / angles)
    at = points.select(KEY, "p.side", (F.col("cx") + F.col("p.r") * F.cos(theta)).cast("int").alias("x"), (F.col("cy") + F.col("p.r") * F.sin(theta)).cast("int").alias("y"))
    off = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    # a point is cut to whole numbers, so its pixel is less than 1.5 off its circle; the others go before the shuffle
    rim = with_images(px.select(KEY, "x", "y", "v"), base).filter((F.abs(off - F.abs(F.col("radius") - ring)) < 2) | (F.abs(off - F.abs(F.col("radius") + ring)) < 2))
    seen = at.join(rim.select(KEY, "x", "y", "v").hint("merge"), [KEY, "x", "y"])
    contrast = seen.groupBy(KEY).agg(F.abs(F.percentile(F.when(F.col("side") == "in", F.col("v")), 0.5) - F.percentile(F.when(F.col("side") == "out", F.col("v")), 0.5)).alias("contrast"))
    return base.join(contrast.hint("merge"), KEY, "left").withColumn("low_contrast", F.coalesce(F.col("contrast") < min_contrast, F.lit(True)))


def mask_plate(px: DataFrame, circles: DataFrame, plates: DataFrame, channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """Outside the circle each channel becomes the median of the four border lines (corners count twice);
    images without a circle are left as they are."""
    sized = px.join(plates.select(KEY, "width", "height").hint("merge"), KEY)
    lines = [F.col("y") == 0, F.col("y") == F.col("height") - 1, F.col("x") == 0, F.col("x") == F.col("width") - 1]
    border = sized.withColumn("__n", sum(F.when(c, 1).otherwise(0) for c in lines)).filter("__n > 0").withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    med = border.groupBy(KEY).agg(*(F.percentile(c, 0.5).alias(f"__{c}") for c in channels))
    out = px.join(circles.select(KEY, "cx", "cy", "radius").hint("merge"), KEY, "left").join(med.hint("merge"), KEY, "left")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    outside = dx * dx + dy * dy > F.col("radius") * F.col("radius")
    for c in channels:
        out = out.withColumn(c, F.when(outside, F.col(f"__{c}").cast("int")).otherwise(F.col(c)))
    return out.select(*px.columns)


def clahe(px: DataFrame, plates: DataFrame, clip: float = 2.0, grid: int = 8) -> DataFrame:
    """Contrast-limited adaptive equalisation (Zuiderveld 1994): each tile's clipped histogram gives a lookup
    table, each pixel mixes those of its four nearest tiles, as far as they have pixels. Tiles are cut by ceiling
    division."""
    sized = with_images(px, plates.select(KEY, "width", "height")).withColumn("tw", F.ceil(F.col("width") / grid).cast("int")).withColumn("th", F.ceil(F.col("height") / grid).cast("int"))
    tiled = sized.withColumn("tx", F.floor(F.col("x") / F.col("tw")).cast("int")).withColumn("ty", F.floor(F.col("y") / F.col("th")).cast("int"))
    tile = [KEY, "tx", "ty"]
    hist = tiled.groupBy(*tile, "v").agg(F.count(F.lit(1)).alias("n"))
    totals = hist.groupBy(*tile).agg(F.sum("n").alias("pixels"), F.collect_list(F.struct("v", "n")).alias("h"))  # 256 entries at most
    fx, fy = (F.col("x") + 0.5) / F.col("tw") - 0.5, (F.col("y") + 0.5) / F.col("th") - 0.5
    placed = sized.withColumn("fx", fx).withColumn("fy", fy)
    last_x, last_y = F.ceil(F.col("width") / F.col("tw")).cast("int") - 1, F.ceil(F.col("height") / F.col("th")).cast("int") - 1
    # a pixel's four nearest tiles are those around the corner of tiles that it is nearest to: the quarters of a tile
    # that share one share their four tables, which meet them in one row
    corner_x, corner_y = F.floor("fx").cast("int"), F.floor("fy").cast("int")
    tables = tile_tables(totals, tile, clip)
    inner = lambda c, last: F.greatest(F.lit(0), F.least(last, c))
    corners = placed.select(KEY, corner_x.alias("cx"), corner_y.alias("cy"), last_x.alias("last_x"), last_y.alias("last_y")).distinct()
    spread = corners.select(KEY, "cx", "cy", F.explode(F.array(*(F.struct(F.lit(2 * dy + dx).alias("k"), inner(F.col("cx") + dx, F.col("last_x")).alias("tx"), inner(F.col("cy") + dy, F.col("last_y")).alias("ty")) for dx in (0, 1) for dy in (0, 1)))).alias("t")).select(KEY, "cx", "cy", "t.*")
    four = spread.join(tables.hint("merge"), tile).groupBy(KEY, "cx", "cy").agg(F.map_from_entries(F.collect_list(F.struct("k", "table"))).alias("tables"))
    met = placed.withColumn("cx", corner_x).withColumn("cy", corner_y).join(four.hint("merge"), [KEY, "cx", "cy"])
    wx, wy = F.col("fx") - F.floor("fx"), F.col("fy") - F.floor("fy")
    zero = F.lit(0.0)
    tables_ = [((wx if dx else 1 - wx) * (wy if dy else 1 - wy), F.try_element_at("tables", F.lit(2 * dy + dx))) for dx in (0, 1) for dy in (0, 1)]
    # tiles in which a ragged image has no pixels have no table; a pixel's own has one, and a quarter of the weight
    weight = sum((F.when(t.isNotNull(), w).otherwise(zero) for w, t in tables_), zero)
    mixed = sum((F.when(t.isNotNull(), w * F.get(t, F.col("v").cast("int"))).otherwise(zero) for w, t in tables_), zero)
    return met.select(KEY, "x", "y", F.floor(F.round(mixed / weight, 6) + 0.5).cast("int").alias("v"))


def _extrema(px: DataFrame, k: int, column: str, picks: tuple[np.ufunc, ...], border: str, plates: DataFrame | None, gaps: str) -> DataFrame:
    """Extrema over squares, one after the other."""
    if gaps not in ("square", "lines"):
        raise ValueError(f"no such rule for gaps: {gaps}")

    def square(df: DataFrame) -> DataFrame:
        return in_blocks(df, column, k * len(picks), square_extrema(k, picks))

    def by_lines(df: DataFrame) -> DataFrame:
        for pick in picks:
            for axis in "xy":
                df = along(df, axis, k, {column: px.schema[column].dataType}, lambda lines, pick=pick: {column: running(lines.get(column, -np.inf if pick is np.maximum else np.inf), k, pick)})
        return df

    if border == "reflect":  # each is of the image mirrored anew
        for pick in picks:
            px = within(px, plates, border, k, lambda df, pick=pick: _extrema(df, k, column, (pick,), "shrink", None, gaps)).select(*px.columns)
        return px
    return within(px, plates, border, k, square if gaps == "square" else by_lines).select(*px.columns)


def dilate(px: DataFrame, k: int, column: str = "v", border: str = "shrink", plates: DataFrame | None = None, gaps: str = "square") -> DataFrame:
    """Maximum over a square of 2k+1 pixels; with border='reflect', of the image mirrored at its edges. Where an image
    has gaps or is ragged, over the pixels of the square that it has; gaps='lines' takes of them only those from which
    a pixel of the same line leads to this one along its column."""
    return _extrema(px, k, column, (np.maximum,), border, plates, gaps)


def erode(px: DataFrame, k: int, column: str = "v", border: str = "shrink", plates: DataFrame | None = None, gaps: str = "square") -> DataFrame:
    return _extrema(px, k, column, (np.minimum,), border, plates, gaps)


def morphology(px: DataFrame, op: str, k: int, border: str = "shrink", plates: DataFrame | None = None, gaps: str = "square") -> DataFrame:
    """erode, dilate, open, close, tophat (v - open) or blackhat (close - v) with a square."""
    rule = {"border": border, "plates": plates, "gaps": gaps}
    if op == "erode":
        return erode(px, k, **rule)
    if op == "dilate":
        return dilate(px, k, **rule)
    if op == "open":
        return _extrema(px, k, "v", (np.minimum, np.maximum), border, plates, gaps)
    if op == "close":
        return _extrema(px, k, "v", (np.maximum, np.minimum), border, plates, gaps)
    if op == "tophat":
        return morphology(px.withColumn("__v", F.col("v")), "open", k, **rule).withColumn("v", F.col("__v") - F.col("v")).drop("__v")
    if op == "blackhat":
        return morphology(px.withColumn("__v", F.col("v")), "close", k, **rule).withColumn("v", F.col("v") - F.col("__v")).drop("__v")
    raise ValueError(f"no such operation: {op}")


def morphology_ellipse(px: DataFrame, op: str, k: int, border: str = "shrink", plates: DataFrame | None = None) -> DataFrame:
    """erode or dilate with a disc of radius k: rows give a pixel the extremum of each half width that the disc has,
    columns combine them, so each axis shuffles a row a pixel."""
    pick = {"erode": np.minimum, "dilate": np.maximum}[op]
    fill = -np.inf if pick is np.maximum else np.inf
    halves = [int(math.sqrt(k * k - d * d)) for d in range(k + 1)]
    columns = {h: f"__{h}" for h in sorted(set(halves))}
    kind = px.schema["v"].dataType

    def disc(df: DataFrame) -> DataFrame:
        wide = along(df, "x", k, {c: T.DoubleType() for c in columns.values()}, lambda lines: {c: running(lines.get("v", fill), h, pick) for h, c in columns.items()}, beyond=True)
        return along(wide, "y", k, {"v": kind}, lambda lines: {"v": running_ellipse(lines, columns, halves, pick)}).filter("__there").drop("__there", *columns.values())

    return within(px, plates, border, k, disc).select(*px.columns)


def close_mask(mask: DataFrame, px: DataFrame, k: int = 1, times: int = 1) -> DataFrame:
    """The mask's pixels (plate_id, x, y) with gaps closed by a disc of radius k, `times` times; px has the
    image's pixels."""
    rows = px.select(KEY, "x", "y", F.lit(0).alias("v")).unionByName(mask.select(KEY, "x", "y", F.lit(1).alias("v")))
    halves = [int(math.sqrt(k * k - d * d)) for d in range(k + 1)]
    return in_blocks(rows, "v", 2 * k * times, closing(halves, times)).filter("v = 1").select(KEY, "x", "y")


def subtract_background(px: DataFrame, op: str = "tophat", k: int = 25, gaps: str = "square") -> DataFrame:
    """'tophat'/'blackhat' as such; 'opening': gray minus its opening, not below 0."""
    if op == "opening":
        return morphology(px, "tophat", k, gaps=gaps).withColumn("v", F.greatest(F.lit(0), F.col("v")))
    if op in ("tophat", "blackhat"):
        return morphology(px, op, k, gaps=gaps)
    raise ValueError(f"no such operation: {op}")


def otsu_threshold(px: DataFrame) -> DataFrame:
    """(plate_id, threshold) of largest between-class variance over the 256-bin histogram, smallest on ties."""
    hist = px.groupBy(KEY, "v").agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy(KEY).orderBy("v").rowsBetween(W.unboundedPreceding, 0)  # 256 rows at most
    every = W.partitionBy(KEY)
    c = hist.select(KEY, "v", F.sum("n").over(upto).alias("n0"), F.sum(F.col("n") * F.col("v")).over(upto).alias("s0"), F.sum("n").over(every).alias("n"), F.sum(F.col("n") * F.col("v")).over(every).alias("s"))
    n1 = F.col("n") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / n1
    scored = c.withColumn("q", F.when(n1 > 0, F.round(F.col("n0") * n1 * gap * gap, 3)).otherwise(0.0))
    return scored.groupBy(KEY).agg(F.max_by("v", F.struct("q", -F.col("v"))).alias("threshold"))


def threshold(px: DataFrame, method: str = "otsu", value: int = 127, block: int = 51, c: float = 2) -> DataFrame:
    """Foreground pixels (plate_id, x, y)."""
    if method == "otsu":
        return with_images(px, otsu_threshold(px)).filter("v > threshold").select(KEY, "x", "y")
    if method == "adaptive":
        sigma = 0.3 * ((block - 1) / 2 - 1) + 0.8
        return local_mean(px, block, "gaussian", sigma).filter(F.col("v") > F.col("local_mean") - c).select(KEY, "x", "y")
    if method == "fixed":
        return px.filter(F.col("v") > value).select(KEY, "x", "y")
    raise ValueError(f"no such method: {method}")


def local_threshold_mask(px: DataFrame, block: int = 51, offset: float = 0.02) -> DataFrame:
    """Pixels of a 0-1 raster darker than their Gaussian surroundings less the offset."""
    return local_mean(px, block, "gaussian", (block - 1) / 6).filter(F.col("v") < F.col("local_mean") - offset).select(KEY, "x", "y")


def local_mean(px: DataFrame, block: int, kernel: str = "box", sigma: float | None = None, column: str = "v", name: str = "local_mean", border: str = "shrink", plates: DataFrame | None = None) -> DataFrame:
    """Adds the mean over a square, or the Gaussian-weighted one. At the border it is over what is there, or with
    border='reflect' over the image mirrored at its edges; where an image has gaps, over the pixels it has. A
    Gaussian is taken line by line, at a cost that doesn't grow with its width."""
    k = block // 2
    if kernel == "box":
        return _box_means(px, k, {name: F.col(column)}, border, plates)
    if kernel != "gaussian":
        raise ValueError(f"no such kernel: {kernel}")
    sigma = sigma or block / 6
    weights = np.exp(-(np.arange(-k, k + 1) ** 2) / (2 * sigma * sigma))
    kinds = {"__s": T.DoubleType(), "__w": T.DoubleType()}
    step = lambda lines: {c: smoothed(lines.get(c, 0.0), weights) for c in kinds}

    def gaussian(df: DataFrame) -> DataFrame:
        there = F.col(column).isNotNull().cast("double")
        start = df.withColumn("__s", F.coalesce(F.col(column).cast("double"), F.lit(0.0))).withColumn("__w", there)
        return along(along(start, "x", k, kinds, step), "y", k, kinds, step).withColumn(name, F.col("__s") / F.col("__w")).drop("__s", "__w")

    return within(px, plates, border, k, gaussian).select(*px.columns, name)


def _box_means(px: DataFrame, k: int, means: dict[str, Column], border: str, plates: DataFrame | None) -> DataFrame:
    """px and the mean of each column over the pixels that there are of a square, all from one pass along each axis."""
    kinds = {f"__{part}{i}": T.DoubleType() for i in range(len(means)) for part in "sn"}
    step = lambda lines: {c: summed(lines.get(c, 0.0), k) for c in kinds}

    def box(df: DataFrame) -> DataFrame:
        start = df.withColumns({f"__s{i}": F.coalesce(c.cast("double"), F.lit(0.0)) for i, c in enumerate(means.values())} | {f"__n{i}": c.isNotNull().cast("double") for i, c in enumerate(means.values())})
        sums = along(along(start, "x", k, kinds, step, beyond=True), "y", k, kinds, step).filter("__there")
        return sums.withColumns({c: F.when(F.col(f"__n{i}") > 0, F.col(f"__s{i}") / F.col(f"__n{i}")) for i, c in enumerate(means)}).drop("__there", *kinds)

    return within(px, plates, border, k, box).select(*px.columns, *means)


def _moments(px: DataFrame, block: int, name: str, border: str, plates: DataFrame | None) -> DataFrame:
    """px and the variance over a square, as `name`."""
    v = F.col("v")
    both = _box_means(px, block // 2, {"__m": v, "__mq": v * v}, border, plates)
    return both.withColumn(name, F.col("__mq") - F.col("__m") * F.col("__m")).drop("__m", "__mq")


def local_variance(px: DataFrame, block: int = 21, border: str = "shrink", plates: DataFrame | None = None) -> DataFrame:
    return _moments(px, block, "local_variance", border, plates)


def local_std(px: DataFrame, block: int = 15, border: str = "shrink", plates: DataFrame | None = None) -> DataFrame:
    return _moments(px, block, "local_std", border, plates).withColumn("local_std", F.sqrt(F.greatest(F.lit(0.0), F.col("local_std"))))


def gradient(px: DataFrame) -> DataFrame:
    """Adds Sobel gx, gy; pixels whose 3x3 neighbourhood leaves the image have none."""
    row, column = W.partitionBy(KEY, "y").orderBy("x"), W.partitionBy(KEY, "x").orderBy("y")
    d = px.withColumn("__d", F.lead("v").over(row) - F.lag("v").over(row)).withColumn("__s", F.lead("v").over(row) + 2 * F.col("v") + F.lag("v").over(row))
    d = d.withColumn("gx", F.lag("__d").over(column) + 2 * F.col("__d") + F.lead("__d").over(column)).withColumn("gy", F.lead("__s").over(column) - F.lag("__s").over(column))
    return d.drop("__d", "__s").filter("gx IS NOT NULL AND gy IS NOT NULL")


def edge_lines(px: DataFrame, low: float = 30, high: float = 100, blur: int = 5) -> DataFrame:
    """Edge pixels one wide (Canny 1986): smoothed gradient, thinned across it in a pass over blocks, weak pixels kept
    where their component has a strong one."""
    weights = np.exp(-(np.arange(blur // 2 + 1) ** 2) / (2 * 1.1 * 1.1))
    rows = px.select(KEY, "x", "y", F.col("v").cast("double").alias("v"), F.col("v").isNotNull().cast("int").alias("w"))
    thin = made_in_blocks(rows, ("v", "w"), {"m": T.DoubleType()}, blur // 2 + 2, thin_edges(low, weights)).filter("m IS NOT NULL")
    labels = label_runs(to_runs(thin, F.max("m").alias("m")), 8)
    strong = labels.groupBy(KEY, "label").agg(F.max("m").alias("m")).filter(F.col("m") > high)
    return to_pixels_of(labels.join(strong.hint("merge"), [KEY, "label"], "left_semi")).select(KEY, "x", "y")


def edges(px: DataFrame, low: float = 30, high: float = 100, blur: int = 5) -> DataFrame:
    """edge_lines, widened by one pixel."""
    kept = edge_lines(px, low, high, blur)
    grown = kept.select(KEY, F.explode(F.array(*(F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("p")).select(KEY, "p.*").distinct()
    return grown.join(px.select(KEY, "x", "y").hint("merge"), [KEY, "x", "y"], "left_semi")


def feature_maps(px: DataFrame, edge: DataFrame, variance: int = 21, deviation: int = 15) -> DataFrame:
    """plate_id, x, y, e (1 on edge_lines' pixels and next to them, else 0), local_variance and local_std, as the
    functions of these names have them, all from one pass over blocks."""
    rows = px.select(KEY, "x", "y", F.col("v").cast("double").alias("v"), F.col("v").isNotNull().cast("int").alias("w"), F.lit(0).alias("mark"))
    rows = rows.unionByName(edge.select(KEY, "x", "y", F.lit(0.0).alias("v"), F.lit(0).alias("w"), F.lit(1).alias("mark")))
    made = edges_and_variances(variance // 2, deviation // 2)
    found = made_in_blocks(rows, ("v", "w", "mark"), {c: T.DoubleType() for c in ("e", "local_variance", "local_std")}, max(1, variance // 2, deviation // 2), made)
    return found.filter("mark = 0").select(KEY, "x", "y", "e", "local_variance", "local_std")


def to_runs(mask: DataFrame, *more: Column) -> DataFrame:
    """Foreground pixels as horizontal runs (plate_id, y, x0, x1), both ends included, and `more` aggregates of them."""
    island = F.col("x") - F.row_number().over(W.partitionBy(KEY, "y").orderBy("x"))
    rows = mask if more else mask.select(KEY, "y", "x")
    return rows.withColumn("__i", island).groupBy(KEY, "y", "__i").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), *more).drop("__i")


def to_pixels_of(runs: DataFrame) -> DataFrame:
    """A row for each pixel of the runs, with their other columns."""
    return runs.withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")


def label_runs(runs: DataFrame, connectivity: int = 8, cell: int = 64, lines: int = 64, frame: int = 0) -> DataFrame:
    """Adds label, the struct (y, x0) of the component's first run. Runs are cut into blocks of `lines` lines and
    `4 * cell` columns, in which an Arrow pass finds components; only those that reach a block's border meet across it,
    by equality on (image, line, cell of x) or (image, column), and are contracted as a graph. The blocks begin
    `frame` pixels above and left of the image."""
    reach, wide = {4: 0, 8: 1}[connectivity], 4 * cell
    first, last = F.floor((F.col("x0") + frame) / wide), F.floor((F.col("x1") + frame) / wide)
    pieces = runs.withColumn("__bx", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn("__by", F.floor((F.col("y") + frame) / lines))
    pieces = pieces.withColumn("__a", F.greatest(F.col("x0").cast("long"), F.col("__bx") * wide - frame)).withColumn("__b", F.least(F.col("x1").cast("long"), (F.col("__bx") + 1) * wide - 1 - frame))
    found = cut_lineage(block_components(pieces, (KEY, "__bx", "__by"), "y", "__a", "__b", reach))
    at = F.struct("__ly", "__la")
    top, bottom = F.pmod(F.col("y") + frame, F.lit(lines)) == 0, F.pmod(F.col("y") + frame + 1, F.lit(lines)) == 0
    cells = F.explode(F.sequence(F.floor((F.col("__a") - reach) / cell), F.floor((F.col("__b") + reach) / cell)))
    upper = found.filter(bottom).select(KEY, (F.col("y") + 1).alias("y"), cells.alias("__c"), F.col("__a").alias("u0"), F.col("__b").alias("u1"), at.alias("dst"))
    lower = found.filter(top).select(KEY, "y", cells.alias("__c"), "__a", "__b", at.alias("src"))
    touch = (F.col("__a") <= F.col("u1") + reach) & (F.col("__b") >= F.col("u0") - reach)
    above = lower.join(upper.hint("merge"), [KEY, "y", "__c"]).filter(touch)
    near = F.explode(F.array(*(F.col("y") + i for i in range(-reach, reach + 1))))
    left = found.filter(F.pmod(F.col("__b") + frame + 1, F.lit(wide)) == 0).select(KEY, near.alias("y"), (F.col("__b") + 1).alias("__a"), at.alias("dst"))
    beside = found.filter(F.pmod(F.col("__a") + frame, F.lit(wide)) == 0).select(KEY, "y", "__a", at.alias("src")).join(left.hint("merge"), [KEY, "y", "__a"])
    links = above.select(KEY, "src", "dst").unionByName(beside.select(KEY, "src", "dst"))
    node = lambda c: F.struct(KEY, F.col(f"{c}.__ly").alias("__ly"), F.col(f"{c}.__la").alias("__la"))
    joined = connected_components(links.select(node("src").alias("src"), node("dst").alias("dst")))
    # a run's first piece stands for it, and a component's first piece is its first run's
    whole = found.filter("__a = x0").withColumn("label", F.struct(F.col("__ly").cast(runs.schema["y"].dataType).alias("y"), F.col("__la").cast(runs.schema["x0"].dataType).alias("x0")))
    if joined.isEmpty():
        return whole.select(*runs.columns, "label")
    ends = joined.select(F.col(f"node.{KEY}").alias(KEY), F.col("node.__ly").alias("__ly"), F.col("node.__la").alias("__la"), F.struct(F.col("component.__ly").cast(runs.schema["y"].dataType).alias("y"), F.col("component.__la").cast(runs.schema["x0"].dataType).alias("x0")).alias("__to"))
    return whole.join(ends.hint("merge"), [KEY, "__ly", "__la"], "left").withColumn("label", F.coalesce("__to", "label")).select(*runs.columns, "label")


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(KEY, "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))


def remove_small_objects(labelled: DataFrame, minimum: int) -> DataFrame:
    return labelled.join(component_sizes(labelled).filter(F.col("area") >= minimum).hint("merge"), [KEY, "label"], "left_semi")


def largest_component(labelled: DataFrame) -> DataFrame:
    """Each image's largest component, the first on ties."""
    size = component_sizes(labelled)
    best = size.groupBy(KEY).agg(F.max_by("label", F.struct("area", (-F.col("label.y")).alias("a"), (-F.col("label.x0")).alias("b"))).alias("label"))
    return labelled.join(best.hint("merge"), [KEY, "label"], "left_semi")


def remove_small_holes(runs: DataFrame, plates: DataFrame, limit: int = 50, connectivity: int = 4) -> DataFrame:
    """Fill background components of fewer than `limit` pixels that don't touch the image's edge. The
    background is taken with a frame around the image, so that all of its outside is one component."""
    frame = plates.select(KEY, "width", F.explode(F.sequence(F.lit(-1), F.col("height"))).alias("y"))
    lines = frame.join(runs.groupBy(KEY, "y").agg(F.array_sort(F.collect_list(F.struct("x0", "x1"))).alias("r")).hint("merge"), [KEY, "y"], "left")
    ends = F.concat(F.array(F.lit(-2)), F.coalesce(F.transform("r", lambda e: e["x1"].cast("int")), F.array().cast("array<int>")))
    starts = F.concat(F.coalesce(F.transform("r", lambda e: e["x0"].cast("int")), F.array().cast("array<int>")), F.array(F.col("width").cast("int") + 1))
    gaps = lines.select(KEY, "y", F.explode(F.arrays_zip(ends.alias("e"), starts.alias("s"))).alias("g")).select(KEY, "y", (F.col("g.e") + 1).alias("x0"), (F.col("g.s") - 1).alias("x1")).filter("x0 <= x1")
    labelled = label_runs(gaps, connectivity, frame=1)
    inner = component_sizes(labelled).filter((F.col("area") < limit) & (F.col("label.y") >= 0))
    holes = labelled.join(inner.hint("merge"), [KEY, "label"], "left_semi").select(KEY, "y", "x0", "x1")
    return to_runs(to_pixels_of(runs.select(KEY, "y", "x0", "x1").unionByName(holes)).distinct())


def region_props(runs: DataFrame, *keys: str) -> DataFrame:
    """area, bbox, centroid, axes and eccentricity of each region from the closed sums over its runs; axes
    are 4 * sqrt(eigenvalue) of the population covariance."""
    n = F.col("x1") - F.col("x0") + 1
    n, a, b, y = n.cast("double"), F.col("x0").cast("double"), F.col("x1").cast("double"), F.col("y").cast("double")
    sx = n * (a + b) / 2
    squares = lambda v: v * (v + 1) * (2 * v + 1) / 6
    sxx = squares(b) - squares(a - 1)
    sums = runs.groupBy(*keys).agg(
        F.sum(n).alias("n"), F.sum(sx).alias("sx"), F.sum(n * y).alias("sy"), F.sum(sxx).alias("sxx"), F.sum(n * y * y).alias("syy"), F.sum(sx * y).alias("sxy"),
        F.min("x0").alias("bbox_x1"), F.min("y").alias("bbox_y1"), (F.max("x1") + 1).alias("bbox_x2"), (F.max("y") + 1).alias("bbox_y2"),
    )
    mx, my = F.col("sx") / F.col("n"), F.col("sy") / F.col("n")
    cxx, cyy, cxy = F.col("sxx") / F.col("n") - mx * mx, F.col("syy") / F.col("n") - my * my, F.col("sxy") / F.col("n") - mx * my
    s = sums.select(*keys, F.col("n").cast("long").alias("area"), "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", mx.alias("centroid_x"), my.alias("centroid_y"), ((cxx + cyy) / 2).alias("__h"), F.sqrt((cxx - cyy) * (cxx - cyy) / 4 + cxy * cxy).alias("__r"))
    l1, l2 = F.greatest(F.lit(0.0), F.col("__h") + F.col("__r")), F.greatest(F.lit(0.0), F.col("__h") - F.col("__r"))
    # an eigenvalue this small is a rounding error of zero
    l2 = F.when(l2 < 1e-9, 0.0).otherwise(l2)
    return s.withColumn("major", 4 * F.sqrt(l1)).withColumn("minor", 4 * F.sqrt(l2)).withColumn("eccentricity", F.when(l1 > 0, F.sqrt(1 - l2 / l1)).otherwise(0.0)).drop("__h", "__r")


# Weights of the border-pixel codes in the perimeter estimator of Benkrid and Crookes.
_KINDS = ((5, 7, 15, 17, 25, 27), (21, 33), (13, 23))
_WEIGHTS = (1.0, math.sqrt(2), (1 + math.sqrt(2)) / 2)


def perimeter(pixels: DataFrame, *keys: str) -> DataFrame:
    """Perimeter of each region (pixels with the key columns, x, y) by the codes of its border pixels."""
    return perimeter_of_runs(pixels.select(*keys, "y", F.col("x").alias("x0"), F.col("x").alias("x1")), *keys)


def perimeter_of_runs(runs: DataFrame, *keys: str, lines: int = 64) -> DataFrame:
    """As perimeter, of regions given as runs. A region is dealt out in bands of `lines` lines, each with the two
    lines above and below that its pixels' codes hang on; an Arrow pass counts the codes of a band."""
    low, high = (F.floor((F.col("y") + i) / lines).cast("long") for i in (-2, 2))
    cells = F.struct(*(F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1")))
    bands = runs.select(*keys, F.explode(F.sequence(low, high)).alias("__band"), cells.alias("r")).groupBy(*keys, "__band").agg(F.collect_list("r").alias("r"))
    names = [f"__n{i}" for i in range(len(_KINDS))]
    counted = border_codes(bands, keys, names, lines, _KINDS)
    return counted.groupBy(*keys).agg(sum(F.sum(n) * w for n, w in zip(names, _WEIGHTS)).alias("perimeter"))


def solidity(runs: DataFrame, *keys: str) -> DataFrame:
    """area, hull_area (over pixel corners) and their ratio. Only each line's ends matter to the hull, so a
    region is a few numbers a line, and an Arrow pass has the hulls of many regions at once."""
    lines = runs.groupBy(*keys, "y").agg(F.min("x0").alias("x0"), (F.max("x1") + 1).alias("x1"), F.sum(F.col("x1") - F.col("x0") + 1).alias("n"))
    regions = lines.groupBy(*keys).agg(F.sum("n").alias("area"), F.collect_list(F.struct("y", "x0", "x1")).alias("l"))
    return hull_areas(regions, keys).withColumn("solidity", F.when(F.col("hull_area") > 0, F.col("area") / F.col("hull_area")).otherwise(0.0))


def saliency(maps: DataFrame, weights: dict[str, float]) -> DataFrame:
    """v: weighted sum of the min-max normalised maps, normalised again, on 0-255. A constant map is 0."""

    def normalised(df: DataFrame, columns: list[str]) -> DataFrame:
        ends = df.groupBy(KEY).agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
        out = with_images(df, ends)
        for c in columns:
            lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
            out = out.withColumn(c, F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0))
        return out.select(*df.columns)

    mixed = normalised(maps, list(weights)).select(KEY, "x", "y", sum(F.col(c) * w for c, w in weights.items()).alias("v"))
    return normalised(mixed, ["v"]).withColumn("v", (F.round(F.col("v") * 255, 6)).cast("int"))


def region_mean(boxes: DataFrame, px: DataFrame, *keys: str) -> DataFrame:
    from .spatial import crop_join

    return crop_join(boxes, px).groupBy(KEY, *keys).agg(F.avg("v").alias("mean_value"), F.count(F.lit(1)).alias("n_pixels"))


def downscale(px: DataFrame, plates: DataFrame, max_side: int = 1024) -> DataFrame:
    """Block means of images whose longer side exceeds max_side; others stay. New sides are rounded, 1 at least."""
    side = F.greatest("width", "height")
    scale = F.when(side > max_side, max_side / side).otherwise(1.0)
    sized = px.join(plates.select(KEY, "width", "height", scale.alias("__s")).hint("merge"), KEY)
    nw, nh = F.greatest(F.lit(1), F.bround(F.col("width") * F.col("__s"), 0)), F.greatest(F.lit(1), F.bround(F.col("height") * F.col("__s"), 0))
    cell = lambda v, new, old: F.floor(F.col(v) * new / F.col(old)).cast("int")
    return sized.select(KEY, cell("x", nw, "width").alias("nx"), cell("y", nh, "height").alias("ny"), "v").groupBy(KEY, F.col("nx").alias("x"), F.col("ny").alias("y")).agg(F.avg("v").alias("v"))


def blob_log(px: DataFrame, sigmas: list[float], min_response: float = 0.01, overlap: float = 0.5) -> DataFrame:
    """Blobs (plate_id, blob_id, x, y, sigma, response): maxima over place and scale of the scale-normalised
    Laplacian of the 0-1 raster; of two discs whose overlap exceeds `overlap` of the smaller, the larger stays."""
    layers = None
    for s, sigma in enumerate(sigmas):
        soft = local_mean(px, 2 * int(3 * sigma + 0.5) + 1, "gaussian", sigma).select(KEY, "x", "y", F.col("local_mean").alias("v"))
        row, column = W.partitionBy(KEY, "y").orderBy("x"), W.partitionBy(KEY, "x").orderBy("y")
        lap = F.lead("v").over(row) + F.lag("v").over(row) + F.lead("v").over(column) + F.lag("v").over(column) - 4 * F.col("v")
        layer = soft.select(KEY, "x", "y", F.lit(s).alias("s"), (-sigma * sigma * lap).alias("response")).filter("response IS NOT NULL")
        layers = layer if layers is None else layers.unionByName(layer)
    layers = cut_lineage(layers)
    peak = layers
    for axis, keys in (("x", ("y", "s")), ("y", ("x", "s")), ("s", ("x", "y"))):
        frame = W.partitionBy(KEY, *keys).orderBy(axis).rangeBetween(-1, 1)
        peak = peak.withColumn("__p", F.max("__p" if axis != "x" else "response").over(frame))
    found = peak.filter((F.col("response") >= F.col("__p")) & (F.col("response") > min_response))
    radius = F.element_at(F.array(*(F.lit(math.sqrt(2) * v) for v in sigmas)), F.col("s") + 1)
    blobs = found.select(KEY, "x", "y", "s", "response", radius.alias("r"))
    blobs = cut_lineage(blobs.withColumn("blob_id", F.row_number().over(W.partitionBy(KEY).orderBy("s", "y", "x")) - 1))
    from .spatial import box_pairs

    boxes = blobs.select(KEY, "blob_id", "x", "y", "r", "response", (F.col("x") - F.col("r")).alias("x1"), (F.col("y") - F.col("r")).alias("y1"), (F.col("x") + F.col("r")).alias("x2"), (F.col("y") + F.col("r")).alias("y2"))
    pairs = box_pairs(boxes, boxes).filter("blob_id < r_blob_id")
    d = F.hypot(F.col("x") - F.col("r_x"), F.col("y") - F.col("r_y"))
    a, b = F.greatest("r", "r_r"), F.least("r", "r_r")
    unit = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    ca, cb = unit((d * d + a * a - b * b) / (2 * d * a)), unit((d * d + b * b - a * a) / (2 * d * b))
    root = F.sqrt(F.greatest(F.lit(0.0), (-d + a + b) * (d + a - b) * (d - a + b) * (d + a + b)))
    lens = F.when(d <= a - b, math.pi * b * b).when(d >= a + b, 0.0).otherwise(a * a * F.acos(ca) + b * b * F.acos(cb) - root / 2)
    gone = pairs.filter(lens / (math.pi * b * b) > overlap).select(KEY, F.when((F.col("r") > F.col("r_r")) | ((F.col("r") == F.col("r_r")) & (F.col("response") >= F.col("r_response"))), F.col("r_blob_id")).otherwise(F.col("blob_id")).alias("blob_id")).distinct()
    sigma = F.element_at(F.array(*(F.lit(float(v)) for v in sigmas)), F.col("s") + 1)
    return blobs.join(gone.hint("merge"), [KEY, "blob_id"], "left_anti").select(KEY, "blob_id", "x", "y", sigma.alias("sigma"), "response")


def blob_to_box(blobs: DataFrame, plates: DataFrame, min_area: float = 1500, max_area: float = 100_000) -> DataFrame:
    """x1, y1, x2, y2 of blobs: half a side is int(2.5 * sigma * sqrt(2)), clipped; of areas within the limits."""
    half = (F.col("sigma") * math.sqrt(2) * 2.5).cast("int")
    b = blobs.join(plates.select(KEY, "width", "height").hint("merge"), KEY)
    b = b.select(*blobs.columns, F.greatest(F.lit(0), F.col("x").cast("int") - half).alias("x1"), F.greatest(F.lit(0), F.col("y").cast("int") - half).alias("y1"), F.least(F.col("width").cast("int"), F.col("x").cast("int") + half).alias("x2"), F.least(F.col("height").cast("int"), F.col("y").cast("int") + half).alias("y2"))
    return b.withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).filter(F.col("area").between(min_area, max_area))
