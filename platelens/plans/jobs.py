"""User-level jobs, and the places where a user's own models plug in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import view
from ..functions import geometry as G
from ..operators import crops, filters, labels, raster, spatial, summaries, suppress, tiles

Model = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def score_tiles(tile_rows: DataFrame, model: Model, key: str = "plate_id") -> DataFrame:
    """Boxes (key, tile_id, x1, y1, x2, y2, conf, class) that a user's function finds in batches of tiles, and
    their place (pos) among those of their tile in the function's order; it is called once per task with an
    iterator, so it can load its weights once."""
    kind = tile_rows.schema[key].dataType.simpleString()

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, int] = {}  # a tile's rows come from one task
        for found in model(batches):
            tile = list(zip(found[key], found["tile_id"]))
            before = [seen.get(t, 0) for t in tile]
            pos = found.groupby([key, "tile_id"], sort=False).cumcount() + before
            seen.update({t: int(p) + 1 for t, p in zip(tile, pos)})
            yield found.assign(pos=pos.astype("int64"))

    return tile_rows.mapInPandas(numbered, f"{key} {kind}, tile_id int, x1 double, y1 double, x2 double, y2 double, conf double, class int, pos long")


def score_tiles_guarded(tile_rows: DataFrame, model: Model, key: str = "plate_id") -> tuple[DataFrame, DataFrame]:
    """(boxes as of score_tiles, errors (key, error)): a plate for whose tiles the user's function raises is an error
    row and loses its boxes, and the others go on. The function is called anew for each batch of tiles, and where it
    raises for each plate of the batch, so what it loads it should remember."""
    kind = tile_rows.schema[key].dataType.simpleString()
    columns = ["x1", "y1", "x2", "y2", "conf", "class"]

    def called(batch: pd.DataFrame) -> pd.DataFrame:
        found = [f for f in model(iter([batch])) if len(f)]
        return pd.concat(found)[[key, "tile_id", *columns]] if found else pd.DataFrame(columns=[key, "tile_id", *columns])

    def guarded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            try:
                parts = [(called(batch), None)]
            except Exception:  # noqa: BLE001  whatever a user's function raises belongs to its plate
                parts = []
                for _, own in batch.groupby(key, sort=False):
                    try:
                        parts.append((called(own), None))
                    except Exception as error:  # noqa: BLE001
                        parts.append((pd.DataFrame({key: [own[key].iloc[0]]}), f"{type(error).__name__}: {error}"))
            for found, error in parts:
                tile = list(zip(found[key], found["tile_id"])) if error is None else []
                pos = found.groupby([key, "tile_id"], sort=False).cumcount() + [seen.get(t, 0) for t in tile] if tile else pd.Series(dtype="int64")
                seen.update({t: int(p) + 1 for t, p in zip(tile, pos)})
                yield found.reindex(columns=[key, "tile_id", *columns]).assign(pos=pos, error=error)

    scored = suppress.cut_lineage(tile_rows.mapInPandas(guarded, f"{key} {kind}, tile_id int, x1 double, y1 double, x2 double, y2 double, conf double, class int, pos long, error string"))
    # tiles of a plate may have been scored in several batches
    errors = suppress.cut_lineage(scored.filter("error IS NOT NULL").groupBy(key).agg(F.min("error").alias("error")))
    boxes = scored.filter("error IS NULL").drop("error").join(errors.select(key).hint("merge"), key, "left_anti")
    return boxes, errors


def score_crops(rows: DataFrame, model: Callable[[pd.Series], pd.Series], column: str = "features", name: str = "p") -> DataFrame:
    """Adds the probability that a user's vectorised function gives each row's crop."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield model(batch)

    return rows.withColumn(name, score(column))


def mask_boxes(boxes: DataFrame, model: Model, key: str = "plate_id", seq: str = "det_seq") -> DataFrame:
    """Runs (key, seq, y, x0, x1) that a user's segmenter gives for batches of boxes."""
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema.fields}
    return boxes.mapInPandas(model, f"{key} {kinds[key]}, {seq} {kinds[seq]}, y int, x0 int, x1 int")


def detect_tiled(plates: DataFrame, model: Model, size: int = 1280, overlap: int = 256, conf: float = 0.6, iou: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(detections with ids, counts per plate): grid, scoring, threshold, image coordinates, suppression. det_seq
    is the order of arrival, by tile and then by place in it, which settles equal confidences."""
    grid = tiles.tile_grid(plates, size, overlap)
    return _everywhere(score_tiles(grid, model), grid, conf, iou)


def _everywhere(scored: DataFrame, grid: DataFrame, conf: float, iou: float) -> tuple[DataFrame, DataFrame]:
    found = filters.min_confidence(scored, conf)
    order = F.shiftleft(F.col("tile_id").cast("long"), 32) + F.col("pos")
    everywhere = suppress.cut_lineage(tiles.tile_to_global(found, grid).withColumn("det_seq", order).drop("pos"))
    kept = summaries.assign_detection_id(suppress.nms_global(everywhere, iou, mixed_sizes=True))
    return kept, summaries.nms_counts(everywhere, kept, grid)


def physical_measurements(props: DataFrame, scale: Column, unit: str) -> DataFrame:
    """Region properties in physical units."""
    return props.select("*", *G.to_physical(scale, unit, "major", "minor", "area"))


def measure_from_masks(boxes: DataFrame, runs: DataFrame, scale: Column, unit: str = "um", key: str = "plate_id", seq: str = "det_seq") -> DataFrame:
    """Each box's mask (runs keyed by key and seq) as one region; boxes without a mask are measured by their
    sides and have mask_available false."""
    props = raster.region_props(runs, key, seq).join(raster.solidity(runs, key, seq).select(key, seq, "solidity").hint("merge"), [key, seq])
    props = props.join(raster.perimeter_of_runs(runs, key, seq).hint("merge"), [key, seq])
    joined = boxes.select(key, seq, "x1", "y1", "x2", "y2").join(props.select(key, seq, "area", "major", "minor", "eccentricity", "solidity", "perimeter").hint("merge"), [key, seq], "left")
    return physical_measurements(with_fallback(joined), scale, unit)


def with_fallback(rows: DataFrame) -> DataFrame:
    """Measurements of a box by its sides where its region has none."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    side = {"major": F.greatest(w, h), "minor": F.least(w, h), "area": w * h, "perimeter": 2 * (w + h), "eccentricity": F.lit(0.0), "solidity": F.lit(0.0)}
    flagged = rows.withColumn("mask_available", F.col("area").isNotNull())
    return flagged.withColumns({c: F.coalesce(F.col(c).cast("double"), v.cast("double")) for c, v in side.items()})


def measure_fast(boxes: DataFrame, px: DataFrame, plates: DataFrame, scale: Column, pad: int = 5, block: int = 51, min_size: int = 50, offset: float = 0.02, unit: str = "mm", key: str = "plate_id", seq: str = "det_seq") -> DataFrame:
    """Each box's largest dark region in its padded crop: local threshold inside the crop, small objects
    removed, region properties; boxes without a region get method no_contour_fallback."""
    sized = boxes.join(plates.select(key, "width", "height").hint("merge"), key).select(key, seq, "x1", "y1", "x2", "y2", *G.pad_clip(pad, "width", "height"))
    pixels = spatial.crop_join(sized.select(key, seq, "px1", "py1", "px2", "py2"), px).select(key, seq, "x", "y", "v")
    runs = suppress.cut_lineage(crops.largest_dark_regions(pixels, block, offset, min_size, key, seq))
    out = measure_from_masks(boxes, runs, scale, unit, key, seq)
    return out.withColumn("method", F.when(F.col("mask_available"), "fast").otherwise("no_contour_fallback"))


def _cleaned(mask: DataFrame, px: DataFrame, min_size: int, close: int, times: int = 1) -> DataFrame:
    """Labelled runs of a mask: small objects removed, gaps closed."""
    large = raster.remove_small_objects(raster.label_runs(raster.to_runs(mask), 8), min_size)
    closed = raster.close_mask(raster.to_pixels_of(large), px, close, times)
    return suppress.cut_lineage(raster.label_runs(raster.to_runs(suppress.cut_lineage(closed)), 8))


def _foreground(px: DataFrame, plates: DataFrame, background: int) -> DataFrame:
    """Contrast, background and Otsu's threshold, which looks at the pixels twice."""
    return raster.threshold(suppress.cut_lineage(raster.subtract_background(raster.clahe(px, plates), "tophat", background)), "otsu")


def _ranked(rows: DataFrame, seq: str) -> DataFrame:
    return summaries.number_rows(rows, "rank", "plate_id", F.desc("conf"), F.asc(seq))


def _with_solidity(labelled: DataFrame) -> DataFrame:
    props = raster.region_props(labelled, "plate_id", "label")
    return props.join(raster.solidity(labelled, "plate_id", "label").select("plate_id", "label", "solidity").hint("merge"), ["plate_id", "label"])


def propose_cv(px: DataFrame, plates: DataFrame, background: int = 25, min_size: int = 50, close: int = 1, areas=(200, 20_000)) -> DataFrame:
    """Proposals with their regions measured, ranked by confidence: contrast, background, Otsu, cleaning, closing,
    components, contour filter."""
    kept = filters.contour_filter(_with_solidity(_cleaned(_foreground(px, plates, background), px, min_size, close)), areas)
    return _ranked(kept.withColumn("conf", G.proposal_confidence("shape", eccentricity="eccentricity", solidity="solidity")), "label")


def proposal_boxes(proposals: DataFrame) -> DataFrame:
    """The boxes alone of propose_cv's proposals."""
    return proposals.select("plate_id", "rank", F.col("bbox_x1").alias("x1"), F.col("bbox_y1").alias("y1"), F.col("bbox_x2").alias("x2"), F.col("bbox_y2").alias("y2"))


def propose_cv_fast(
    px: DataFrame, plates: DataFrame, background: int = 25, scale: float = 3.0, preset: str = "detect", ring: int = 100, shrink: float = 50, min_size: int = 50, close: int = 1, min_eccentricity: float = 0.6
) -> DataFrame:
    """Boxes of components inside the plate, scaled about their centres, filtered by area and eccentricity,
    suppressed and ranked."""
    circle = raster.plate_circle(px, plates, ring=ring)
    mask = _foreground(px, plates, background).join(circle.select("plate_id", "cx", "cy", "radius").hint("merge"), "plate_id")
    inside = filters.inside_plate(mask, "cx", "cy", "radius", shrink).select("plate_id", "x", "y")
    boxes = _scaled(raster.region_props(_cleaned(inside, px, min_size, close), "plate_id", "label"), plates, scale)
    return _suppressed(filters.area_filter(boxes, preset).filter(F.col("eccentricity") >= min_eccentricity))


def _scaled(props: DataFrame, plates: DataFrame, scale: float) -> DataFrame:
    """Boxes of regions, scaled about their centres: x1 to y2, area and eccentricity of the box, and `conf`, the
    share of its area that the region fills."""
    sized = props.join(plates.select("plate_id", "width", "height").hint("merge"), "plate_id")
    box = sized.select("plate_id", "label", F.col("area").alias("pixels"), F.col("bbox_x1").alias("x"), F.col("bbox_y1").alias("y"), (F.col("bbox_x2") - F.col("bbox_x1")).alias("w"), (F.col("bbox_y2") - F.col("bbox_y1")).alias("h"), "width", "height")
    scaled = box.select("*", *G.scale_clip(scale, "width", "height")).withColumn("area", F.col("sw") * F.col("sh"))
    return scaled.select("plate_id", "label", "area", F.col("sx").alias("x1"), F.col("sy").alias("y1"), (F.col("sx") + F.col("sw")).alias("x2"), (F.col("sy") + F.col("sh")).alias("y2"), G.aspect_eccentricity("sw", "sh").alias("eccentricity"), G.proposal_confidence("fill", area="pixels", bbox_area="area").alias("conf"))


def _suppressed(rows: DataFrame) -> DataFrame:
    numbered = suppress.cut_lineage(summaries.number_rows(rows, "det_seq", "plate_id", F.asc("label")).drop("label"))
    return _ranked(suppress.nms_proposals(numbered, mixed_sizes=True), "det_seq")


def propose_multifeature(px: DataFrame, plates: DataFrame, threshold: int = 40, scale: float = 1.5, ring: int = 100, shrink: float = 50, min_size: int = 100, close: int = 2, times: int = 2, low: float = 30, high: float = 100, **shape) -> DataFrame:
    """Boxes of salient regions inside the plate that the shape filter keeps, with their mean saliency as
    confidence: edges, local variance and local contrast weighted into one map. shape: limits of shape_keep."""
    maps = suppress.cut_lineage(raster.feature_maps(px, raster.edge_lines(px, low, high), 21, 15))  # looked at three times
    map_ = suppress.cut_lineage(raster.saliency(maps, {"local_variance": 0.5, "e": 0.3, "local_std": 0.2}))
    circle = raster.plate_circle(px, plates, ring=ring)
    salient = filters.inside_plate(map_.filter(F.col("v") > threshold).join(circle.select("plate_id", "cx", "cy", "radius").hint("merge"), "plate_id"), "cx", "cy", "radius", shrink)
    props = suppress.cut_lineage(_with_solidity(_cleaned(salient.select("plate_id", "x", "y"), px, min_size, close, times)))
    boxes = suppress.cut_lineage(_scaled(props, plates, scale))
    w, h = F.col("bbox_x2") - F.col("bbox_x1"), F.col("bbox_y2") - F.col("bbox_y1")
    shapes = props.select("plate_id", "label", "solidity", F.col("area").alias("pixels"), (F.col("area") / (w * h)).alias("extent"), (F.greatest(w, h) / F.least(w, h)).alias("aspect"))
    kept = boxes.drop("conf").join(shapes.hint("merge"), ["plate_id", "label"]).filter(filters.shape_keep(area="pixels", expanded="area", **shape)).drop("pixels", "extent", "aspect", "solidity")
    cut = kept.select("plate_id", "label", *(F.col(c).cast("int").alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")))
    mean = raster.region_mean(cut, map_, "label").select("plate_id", "label", (F.col("mean_value") / 255).alias("conf"))
    return _suppressed(kept.join(mean.hint("merge"), ["plate_id", "label"]))


def propose_blob(px: DataFrame, plates: DataFrame, sigmas: list[float], ring: int = 100, shrink: float = 50, min_area: float = 1500) -> DataFrame:
    """Boxes around Laplacian blobs of the plate (a 0-255 raster, outside the plate its mean), ranked by size."""
    circle = raster.plate_circle(px, plates, ring=ring).select("plate_id", "cx", "cy", "radius")
    mean = px.groupBy("plate_id").agg(F.avg("v").alias("mean"))
    dx, dy, r = F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.greatest(F.lit(10), F.col("radius") - shrink)
    inside = px.join(circle.hint("merge"), "plate_id").join(mean.hint("merge"), "plate_id").select("plate_id", "x", "y", (F.when(dx * dx + dy * dy <= r * r, F.col("v")).otherwise(F.col("mean")) / 255).alias("v"))
    blobs = raster.blob_log(suppress.cut_lineage(inside), sigmas)
    boxes = raster.blob_to_box(blobs, plates, min_area).withColumn("conf", F.least(F.lit(1.0), F.col("sigma") * 2**0.5 / max(sigmas)))
    return _ranked(boxes, "blob_id")


def classify_and_filter(proposals: DataFrame, model: Callable[[pd.Series], pd.Series], t: float = 0.97, column: str = "features") -> DataFrame:
    """Measured proposals that the user's classifier accepts and the morphology filter keeps, numbered."""
    scored = suppress.cut_lineage(score_crops(proposals, model, column))
    ok = (F.col("p") >= t) & filters.morphology_reason().isNull()
    return summaries.assign_organism_id(scored, ok)


def analyze_plates(px: DataFrame, plates: DataFrame, boxes: DataFrame, classifier: Callable[[pd.Series], pd.Series], segmenter: Model, t: float = 0.97, pad: int = 5, scale: Column | None = None, **limits) -> DataFrame:
    """From rasters and proposed boxes (plate_id, det_seq, x1, y1, x2, y2) to organisms: dark plates brightened,
    the padded crops' mean gray given to the user's classifier, masks of the accepted from the user's segmenter,
    measured, filtered by morphology (limits as morphology_reason takes them) and numbered."""
    bright = suppress.cut_lineage(raster.normalize_brightness(px))
    sized = boxes.select("plate_id", "det_seq", "x1", "y1", "x2", "y2").join(plates.select("plate_id", "width", "height").hint("merge"), "plate_id")
    cut = sized.select("plate_id", "det_seq", *G.pad_clip(pad, "width", "height"))
    features = raster.region_mean(cut, bright, "det_seq").select("plate_id", "det_seq", F.col("mean_value").alias("features"))
    accepted = filters.min_confidence(suppress.cut_lineage(score_crops(features, classifier)), t, "p").select("plate_id", "det_seq", "p")
    chosen = suppress.cut_lineage(boxes.join(accepted.hint("merge"), ["plate_id", "det_seq"]))
    measured = measure_from_masks(chosen, suppress.cut_lineage(mask_boxes(chosen.select("plate_id", "det_seq", "x1", "y1", "x2", "y2"), segmenter)), F.lit(8.666) if scale is None else scale)
    rows = suppress.cut_lineage(measured.join(accepted.hint("merge"), ["plate_id", "det_seq"]))
    return summaries.assign_organism_id(rows, filters.morphology_reason(**limits).isNull())


def batch_plates(catalog: DataFrame, px: DataFrame, model: Model, scale: Column, size: int = 1280, overlap: int = 256, conf: float = 0.6, iou: float = 0.5, **measuring) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, measurements, counts) of all plates of a catalog (plate_id, width, height) in one job: tiled
    detection, measurement on the rasters px, and a row of the summary for each plate asked for.

    status: 'missing' for plates without a raster, which are not scored; 'failed' for those at which the model
    raised, with what it said in `error`; 'empty' where nothing was found; else 'ok'. The first three have zeros.
    measuring: options of measure_fast."""
    there = suppress.cut_lineage(px.select("plate_id").distinct())
    missing = labels.missing_images(catalog.select("plate_id"), there, "plate_id")
    plates = suppress.cut_lineage(catalog.join(there.hint("merge"), "plate_id", "left_semi"))
    grid = suppress.cut_lineage(tiles.tile_grid(plates, size, overlap))
    scored, errors = score_tiles_guarded(grid, model)
    kept, counts = _everywhere(scored, grid, conf, iou)
    kept = suppress.cut_lineage(kept)
    rows = suppress.cut_lineage(measure_fast(kept, px, plates, scale, unit="um", **measuring))
    summary = summaries.batch_summary(catalog, rows).drop("status")
    told = summary.join(errors.hint("merge"), "plate_id", "left").join(missing.select("plate_id", F.lit(True).alias("lacks")).hint("merge"), "plate_id", "left")
    status = F.when(F.col("lacks"), "missing").when(F.col("error").isNotNull(), "failed").when(F.col("organisms") == 0, "empty").otherwise("ok")
    return told.withColumn("status", status).drop("lacks"), rows, counts


def build_tiled_dataset(rois: DataFrame, plates: DataFrame, splits: DataFrame, size: int = 1280, overlap: int = 256) -> DataFrame:
    """Label rows (plate, tile, split, bx, by, bw, bh) of a detector's training tiles."""
    rows = tiles.global_to_tile(tiles.roi_tile_join(rois, plates, size, overlap), size)
    return labels.assign_split(rows, splits).withColumn("tile_name", tiles.names()["tile_name"])


def build_label_dataset(positives: DataFrame, truth: DataFrame, negatives: DataFrame, id_column: str, val_frac: float = 0.2) -> DataFrame:
    """(path, label, split) of a classifier's training crops."""
    return summaries.shuffle_split(labels.unify_labels(positives, truth, negatives, id_column), "path", "label", val_frac=val_frac)


def detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of all plates: confidence filter, suppression, ids, physical sizes, summary per plate."""
    det = filters.min_confidence(view(spark, sf_dir, "fx_det"))
    kept = summaries.assign_detection_id(suppress.nms_global(det))
    sized = kept.select("plate_id", "detection_id", *G.to_physical(F.lit(8.666), "um", F.greatest("w", "h"), F.least("w", "h"), F.col("w") * F.col("h")))
    return summaries.measurement_summary(sized)
