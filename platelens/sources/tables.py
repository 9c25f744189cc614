"""Catalogs, images, and the CSV, JSON and text forms of the tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.components import cut_lineage

# The columns of the files.
DETECTION_CSV = "x1 double, y1 double, x2 double, y2 double, width double, height double, confidence double, class int"
ROI_CSV = "plate_id string, image_name string, x int, y int, w int, h int, roi_name string, roi_type string"
CALIBRATION_JSON = "image string, ruler_mm double, ruler_um double, ruler_px double, um_per_pixel double"
_PIXEL_COLUMNS = ["bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "bbox_width_px", "bbox_height_px", "centroid_x_px", "centroid_y_px"]


def measurement_columns(unit: str) -> list[str]:
    """The fixed 22 columns of a measurement file in 'um' or 'mm'."""
    last = {"um": "mask_available", "mm": "method"}[unit]
    sizes = [f"length_{unit}", f"width_{unit}", f"area_{unit}2", f"volume_{unit}3"]
    return ["detection_id", *_PIXEL_COLUMNS, *sizes, "area_px", "perimeter_px", "major_axis_px", "minor_axis_px", "eccentricity", "solidity", "confidence", "class", last]


def stem(path: str | Column = "path") -> Column:
    """File name without folders and the last extension."""
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def plate_catalog(spark: SparkSession, paths: list[str], pattern: str | None = None) -> DataFrame:
    """image_id, path, length and time of the files; an error if there are none. Contents are not read."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    found = reader.load(paths).select(stem().alias("image_id"), "path", "length", "modificationTime")
    if found.isEmpty():
        raise FileNotFoundError(f"no files: {paths}")
    return found


def read_images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Decoded images (Spark's image source); what cannot be decoded is dropped."""
    return spark.read.format("image").option("dropInvalid", True).load(paths).select(stem("image.origin").alias("image_id"), "image.width", "image.height", "image.nChannels", "image.data")


def own_areas(offsets: DataFrame, key: str = "plate_id") -> DataFrame:
    """offsets (tile_name, key, x_off, y_off) and own_x, own_y: where the part of each tile begins that no tile to
    its left or above it covers, in a grid of tiles of one size to a plate, x_end and y_end given. A row a tile."""
    row, column = W.partitionBy(key, "y_off").orderBy("x_off"), W.partitionBy(key, "x_off").orderBy("y_off")
    own_x, own_y = F.coalesce(F.lag("x_end").over(row), F.col("x_off")), F.coalesce(F.lag("y_end").over(column), F.col("y_off"))
    return offsets.withColumn("own_x", own_x).withColumn("own_y", own_y)


def tiled_pixels(images: DataFrame, offsets: DataFrame, key: str = "plate_id", band: int = 64) -> DataFrame:
    """(key, y, x, r, g, b) of plates that are stored as tile files: images as of read_images, named by tile_name,
    and the table of offsets (tile_name, key, x_off, y_off, x_end, y_end). A task decodes one tile at a time, so a
    plate's size doesn't matter; of tiles that overlap, each pixel comes from the first, without a shuffle of
    pixels."""
    place = F.struct(F.col(key).alias("key"), "x_off", "y_off", "own_x", "own_y")
    placed = own_areas(offsets, key).select(F.col("tile_name").alias("image_id"), F.to_json(place).alias("place"))
    # the place rides on the name, so that what is joined is a row a tile and not a row a pixel
    named = images.join(placed.hint("merge"), "image_id").withColumn("image_id", F.col("place")).drop("place")
    kinds = {c: offsets.schema[c].dataType.simpleString() for c in (key, "x_off", "y_off")}
    at = F.from_json("image_id", f"key {kinds[key]}, x_off {kinds['x_off']}, y_off {kinds['y_off']}, own_x long, own_y long")
    px = to_pixels(named, band).withColumn("at", at)
    y, x = F.col("y") + F.col("at.y_off"), F.col("x") + F.col("at.x_off")
    return px.filter((x >= F.col("at.own_x")) & (y >= F.col("at.own_y"))).select(F.col("at.key").alias(key), y.alias("y"), x.alias("x"), "r", "g", "b")


def to_pixels(images: DataFrame, band: int = 64) -> DataFrame:
    """(image_id, y, x, r, g, b) from BGR, BGRA or gray bytes, in batches of `band` lines. Where a picture is wholly
    transparent it has no pixel."""

    def unpack(batches):
        import numpy as np

        for b in batches:
            for name, w, h, n, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                px = np.frombuffer(data, np.uint8).reshape(h, w, n)
                for top in range(0, h, band):
                    part = px[top : top + band]
                    y, x = np.nonzero(part[:, :, 3]) if n == 4 else (i.ravel() for i in np.indices(part.shape[:2]))
                    colour = [part[y, x, c] for c in ((2, 1, 0) if n >= 3 else (0, 0, 0))]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * y.size, pa.string()), pa.array(y + top, pa.int32()), pa.array(x, pa.int32()), *(pa.array(c, pa.int32()) for c in colour)], ["image_id", "y", "x", "r", "g", "b"])

    return images.select("image_id", "width", "height", "nChannels", "data").mapInArrow(unpack, "image_id string, y int, x int, r int, g int, b int")


def discover_annotations(files: DataFrame, archive: str = r"\.zip$", image: str = r"\.(jpg|JPG)$") -> DataFrame:
    """plate_id, roi_path and image_path of each folder of a path table; of several images .jpg goes before
    .JPG. A side that a folder lacks is null (see missing_sides)."""
    parts = files.select(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("dir"), "path")
    roi = F.when(F.col("path").rlike(archive), F.col("path"))
    picture = F.when(F.col("path").rlike(image), F.struct(F.col("path").rlike(r"\.JPG$").alias("upper"), F.col("path").alias("path")))
    per = parts.groupBy("dir").agg(F.min(roi).alias("roi_path"), F.min(picture).alias("p"))
    return per.select(F.regexp_replace("dir", "^ROI_", "").alias("plate_id"), "roi_path", F.col("p.path").alias("image_path"))


def missing_sides(found: DataFrame) -> DataFrame:
    return found.filter("roi_path IS NULL OR image_path IS NULL").select("plate_id", F.when(F.col("roi_path").isNull(), "annotations").otherwise("image").alias("missing"))


def ingest_rois(spark: SparkSession, paths: list[str], decoder: Callable[[bytes], Iterator[dict]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ROIs, quarantine, errors): archives decoded by a user's function from bytes to dicts with left, top,
    width, height, name and type. A ROI without a side goes to quarantine, a bad archive to errors. Archives are
    decoded once, one at a time, and what is in them is written to the shared folder; one may hold the ROIs of many
    plates, told apart by their names."""
    schema = "path string, name string, left double, top double, width double, height double, type string, error string"

    def decode(batches):
        kinds = [pa.string()] * 2 + [pa.float64()] * 4 + [pa.string()] * 2
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    got = [(path, r.get("name"), *(None if r.get(k) is None else float(r[k]) for k in ("left", "top", "width", "height")), r.get("type"), None) for r in decoder(content.as_py())]
                except Exception as e:  # whatever a user's decoder raises
                    got = [(path, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], k) for i, k in enumerate(kinds)], [f.split()[0] for f in schema.split(", ")])

    rows = cut_lineage(spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(decode, schema))
    ok = " AND ".join(f"{c} IS NOT NULL" for c in ("left", "top", "width", "height"))
    good = rows.filter(f"error IS NULL AND {ok}").select("path", F.col("name").alias("roi_name"), F.col("left").cast("int").alias("x"), F.col("top").cast("int").alias("y"), F.col("width").cast("int").alias("w"), F.col("height").cast("int").alias("h"), F.coalesce("type", F.lit("unknown")).alias("roi_type"))
    return good, rows.filter(f"error IS NULL AND NOT ({ok})").drop("error"), rows.filter("error IS NOT NULL").select("path", "error")


def image_of(path: Column) -> Column:
    """The image of a detection file: its folder image_id=..., as write_detections makes them, or its name."""
    folder = F.regexp_extract(path, "/image_id=([^/]+)/", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_replace(stem(path), "_detections$", ""))


def read_detections(spark: SparkSession, path: str, together: bool = False) -> DataFrame:
    """Detection files of one image each, or, together, of many, with the image in a first column."""
    if together:
        return spark.read.schema(f"image_id string, {DETECTION_CSV}").option("header", True).csv(path)
    rows = spark.read.schema(DETECTION_CSV).option("header", True).option("recursiveFileLookup", True).csv(path)
    return rows.select(image_of(F.col("_metadata.file_path")).alias("image_id"), "*")


def detection_rows(det: DataFrame, *keep: str) -> DataFrame:
    """Columns of a detection file: conf becomes confidence, sides are added, tile_id goes."""
    return det.select(*keep, "x1", "y1", "x2", "y2", (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"), F.col("conf").alias("confidence"), "class")


def _write_images(rows: DataFrame, path: str, key: str, together: bool) -> None:
    """CSV with a folder an image, which takes a file or more for each; or, together, files of many images, whose
    number goes by the tasks that write them. Rows begin with the key."""
    (rows.write if together else rows.write.partitionBy(key)).option("header", True).csv(path)


def write_detections(det: DataFrame, path: str, key: str = "image_id", together: bool = False) -> None:
    _write_images(detection_rows(det, key), path, key, together)


def read_rois(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROI_CSV).option("header", True).csv(path)


def write_rois(rois: DataFrame, path: str) -> None:
    rois.select(*(c.split()[0] for c in ROI_CSV.split(", "))).write.option("header", True).csv(path)


def measurement_rows(rows: DataFrame, unit: str, *keep: str) -> DataFrame:
    """The 22 columns in order; those that rows lack are null."""
    return rows.select(*keep, *(F.col(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in measurement_columns(unit)))


def write_measurements(rows: DataFrame, path: str, unit: str, key: str = "image_id", together: bool = False) -> None:
    _write_images(measurement_rows(rows, unit, key), path, key, together)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALIBRATION_JSON).json(path)


def write_calibration(rows: DataFrame, path: str) -> None:
    rows.select(*(c.split()[0] for c in CALIBRATION_JSON.split(", "))).write.json(path)


def write_summary(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def write_split(rows: DataFrame, path: str) -> None:
    """One folder of CSV per split."""
    rows.write.partitionBy("split").option("header", True).csv(path)


def run_metadata(plates: DataFrame, counts: DataFrame, tile_size: int, overlap: int, conf: float, iou: float, key: str = "plate_id") -> DataFrame:
    """(key, json): one document per plate."""
    doc = F.struct(F.col(key).cast("string").alias("image"), F.array("width", "height").alias("image_size"), F.lit(tile_size).alias("tile_size"), F.lit(overlap).alias("overlap"), F.lit(conf).alias("conf_threshold"), F.lit(iou).alias("iou_threshold"), "num_tiles", F.col("before").alias("detections_before_nms"), F.col("after").alias("detections_after_nms"))
    return plates.join(counts.hint("merge"), key).select(key, F.to_json(doc).alias("json"))


def batch_config(plates: DataFrame, model: str, um_per_pixel: float, device: str, image: str = "image_name") -> DataFrame:
    """One row, json: the images of a batch (a list as long as the batch) and its settings."""
    return plates.agg(F.array_sort(F.collect_list(image)).alias("images"), F.count(F.lit(1)).alias("num_plates")).select(F.to_json(F.struct("images", F.lit(model).alias("model"), F.lit(um_per_pixel).alias("um_per_pixel"), F.lit(device).alias("device"), "num_plates")).alias("json"))


def yolo_labels(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, body): a line '0 cx cy w h' per label of a tile; tiles without labels have no row."""
    line = F.format_string("0 %.6f %.6f %.6f %.6f", "bx", "by", "bw", "bh")
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))


def write_yolo_labels(rows: DataFrame, path: str) -> None:
    yolo_labels(rows, "split", "tile_name").write.partitionBy("split", "tile_name").option("lineSep", "\n").text(path)


def tile_metadata(rows: DataFrame, size: int, key: str = "plate_id") -> DataFrame:
    """(plate, json): a map from tile name to its offsets, split and number of labels."""
    tiles = rows.groupBy(key, "tile_name", "tile_id", "x_off", "y_off", "split").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct("tile_name", F.struct(F.col(key).cast("string").alias("plate_id"), "tile_id", F.col("x_off").alias("offset_x"), F.col("y_off").alias("offset_y"), F.lit(size).alias("tile_size"), "split", F.col("n").alias("num_annotations")))
    return tiles.groupBy(key).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("json"))


def data_yaml(root: str, names: list[str], size: int, overlap: int) -> str:
    return f"path: {root}\ntrain: images/train\nval: images/val\ntest: images/test\nnc: {len(names)}\nnames: {names}\ntile_size: {size}\noverlap: {overlap}\n"


def coco_annotations(det: DataFrame, image: str = "plate_id", category: int = 1) -> DataFrame:
    """id, image_id, category_id, bbox, area and score of each detection."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return det.select(F.concat_ws("-", image, "det_seq").alias("id"), F.col(image).alias("image_id"), F.lit(category).alias("category_id"), F.array("x1", "y1", w, h).alias("bbox"), (w * h).alias("area"), F.col("conf").alias("score"))


def coco_export(det: DataFrame, plates: DataFrame, image: str = "plate_id") -> DataFrame:
    """(image_id, json): images, annotations and categories of each image."""
    notes = coco_annotations(det, image).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", "image_id", "category_id", "bbox", "area", "score"))).alias("annotations"))
    doc = F.struct(F.array(F.struct(F.col(image).alias("id"), "width", "height")).alias("images"), F.coalesce("annotations", F.array().cast(notes.schema["annotations"].dataType)).alias("annotations"), F.array(F.struct(F.lit(1).alias("id"), F.lit("organism").alias("name"))).alias("categories"))
    return plates.join(notes, plates[image] == notes["image_id"], "left").select(F.col(image).alias("image_id"), F.to_json(doc).alias("json"))
