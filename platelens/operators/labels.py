"""Label tables and joins by plate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of label columns, in order of preference.
LABEL_NAMES = ("collembola", "label", "is_collembola")


def resolve_path(df: DataFrame, directory: str = "") -> Column:
    """The image path of a label table: the first column whose name contains 'path' or 'file' or is crop_id
    or img_path; else `crop` or `id` inside the directory."""
    for c in df.columns:
        n = c.lower()
        if "path" in n or "file" in n or n in ("crop_id", "img_path"):
            return F.col(c)
    join = lambda name: F.concat_ws("/", F.lit(directory), name)
    if "crop" in df.columns:
        return join(F.col("crop"))
    if "id" in df.columns:
        return join(F.concat(F.col("id").cast("string"), F.lit(".png")))
    raise ValueError(f"no column names an image: {df.columns}")


def resolve_label(df: DataFrame) -> Column:
    for c in df.columns:
        if c.lower() in LABEL_NAMES:
            return F.col(c).cast("int")
    raise ValueError(f"no label column: {df.columns}")


def unify_labels(positives: DataFrame, ground_truth: DataFrame, negatives: DataFrame, id_column: str, directory: str = "gt") -> DataFrame:
    """(path, label) of the positive crops, the ground truth (label 1) and the negatives; equal rows once."""
    labelled = lambda df: df.select(resolve_path(df).alias("path"), resolve_label(df).alias("label"))
    truth = ground_truth.select(F.concat(F.lit(f"{directory}/"), F.col(id_column).cast("string"), F.lit(".png")).alias("path"), F.lit(1).alias("label"))
    return labelled(positives).filter("label = 1").unionByName(truth).unionByName(labelled(negatives).filter("label = 0")).dropDuplicates()


def assign_split(plates: DataFrame, splits: DataFrame, key: str = "plate_id", default: str = "test", broadcast_rows: int = 100_000) -> DataFrame:
    """Adds split from (key, split). The split table is broadcast while it has at most broadcast_rows rows."""
    small = splits.limit(broadcast_rows + 1).count() <= broadcast_rows
    side = F.broadcast(splits) if small else splits
    return plates.join(side, key, "left").withColumn("split", F.coalesce("split", F.lit(default)))


def test_plates(plates: DataFrame, train: DataFrame, val: DataFrame, key: str = "plate_id") -> DataFrame:
    return plates.select(key).distinct().join(train.select(key).unionByName(val.select(key)), key, "left_anti")


test_plates.__test__ = False  # not a test case


def join_measurements(det: DataFrame, meas: DataFrame, keys: tuple[str, ...] = ("plate_id", "detection_id")) -> DataFrame:
    """Equal names beyond the keys get the suffixes _det and _meas."""
    clash = [c for c in det.columns if c in meas.columns and c not in keys]
    return det.withColumnsRenamed({c: f"{c}_det" for c in clash}).join(meas.withColumnsRenamed({c: f"{c}_meas" for c in clash}), list(keys))


def with_calibration(det: DataFrame, calibration: DataFrame, key: str = "plate_id", default: float = 8.666) -> DataFrame:
    return det.join(calibration.select(key, "um_per_pixel"), key, "left").withColumn("um_per_pixel", F.coalesce("um_per_pixel", F.lit(default)))


def missing_images(wanted: DataFrame, images: DataFrame, key: str = "plate_id") -> DataFrame:
    return wanted.join(images, key, "left_anti")


def present_images(wanted: DataFrame, images: DataFrame, key: str = "plate_id") -> DataFrame:
    return wanted.join(images, key, "left_semi")
