"""Counts, measurement summaries, ids, samples and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import cut_lineage, exact_ranks


def roi_counts(rois: DataFrame, by: str = "plate_id") -> DataFrame:
    return rois.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)


def roi_totals(rois: DataFrame) -> DataFrame:
    return rois.agg(F.count(F.lit(1)).alias("rois"), F.count_distinct("plate_id").alias("plates"))


def dataset_stats(labels: DataFrame, splits: list[str]) -> DataFrame:
    """Non-empty tiles and annotations of each split, with zeros for splits without any."""
    per = labels.groupBy("split").agg(F.count_distinct("plate_id", "tile_id").alias("tiles"), F.count(F.lit(1)).alias("annotations"))
    wanted = labels.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    return wanted.join(per.hint("merge"), "split", "left").select("split", F.coalesce("tiles", F.lit(0)).alias("tiles"), F.coalesce("annotations", F.lit(0)).alias("annotations"))


def measurement_summary(rows: DataFrame, unit: str = "um", key: str | None = "plate_id", overall: bool = False) -> DataFrame:
    """Counts, means, exact medians and sums of length, width, area and volume per image, or over all (key None; with
    `overall`, a row more). An image's medians are taken of its organisms in one task; those over all come from
    ranks, for which no task has more than a range of them."""
    l, w, a, v = names = f"length_{unit}", f"width_{unit}", f"area_{unit}2", f"volume_{unit}3"
    short = ("length", "width", "area", "volume")

    def sums(df, median) -> DataFrame:
        found = df.agg(
            F.count(F.lit(1)).alias("organisms"),
            *(F.avg(c).alias(f"mean_{n}") for n, c in zip(short, names)), F.min(l).alias("min_length"), F.max(l).alias("max_length"), F.sum(v).alias("total_volume"),
            *(F.percentile(c, 0.5).alias(f"median_{n}") for n, c in zip(short, names) if median),
        )
        return found

    columns = ["organisms", "mean_length", "median_length", "min_length", "max_length", "mean_width", "median_width", "mean_area", "median_area", "mean_volume", "median_volume", "total_volume"]
    per = None
    if key is not None:
        per = sums(rows.groupBy(key), True).select(key, *columns)
        if not overall:
            return per
    rows = cut_lineage(rows.select(l, w, a, v))
    every = sums(rows, False)
    for name, column in zip(short, names):
        every = every.crossJoin(F.broadcast(exact_median(rows, column).withColumnRenamed("median", f"median_{name}")))  # a row each
    if per is None:
        return every.select(*columns)
    return per.unionByName(every.select(F.lit(None).cast(per.schema[key].dataType).alias(key), *columns))


def exact_median(rows: DataFrame, column: str) -> DataFrame:
    """One row: the median of the column's values that aren't null, the mean of the middle two of an even number."""
    values = rows.select(F.col(column).cast("double").alias("value")).filter("value IS NOT NULL")
    # equal values are one row, so that a value that fills the table is no large range
    counted = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    ranked, parts = exact_ranks(counted, F.asc("value"))
    ranked = cut_lineage(ranked)
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranked.groupBy("part").agg(F.sum("n").alias("of"))  # a row a part
    sizes = sizes.select("part", F.coalesce(F.sum("of").over(before), F.lit(0)).alias("before"), F.sum("of").over(W.partitionBy(F.lit(0))).alias("all"))
    placed = ranked.join(F.broadcast(sizes), "part").withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy("part").orderBy("rank")))
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
    has = lambda k: (F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)
    return placed.agg(((F.max(F.when(has(low), F.col("value"))) + F.max(F.when(has(high), F.col("value")))) / 2).alias("median"))


def batch_summary(catalog: DataFrame, rows: DataFrame, key: str = "plate_id") -> DataFrame:
    """A row for every image of the catalog; zeros and status 'empty' where nothing was measured."""
    per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("organisms"), F.avg("length_um").alias("avg_length_um"), F.avg("width_um").alias("avg_width_um"), F.avg("volume_um3").alias("avg_volume_um3"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = catalog.select(key).join(per, key, "left")
    return joined.select(key, zero("organisms"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg_length_um", "avg_width_um", "avg_volume_um3")), F.when(F.col("organisms").isNull(), "empty").otherwise("ok").alias("status"))


def nms_counts(before: DataFrame, after: DataFrame, tiles: DataFrame, key: str = "plate_id") -> DataFrame:
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    joined = count(tiles, "num_tiles").join(count(before, "before").hint("merge"), key, "left").join(count(after, "after").hint("merge"), key, "left")
    return joined.select(key, "num_tiles", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def brightness_stats(pixels: DataFrame, key: str = "plate_id") -> DataFrame:
    """Median, mean, population deviation and range over all channels, and each channel's mean."""
    long = pixels.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in "rgb"))).alias("p")).select(key, "p.*")
    return long.groupBy(key).agg(
        F.percentile("v", 0.5).alias("median"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        *(F.avg(F.when(F.col("c") == c, F.col("v"))).alias(f"mean_{c}") for c in "rgb"),
    )


def number_rows(df: DataFrame, name: str, key: str, *order: Column) -> DataFrame:
    """Adds a number from 0 on per image."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1)


def assign_detection_id(det: DataFrame, key: str = "plate_id", seq: str = "det_seq") -> DataFrame:
    return number_rows(det, "detection_id", key, F.desc("conf"), F.desc(seq))


def assign_organism_id(proposals: DataFrame, accepted: Column, mode: str = "accepted", key: str = "plate_id", seq: str = "det_seq") -> DataFrame:
    """Accepted rows with their number among all proposals ('proposal', with gaps) or among the accepted."""
    if mode == "proposal":
        return number_rows(proposals, "organism_id", key, F.asc(seq)).filter(accepted)
    if mode == "accepted":
        return number_rows(proposals.filter(accepted), "organism_id", key, F.asc(seq))
    raise ValueError(f"no such mode: {mode}")


def first_per_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """The smallest value of each group; map-side minima, no window."""
    return df.groupBy(group).agg(F.min(value).alias(value))


def top_per_group(df: DataFrame, k: int, key: str = "plate_id", seq: str = "det_seq", conf: str = "conf") -> DataFrame:
    return number_rows(df, "rank", key, F.desc(conf), F.asc(seq)).filter(F.col("rank") < k)


def recent(df: DataFrame, k: int, time: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(time), *ties).limit(k)


def stratified_sample(df: DataFrame, n: int, stratum: str, *identity: str, seed: str = "42") -> DataFrame:
    """Up to n rows of each stratum, by hash order of their identity."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in identity)))
    return df.withColumn("__d", digest).withColumn("__n", F.row_number().over(W.partitionBy(stratum).orderBy("__d", *identity))).filter(F.col("__n") <= n).drop("__d", "__n")


def shuffle_split(df: DataFrame, *identity: str, val_frac: float = 0.2, seed: str = "42") -> DataFrame:
    """Adds split: the first int(n * val_frac) rows in hash order are 'val', the others 'train'. The rank is exact,
    and no window spans all rows."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in identity)))
    ranked, parts = exact_ranks(df.withColumn("__d", digest), F.asc("__d"), *(F.asc(c) for c in identity), name="__rank")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("__all"))  # one row
    split = F.when(F.col("__rank") <= F.floor(F.col("__all") * val_frac), "val").otherwise("train")
    return ranked.crossJoin(F.broadcast(total)).withColumn("split", split).select(*df.columns, "split")


def ruler_from_ticks(ticks: DataFrame, tick_um: float = 5000, max_variation: float = 0.15, default: float = 8.666, key: str = "image_id") -> DataFrame:
    """um_per_pixel from the mean gap of a ruler's ticks where gaps vary by less than max_variation, else the
    default."""
    gap = F.col("pos") - F.lag("pos").over(W.partitionBy(key).orderBy("pos"))
    stats = ticks.withColumn("gap", gap).groupBy(key).agg(F.count("gap").alias("gaps"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("sd"))
    good = (F.col("gaps") > 0) & (F.col("sd") / F.col("mean_gap") < max_variation)
    return stats.select(key, "gaps", "mean_gap", (F.col("sd") / F.col("mean_gap")).alias("variation"), F.coalesce(good, F.lit(False)).alias("valid"), F.when(good, tick_um / F.col("mean_gap")).otherwise(default).alias("um_per_pixel"))
