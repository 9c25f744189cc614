"""Detections against ground truth: matching, precision and recall, average precision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geometry import iou
from .components import cut_lineage, exact_ranks
from .spatial import fixed_pairs


def overlapping(det: DataFrame, gt: DataFrame, t: float, key: str, cell: int) -> DataFrame:
    """(key, det_seq, conf, gt_id, iou) of detections and ground truth with IoU of at least t."""
    boxes = det.select(key, "det_seq", "conf", "x1", "y1", "x2", "y2")
    pairs = fixed_pairs(boxes, gt.select(key, "gt_id", "x1", "y1", "x2", "y2"), key, cell).withColumn("iou", iou()).filter(F.col("iou") >= t)
    return pairs.select(key, "det_seq", "conf", F.col("r_gt_id").alias("gt_id"), "iou")


def match_ground_truth(det: DataFrame, gt: DataFrame, t: float = 0.5, key: str = "plate_id", cell: int = 64, max_rounds: int = 1000) -> DataFrame:
    """(key, det_seq, gt_id): each detection, strongest first, takes its best free ground truth of IoU at
    least t. The sequential rule is run as rounds: a pair whose detection is the strongest that its ground truth has
    left, and whose ground truth is the best that its detection has left, stands, and the other pairs of both go; the
    strongest detection left always has such a pair, so the end is the sequential result."""
    return _matched(overlapping(det, gt, t, key, cell), [key], max_rounds).select(key, "det_seq", "gt_id", "iou", "conf")


def match_at_thresholds(det: DataFrame, gt: DataFrame, thresholds: list[float], key: str = "plate_id", cell: int = 64, max_rounds: int = 1000) -> DataFrame:
    """As match_ground_truth, with a column `threshold`: the matches at each of the thresholds, from one table of
    pairs and one run of rounds."""
    lonely, contested = _matched_at(det, gt, thresholds, key, cell, max_rounds)
    columns = ["threshold", key, "det_seq", "gt_id", "iou"]
    return lonely.withColumn("threshold", _reached(thresholds)).select(*columns).unionByName(contested.select(*columns))


def _reached(thresholds: list[float]):
    return F.explode(F.filter(F.array(*(F.lit(float(t)) for t in sorted(thresholds))), lambda t: t <= F.col("iou")))


def _matched_at(det: DataFrame, gt: DataFrame, thresholds: list[float], key: str, cell: int, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """(pairs that are matched at each threshold that their IoU reaches, a row a pair; matches by threshold of the
    others). A pair that shares neither side with another one at the least threshold does so at none."""
    seen = _seen(overlapping(det, gt, min(thresholds), key, cell), [key])
    others = seen.filter(f"NOT ({_LONELY})").drop("__d", "__nd", "__g", "__ng").withColumn("threshold", _reached(thresholds))
    return seen.filter(_LONELY), _matched(others, ["threshold", key], max_rounds)


_LONELY = "__nd = 1 AND __ng = 1"


def _seen(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs and, written out, their place among those of their detection and of their ground truth, and how many
    these have."""
    det, gt = W.partitionBy(*keys, "det_seq"), W.partitionBy(*keys, "gt_id")
    tasted = pairs.withColumn("__d", F.row_number().over(det.orderBy(F.desc("iou"), "gt_id"))).withColumn("__nd", F.count(F.lit(1)).over(det))
    return cut_lineage(tasted.withColumn("__g", F.row_number().over(gt.orderBy(F.desc("conf"), F.desc("det_seq")))).withColumn("__ng", F.count(F.lit(1)).over(gt)))


def _matched(pairs: DataFrame, keys: list[str], max_rounds: int) -> DataFrame:
    """The rounds, in which pairs of different keys don't meet. Pairs that share no side with another are matched
    before them, and each round's pairs are ranked among those that are left."""
    columns = [*keys, "det_seq", "gt_id", "conf", "iou"]
    seen = _seen(pairs.select(*columns), keys)
    done, left = [seen.filter(_LONELY).select(*columns)], seen.filter(f"NOT ({_LONELY})")
    for _ in range(max_rounds):
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        found = cut_lineage(left.filter("__d = 1 AND __g = 1").select(*columns))
        done.append(found)
        left = left.select(*columns).join(found.select(*keys, "det_seq").hint("merge"), [*keys, "det_seq"], "left_anti")
        left = _seen(left.join(found.select(*keys, "gt_id").hint("merge"), [*keys, "gt_id"], "left_anti"), keys)
    raise RuntimeError(f"matching did not settle in {max_rounds} rounds")


def match_flags(det: DataFrame, gt: DataFrame, matches: DataFrame, key: str = "plate_id") -> tuple[DataFrame, DataFrame]:
    """(detections with tp, ground truth with found)."""
    d = det.join(matches.select(key, "det_seq", F.lit(True).alias("tp")), [key, "det_seq"], "left").withColumn("tp", F.coalesce("tp", F.lit(False)))
    g = gt.join(matches.select(key, "gt_id", F.lit(True).alias("found")), [key, "gt_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return d, g


def _rates(df: DataFrame) -> DataFrame:
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def precision_recall_f1(det: DataFrame, gt: DataFrame, matches: DataFrame, key: str = "plate_id") -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of each image, and of all (key null)."""
    # a match takes one detection and one ground truth, so counts tell what is left of both
    count = lambda df, **n: df.select(key, *(F.lit(n.get(c, 0)).alias(c) for c in ("tp", "fp", "fn")))
    rows = count(det, fp=1).unionByName(count(gt, fn=1)).unionByName(count(matches, tp=1, fp=-1, fn=-1))
    return _rates(rows.rollup(key).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def threshold_sweep(det: DataFrame, gt: DataFrame, matches: DataFrame, thresholds: list[float], key: str = "plate_id") -> DataFrame:
    """The figures at each confidence threshold; matches are those of all detections."""
    if "conf" not in matches.columns:
        matches = matches.join(det.select(key, "det_seq", "conf").hint("merge"), [key, "det_seq"])
    above = lambda df, name: df.agg(*(F.count_if(F.col("conf") >= t).alias(f"{name}{i}") for i, t in enumerate(thresholds)))
    one = above(det, "n").crossJoin(above(matches, "tp")).crossJoin(gt.agg(F.count(F.lit(1)).alias("n_gt")))  # one row each
    figures = (F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), (F.col(f"n{i}") - F.col(f"tp{i}")).alias("fp"), (F.col("n_gt") - F.col(f"tp{i}")).alias("fn")) for i, t in enumerate(thresholds))
    return _rates(one.select(F.explode(F.array(*figures)).alias("s")).select("s.*"))


def average_precision(det: DataFrame, gt: DataFrame, matches: DataFrame, key: str = "plate_id") -> DataFrame:
    """Area under the precision envelope (one row: ap)."""
    at = _precision_areas(det, matches.select(key, "det_seq", F.lit(1).cast("long").alias("at")), [0.0], key)
    return _per_truth(at, gt).select("ap")


def mean_average_precision(det: DataFrame, gt: DataFrame, thresholds: list[float] | None = None, key: str = "plate_id") -> DataFrame:
    """ap50 and the mean over IoU 0.50, 0.55, ..., 0.95, or over the thresholds given."""
    per = average_precisions(det, gt, thresholds or [round(0.5 + 0.05 * i, 2) for i in range(10)], key)
    return per.agg(F.max(F.when(F.col("threshold") == 0.5, F.col("ap"))).alias("ap50"), F.avg("ap").alias("ap50_95"))


def average_precisions(det: DataFrame, gt: DataFrame, thresholds: list[float], key: str = "plate_id") -> DataFrame:
    """(threshold, ap): the average precision at each IoU threshold."""
    order = sorted(set(map(float, thresholds)))
    if len(order) > 60:  # a bit of a number each
        half = len(order) // 2
        return average_precisions(det, gt, order[:half], key).unionByName(average_precisions(det, gt, order[half:], key))
    lonely, contested = _matched_at(det, gt, order, key, 64, 1000)
    bits = lambda c, test: sum((F.when(test(c, F.lit(t)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, t in enumerate(order)), F.lit(0).cast("long"))
    some = contested.groupBy(key, "det_seq").agg(F.sum(bits(F.col("threshold"), lambda c, t: c == t)).alias("at"))
    masks = lonely.select(key, "det_seq", bits(F.col("iou"), lambda c, t: c >= t).alias("at")).unionByName(some)
    return _per_truth(_precision_areas(det, masks, order, key), gt)


def _per_truth(areas: DataFrame, gt: DataFrame) -> DataFrame:
    total = gt.agg(F.count(F.lit(1)).alias("n_gt"))  # one row, and one a threshold
    return areas.crossJoin(F.broadcast(total)).select("threshold", F.when(F.col("n_gt") > 0, F.col("area") / F.col("n_gt")).otherwise(0.0).alias("ap"))


def _precision_areas(det: DataFrame, hits: DataFrame, thresholds: list[float], key: str) -> DataFrame:
    """(threshold, area): the sum of the best precision at or behind each hit, over detections by falling
    confidence. hits: (key, det_seq, at), a bit of `at` for each threshold. Detections are ranked once; hits are a row
    for all thresholds and counted within the ranges of ranks, and what the ranges before and behind one add is a row
    a range."""
    number = range(len(thresholds))
    tagged = det.select(key, "det_seq", "conf").join(hits.hint("merge"), [key, "det_seq"], "left")
    ranked, _ = exact_ranks(tagged, F.desc("conf"), F.asc(key), F.asc("det_seq"))
    hits = cut_lineage(ranked.filter("at > 0").select("part", "rank", "at"))
    hit = [F.col("at").bitwiseAND(1 << i) != 0 for i in number]
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = hits.groupBy("part").agg(*(F.count_if(h).alias(f"n{i}") for i, h in enumerate(hit)))
    counts = cut_lineage(counts.select("part", *(F.coalesce(F.sum(f"n{i}").over(before), F.lit(0)).alias(f"before{i}") for i in number)))
    upto = W.partitionBy("part").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    points = hits.join(F.broadcast(counts), "part")
    points = points.select("part", "rank", "at", *(F.when(h, (F.col(f"before{i}") + F.count_if(h).over(upto)) / F.col("rank")).alias(f"p{i}") for i, h in enumerate(hit)))
    behind = W.partitionBy(F.lit(0)).orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    best = points.groupBy("part").agg(*(F.max(f"p{i}").alias(f"top{i}") for i in number))
    best = cut_lineage(best.select("part", *(F.coalesce(F.max(f"top{i}").over(behind), F.lit(0.0)).alias(f"later{i}") for i in number)))
    # backwards, since a frame up to the end is gone through again for each row
    rest = W.partitionBy("part").orderBy(F.desc("rank")).rowsBetween(W.unboundedPreceding, 0)
    inside = points.select("part", "at", *(F.max(f"p{i}").over(rest).alias(f"inside{i}") for i in number)).join(F.broadcast(best), "part")
    areas = inside.agg(*(F.coalesce(F.sum(F.when(h, F.greatest(f"inside{i}", f"later{i}"))), F.lit(0.0)).alias(f"area{i}") for i, h in enumerate(hit)))
    return areas.select(F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"area{i}").alias("area")) for i, t in enumerate(thresholds)))).alias("a")).select("a.*")
