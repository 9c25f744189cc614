"""Suppression of overlapping boxes, in rounds over the graph of overlapping pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geometry import iou
from .components import cut_lineage
from .spatial import box_pairs, fixed_pairs


def non_maximum_suppression(
    boxes: DataFrame, t: float = 0.5, later_wins: bool = True, zero_union: str = "suppress", key: str = "plate_id", seq: str = "det_seq", conf: str = "conf", cell: int = 64, mixed_sizes: bool = False, max_rounds: int = 1000
) -> DataFrame:
    """The boxes that greedy suppression keeps: strongest first, each removes weaker ones of its image with
    IoU above t. On equal confidence the later box wins (or the earlier). zero_union='suppress': of boxes
    without area only an image's strongest stays, wherever they lie; 'keep': they touch nothing.

    Rounds settle all boxes at once: an undecided box with no undecided stronger neighbour stays, and its
    neighbours go. The result is that of the sequential loop, and rounds are as many as the longest chain
    of ever weaker overlapping boxes. Boxes without overlap never enter them.
    """
    b = boxes.select(key, seq, conf, "x1", "y1", "x2", "y2")
    pairs = (box_pairs if mixed_sizes else fixed_pairs)(b, b, key, cell).filter(F.col(seq) < F.col(f"r_{seq}")).filter(iou() > t)
    tie = F.col(f"r_{seq}") > F.col(seq) if later_wins else F.lit(False)
    right_wins = (F.col(f"r_{conf}") > F.col(conf)) | ((F.col(f"r_{conf}") == F.col(conf)) & tie)
    edges = cut_lineage(pairs.select(key, F.when(right_wins, F.col(f"r_{seq}")).otherwise(F.col(seq)).alias("strong"), F.when(right_wins, F.col(seq)).otherwise(F.col(f"r_{seq}")).alias("weak")))
    gone, open_edges = [], edges
    for _ in range(max_rounds):
        weak = open_edges.select(key, F.col("weak").alias("node")).distinct()
        stay = open_edges.select(key, F.col("strong").alias("node")).distinct().join(weak.hint("merge"), [key, "node"], "left_anti")
        beaten = open_edges.join(stay.withColumnRenamed("node", "strong").hint("merge"), [key, "strong"], "left_semi").select(key, F.col("weak").alias("node")).distinct()
        beaten = cut_lineage(beaten)
        gone.append(beaten)
        left = open_edges.join(beaten.withColumnRenamed("node", "weak").hint("merge"), [key, "weak"], "left_anti")
        open_edges = cut_lineage(left.join(beaten.withColumnRenamed("node", "strong").hint("merge"), [key, "strong"], "left_anti"))
        if open_edges.isEmpty():
            break
    else:
        raise RuntimeError(f"suppression did not settle in {max_rounds} rounds")
    kept = boxes.join(reduce(DataFrame.unionByName, gone).withColumnRenamed("node", seq).hint("merge"), [key, seq], "left_anti")
    if zero_union == "suppress":
        flat = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
        order = [F.desc(conf), F.desc(seq) if later_wins else F.asc(seq)]
        first = kept.filter(flat).withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")
        kept = kept.filter(~flat).unionByName(first)
    elif zero_union != "keep":
        raise ValueError(f"no such rule: {zero_union}")
    return kept


def nms_global(boxes: DataFrame, t: float = 0.5, **options) -> DataFrame:
    return non_maximum_suppression(boxes, t, later_wins=True, zero_union="suppress", **options)


def nms_proposals(boxes: DataFrame, t: float = 0.3, **options) -> DataFrame:
    return non_maximum_suppression(boxes, t, later_wins=False, zero_union="keep", **options)


def dedup_keep_larger(boxes: DataFrame, t: float = 0.7, key: str = "plate_id", seq: str = "det_seq", cell: int = 64, max_rounds: int = 1000) -> DataFrame:
    """In order of arrival, a box replaces the box of the first slot that it overlaps with IoU of at least t if it is
    larger, and is dropped otherwise; without such a slot it gets a slot of its own.

    Rounds settle many boxes at once. A row (early, late) is an overlapping pair whose late box is open; `slot` is
    that of the early box once it holds one. Pairs of boxes that are dropped or replaced go. A box settles when each
    early box that it still has a pair with holds a slot, and no open box that overlaps this one comes before it: what
    then holds the slots it meets is what the sequential rule sees. A box without a pair left gets its own slot. So
    rounds are as many as the longest chain of decisions that hang on one another, and no group of boxes, however
    large, meets in one task. Boxes without overlap never enter.
    """
    b = boxes.select(key, seq, "x1", "y1", "x2", "y2")
    area = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))
    pairs = fixed_pairs(b, b, key, cell).filter(F.col(seq) < F.col(f"r_{seq}")).filter(iou() >= t)
    open_pairs = cut_lineage(pairs.select(key, F.col(seq).alias("early"), F.col(f"r_{seq}").alias("late"), (area("r_") > area("")).alias("larger")))
    starts = open_pairs.select(key, F.col("early").alias("node")).distinct().join(open_pairs.select(key, F.col("late").alias("node")).distinct().hint("merge"), [key, "node"], "left_anti")
    slots = cut_lineage(starts.withColumn("slot", F.col("node")))
    open_pairs = cut_lineage(_with_slots(open_pairs.withColumn("slot", F.lit(None).cast(slots.schema["slot"].dataType)), slots, key))
    lost: list[DataFrame] = []
    for _ in range(max_rounds):
        if open_pairs.isEmpty():
            break
        turn = F.min("late").over(W.partitionBy(key, "early"))
        free = open_pairs.withColumn("may", F.col("slot").isNotNull() & (F.col("late") == turn))
        ready = free.groupBy(key, "late").agg(F.bool_and("may").alias("ready"), F.min(F.struct("slot", "early", "larger")).alias("met")).filter("ready")
        settled = cut_lineage(ready.select(key, F.col("late").alias("node"), "met.slot", "met.early", "met.larger"))
        # the larger box takes the slot and its holder is lost, else the box itself is
        gone = cut_lineage(settled.select(key, F.when(F.col("larger"), F.col("early")).otherwise(F.col("node")).alias("node")))
        lost.append(gone)
        left = open_pairs.join(settled.select(key, F.col("node").alias("late")).hint("merge"), [key, "late"], "left_anti")
        left = cut_lineage(left.join(gone.withColumnRenamed("node", "early").hint("merge"), [key, "early"], "left_anti"))
        waiting = open_pairs.select(key, F.col("late").alias("node")).distinct().join(settled.select(key, "node").hint("merge"), [key, "node"], "left_anti")
        alone = waiting.join(left.select(key, F.col("late").alias("node")).distinct().hint("merge"), [key, "node"], "left_anti")
        slots = settled.filter("larger").select(key, "node", "slot").unionByName(alone.withColumn("slot", F.col("node")))
        open_pairs = cut_lineage(_with_slots(left, slots, key))
    else:
        raise RuntimeError(f"dedup did not settle in {max_rounds} rounds")
    if not lost:
        return boxes
    return boxes.join(reduce(DataFrame.unionByName, lost).withColumnRenamed("node", seq).hint("merge"), [key, seq], "left_anti")


def _with_slots(pairs: DataFrame, slots: DataFrame, key: str) -> DataFrame:
    """Pairs whose early box has got a slot."""
    given = slots.select(key, F.col("node").alias("early"), F.col("slot").alias("given"))
    return pairs.join(given.hint("merge"), [key, "early"], "left").select(key, "early", "late", "larger", F.coalesce("slot", "given").alias("slot"))
