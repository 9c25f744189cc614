"""Matching by mutual choice against the sequential rule, and how widely boxes are spread."""

import random

from pyspark.sql import functions as F

from platelens.operators import evaluate, spatial


def test_matches_at_thresholds_are_those_of_the_sequential_rule(spark):
    rng = random.Random(3)
    boxes = lambda n: [(float(x := rng.randint(0, 60)), float(y := rng.randint(0, 60)), x + float(rng.randint(20, 30)), y + float(rng.randint(20, 30))) for _ in range(n)]
    det, gt, conf = boxes(80), boxes(60), [rng.randint(0, 9) / 10 for _ in range(80)]
    d = spark.createDataFrame([(1, i, conf[i], *b) for i, b in enumerate(det)], "plate_id long, det_seq long, conf double, x1 double, y1 double, x2 double, y2 double")
    g = spark.createDataFrame([(1, i, *b) for i, b in enumerate(gt)], "plate_id long, gt_id long, x1 double, y1 double, x2 double, y2 double")

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        common = max(0, w) * max(0, h)
        return common / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common)

    def sequential(t):
        free, out = set(range(len(gt))), set()
        for i in sorted(range(len(det)), key=lambda i: (-conf[i], -i)):
            able = [(-iou(det[i], gt[j]), j) for j in free if iou(det[i], gt[j]) >= t]
            if able:
                out.add((i, min(able)[1]))
                free.discard(min(able)[1])
        return out

    at = [0.3, 0.5, 0.7]
    found = evaluate.match_at_thresholds(d, g, at).collect()
    for t in at:
        assert {(r.det_seq, r.gt_id) for r in found if r.threshold == t} == sequential(t)
    per = {r.threshold: r.ap for r in evaluate.average_precisions(d, g, at).collect()}
    for t in at:
        hit = {i for i, _ in sequential(t)}
        order = sorted(range(len(det)), key=lambda i: (-conf[i], i))
        points = [(sum(o in hit for o in order[: n + 1]) / (n + 1), o in hit) for n, o in enumerate(order)]
        area = sum(max(p for p, _ in points[n:]) for n, (_, h) in enumerate(points) if h)
        assert abs(per[t] - area / len(gt)) < 1e-9


def test_boxes_touch_at_most_four_cells_of_their_class(spark):
    """They touched up to 25, and 16 of those of the query."""
    box = spark.range(1, 400).select((F.col("id") * 7 % 101).cast("double").alias("x1"), (F.col("id") * 3 % 103).cast("double").alias("y1"), F.col("id").cast("double").alias("side"))
    size = F.lit(4) * F.pow(F.lit(2.0), spatial._size_class("x1", "y1", "x2", "y2", 4))
    box = box.withColumn("x2", F.col("x1") + F.col("side")).withColumn("y2", F.col("y1") + F.col("side"))
    cells = lambda lo, hi: F.floor(F.col(hi) / size) - F.floor(F.col(lo) / size) + 1
    assert box.agg(F.max(cells("x1", "x2") * cells("y1", "y2"))).first()[0] <= 4
