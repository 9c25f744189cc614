"""Dedup by rounds, components by contraction, exact ranks and matches at many thresholds, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from platelens.operators import evaluate, summaries, suppress
from platelens.operators.components import connected_components, exact_ranks


def overlap(a, b):
    common = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
    return common / union if union > 0 else 0.0


def keep_larger(boxes, t):
    slots = []
    for i, box in enumerate(boxes):
        area = (box[2] - box[0]) * (box[3] - box[1])
        for k, (_, other) in enumerate(slots):
            if overlap(box, other) >= t:
                if area > (other[2] - other[0]) * (other[3] - other[1]):
                    slots[k] = (i, box)
                break
        else:
            slots.append((i, box))
    return {i for i, _ in slots}


@pytest.mark.parametrize("t", [0.2, 0.5])
def test_dedup_equals_the_sequential_rule_in_dense_plates(spark, t):
    rng, rows, want = random.Random(int(t * 10)), [], set()
    for plate, spread in ((1, 25), (2, 60), (3, 400)):
        boxes = []
        for _ in range(45):
            x, y, w, h = rng.randrange(spread), rng.randrange(spread), rng.randrange(10, 40), rng.randrange(10, 40)
            boxes.append((float(x), float(y), float(x + w), float(y + h)))
        boxes += boxes[:4] + [(5.0, 5.0, 5.0, 9.0)] * 2  # copies and boxes without area
        rows += [(plate, i, *b) for i, b in enumerate(boxes)]
        want |= {(plate, i) for i in keep_larger(boxes, t)}
    df = spark.createDataFrame(rows, "plate_id long, det_seq int, x1 double, y1 double, x2 double, y2 double").repartition(3)
    assert {(r.plate_id, r.det_seq) for r in suppress.dedup_keep_larger(df, t).collect()} == want


def test_dedup_of_boxes_that_touch_nothing(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 9.0, 9.0), (1, 1, 50.0, 0.0, 59.0, 9.0)], "plate_id long, det_seq int, x1 double, y1 double, x2 double, y2 double")
    assert suppress.dedup_keep_larger(df).count() == 2
    assert suppress.dedup_keep_larger(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_cliques(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2000 + j) for i in range(12) for j in range(i)] + [(5, 5), (9000, 9000)]
    edges += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    want = {(n, find(n)) for n in parent if any(n in e and e[0] != e[1] for e in edges)}
    got = connected_components(spark.createDataFrame(edges + edges[:50], "src long, dst long"))
    assert {(r.node, r.component) for r in got.collect()} == want
    assert connected_components(got.select(F.col("node").alias("src"), F.col("node").alias("dst")).limit(0)).count() == 0


def test_exact_ranks_and_medians(spark):
    rng = random.Random(6)
    values = [rng.randrange(50) for _ in range(999)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v int").repartition(5)
    ranked, parts = exact_ranks(df, F.desc("v"), F.asc("id"))
    assert [r.id for r in sorted(ranked.collect(), key=lambda r: r.rank)] == [i for i, _ in sorted(enumerate(values), key=lambda e: (-e[1], e[0]))]
    assert {r.rank for r in ranked.collect()} == set(range(1, 1000)) and sum(r.n for r in parts.collect()) == 999
    for n in (1, 2, 998, 999):
        mine = sorted(values[:n])
        got = summaries.exact_median(df.filter(F.col("id") < n).unionByName(spark.createDataFrame([(None, None)], "id long, v int")), "v").first().median
        assert got == (mine[(n - 1) // 2] + mine[n // 2]) / 2
    assert summaries.exact_median(df.limit(0), "v").first().median is None


def test_matches_at_thresholds_are_those_of_each(spark):
    rng = random.Random(8)
    box = lambda: (lambda x, y: (float(x), float(y), float(x + rng.randrange(8, 20)), float(y + rng.randrange(8, 20))))(rng.randrange(60), rng.randrange(60))
    det = spark.createDataFrame([(1, i, rng.random(), *box()) for i in range(70)], "plate_id long, det_seq int, conf double, x1 double, y1 double, x2 double, y2 double")
    gt = spark.createDataFrame([(1, i, *box()) for i in range(50)], "plate_id long, gt_id int, x1 double, y1 double, x2 double, y2 double")
    every = {(r.threshold, r.det_seq, r.gt_id) for r in evaluate.match_at_thresholds(det, gt, [0.3, 0.5, 0.99]).collect()}
    aps = {r.threshold: r.ap for r in evaluate.average_precisions(det, gt, [0.3, 0.5, 0.99]).collect()}
    conf = {r.det_seq: r.conf for r in det.collect()}
    for t in (0.3, 0.5, 0.99):
        matches = evaluate.match_ground_truth(det, gt, t)
        assert {(t, r.det_seq, r.gt_id) for r in matches.collect()} == {e for e in every if e[0] == t}
        hit = {e[1] for e in every if e[0] == t}
        hits, points = 0, []
        for n, i in enumerate(sorted(conf, key=lambda i: (-conf[i], i)), 1):
            hits += i in hit
            points.append((hits / n, i in hit))
        want = sum(max(p for p, _ in points[k:]) for k, (_, h) in enumerate(points) if h) / 50
        assert abs(aps[t] - want) < 1e-12
        assert abs(evaluate.average_precision(det, gt, matches).first().ap - want) < 1e-12
