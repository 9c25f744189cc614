"""Proposal jobs, edges, blobs, hulls and crops against plain loops over small scenes of separate objects."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from platelens.operators import lines, raster
from platelens.plans import jobs

from . import plain_rasters as P

W, H = 44, 36


def scene(seed):
    """Bright objects of several shapes on a dark, slightly uneven ground."""
    rng = random.Random(seed)
    img = np.array([[2 + (x * 5 + y * 3 + seed) % 3 for x in range(W)] for y in range(H)])
    for cy in range(3):
        for cx in range(3):
            w, h, v = rng.randrange(4, 11), rng.randrange(2, 6), rng.randrange(150, 230)
            x0, y0 = 3 + cx * 14, 4 + cy * 11
            for y in range(y0, y0 + h):
                img[y, x0 + (y - y0) % 3 : x0 + w] = v + (y - y0)
    return img


SCENES = {1: scene(1), 2: scene(2)}


@pytest.fixture(scope="module")
def px(spark):
    rows = [(p, x, y, int(img[y, x])) for p, img in SCENES.items() for y in range(H) for x in range(W)]
    return spark.createDataFrame(rows, "plate_id long, x long, y long, v int").repartition(4)


@pytest.fixture(scope="module")
def plates(spark):
    return spark.createDataFrame([(p, W, H) for p in SCENES], "plate_id long, width int, height int")


def points(df, plate):
    return {(r.y, r.x) for r in df.filter(F.col("plate_id") == plate).collect()}


def test_propose_cv(px, plates):
    got = jobs.propose_cv(px, plates, background=9, min_size=6, areas=(6, 3000)).collect()
    total = 0
    for p, img in SCENES.items():
        hat = P.tophat(P.clahe(img), 9)
        found = [P.props(c) for c in P.cleaned(hat > P.otsu(hat), 6, 1)]
        kept = [f for f in found if 6 <= f["area"] <= 3000 and 0.70 <= f["eccentricity"] <= 0.999 and f["solidity"] >= 0.5]
        want = sorted((*f["box"], f["area"], round(0.5 * f["eccentricity"] + 0.5 * f["solidity"], 9)) for f in kept)
        mine = [r for r in got if r.plate_id == p]
        assert sorted((r.bbox_x1, r.bbox_y1, r.bbox_x2, r.bbox_y2, r.area, round(r.conf, 9)) for r in mine) == want
        assert [r.conf for r in sorted(mine, key=lambda r: r.rank)] == sorted((r.conf for r in mine), reverse=True)
        total += len(want)
    assert total >= 2


def test_propose_cv_fast(px, plates):
    got = jobs.propose_cv_fast(px, plates, background=9, scale=4.5, preset="any", ring=4, shrink=0, min_size=3, min_eccentricity=0.3).collect()
    total = 0
    for p, img in SCENES.items():
        hat = P.tophat(P.clahe(img), 9)
        rows = []
        for c in P.cleaned(P.in_circle(hat > P.otsu(hat), 0), 3, 1):
            f = P.props(c)
            box = P.scaled(f["box"], 4.5, W, H)
            w, h = box[2] - box[0], box[3] - box[1]
            if 200 <= w * h <= 100_000 and math.sqrt(1 - (min(w, h) / max(w, h)) ** 2) >= 0.3:
                rows.append((box, min(1.0, f["area"] / (w * h))))
        want = [(*box, round(conf, 9)) for box, conf in P.suppressed(rows)]
        mine = sorted((r for r in got if r.plate_id == p), key=lambda r: r.rank)
        assert [(r.x1, r.y1, r.x2, r.y2, round(r.conf, 9)) for r in mine] == want
        total += len(want)
    assert total >= 1


def test_propose_multifeature(px, plates):
    options = {"threshold": 40, "ring": 4, "shrink": 0, "min_size": 6, "close": 1, "times": 1, "low": 30, "high": 100, "min_area": 4, "min_expanded": 20}
    got = jobs.propose_multifeature(px, plates, **options).collect()
    total = 0
    for p, img in SCENES.items():
        f = img.astype(float)
        variance = lambda k: P.each(f, lambda y, x: (P.window(f, y, x, k) ** 2).mean() - P.window(f, y, x, k).mean() ** 2)  # noqa: E731, B023
        maps = [variance(10), P.edges(f, 30, 100).astype(float), np.sqrt(np.maximum(0, variance(7)))]
        norm = lambda m: (m - m.min()) / (m.max() - m.min()) if m.max() > m.min() else m * 0
        mixed = norm(sum(w * norm(m) for w, m in zip((0.5, 0.3, 0.2), maps)))
        salient = np.trunc(np.round(mixed * 255, 6)).astype(int)
        rows = []
        for c in P.cleaned(P.in_circle(salient > 40, 0), 6, 1):
            q = P.props(c)
            x1, y1, x2, y2 = q["box"]
            w, h = x2 - x1, y2 - y1
            box = P.scaled(q["box"], 1.5, W, H)
            if q["area"] >= 4 and q["area"] / (w * h) >= 0.2 and max(w, h) / min(w, h) <= 5 and q["solidity"] >= 0.3 and 20 <= (box[2] - box[0]) * (box[3] - box[1]) <= 100_000:
                rows.append((box, salient[box[1] : box[3], box[0] : box[2]].mean() / 255))
        want = [(*box, round(conf, 9)) for box, conf in P.suppressed(rows)]
        mine = sorted((r for r in got if r.plate_id == p), key=lambda r: r.rank)
        assert [(r.x1, r.y1, r.x2, r.y2, round(r.conf, 9)) for r in mine] == want
        total += len(want)
    assert total >= 1


def test_propose_blob_and_blobs(px, plates):
    sigmas = [1.0, 1.6, 2.5]
    got = jobs.propose_blob(px, plates, sigmas, ring=4, shrink=0, min_area=9).collect()
    total = 0
    for p, img in SCENES.items():
        cx, cy, r = P.circle(W, H, 0)
        inside = P.each(img, lambda y, x: (x - cx) ** 2 + (y - cy) ** 2 <= r * r)  # noqa: B023
        found = P.blobs(np.where(inside, img, img.mean()) / 255, sigmas)
        want = set()
        for x, y, sigma, _ in found:
            half = int(sigma * math.sqrt(2) * 2.5)
            box = max(0, x - half), max(0, y - half), min(W, x + half), min(H, y + half)
            if 9 <= (box[2] - box[0]) * (box[3] - box[1]) <= 100_000:
                want.add((x, y, sigma, *box, round(min(1.0, sigma * math.sqrt(2) / 2.5), 9)))
        assert {(r.x, r.y, r.sigma, r.x1, r.y1, r.x2, r.y2, round(r.conf, 9)) for r in got if r.plate_id == p} == want
        total += len(want)
    assert total >= 6


def test_edges(px):
    got = raster.edges(px, 30, 100)
    for p, img in SCENES.items():
        want = P.edges(img.astype(float), 30, 100)
        assert points(got, p) == set(zip(*(int_list.tolist() for int_list in np.nonzero(want))))
        assert want.sum() > 50


def test_solidity(px):
    runs = raster.label_runs(raster.to_runs(px.filter("v > 100")), 8)
    got = {(r.plate_id, r.label.y, r.label.x0): (r.area, r.hull_area) for r in raster.solidity(runs, "plate_id", "label").collect()}
    want = {(p, *c[0]): (len(c), P.hull_area(c)) for p, img in SCENES.items() for c in P.components(img > 100)}
    assert got == want


@pytest.mark.parametrize("k", [1, 3, 60])
def test_mirrored_borders_and_long_windows(px, plates, k):
    rule = {"border": "reflect", "plates": plates}
    for p, img in SCENES.items():
        wide = np.pad(img, k, mode="symmetric")
        own = px.filter(F.col("plate_id") == p)
        grid = lambda df, c="v": {(r.y, r.x): r[c] for r in df.collect()}
        spots = [(0, 0), (0, W - 1), (H - 1, 0), (H // 2, W // 2), (H - 1, W - 1), (1, 5)]
        big, small, mean = grid(raster.dilate(own, k, **rule)), grid(raster.erode(own, k)), grid(raster.local_mean(own, 2 * k + 1, **rule), "local_mean")
        soft = grid(raster.local_mean(own, 2 * k + 1, "gaussian", 9.0), "local_mean")
        assert len(big) == H * W
        for y, x in spots:
            part = wide[y : y + 2 * k + 1, x : x + 2 * k + 1]
            assert big[y, x] == part.max() and abs(mean[y, x] - part.mean()) < 1e-9
            assert small[y, x] == P.window(img, y, x, k).min()
            near, y0, x0 = P.window(img, y, x, k), max(0, y - k), max(0, x - k)
            w = np.exp(-((np.arange(near.shape[0])[:, None] + y0 - y) ** 2 + (np.arange(near.shape[1])[None] + x0 - x) ** 2) / 162)
            assert abs(soft[y, x] - (near * w).sum() / w.sum()) < 1e-9
        break


def test_running_extrema():
    rng = np.random.default_rng(3)
    for n, k in ((1, 4), (20, 1), (50, 7), (9, 30)):
        v = rng.integers(0, 99, n).astype(float)
        assert lines.running(v, k, np.maximum).tolist() == [v[max(0, i - k) : i + k + 1].max() for i in range(n)]
        assert lines.running(v, k, np.minimum).tolist() == [v[max(0, i - k) : i + k + 1].min() for i in range(n)]


def test_batch_goes_on_where_the_model_fails(spark, px, plates):
    import pandas as pd

    def model(batches):
        for t in batches:
            if (t["plate_id"] == 2).any():
                raise RuntimeError("no weights")
            yield pd.DataFrame({"plate_id": t["plate_id"], "tile_id": t["tile_id"].astype("int32"), "x1": 3.0, "y1": 4.0, "x2": 13.0, "y2": 9.0, "conf": 0.9, "class": 0})[:1]

    catalog = plates.unionByName(spark.createDataFrame([(7, W, H)], "plate_id long, width int, height int"))
    dark = px.withColumn("v", (255 - F.col("v")) / 255)
    summary, measured, counts = jobs.batch_plates(catalog, dark, model, F.lit(8.666), 64, 8, pad=3, block=15, min_size=3)
    got = {r.plate_id: (r.status, r.organisms, r.error) for r in summary.collect()}
    assert got == {1: ("ok", 1, None), 2: ("failed", 0, "RuntimeError: no weights"), 7: ("missing", 0, None)}
    assert [(r.plate_id, r.method) for r in measured.collect()] == [(1, "fast")]


def test_measure_from_masks(spark):
    """A mask is one region, in one piece or not; a box without one is measured by its sides."""
    masks = {(p, k): part for p, img in SCENES.items() for k, part in enumerate(P.components(img > 100))}
    masks[1, 50] = sorted(masks[1, 0] + masks[1, 5])  # two pieces
    px = spark.createDataFrame([(p, k, int(x), int(y)) for (p, k), part in masks.items() for y, x in part], "plate_id long, det_seq int, x long, y long")
    runs = raster.to_runs(px.select(F.struct("plate_id", "det_seq").alias("plate_id"), "x", "y")).select("plate_id.plate_id", "plate_id.det_seq", "y", "x0", "x1")
    boxes = spark.createDataFrame([(p, k, 0.0, 0.0, 9.0, 5.0) for p, k in [*masks, (2, 70)]], "plate_id long, det_seq int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.plate_id, r.det_seq): r for r in jobs.measure_from_masks(boxes, runs, F.lit(2.0)).collect()}
    assert set(got) == {*masks, (2, 70)}
    for at, part in masks.items():
        want, r = P.props(part), got[at]
        assert r.mask_available and (r.area, round(r.perimeter, 9)) == (want["area"], round(P.perimeter(part), 9))
        for name in ("major", "minor", "eccentricity", "solidity"):
            assert abs(r[name] - want[name]) < 1e-9, (at, name)
        assert abs(r.length_um - 2 * want["major"]) < 1e-9 and abs(r.volume_um3 - math.pi * want["minor"] ** 2 * 2 * want["major"]) < 1e-6
    r = got[2, 70]
    assert (r.mask_available, r.area, r.major, r.minor, r.perimeter, r.solidity) == (False, 45.0, 9.0, 5.0, 28.0, 0.0)
