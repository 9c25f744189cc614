"""Edges, variances and rims that come from passes over blocks: images wider than a block, gaps, nulls."""

import math

import numpy as np
import pytest

from platelens.operators import raster as R
from platelens.plans import jobs

from . import plain_rasters as P


def wide(spark, h=20, w=300):
    rng = np.random.default_rng(8)
    img = rng.integers(0, 9, (h, w))
    for x in range(5, w - 12, 12):
        img[4 : 9 + x % 7, x : x + 7] = rng.integers(60, 250)
    return img, spark.createDataFrame([(1, x, y, int(img[y, x])) for y in range(h) for x in range(w)], "plate_id long, x long, y long, v int")


def test_edges_and_maps_reach_over_the_borders_of_blocks(spark):
    img, px = wide(spark)
    want = P.edges(img.astype(float), 30, 100)
    assert {(r.y, r.x) for r in R.edges(px).collect()} == set(zip(*np.nonzero(want)))
    maps = {(r.y, r.x): r for r in R.feature_maps(px, R.edge_lines(px), 21, 15).collect()}
    assert len(maps) == img.size
    assert {at for at, r in maps.items() if r.e} == set(zip(*np.nonzero(want)))
    for y in (0, 7, 19):
        for x in (0, 100, 245, 255, 256, 266, 299):
            assert maps[y, x].local_variance == pytest.approx(P.window(img, y, x, 10).var())
            assert maps[y, x].local_std == pytest.approx(P.window(img, y, x, 7).std())


def test_maps_of_images_with_gaps_and_nulls_are_those_along_lines(spark):
    rng = np.random.default_rng(3)
    rows = [(p, x, y, None if rng.random() < 0.1 else int(rng.integers(0, 256))) for p in range(2) for y in range(17) for x in range(-3, 23) if rng.random() < 0.6]
    px = spark.createDataFrame([*rows, (2, 0, 0, None)], "plate_id long, x int, y int, v int")
    edge = spark.createDataFrame([(0, 4, 4)], "plate_id long, x int, y int")
    got = {(r.plate_id, r.x, r.y): r for r in R.feature_maps(px, edge, 5, 3).collect()}
    want = {(r.plate_id, r.x, r.y): r for r in R.local_std(R.local_variance(px, 5), 3).collect()}
    assert got.keys() == want.keys() and got[2, 0, 0].local_variance is None
    assert all(got[at].local_variance == r.local_variance and got[at].local_std == r.local_std for at, r in want.items())
    assert {at for at, r in got.items() if r.e} == {at for at in want if at[0] == 0 and abs(at[1] - 4) < 2 and abs(at[2] - 4) < 2}


def test_maps_shuffle_a_pixel_once(spark):
    _, px = wide(spark, 2, 4)
    plan = R.feature_maps(px, px.select("plate_id", "x", "y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Aggregate" not in plan and "Window" not in plan and "Join" not in plan


def test_multifeature_takes_no_windows_along_lines(spark, monkeypatch):
    """It took eight passes along lines, three times over, and joined pixels with their neighbours."""

    def along(*_, **__):
        raise AssertionError("a pass along lines")

    monkeypatch.setattr(R, "along", along)
    _, px = wide(spark)
    plates = spark.createDataFrame([(1, 300, 20)], "plate_id long, width int, height int")
    jobs.propose_multifeature(px, plates, threshold=40, ring=4, shrink=0, min_size=6, close=1, times=1, min_area=4, min_expanded=20)


def test_a_rim_has_all_its_points(spark):
    rng = np.random.default_rng(2)
    sides = {1: (90, 61), 2: (33, 128)}
    px = spark.createDataFrame([(p, x, y, int(rng.integers(0, 256))) for p, (w, h) in sides.items() for x in range(w) for y in range(h)], "plate_id long, x int, y int, v int")
    v = {(r.plate_id, r.x, r.y): r.v for r in px.collect()}
    plates = spark.createDataFrame([(p, w, h) for p, (w, h) in sides.items()], "plate_id long, width int, height int")
    for ring in (4, 25):
        for r in R.plate_circle(px, plates, ring=ring).collect():
            found = []
            for radius in (r.radius - ring, r.radius + ring):
                at = [(r.plate_id, int(r.cx + radius * math.cos(a * 2 * math.pi / 36)), int(r.cy + radius * math.sin(a * 2 * math.pi / 36))) for a in range(36)]
                found.append([v[p] for p in at if p in v])
            want = abs(np.median(found[0]) - np.median(found[1])) if all(found) else None
            assert r.contrast == want
