"""Components of runs, found in blocks and joined across their borders, against a flood over pixels."""

import numpy as np
import pytest

from platelens.operators import raster as R
from platelens.operators.components import connected_components


@pytest.mark.parametrize("reach", [0, 1])
def test_labels_across_blocks(spark, reach):
    rng = np.random.default_rng(11)
    pixels = {(p, int(x), int(y)) for p in (1, 2) for y, x in zip(*np.nonzero(rng.random((23, 31)) < (0.62 if reach == 0 else 0.42)))}
    pixels = {(p, x - 5, y - 3) for p, x, y in pixels}  # also left of and above the origin
    label = {}
    for start in sorted(pixels, key=lambda q: (q[0], q[2], q[1])):
        if start in label:
            continue
        label[start], todo = (start[2], start[1]), [start]
        while todo:
            p, x, y = todo.pop()
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    n = (p, x + i, y + j)
                    if (reach or not (i and j)) and n in pixels and n not in label:
                        label[n] = label[start]
                        todo.append(n)
    mask = spark.createDataFrame(sorted(pixels), "plate_id long, x int, y int")
    found = R.label_runs(R.to_runs(mask), 8 if reach else 4, cell=2, lines=4, frame=reach).collect()
    got = {(r.plate_id, x, r.y): (r.label.y, r.label.x0) for r in found for x in range(r.x0, r.x1 + 1)}
    assert len(got) == sum(r.x1 - r.x0 + 1 for r in found)
    assert got == label


def test_components_inside_a_block_need_no_rounds(spark, monkeypatch):
    """Every pair of touching runs was an edge of the graph before."""
    edges = []
    monkeypatch.setattr(R, "connected_components", lambda e: edges.append(e.count()) or connected_components(e))
    mask = spark.createDataFrame([(1, x, y) for x in range(20) for y in range(20) if (x + y) % 3], "plate_id long, x int, y int")
    labels = {tuple(r.label) for r in R.label_runs(R.to_runs(mask), 8).collect()}
    assert labels == {(0, 1)} and edges == [0]
