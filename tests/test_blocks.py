import numpy as np

from platelens.operators import raster as R
from platelens.operators.blocks import _envelope, _under, in_blocks, square_extrema


def plain(values, k, pick):
    return {(p, x, y): pick(v for (q, a, b), v in values.items() if q == p and abs(a - x) <= k and abs(b - y) <= k) for p, x, y in values}


def test_windows_reach_over_the_borders_of_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(p, x, y, int(rng.integers(0, 99))) for p in range(3) for x in range(-3, 19) for y in range(9 + 4 * p) if rng.random() < 0.85]
    px = spark.createDataFrame(rows, "plate_id long, x int, y int, v int")
    opened = in_blocks(px, "v", 4, square_extrema(2, (np.minimum, np.maximum)), side=5)
    values = {(p, x, y): v for p, x, y, v in rows}
    assert opened.dtypes == px.dtypes
    assert sorted((r.plate_id, r.x, r.y, r.v) for r in opened.collect()) == sorted((*at, v) for at, v in plain(plain(values, 2, min), 2, max).items())


def test_morphology_shuffles_a_pixel_once(spark):
    px = spark.range(40).selectExpr("id DIV 20 AS plate_id", "CAST(id % 5 AS INT) AS x", "CAST(id % 20 DIV 5 AS INT) AS y", "CAST(id * 7 % 11 AS INT) AS v")
    plan = R.morphology(px, "tophat", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Aggregate" not in plan


def test_hulls_of_many_regions_come_from_one_pass(spark):
    runs = [(1, 0, 0, 9), (1, 1, 0, 0), (1, 2, 0, 9), (2, 5, 3, 3), (3, 0, 4, 4), (3, 1, 3, 5), (3, 2, 4, 4), (4, 0, 0, 0), (4, 3, 6, 6)]
    df = spark.createDataFrame(runs, "region long, y int, x0 int, x1 int")
    made = R.solidity(df, "region")
    assert "transform(" not in made._jdf.queryExecution().optimizedPlan().toString() and "aggregate(" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.region, r.area, r.hull_area) for r in made.collect()} == {(1, 21, 30.0), (2, 1, 1.0), (3, 5, 7.0), (4, 2, 10.0)}
    assert R.solidity(df.filter("region > 9"), "region").collect() == []


def test_envelopes_against_the_definition():
    rng = np.random.default_rng(1)
    for _ in range(30):
        y, x = np.arange(12), rng.integers(-9, 9, 12)
        low = [min([x[i]] + [x[a] + (x[b] - x[a]) * (i - a) / (b - a) for a in range(i) for b in range(i + 1, 12)]) for i in range(12)]
        assert np.isclose(_under(*_envelope(np.zeros(12, np.int64), y, x), 1)[0], sum(low[i] + low[i + 1] for i in range(11)))
