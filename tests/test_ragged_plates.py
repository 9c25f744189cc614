"""Plates that are smaller than the others, ragged or with gaps: queries against their SQL, windows against loops."""

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from platelens.operators import raster as R
from platelens.plans.library import ORACLE_SQL, QUERIES

NAMES = ["s02_s03_images", "s02_tiled_plates", "r02_plate_circle", "r03_mask_plate", "r04_clahe", "r05_blackhat", "r05_opening", "r05_dilate_ellipse", "r05_reflected"]
NAMES += ["r08_local_mean", "r08_r09_reflected", "r09_local_std", "r16_saliency", "r18_downscale", "r05_close", "r05_tophat"]


@pytest.fixture(scope="module")
def ragged(tmp_path_factory):
    """The first plate whole; of the second a line of blocks and seven more, of the third six blocks, so 48x8 pixels."""
    folder = tmp_path_factory.mktemp("ragged")
    table = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    ids = table.column("vec_id").to_numpy()
    pq.write_table(table.filter((ids < 67) | ((ids >= 100) & (ids < 106))), f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_its_sql_on_ragged_plates(spark, ragged, name):
    found = QUERIES[name](spark, ragged)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{ragged}/embeddings.parquet'")
    wanted = con.sql(ORACLE_SQL[name]).select(", ".join(found.columns)).fetchall()
    rows = [tuple(r) for r in found.collect()]
    key = lambda r: tuple(str(v) for v in r if not isinstance(v, float))
    assert len(rows) == len(wanted)
    for a, b in zip(sorted(rows, key=key), sorted(wanted, key=key)):
        assert a == pytest.approx(b, abs=2e-6)


def test_squares_discs_and_means_over_gaps(spark):
    rng = np.random.default_rng(5)
    there = rng.random((17, 23)) < 0.6
    v = rng.integers(0, 256, there.shape)
    px = spark.createDataFrame([(1, int(x), int(y), int(v[y, x])) for y, x in zip(*np.nonzero(there))], "plate_id long, x int, y int, v int")

    def around(values, f, k, disc=False):
        out = {}
        for y, x in zip(*np.nonzero(there)):
            near = [values[b, a] for b in range(max(0, y - k), min(17, y + k + 1)) for a in range(max(0, x - k), min(23, x + k + 1)) if there[b, a] and (not disc or (a - x) ** 2 + (b - y) ** 2 <= k * k)]
            out[int(x), int(y)] = f(near)
        return out

    def got(df, c="v"):
        return {(r.x, r.y): r[c] for r in df.collect()}

    k = 2
    wide = around(v, max, k)
    assert got(R.dilate(px, k)) == wide
    full = np.zeros_like(v)
    for (x, y), m in wide.items():
        full[y, x] = m
    shut = around(full, min, k)
    assert got(R.morphology(px, "blackhat", k)) == {(x, y): shut[x, y] - v[y, x] for x, y in shut}
    assert got(R.morphology_ellipse(px, "dilate", 3)) == around(v, max, 3, True)
    assert got(R.local_mean(px, 5), "local_mean") == pytest.approx(around(v, np.mean, k))
    assert got(R.local_std(px, 5), "local_std") == pytest.approx(around(v, np.std, k), abs=1e-5)


def test_regions_of_crops_on_ragged_plates_give_their_sql(spark, tmp_path):
    """Plates that end within a line of blocks or have holes: a crop's pixel may lack the one above it and not that one's neighbours."""
    embeddings, lineitem, part = (pq.read_table(f"/root/testdata/sf0.01/{t}.parquet") for t in ("embeddings", "lineitem", "part"))
    ids = embeddings.column("vec_id").to_numpy()
    pq.write_table(embeddings.filter((ids < 67) | ((ids >= 100) & (ids < 150) & (ids % 3 != 1))), tmp_path / "embeddings.parquet")
    pq.write_table(lineitem.filter(lineitem.column("l_suppkey").to_numpy() < 3), tmp_path / "lineitem.parquet")
    pq.write_table(part, tmp_path / "part.parquet")
    found = QUERIES["x02_measured_regions"](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    wanted = con.sql(ORACLE_SQL["x02_measured_regions"]).select(", ".join(found.columns)).fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)
