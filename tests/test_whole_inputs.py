"""Queries over whole input tables, against brute force and their SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from platelens.fixtures import view
from platelens.plans import table_queries as Q

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["j03_crop_join_all", "j05_join_measurements_all", "a07_batch_summary_all"])
def test_rows_equal_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    rel = con.sql(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})")
    got, want = sorted(map(tuple, df.collect())), sorted(rel.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == pytest.approx(y, abs=2e-3) if isinstance(y, float) else x == y for x, y in zip(a, b))


def test_every_box_is_cropped(spark):
    gray = {(r.plate_id, r.x, r.y): r.v for r in view(spark, SMALL, "fx_gray").collect()}
    det, want = view(spark, SMALL, "fx_det").collect(), {}
    for r in det:
        a, c = math.trunc(r.x1 / 13), math.trunc(r.y1 / 26)
        v = [gray[r.plate_id, x, y] for x in range(max(0, a - 2), min(80, a + 6)) for y in range(max(0, c - 2), min(40, c + 6)) if (r.plate_id, x, y) in gray]
        if v:
            want[r.plate_id, r.det_seq] = (len(v), sum(v))
    got = {(r.plate_id, r.det_seq): (r.n, r.total) for r in entry.queries()["j03_crop_join_all"](spark, SMALL).collect()}
    assert got == want and max(s for _, s in got) >= 40


def test_empty_plates_and_unmatched_detections(spark):
    m = Q.physical(spark, SMALL).filter("plate_id <> 3")
    got = {r.plate_id: (r.organisms, r.status) for r in Q.plate_batch(view(spark, SMALL, "fx_plate"), m).collect()}
    assert got[3] == (0, "empty") and all(s == "ok" and n > 0 for p, (n, s) in got.items() if p != 3)
    det = view(spark, SMALL, "fx_det")
    assert Q.with_measurements(det, det.filter(F.col("conf") > 0.5)).count() == det.filter("conf > 0.5").count() < det.count()
