"""The grid in tiles equals the grid of sparse cells, for every instrument."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mzloom.operators import grid, tiles
from mzloom.params import Resampling, Run


def _points(spark, n=140, seed=2):
    r = np.random.default_rng(seed)
    rows = [(int(r.integers(0, 2)), float(r.uniform(0, 200)), float(r.uniform(300, 318)), float(r.integers(1, 50))) for _ in range(n)]
    rows += [(0, 50.0, 305.0, 10.0)] * 3 + [(1, 0.0, 300.0, 5.0), (1, 200.0, 318.0, 5.0)]
    return spark.createDataFrame(rows, "file_id int, rt double, mz double, intensity double").repartition(3)


@pytest.mark.parametrize("kind", ["orbitrap", "fticr", "tof", "quad"])
def test_tiles_equal_sparse_cells(spark, kind):
    pts, how = _points(spark), Resampling(4, 4, 0.5, 0.4)
    run = Run(kind, resolution_ms1=600 if kind == "quad" else 900, reference_mz=200, fwhm_rt=20)
    b = grid.bounds_of(pts)
    want = grid.smooth_mz(grid.smooth_rt(grid.splat(pts, b, run, how), b, run, how), b, run, how)
    want = {(x.file_id, x.i, x.j): x.value for x in want.collect()}
    dims = grid.shape(b, run, how).select("file_id", "n", "m")
    assert max(x.n for x in dims.collect()) > 50
    for tile in (16, 256):
        got = {(x.file_id, x.i, x.j): x.value for x in grid.resample(pts, b, run, how, tile).collect()}
        assert got.keys() == want.keys()
        assert np.allclose([got[k] for k in want], [want[k] for k in want], rtol=1e-9, atol=1e-12)
        cells = spark.createDataFrame([(*k, round(v, 7)) for k, v in want.items()], "file_id int, i long, j long, value double")
        tops = {(x.file_id, x.i, x.j) for x in grid.local_maxima(cells, dims).collect()}
        found = grid.maxima_of(pts, b, run, how, 7, tile).collect()
        assert {(x.file_id, x.i, x.j) for x in found} == tops and len(found) == len(tops) > 5
        assert all(abs(x.value - want[x.file_id, x.i, x.j]) < 1e-6 for x in found)


def test_tiles_hold_any_number_of_points(spark):
    """Many points in one tile are streamed; files follow each other within a partition."""
    run, how = Run("quad", resolution_ms1=600, reference_mz=200, fwhm_rt=20), Resampling(4, 4, 0.5, 0.4)
    pts = spark.range(30_000).select((F.col("id") % 3).cast("int").alias("file_id"), (F.col("id") % 7 * 10.0).alias("rt"), (300 + F.col("id") % 11).cast("double").alias("mz"), F.lit(1.0).alias("intensity"))
    got = grid.resample(pts.coalesce(1), grid.bounds_of(pts), run, how)
    assert got.groupBy("file_id").agg(F.sum("value").alias("v")).where("v > 0").count() == 3
    few = pts.groupBy("file_id", "rt", "mz").agg(F.sum("intensity").alias("intensity"))
    same = {(x.file_id, x.i, x.j): x.value for x in grid.resample(few, grid.bounds_of(pts), run, how).collect()}
    assert all(np.isclose(x.value, same[x.file_id, x.i, x.j]) for x in got.collect())
    assert grid.resample(pts.limit(0), grid.bounds_of(pts), run, how).count() == 0
    assert tiles.TILE > 0
