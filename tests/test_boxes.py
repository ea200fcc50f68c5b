"""Box joins give every point of every box once, whatever the density, and no crowded key is left."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mzloom.operators import features, match, rangejoin


def _skewed(seed, n):
    """A third in one spot, a third in a narrow band, the rest spread out."""
    r = np.random.default_rng(seed)
    x = np.concatenate([np.full(n // 3, 50.0), r.uniform(49.5, 50.5, n // 3), r.uniform(-100, 100, n - 2 * (n // 3))])
    y = np.concatenate([np.full(n // 3, 7.0), r.uniform(0, 10, n // 3), r.uniform(-50, 50, n - 2 * (n // 3))])
    return x, y


@pytest.mark.parametrize("full", [5, 40, 100_000])
def test_boxes_hold_their_points(spark, full):
    x, y = _skewed(1, 240)
    r = np.random.default_rng(2)
    cx, cy = np.append(r.uniform(40, 60, 60), [50.0, 50.0, 0.0]), np.append(r.uniform(0, 10, 60), [7.0, 7.0, 0.0])
    hx, hy = np.append(r.uniform(0, 3, 60), [0.0, 4.0, 200.0]), np.append(r.uniform(0, 3, 60), [0.0, 4.0, 200.0])
    points = spark.createDataFrame([(k, k % 2, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "id long, file int, x double, y double")
    boxes = spark.createDataFrame([(k, k % 2, float(a - c), float(a + c), float(b - d), float(b + d)) for k, (a, b, c, d) in enumerate(zip(cx, cy, hx, hy))], "box long, file int, x0 double, x1 double, y0 double, y1 double")
    got = [(g.id, g.box) for g in rangejoin.boxed(points, boxes, ["file"], "x", "y", ("x0", "x1", "y0", "y1"), (2.0, 5.0), full).select("id", "box").collect()]
    want = {(i, b) for i in range(240) for b in range(63) if i % 2 == b % 2 and cx[b] - hx[b] <= x[i] <= cx[b] + hx[b] and cy[b] - hy[b] <= y[i] <= cy[b] + hy[b]}
    assert len(got) == len(want) and set(got) == want and len(want) > 300


def test_no_key_is_crowded(spark):
    x, y = _skewed(3, 3000)
    points = spark.createDataFrame([(0, float(a), float(b), k) for k, (a, b) in enumerate(zip(x, y))], "file int, x double, y double, id long")
    boxes = points.limit(1).selectExpr("file", "x - 1 x0", "x + 1 x1", "y - 1 y0", "y + 1 y1")
    j = rangejoin.boxed(points, boxes, ["file"], "x", "y", ("x0", "x1", "y0", "y1"), (2.0, 5.0), 50)
    keys = [c for c in ("_cx", "_cy", "_px", "_py", "_salt")]
    most = j.groupBy(*[F.col(f"p.{k}") for k in keys]).count().agg(F.max("count")).first()[0]
    assert most < 3 * 50 and j.count() >= 1000


def test_candidates_on_crowded_cells(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(k, 0, 0, 0, float(500 + r.uniform(0, 0.4)), float(r.uniform(0, 5)), 0.02, 1.0, float(k)) for k in range(120)]
    items = spark.createDataFrame(rows, "uid long, file_id int, group_id int, charge int, mz double, rt double, s_mz double, s_rt double, intensity double")
    plain = {(a.ref, a.other) for a in match.candidates(items, 1.5, 1.5, 2.0).collect()}
    peaks = items.selectExpr("file_id", "uid peak_id", "500 + (mz - 500) * 10 fitted_mz", "rt fitted_rt", "0.1D fitted_sigma_mz", "s_rt fitted_sigma_rt")
    edges = {tuple(e) for e in features.candidate_graph(peaks, [1, 2, 3]).collect()}
    monkeypatch.setattr(rangejoin, "FULL", 10)
    assert {(a.ref, a.other) for a in match.candidates(items, 1.5, 1.5, 2.0).collect()} == plain and len(plain) > 200
    assert {tuple(e) for e in features.candidate_graph(peaks, [1, 2, 3]).collect()} == edges and len(edges) > 20


def test_isotope_cells_follow_the_density(spark, monkeypatch):
    rng, held = np.random.default_rng(7), []
    real = features.boxed

    def boxed(points, boxes, keys, x, y, box, widths):
        cells = points.groupBy(*keys, F.floor(F.col(x) / widths[0]), F.floor(F.col(y) / widths[1])).count()
        held.append(cells.agg(F.avg("count")).first()[0])
        return real(points, boxes, keys, x, y, box, widths)

    monkeypatch.setattr(features, "boxed", boxed)
    for n in (500, 8_000):
        s = (500 / n) ** 0.5
        peaks = [(0, k, 300 + 4 * float(a), 100 * float(b), 0.02 * s, 2.0 * s) for k, (a, b) in enumerate(rng.random((n, 2)))]
        df = spark.createDataFrame(peaks, "file_id int, peak_id long, fitted_mz double, fitted_rt double, fitted_sigma_mz double, fitted_sigma_rt double")
        got = sorted((r.charge, r.lower, r.upper) for r in features.candidate_graph(df, [1, 2]).collect())
        mz, rt = np.array([p[2] for p in peaks]), np.array([p[3] for p in peaks])
        want = []
        for z in (1, 2):
            for k in range(n):
                near = (np.abs(mz - (mz[k] + features.ISOTOPE_STEP / z)) < 0.02 * s) & (np.abs(rt - rt[k]) < 2.0 * s)
                want += [(z, k, int(u)) for u in np.flatnonzero(near)]
        assert got == sorted(want) and got
    assert max(held) < 20


def test_isotope_search_asks_once_for_all_charges(spark, monkeypatch):
    """The boxes are one a peak, and the edges those of all pairs, also where steps of several charges meet in one box."""
    rng, asked = np.random.default_rng(8), []
    real = features.boxed

    def boxed(points, boxes, *more):
        asked.append(boxes.count())
        return real(points, boxes, *more)

    monkeypatch.setattr(features, "boxed", boxed)
    n, charges = 400, [5, 4, 3, 2, 1]
    peaks = [(k % 2, k, 300 + 6 * float(a), 50 * float(b), 0.05 + 0.1 * float(c), 3.0) for k, (a, b, c) in enumerate(rng.random((n, 3)))]
    df = spark.createDataFrame(peaks, "file_id int, peak_id long, fitted_mz double, fitted_rt double, fitted_sigma_mz double, fitted_sigma_rt double")
    got = sorted((r.charge, r.lower, r.upper) for r in features.candidate_graph(df, charges).collect())
    want = [(z, a[1], b[1]) for z in charges for a in peaks for b in peaks if a[0] == b[0] and abs(b[2] - (a[2] + features.ISOTOPE_STEP / z)) < a[4] and abs(b[3] - a[3]) < a[5]]
    assert got == sorted(want) and len(got) > 500 and asked == [n]
