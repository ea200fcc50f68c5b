"""Similarities of warped segments against matrices of all pairs, for every edge."""

import numpy as np
import pytest

from mzloom.operators import warp
from mzloom.params import Warping


def _peaks(n, seed, file_id=0, shift=0.0):
    r = np.random.default_rng(seed)
    return [(file_id, k, float(400 + r.uniform(0, 8)), float(r.uniform(0, 900) + shift), 0.0, float(r.integers(1, 40)), float(r.uniform(0.02, 0.3)), float(r.uniform(2, 9))) for k in range(n)]


def _table(rows):
    return np.array([[x[2], x[3], x[6], x[7], x[5]] for x in rows])


def test_pairs_are_those_of_a_matrix():
    a, b = _table(_peaks(80, 1)), _table(_peaks(90, 2))
    i, j = warp.touching_pairs(a, b)
    want = np.abs(a[:, None, 0] - b[None, :, 0]) <= 3 * (a[:, None, 2] + b[None, :, 2])
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(want)))) and len(i) == want.sum()
    assert all(len(x) == 0 for x in warp.touching_pairs(a[:0], b)) and all(len(x) == 0 for x in warp.touching_pairs(a, b[:0]))


def test_every_edge_has_the_overlap_of_its_warped_peaks(spark):
    rows = _peaks(150, 3) + _peaks(170, 4, 1, 30.0) + _peaks(3, 5, 2, 400.0)
    how = Warping(slack=3, window=10, num_points=60, expand=0.1, peaks_per_window=12)
    frame = spark.createDataFrame(rows, "file_id int, peak_id long, fitted_mz double, fitted_rt double, rt_delta double, fitted_height double, fitted_sigma_mz double, fitted_sigma_rt double")
    got = {(r.file_id, r.level, r.src_start, r.src_end): r.similarity for r in warp.warped_similarities(frame, 0, how, parts=3).collect()}
    edges = [(r.level, r.src_start, r.src_end) for r in warp.warpings(spark, 6, 10, 3).collect()]
    ranges = {r.file_id: (r.rt_min, r.rt_max) for r in warp.rt_range(frame, 0, 0.1).collect()}
    assert len(got) == 3 * len(edges)
    for f, (lo, hi) in ranges.items():
        delta = (hi - lo) / 59

        def top(file, f=f, lo=lo, delta=delta):
            out = {}
            for x in rows:
                if x[0] == file:
                    out.setdefault(int(np.floor((x[3] - lo) / (delta * 10))), []).append(x)
            return {k: sorted(v, key=lambda x: (-x[5], x[1]))[:12] for k, v in out.items() if 0 <= k < 6}

        ref, src = top(0), [x for v in top(f).values() for x in v]
        for level, s, e in edges:
            a, b, start, end = lo + s * delta, lo + e * delta, lo + level * 10 * delta, lo + (level + 1) * 10 * delta
            moved = _table([x for x in src if a <= x[3] < b]).reshape(-1, 5)
            moved[:, 1] = start + (moved[:, 1] - a) / (b - a) * (end - start)
            want = warp.overlap_sum(_table(ref.get(level, [])).reshape(-1, 5), moved)
            assert np.isclose(got[f, level, s, e], want, rtol=1e-9, atol=1e-12), (f, level, s, e)
    assert sum(v > 0 for v in got.values()) > 100


def test_the_reference_must_fit(spark, monkeypatch):
    monkeypatch.setattr(warp, "REFERENCE_PEAKS", 10)
    frame = spark.createDataFrame(_peaks(11, 1), "file_id int, peak_id long, fitted_mz double, fitted_rt double, rt_delta double, fitted_height double, fitted_sigma_mz double, fitted_sigma_rt double")
    with pytest.raises(ValueError, match="11 peaks"):
        warp.warped_similarities(frame, 0, Warping())


def test_the_reference_may_have_any_size(spark, monkeypatch):
    schema = "file_id int, peak_id long, fitted_mz double, fitted_rt double, rt_delta double, fitted_height double, fitted_sigma_mz double, fitted_sigma_rt double"
    frame = spark.createDataFrame(_peaks(150, 3) + _peaks(170, 4, 1, 30.0), schema)
    how = Warping(slack=3, window=10, num_points=60, expand=0.1, peaks_per_window=2)
    read = lambda: sorted(tuple(r) for r in warp.warped_similarities(frame, 0, how).collect())
    want = read()
    monkeypatch.setattr(warp, "REFERENCE_PEAKS", 20)  # 150 peaks, of which six segments keep two each
    assert read() == want and any(x[-1] > 0 for x in want)
