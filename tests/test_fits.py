import duckdb
import numpy as np

from mzloom.operators import peaks
from mzloom.plans import queries

_ROW = "struct(0D AS a, 0D AS b, -0.5D AS c, 0D AS d, -0.5D AS e) AS fit, 1D AS raw_roi_total_intensity, 10D AS raw_roi_max_height, 1D AS raw_roi_sigma_mz, 1D AS raw_roi_sigma_rt"
_ROW += ", 400D AS fitted_mz, 400D AS local_max_mz, 1D AS theory_mz, 1D AS fitted_sigma_mz, 9D AS fitted_rt, 9D AS local_max_rt, 1D AS theory_rt, 1D AS fitted_sigma_rt"


def test_heights_beyond_doubles_have_the_codes_of_the_sql(spark):
    """Bit 23 for a height that underflows, bit 18 for one that overflows, on both sides."""
    logs = [-800.0, -745.0, 0.0, 709.0, 800.0]
    x = spark.sql(f"SELECT v, {_ROW} FROM (SELECT explode(array({', '.join(f'{v}D' for v in logs)})) AS v)").selectExpr("*", "exp(v) AS fitted_height")
    got = {r.v: r.code for r in x.select("v", peaks.failure_code().alias("code")).collect()}
    case = queries._CENTROID.rsplit("fits AS (", 1)[1].rsplit(" FROM g3)", 1)[0]
    rows = ", ".join(f"(CAST({v} AS DOUBLE))" for v in logs)
    want = dict(duckdb.sql(f"SELECT lnh, code FROM ({case} FROM (SELECT *, -0.5 AS e, 1 AS rm, 1 AS rr, 10 AS mw, 9 AS frt, 9 AS lr, 1 AS sr, 1 AS fs FROM (VALUES {rows}) t(lnh)) g3)").fetchall())
    assert got == want and want[-800.0] == 1 << 23 and want[800.0] == 1 << 18 | 1 << 30


def test_log_height_stays_finite(spark):
    x = spark.sql("SELECT explode(array(struct(800D AS a, 0D AS b, -0.5D AS c, 0D AS d, -0.5D AS e), struct(-800D AS a, 2D AS b, -0.5D AS c, 0D AS d, -0.5D AS e))) AS fit")
    assert [r[0] for r in x.select(peaks.log_height()).collect()] == [800.0, -798.0]


def test_equal_points_are_one_row_of_a_region(spark):
    """Moments of regions from merged points are those of all points."""
    rows = [(0, 400.0 + dm / 10, 9.0 + dr, 1.0 + dm * dm) for dm in range(-3, 4) for dr in range(-2, 3)]
    p = spark.createDataFrame(rows * 3, "file_id int, mz double, rt double, intensity double")
    roi = spark.sql("SELECT 0 AS file_id, 400D AS local_max_mz, 9D AS local_max_rt, 5D AS local_max_height, 1D AS theory_mz, 1D AS theory_rt, 399D AS roi_min_mz, 401D AS roi_max_mz, 0D AS roi_min_rt, 20D AS roi_max_rt")
    merged = peaks.in_regions(p, roi, 4.0, 4.0)
    assert merged.count() == len(rows)
    every = merged.withColumn("again", queries.F.explode(queries.F.array_repeat(queries.F.lit(1), 3))).drop("n", "again")
    a, b = peaks.raw_moments(merged).first().asDict(), peaks.raw_moments(every).first().asDict()
    assert a["raw_roi_num_points"] == 3 * len(rows) and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_scans_of_a_region_are_counted_without_their_times(spark):
    """Scans are those of a plain loop, and no aggregation has the times of points among its keys."""
    r = np.random.default_rng(5)
    rows = [(int(f), float(m), float(t), float(v)) for f, m, t, v in zip(r.integers(0, 2, 400), r.integers(3980, 4020, 400) / 10, r.integers(0, 30, 400), r.integers(1, 4, 400))]
    p = spark.createDataFrame(rows + rows[:50], "file_id int, mz double, rt double, intensity double")
    boxes = [(f, 400.0 + k / 10, 9.0 + k, 5.0, 1.0, 1.0, 399.5 + k / 10, 400.5 + k / 10, 2.0, 16.0 + k) for f in (0, 1) for k in (0, 3, 7)]
    roi = spark.createDataFrame(boxes, ", ".join(f"{c} {'int' if c == 'file_id' else 'double'}" for c in peaks.ROI_KEY))
    m = peaks.raw_moments(peaks.in_regions(p, roi, 0.3, 4.0))
    got = {(r.file_id, r.local_max_mz): (r.raw_roi_num_scans, r.raw_roi_num_points) for r in m.collect()}
    inside = {(b[0], b[1]): [x for x in rows + rows[:50] if x[0] == b[0] and b[6] <= x[1] <= b[7] and b[8] <= x[2] <= b[9]] for b in boxes}
    assert got == {k: (len({x[2] for x in v}), len(v)) for k, v in inside.items()} and min(n for n, _ in got.values()) > 5
    assert "distinct" not in m._jdf.queryExecution().optimizedPlan().toString().lower()
