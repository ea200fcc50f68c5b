"""Registered queries of the engine, each with the SQL that gives the same rows where SQL can express it.

The tables stand in for domain data through ``mzloom.adapters``; every query runs over whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mzloom.adapters import duckdb_view, view
from mzloom.functions import exprs as X
from mzloom.operators import features, grid, link, match, peaks, points, proteins, quant, similarity, summary, warp
from mzloom.params import Resampling, Run, Warping
from mzloom.sources import encode, files, identifications, sinks, spectra
from mzloom.storage import materialise, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Acquisition settings that suit the stand-in tables.
RUN = Run("orbitrap", resolution_ms1=2000, fwhm_rt=20)
GRID_RUN = Run("quad", resolution_ms1=100, reference_mz=200, fwhm_rt=86_400)
GRID = Resampling()
FILES = list(range(7))


def query(*views: str, sql: str | None = None):
    """Register a query; it gets the named views as arguments."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[view(spark, sf_dir, v) for v in views])

        QUERIES[f.__name__] = run
        if sql:
            lead = ", ".join(duckdb_view(v) for v in views)
            body = sql.strip()
            ORACLES[f.__name__] = f"WITH RECURSIVE {lead}, {body[5:]}" if body.startswith("WITH ") else f"WITH {lead} {body}"
        return f

    return add


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- points -----------------------------------------------------------------------------------


@query("points", sql="SELECT file_id, rt, sum(CASE WHEN mz BETWEEN 400 AND 800 THEN intensity ELSE 0.0 END) AS intensity FROM points GROUP BY file_id, rt")
def xic_sum(p):
    return points.xic(p, 400, 800)


@query("points", sql="SELECT file_id, rt, greatest(0.0, max(CASE WHEN mz BETWEEN 400 AND 410 THEN intensity ELSE 0.0 END)) AS intensity FROM points WHERE rt BETWEEN 100 AND 2000 GROUP BY file_id, rt")
def xic_max(p):
    return points.xic(p, 400, 410, 100, 2000, "max")


@query("points", sql="SELECT file_id, rt, sum(intensity) AS intensity FROM points GROUP BY file_id, rt")
def total_ion_current(p):
    return points.xic(p)


@query("points", sql="SELECT file_id, rt, max(intensity) AS intensity FROM points GROUP BY file_id, rt")
def base_peak(p):
    return points.xic(p, method="max")


@query("points", sql="SELECT file_id, rt, mz, intensity FROM points WHERE mz BETWEEN 500 AND 600 AND rt BETWEEN 300 AND 900")
def raw_points(p):
    return points.raw_points(p, 500, 600, 300, 900)


@query("points", sql="SELECT file_id, count(*) AS num_points, count(DISTINCT rt) AS num_scans FROM points WHERE mz BETWEEN 500 AND 600 AND rt BETWEEN 300 AND 900 GROUP BY file_id")
def count_raw_points(p):
    return points.count_points(points.raw_points(p, 500, 600, 300, 900))


@query(
    "points", "peaks",
    sql="""SELECT r.file_id, r.peak_id, p.rt, sum(CASE WHEN p.mz BETWEEN r.fitted_mz - 2 * fitted_sigma_mz AND r.fitted_mz + 2 * fitted_sigma_mz THEN p.intensity ELSE 0.0 END) AS intensity
           FROM peaks r JOIN points p ON p.file_id = r.file_id AND p.rt BETWEEN r.fitted_rt - fitted_sigma_rt AND r.fitted_rt + fitted_sigma_rt
           GROUP BY r.file_id, r.peak_id, p.rt""",
)
def peak_chromatograms(p, k):
    s_mz, s_rt = F.col("fitted_sigma_mz"), F.col("fitted_sigma_rt")
    k = k.select("file_id", "peak_id", (F.col("fitted_mz") - 2 * s_mz).alias("roi_min_mz"), (F.col("fitted_mz") + 2 * s_mz).alias("roi_max_mz"), (F.col("fitted_rt") - s_rt).alias("roi_min_rt"), (F.col("fitted_rt") + s_rt).alias("roi_max_rt"))
    return points.peak_xic(p, k, 20.0)


@query(
    "points",
    sql="""SELECT file_id, rt, mz, round(0.1 * power(mz / 200, 1.5), 9) AS orbitrap, round(0.1 * power(mz / 200, 2), 9) AS fticr, round(0.1 * power(mz / 200, 1.0), 9) AS tof, round(0.1, 9) AS quad,
           round(0.1 * power(mz / 200, 1.5) / (2 * sqrt(2 * ln(2))), 9) AS sigma FROM points""",
)
def theoretical_widths(p):
    runs = {k: Run(k, resolution_ms1=2000) for k in X.EXPONENT}
    return p.select("file_id", "rt", "mz", *[F.round(X.theoretical_fwhm("mz", r), 9).alias(k) for k, r in runs.items()], F.round(X.sigma_mz("mz", runs["orbitrap"]), 9).alias("sigma"))


@query(
    "points",
    sql="""SELECT file_id, rt, mz, CAST(floor(10 / (0.1 / power(200, 1.5)) * (1 / sqrt(300) - 1 / sqrt(mz)) + 1e-9) AS BIGINT) AS orbitrap,
           CAST(floor(5 * (1 - 300 / mz) * 40000 / (0.1 * 300) + 1e-9) AS BIGINT) AS fticr, CAST(floor(5 * 200 / 0.1 * ln(mz / 300) + 1e-9) AS BIGINT) AS tof,
           CAST(floor(5 * (mz - 300) / 0.1 + 1e-9) AS BIGINT) AS quad, CAST(ceil(rt / (20 / 5.0)) AS BIGINT) AS y FROM points""",
)
def grid_indexes(p):
    runs = {k: Run(k, resolution_ms1=2000, fwhm_rt=20) for k in X.EXPONENT}

    def at(r):  # a billionth of a bin guards against last-bit differences between engines
        return X.x_index("mz", 300, r, 5, 1e-9)

    return p.select("file_id", "rt", "mz", *[at(r).alias(k) for k, r in runs.items()], X.y_index("rt", 0, runs["quad"], 5).alias("y"))


@query(
    "points",
    sql="""WITH r AS (SELECT file_id, rt, mz, 0.1 / power(200, 1.5) AS a, CAST(floor((mz - 300) * 2) AS BIGINT) AS i FROM points)
           SELECT file_id, rt, mz, round(power(1 / sqrt(300) - i * (a / 10), -2), 6) AS orbitrap, round(300 / (1 - i * 0.1 * 300 / (5 * 40000)), 6) AS fticr,
                  round(300 * exp(i * 0.1 / (5 * 200)), 6) AS tof, round(300 + i * CAST(1100 AS DOUBLE) / 54999, 6) AS quad FROM r""",
)
def grid_mz_positions(p):
    runs = {k: Run(k, resolution_ms1=2000) for k in X.EXPONENT}
    p = p.withColumn("i", F.floor((F.col("mz") - 300) * 2))
    return p.select("file_id", "rt", "mz", *[F.round(X.mz_at("i", 300, 1400, 55_000, r, 5), 6).alias(k) for k, r in runs.items()])


# --- grid -------------------------------------------------------------------------------------

_DIMS = """b AS (SELECT file_id, min(mz) AS min_mz, max(mz) AS max_mz, min(rt) AS min_rt, max(rt) AS max_rt FROM signal GROUP BY file_id),
g AS (SELECT *, CAST(floor(5 * (max_mz - min_mz) / 2.0) AS BIGINT) + 1 AS n, CAST(ceil((max_rt - min_rt) / 17280.0) AS BIGINT) + 1 AS m FROM b),
k AS (SELECT 2.0 / (2 * sqrt(2 * ln(2))) * 0.4 / sqrt(2) AS s_mz, 86400 / (2 * sqrt(2 * ln(2))) * 0.4 / sqrt(2) AS s_rt),
"""
_SPLAT = _DIMS + """p AS (SELECT row_number() OVER () AS id, s.file_id, s.rt, s.mz, s.intensity, g.*, CAST(floor(5 * (s.mz - min_mz) / 2.0) AS BIGINT) AS ci, CAST(ceil((s.rt - min_rt) / 17280.0) AS BIGINT) AS cj
       FROM signal s JOIN g ON g.file_id = s.file_id),
w AS (SELECT id, p.file_id, intensity, i, j,
       exp(-0.5 * (power((min_mz + i * (max_mz - min_mz) / (n - 1) - mz) / s_mz, 2) + power((min_rt + j * (max_rt - min_rt) / (m - 1) - rt) / s_rt, 2))) AS w
      FROM p, k, generate_series(greatest(ci - 5, 0), least(ci + 5, n - 1)) a(i), generate_series(greatest(cj - 5, 0), least(cj + 5, m - 1)) c(j)),
t AS (SELECT id, sum(w) AS t FROM w GROUP BY id),
cells AS (SELECT file_id, i, j, sum(w / t * intensity) AS value FROM w JOIN t USING (id) GROUP BY file_id, i, j)"""


def _bounds(s):
    return grid.bounds_of(s)


@query("signal", sql="WITH " + _SPLAT + " SELECT file_id, i, j, round(value, 5) AS value FROM cells")
def grid_splat(s):
    return rounded(grid.splat(s, _bounds(s), GRID_RUN, GRID), 5, "value")


@query(
    "signal",
    sql="WITH " + _SPLAT + """,
    kr AS (SELECT file_id, a.j, c.j AS o, exp(-0.5 * power((c.j - a.j) * (max_rt - min_rt) / (m - 1) / s_rt, 2)) AS w FROM g, k, generate_series(0, m - 1) a(j), generate_series(greatest(a.j - 5, 0), least(a.j + 5, m - 1)) c(j)),
    sr AS (SELECT cells.file_id, cells.i, kr.j, sum(value * w) AS up FROM cells JOIN kr ON kr.file_id = cells.file_id AND kr.o = cells.j GROUP BY ALL),
    nr AS (SELECT file_id, j, sum(w) AS down FROM kr GROUP BY ALL)
    SELECT sr.file_id, i, sr.j, round(up / down, 5) AS value FROM sr JOIN nr ON nr.file_id = sr.file_id AND nr.j = sr.j""",
)
def grid_smooth_rt(s):
    b = _bounds(s)
    return rounded(grid.smooth_rt(grid.splat(s, b, GRID_RUN, GRID), b, GRID_RUN, GRID), 5, "value")


_RESAMPLED = "WITH " + _SPLAT + """,
    kr AS (SELECT file_id, a.j, c.j AS o, exp(-0.5 * power((c.j - a.j) * (max_rt - min_rt) / (m - 1) / s_rt, 2)) AS w FROM g, k, generate_series(0, m - 1) a(j), generate_series(greatest(a.j - 5, 0), least(a.j + 5, m - 1)) c(j)),
    sr AS (SELECT cells.file_id, cells.i, kr.j, sum(value * w) AS up FROM cells JOIN kr ON kr.file_id = cells.file_id AND kr.o = cells.j GROUP BY ALL),
    nr AS (SELECT file_id, j, sum(w) AS down FROM kr GROUP BY ALL),
    rt_smooth AS (SELECT sr.file_id, i, sr.j, up / down AS value FROM sr JOIN nr ON nr.file_id = sr.file_id AND nr.j = sr.j),
    km AS (SELECT file_id, a.i, c.i AS o, exp(-0.5 * power((c.i - a.i) * (max_mz - min_mz) / (n - 1) / s_mz, 2)) AS w FROM g, k, generate_series(0, n - 1) a(i), generate_series(greatest(a.i - 5, 0), least(a.i + 5, n - 1)) c(i)),
    sm AS (SELECT r.file_id, km.i, r.j, sum(value * w) AS up FROM rt_smooth r JOIN km ON km.file_id = r.file_id AND km.o = r.i GROUP BY ALL),
    nm AS (SELECT file_id, i, sum(w) AS down FROM km GROUP BY ALL),
    smooth AS (SELECT sm.file_id, sm.i, sm.j, up / down AS value FROM sm JOIN nm ON nm.file_id = sm.file_id AND nm.i = sm.i)"""


_MAXIMA = """,
    q AS MATERIALIZED (SELECT file_id, i, j, round(value, 6) AS value FROM smooth),
    moved AS (SELECT file_id, i, j, value AS own, CAST(NULL AS DOUBLE) AS other FROM q UNION ALL SELECT file_id, i + di, j + dj, CAST(NULL AS DOUBLE), value FROM q, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(di, dj)),
    best AS (SELECT file_id, i, j, max(own) AS value, max(other) AS other FROM moved GROUP BY ALL),
    top AS MATERIALIZED (SELECT best.file_id, best.i, best.j, best.value FROM best JOIN g ON g.file_id = best.file_id WHERE value > 0 AND value > coalesce(other, 0) AND best.i BETWEEN 1 AND n - 2 AND best.j BETWEEN 1 AND m - 2)"""


@query("signal", sql=_RESAMPLED + " SELECT file_id, i, j, round(value, 5) AS value FROM smooth")
def grid_resample(s):
    return rounded(grid.resample(s, _bounds(s), GRID_RUN, GRID), 5, "value")


@query(
    "signal",
    sql=_RESAMPLED + _MAXIMA + " SELECT * FROM top",
)
def grid_local_maxima(s):
    return grid.maxima_of(s, _bounds(s), GRID_RUN, GRID, digits=6)


@query("signal", sql="WITH " + _SPLAT + " SELECT file_id, i, round(sum(value), 4) AS value FROM cells GROUP BY file_id, i")
def grid_marginal_mz(s):
    return rounded(grid.marginals(grid.splat(s, _bounds(s), GRID_RUN, GRID), "i"), 4, "value")


@query(
    "signal",
    sql="WITH " + _SPLAT + """ SELECT c.file_id, c.j, round(min_rt + c.j * (max_rt - min_rt) / (m - 1), 2) AS rt, round(sum(value), 4) AS intensity FROM cells c JOIN g ON g.file_id = c.file_id
        WHERE min_mz + c.i * (max_mz - min_mz) / (n - 1) > 420.1 AND min_mz + c.i * (max_mz - min_mz) / (n - 1) < 440.1 GROUP BY c.file_id, c.j, min_rt, max_rt, m""",
)
def grid_smoothed_xic(s):
    b = _bounds(s)
    cells = grid.locate(grid.splat(s, b, GRID_RUN, GRID), b, GRID_RUN, GRID)
    return rounded(summary.smoothed_xic(cells, 420.1, 440.1, float("-inf"), float("inf")), 4, "intensity").withColumn("rt", F.round("rt", 2))


# --- peaks ------------------------------------------------------------------------------------

_ROI_RUN = GRID_RUN
_ROI = _RESAMPLED + _MAXIMA + """,
    s AS (SELECT 2.0 / (2 * sqrt(2 * ln(2))) AS sm, 86400 / (2 * sqrt(2 * ln(2))) AS sr),
    r AS MATERIALIZED (SELECT t.file_id, t.i, t.j, min_mz + t.i * (max_mz - min_mz) / (n - 1) AS lm, min_rt + t.j * (max_rt - min_rt) / (m - 1) AS lr FROM top t JOIN g ON g.file_id = t.file_id),
    x AS MATERIALIZED (SELECT r.file_id, i, j, lm, lr, p.mz, p.rt, p.intensity AS w FROM r, s JOIN signal p ON p.file_id = r.file_id AND p.mz BETWEEN lm - 2 * sm AND lm + 2 * sm AND p.rt BETWEEN lr - 2 * sr AND lr + 2 * sr),
    a AS (SELECT file_id, i, j, sum(w) AS sw, max(w) AS mw, count(*) AS np, count(DISTINCT rt) AS ns, sum(w * mz) / sum(w) AS am, sum(w * rt) / sum(w) AS ar FROM x GROUP BY ALL HAVING count(DISTINCT rt) >= 3),
    c AS (SELECT a.file_id, a.i, a.j, max(lm) AS lm, max(lr) AS lr, max(sw) AS sw, max(mw) AS mw, max(np) AS np, max(ns) AS ns, max(am) AS am, max(ar) AS ar, sum(w * power(mz - am, 2)) / max(sw) AS m2, sum(w * power(mz - am, 3)) / max(sw) AS m3,
          sum(w * power(rt - ar, 2)) / max(sw) AS r2, sum(w * power(rt - ar, 4)) / max(sw) AS r4 FROM a JOIN x ON x.file_id = a.file_id AND x.i = a.i AND x.j = a.j GROUP BY a.file_id, a.i, a.j)"""


def _maxima(s):
    """Local maxima of the smoothed grid; values are rounded so that both engines see the same ones."""
    b = _bounds(s)
    return grid.locate(grid_local_maxima(s), b, GRID_RUN, GRID)


@query("signal", sql=_ROI + " SELECT file_id, round(lm, 6) AS mz, round(lr, 2) AS rt, round(sw, 6) AS total, mw AS highest, np AS num_points, ns AS num_scans, round(am, 6) AS mean_mz, round(ar, 2) AS mean_rt, round(sqrt(m2), 5) AS sigma_mz, round(sqrt(r2), 1) AS sigma_rt, CASE WHEN m2 > 1e-9 THEN round(m3 / power(m2, 1.5), 3) END AS skewness_mz, round(r4 / power(r2, 2), 3) AS kurtosis_rt FROM c")
def region_moments(p):
    m = peaks.raw_moments(peaks.in_regions(p, peaks.regions(_maxima(p), _ROI_RUN), 4.0, 4 * X.sigma_rt(_ROI_RUN)))
    c = F.col
    return m.select(
        "file_id", F.round("local_max_mz", 6).alias("mz"), F.round("local_max_rt", 2).alias("rt"), F.round("raw_roi_total_intensity", 6).alias("total"), c("raw_roi_max_height").alias("highest"),
        c("raw_roi_num_points").alias("num_points"), c("raw_roi_num_scans").alias("num_scans"), F.round("raw_roi_mean_mz", 6).alias("mean_mz"), F.round("raw_roi_mean_rt", 2).alias("mean_rt"),
        F.round("raw_roi_sigma_mz", 5).alias("sigma_mz"), F.round("raw_roi_sigma_rt", 1).alias("sigma_rt"),
        F.when(c("raw_roi_sigma_mz") * c("raw_roi_sigma_mz") > 1e-9, F.round("raw_roi_skewness_mz", 3)).alias("skewness_mz"), F.round("raw_roi_kurtosis_rt", 3).alias("kurtosis_rt"),
    )


@query("signal")
def find_peaks(p):
    return peaks.find_peaks(p, _maxima(p), _ROI_RUN, 1_000_000, bin_mz=4.0).drop("fit")


@query("signal")
def find_failed_peaks(p):
    f = peaks.find_peaks(p, _maxima(p), _ROI_RUN, 1_000_000, centroid=True, failed=True, bin_mz=4.0)
    return f.select("file_id", "peak_id", "fit_failure_code", "peak_fit_failure", peaks.failure_text("fit_failure_code").alias("errors"))


#: Fit of the centroid model: three unknowns by Cramer's rule, then every failure bit that this model can have. Heights are doubles: below exp(-745.13...) one is zero,
#: which is not positive, and beyond exp(709.78...) it is infinite.
_CENTROID = _ROI + """,
    q3 AS (SELECT x.file_id, x.i, x.j, x.lm, x.lr, (x.mz - x.lm) / sm AS u, (x.rt - x.lr) / sr AS v, x.w FROM x JOIN c ON c.file_id = x.file_id AND c.i = x.i AND c.j = x.j, s),
    z3 AS (SELECT *, CASE WHEN w > 0 THEN power(w * exp(-0.5 * (u * u + v * v)), 2) ELSE 0 END AS k, CASE WHEN w > 0 THEN ln(w) ELSE 0 END + 0.5 * u * u AS y FROM q3),
    t3 AS (SELECT file_id, i, j, max(lm) AS lm, max(lr) AS lr, sum(k) AS s0, sum(k * v) AS s1, sum(k * v * v) AS s2, sum(k * v * v * v) AS s3, sum(k * v * v * v * v) AS s4, sum(k * y) AS t0, sum(k * v * y) AS t1, sum(k * v * v * y) AS t2 FROM z3 GROUP BY ALL),
    d3 AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det FROM t3),
    f3 AS (SELECT *, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det AS a, (s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / det AS d,
          (s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / det AS e FROM d3),
    g3 AS (SELECT f3.*, a - d * d / (4 * e) AS lnh, f3.lr - d / (2 * e) * sr AS frt, CASE WHEN e < 0 THEN sqrt(-0.5 / e) * sr END AS fs, sr, sqrt(greatest(c.m2, 0)) AS rm, sqrt(greatest(c.r2, 0)) AS rr, c.mw FROM f3 JOIN c ON c.file_id = f3.file_id AND c.i = f3.i AND c.j = f3.j, s),
    fits AS (SELECT *, CASE WHEN e >= 0 THEN (1 << 12) | (1 << 17) ELSE 0 END + CASE WHEN rm <= 1e-6 THEN 1 << 28 ELSE 0 END + CASE WHEN rr <= 0 THEN 1 << 29 ELSE 0 END + CASE WHEN lnh > ln(2 * mw) THEN 1 << 30 ELSE 0 END
          + CASE WHEN lnh < CAST(-745.1332191019412 AS DOUBLE) THEN 1 << 23 ELSE 0 END + CASE WHEN lnh > CAST(709.782712893384 AS DOUBLE) THEN 1 << 18 ELSE 0 END
          + CASE WHEN frt < lr - 3 * sr THEN CAST(1 AS BIGINT) << 33 ELSE 0 END + CASE WHEN frt > lr + 3 * sr THEN CAST(1 AS BIGINT) << 34 ELSE 0 END
          + CASE WHEN fs <= sr / 3 THEN CAST(1 AS BIGINT) << 36 ELSE 0 END + CASE WHEN fs >= 3 * sr THEN CAST(1 AS BIGINT) << 38 ELSE 0 END AS code FROM g3)"""


def _centroid_fits(p):
    return peaks.find_peaks(p, _maxima(p), _ROI_RUN, 1_000_000, centroid=True, failed=True, bin_mz=4.0)


@query("signal", sql=_CENTROID + " SELECT file_id, round(lm, 6) AS mz, round(lr, 2) AS rt, code AS fit_failure_code, code <> 0 AS peak_fit_failure FROM fits")
def centroid_failures(p):
    """Whether the width of a region of one m/z is zero or a rounding error is no question here: the bit is set for both."""
    one = F.lit(1 << 28)
    code = F.col("fit_failure_code").bitwiseAND(F.lit(~(1 << 28))).bitwiseOR(F.when(F.col("raw_roi_sigma_mz") <= 1e-6, one).otherwise(0))
    return _centroid_fits(p).select("file_id", F.round("local_max_mz", 6).alias("mz"), F.round("local_max_rt", 2).alias("rt"), code.alias("fit_failure_code"), (code != 0).alias("peak_fit_failure"))


@query("signal", sql=_CENTROID + " SELECT file_id, round(lm, 6) AS fitted_mz, round(frt, 1) AS fitted_rt, round(lnh, 4) + CAST(0 AS DOUBLE) AS log_height, round(fs / sr, 5) AS width, round(lnh + ln(fs / sr), 4) + CAST(0 AS DOUBLE) AS log_volume FROM fits WHERE code = 0")
def centroid_peaks(p):
    f = peaks.find_peaks(p, _maxima(p), _ROI_RUN, 1_000_000, centroid=True, bin_mz=4.0).where("raw_roi_sigma_mz > 1e-6")
    width = F.col("fitted_sigma_rt") / X.sigma_rt(_ROI_RUN)
    volume = F.col("fitted_volume") / (F.col("fitted_sigma_mz") * X.sigma_rt(_ROI_RUN) * 6.283185307179586)
    return f.select("file_id", F.round("fitted_mz", 6).alias("fitted_mz"), F.round("fitted_rt", 1).alias("fitted_rt"), (F.round(F.log("fitted_height"), 4) + 0.0).alias("log_height"), F.round(width, 5).alias("width"), (F.round(F.log(volume), 4) + 0.0).alias("log_volume"))


_TERM = ["1", "u", "u * u", "v", "v * v"]


def _elimination() -> str:
    """Gauss elimination of the 5 x 5 normal equations, one unknown per CTE, then the unknowns from the last to the first."""
    ids, n = "file_id, i, j", range(5)
    out = "e0 AS (SELECT " + ids + ", max(lm) AS lm, max(lr) AS lr, " + ", ".join([f"sum(k * {_TERM[r]} * {_TERM[c]}) AS a{r}{c}" for r in n for c in n] + [f"sum(k * y * {_TERM[r]}) AS b{r}" for r in n]) + f" FROM w3 GROUP BY {ids} HAVING count(DISTINCT mz) >= 3 AND count(DISTINCT rt) >= 5 AND count(*) >= 6)"
    for k in range(4):
        rows = [f"a{r}{c} - a{r}{k} / a{k}{k} * a{k}{c} AS a{r}{c}" if r > k else f"a{r}{c}" for r in n for c in n] + [f"b{r} - a{r}{k} / a{k}{k} * b{k} AS b{r}" if r > k else f"b{r}" for r in n]
        out += f", e{k + 1} AS (SELECT {ids}, lm, lr, {', '.join(rows)} FROM e{k})"
    for k in (4, 3, 2, 1, 0):
        out += f", x{k} AS (SELECT *, (b{k}" + "".join(f" - a{k}{c} * p{c}" for c in range(k + 1, 5)) + f") / a{k}{k} AS p{k} FROM {'e4' if k == 4 else f'x{k + 1}'})"
    return out


@query("signal", sql=_ROI + """,
    q3 AS (SELECT x.file_id, x.i, x.j, x.lm, x.lr, x.mz, x.rt, (x.mz - x.lm) / sm AS u, (x.rt - x.lr) / sr AS v, x.w FROM x, s),
    w3 AS (SELECT *, CASE WHEN w > 0 THEN power(w * exp(-0.5 * (u * u + v * v)), 2) ELSE 0 END AS k, CASE WHEN w > 0 THEN ln(w) ELSE 0 END AS y FROM q3),
    """ + _elimination() + """
    SELECT file_id, round(lm, 6) AS mz, round(lr, 2) AS rt, round(p0, 3) + CAST(0 AS DOUBLE) AS a, round(p1, 3) + CAST(0 AS DOUBLE) AS b, round(p2, 3) + CAST(0 AS DOUBLE) AS c, round(p3, 3) + CAST(0 AS DOUBLE) AS d, round(p4, 3) + CAST(0 AS DOUBLE) AS e,
           CASE WHEN p2 < 0 AND p4 < 0 THEN round(p0 - p1 * p1 / (4 * p2) - p3 * p3 / (4 * p4), 2) + CAST(0 AS DOUBLE) END AS log_height FROM x0""")
def gaussian_fits(p):
    """Parameters of the two-dimensional fit of all regions with enough points for five unknowns."""
    members = peaks.in_regions(p, peaks.regions(_maxima(p), _ROI_RUN), 4.0, 4 * X.sigma_rt(_ROI_RUN))
    enough = members.groupBy("file_id", "local_max_mz", "local_max_rt").agg(F.countDistinct("mz").alias("n_mz"), F.countDistinct("rt").alias("n_rt"), F.sum("n").alias("n")).where("n_mz >= 3 and n_rt >= 5 and n >= 6")
    f = peaks.fit(peaks.raw_moments(members)).join(enough.select("file_id", "local_max_mz", "local_max_rt"), ["file_id", "local_max_mz", "local_max_rt"])
    height = F.when((F.col("fit.c") < 0) & (F.col("fit.e") < 0), F.round(peaks.log_height(), 2) + 0.0)
    return f.select("file_id", F.round("local_max_mz", 6).alias("mz"), F.round("local_max_rt", 2).alias("rt"), *[(F.round(f"fit.{x}", 3) + 0.0).alias(x) for x in "abcde"], height.alias("log_height"))


@query("points", "peaks", sql="""WITH a AS MATERIALIZED (SELECT file_id, peak_id, fitted_mz - fitted_sigma_mz AS m0, fitted_mz + fitted_sigma_mz AS m1, fitted_rt - fitted_sigma_rt AS r0, fitted_rt + fitted_sigma_rt AS r1, CAST(floor(fitted_mz) AS BIGINT) + k AS bin FROM peaks, (VALUES (-2), (-1), (0), (1), (2)) d(k)),
    b AS MATERIALIZED (SELECT file_id, mz, rt, intensity, CAST(floor(mz) AS BIGINT) AS bin FROM points)
    SELECT a.file_id, peak_id, mz, rt, intensity, round(sqrt(intensity), 9) AS shade FROM a JOIN b ON a.bin = b.bin AND a.file_id = b.file_id WHERE mz BETWEEN m0 AND m1 AND rt BETWEEN r0 AND r1""")
def peak_raw_points(p, k):
    for axis in ("mz", "rt"):
        k = k.withColumns({f"roi_min_{axis}": F.col(f"fitted_{axis}") - F.col(f"fitted_sigma_{axis}"), f"roi_max_{axis}": F.col(f"fitted_{axis}") + F.col(f"fitted_sigma_{axis}")})
    return rounded(points.peak_points(p, k, 2.0, 30.0), 9, "shade")


@query("peaks", sql="SELECT file_id, k - 1 AS peak_id, fitted_mz, fitted_rt, fitted_height FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY fitted_height DESC, fitted_mz, fitted_rt) AS k FROM peaks) x WHERE k <= 1000")
def highest_peaks(k):
    k = k.drop("peak_id").withColumn("local_max_mz", F.col("fitted_mz")).withColumn("local_max_rt", F.col("fitted_rt"))
    return peaks.rank(k, 1000).select("file_id", "peak_id", "fitted_mz", "fitted_rt", "fitted_height")


@query(
    "edges",
    sql="SELECT protein, peptide, code, 'Fit Failure Errors:' || chr(10) || CASE WHEN code = 0 THEN 'No errors detected.' ELSE array_to_string(list_transform(list_filter(range(1, 40), lambda n: (code >> (n - 1)) & 1 = 1), lambda n: '- ' || t[n]), chr(10)) END || chr(10) AS errors "
    "FROM (SELECT protein, peptide, CASE WHEN peptide % 10 = 0 THEN 0 ELSE (CAST(1 AS BIGINT) << (peptide % 39)) | (CAST(1 AS BIGINT) << (protein % 39)) END AS code, [" + ", ".join("'" + t.replace("'", "''") + "'" for t in peaks.FAILURES) + "] AS t FROM edges) x",
)
def failure_messages(e):
    one = F.lit(1).cast("long")
    code = F.when(F.col("peptide") % 10 == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", one, (F.col("peptide") % 39).cast("int")).bitwiseOR(F.call_function("shiftleft", one, (F.col("protein") % 39).cast("int"))))
    e = e.withColumn("code", code)
    return e.select("protein", "peptide", "code", peaks.failure_text("code").alias("errors"))


@query("points", sql="SELECT file_id, mz AS fitted_mz, rt AS fitted_rt, intensity AS fitted_height, mz - 0.03 AS roi_min_mz, mz + 0.03 AS roi_max_mz, rt - 45 AS roi_min_rt, rt + 45 AS roi_max_rt, round(intensity * 2 * pi() * 0.01 * 15, 6) AS fitted_volume FROM points")
def make_peaks(p):
    out = peaks.from_arrays(p)
    return rounded(out.select("file_id", "fitted_mz", "fitted_rt", "fitted_height", "roi_min_mz", "roi_max_mz", "roi_min_rt", "roi_max_rt", "fitted_volume"), 6, "fitted_volume")


@query("points", sql="SELECT file_id, mz AS fitted_mz, rt AS fitted_rt, round(mz - 2 * 0.02, 6) AS roi_min_mz, round(mz + 2 * 0.02, 6) AS roi_max_mz, rt - 20 AS roi_min_rt, rt + 20 AS roi_max_rt FROM points")
def create_peaks_from_arrays(p):
    out = peaks.from_arrays(p, 0.02, 10.0, roi=2.0)
    return rounded(out.select("file_id", "fitted_mz", "fitted_rt", "roi_min_mz", "roi_max_mz", "roi_min_rt", "roi_max_rt"), 6, "roi_min_mz", "roi_max_mz")


@query("peaks", sql="SELECT file_id, peak_id, fitted_height FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY fitted_height DESC, peak_id) AS k FROM peaks) x WHERE k <= 2000")
def top_peaks(k):
    return similarity.top_peaks(k, 2000).select("file_id", "peak_id", "fitted_height")


# --- similarity and alignment -----------------------------------------------------------------

_SIM = """t AS (SELECT * FROM (SELECT *, fitted_rt + rt_delta AS art, row_number() OVER (PARTITION BY file_id ORDER BY fitted_height DESC, peak_id) AS k FROM peaks) x WHERE k <= 2000),
    o AS (SELECT a.file_id AS file_a, b.file_id AS file_b, sum(a.fitted_height * b.fitted_height
        * power(a.fitted_sigma_rt * b.fitted_sigma_rt, 2) * exp(-0.5 * power(a.art - b.art, 2) / (power(a.fitted_sigma_rt, 2) + power(b.fitted_sigma_rt, 2))) / sqrt(power(a.fitted_sigma_rt, 2) + power(b.fitted_sigma_rt, 2))
        * power(a.fitted_sigma_mz * b.fitted_sigma_mz, 2) * exp(-0.5 * power(a.fitted_mz - b.fitted_mz, 2) / (power(a.fitted_sigma_mz, 2) + power(b.fitted_sigma_mz, 2))) / sqrt(power(a.fitted_sigma_mz, 2) + power(b.fitted_sigma_mz, 2))) AS overlap
      FROM t a JOIN t b ON a.file_id <= b.file_id AND abs(a.fitted_mz - b.fitted_mz) <= 3 * (a.fitted_sigma_mz + b.fitted_sigma_mz) AND abs(a.art - b.art) <= 3 * (a.fitted_sigma_rt + b.fitted_sigma_rt) GROUP BY ALL),
    f AS (SELECT DISTINCT file_id FROM peaks),
    p AS (SELECT x.file_id AS file_a, y.file_id AS file_b FROM f x JOIN f y ON x.file_id <= y.file_id),
    s AS (SELECT p.file_a, p.file_b, coalesce(sa.overlap, 0) AS self_a, coalesce(sb.overlap, 0) AS self_b, coalesce(o.overlap, 0) AS overlap
          FROM p LEFT JOIN o ON o.file_a = p.file_a AND o.file_b = p.file_b LEFT JOIN o sa ON sa.file_a = p.file_a AND sa.file_b = p.file_a LEFT JOIN o sb ON sb.file_a = p.file_b AND sb.file_b = p.file_b),
    z AS (SELECT *, CASE WHEN self_a * self_b <> 0 THEN overlap / sqrt(self_a * self_b) ELSE 0 END AS geometric_ratio, CASE WHEN self_a * self_b <> 0 THEN 2 * overlap / (self_a + self_b) ELSE 0 END AS mean_ratio FROM s)"""


@query("peaks", sql="WITH " + _SIM + " SELECT file_a, file_b, round(self_a, 2) AS self_a, round(self_b, 2) AS self_b, round(overlap, 2) AS overlap, round(geometric_ratio, 6) AS geometric_ratio, round(mean_ratio, 6) AS mean_ratio FROM z")
def find_similarity(k):
    return rounded(rounded(similarity.similarity(k, 2000), 2, "self_a", "self_b", "overlap"), 6, "geometric_ratio", "mean_ratio")


@query("peaks", sql="WITH " + _SIM + ", y AS (SELECT file_a, file_b, round(geometric_ratio, 6) AS v FROM z UNION ALL SELECT file_b, file_a, round(geometric_ratio, 6) FROM z WHERE file_a <> file_b) SELECT file_a AS file_id, " + ", ".join(f"max(v) FILTER (file_b = {f}) AS f{f}" for f in FILES) + " FROM y GROUP BY file_a")
def similarity_matrix(k):
    return rounded(similarity.similarity_matrix(similarity.similarity(k, 2000), FILES), 6, *[f"f{f}" for f in FILES])


@query("peaks", sql="WITH " + _SIM + ", y AS (SELECT file_a, geometric_ratio AS v FROM z UNION ALL SELECT file_b, geometric_ratio FROM z WHERE file_a <> file_b) SELECT file_a AS file_id FROM (SELECT file_a, round(sum(v), 9) AS t FROM y GROUP BY file_a) q ORDER BY t DESC, file_a LIMIT 1")
def reference_run(k):
    return similarity.reference_run(similarity.similarity(k, 2000))


_RANGES = """own AS (SELECT file_id, min(fitted_rt) AS lo, max(fitted_rt) AS hi FROM peaks GROUP BY file_id),
    both_ AS (SELECT o.file_id, least(o.lo, r.lo) AS a, greatest(o.hi, r.hi) AS b FROM own o, (SELECT lo, hi FROM own WHERE file_id = 0) r),
    wide AS (SELECT *, a - (b - a) * CAST(0.2 AS DOUBLE) AS rt_min FROM both_),
    rg AS (SELECT file_id, rt_min, (b + (b - rt_min) * CAST(0.2 AS DOUBLE) - rt_min) / 1999 AS delta FROM wide),
    l AS (SELECT i AS level, greatest(i * 70, 2000 - (20 - i) * 130) AS start, least(i * 130, 2000 - (20 - i) * 70) AS "end" FROM range(0, 21) t(i))"""


def _node_times(nodes, ranges, *columns):
    """Times of nodes in the ranges of runs; both sides are small (levels and runs)."""
    delta = (F.col("rt_max") - F.col("rt_min")) / 1999
    j = ranges.crossJoin(F.broadcast(nodes))
    return j.select("file_id", *nodes.columns, *[F.round(F.col("rt_min") + F.col(c) * delta, 6).alias(f"{c}_rt") for c in columns])


@query("peaks", sql="WITH " + _RANGES + ' SELECT file_id, level, start, "end", round(rt_min + start * delta, 6) AS start_rt, round(rt_min + "end" * delta, 6) AS end_rt FROM rg, l')
def warp_levels(k):
    """Where the nodes of every level lie in every run."""
    return _node_times(warp.levels(k.sparkSession, 20, 100, 30), warp.rt_range(k, 0, 0.2), "start", "end")


@query("peaks", sql="WITH " + _RANGES + """, e AS (SELECT a.level, a.start, a."end", b.start AS s2, b."end" AS e2 FROM l a JOIN l b ON b.level = a.level + 1),
    w AS (SELECT level, x AS src_start, x + 100 + u AS src_end FROM e, generate_series(start, "end") g(x), generate_series(-30, 30) h(u) WHERE x + 100 + u BETWEEN s2 AND e2)
    SELECT file_id, level, src_start, src_end, round(rt_min + src_start * delta, 6) AS src_start_rt, round(rt_min + src_end * delta, 6) AS src_end_rt FROM w, rg WHERE file_id = 0""")
def warp_edges(k):
    """All warpings of the segments of the reference run, in nodes and in its times."""
    return _node_times(warp.warpings(k.sparkSession, 20, 100, 30), warp.rt_range(k, 0, 0.2).where("file_id = 0"), "src_start", "src_end")


@query("peaks")
def time_maps(k):
    return warp.time_map(k, 0, Warping())


#: Six segments; a level's edges start within its nodes and end within the next one's.
_SMALL = Warping(slack=2, window=10, num_points=60, expand=0.2, peaks_per_window=25)
_WARPED = """own AS (SELECT file_id, min(fitted_rt) AS lo, max(fitted_rt) AS hi FROM peaks GROUP BY file_id),
    both_ AS (SELECT o.file_id, least(o.lo, r.lo) AS a, greatest(o.hi, r.hi) AS b FROM own o, (SELECT lo, hi FROM own WHERE file_id = 0) r),
    wide AS (SELECT *, a - (b - a) * CAST(0.2 AS DOUBLE) AS rt_min FROM both_),
    rg AS (SELECT file_id, rt_min, (b + (b - rt_min) * CAST(0.2 AS DOUBLE) - rt_min) / 59 AS delta FROM wide),
    seg AS (SELECT rg.file_id, p.file_id AS own_file, p.fitted_mz AS mz, p.fitted_rt AS rt, p.fitted_sigma_mz AS sm, p.fitted_sigma_rt AS sr, p.fitted_height AS h, p.peak_id, CAST(floor((p.fitted_rt - rt_min) / (delta * 10)) AS BIGINT) AS segment FROM rg JOIN peaks p ON p.file_id = rg.file_id OR p.file_id = 0),
    top_ AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, own_file, segment ORDER BY h DESC, peak_id) AS k FROM seg) x WHERE k <= 25 AND segment BETWEEN 0 AND 5),
    lv AS (SELECT CAST(i AS BIGINT) AS level, greatest(i * 8, 60 - (6 - i) * 12) AS lo, least(i * 12, 60 - (6 - i) * 8) AS hi FROM range(0, 7) t(i)),
    ed AS (SELECT a.level, CAST(x AS BIGINT) AS src_start, CAST(x + 10 + u AS BIGINT) AS src_end FROM lv a JOIN lv b ON b.level = a.level + 1, range(0, 61) g(x), range(-2, 3) h(u) WHERE x BETWEEN a.lo AND a.hi AND x + 10 + u BETWEEN b.lo AND b.hi),
    mv AS (SELECT rg.file_id, level, src_start, src_end, rt_min + level * 10 * delta AS start, rt_min + (level + 1) * 10 * delta AS fin, rt_min + src_start * delta AS a, rt_min + src_end * delta AS b FROM rg, ed),
    pr AS MATERIALIZED (SELECT r.file_id, r.segment AS level, r.rt AS rrt, q.rt AS qrt, 3 * (r.sr + q.sr) AS reach, r.sr * r.sr + q.sr * q.sr AS wide, r.h * q.h * (r.sm * r.sm * q.sm * q.sm * exp(-0.5 * power(r.mz - q.mz, 2) / (r.sm * r.sm + q.sm * q.sm)) / sqrt(r.sm * r.sm + q.sm * q.sm)) * (r.sr * r.sr * q.sr * q.sr / sqrt(r.sr * r.sr + q.sr * q.sr)) AS f
           FROM top_ r JOIN top_ q ON q.file_id = r.file_id WHERE r.own_file = 0 AND q.own_file = q.file_id AND abs(r.mz - q.mz) <= 3 * (r.sm + q.sm)),
    ov AS (SELECT mv.file_id, mv.level, src_start, src_end, f * exp(-0.5 * power(rrt - (start + (qrt - a) / (b - a) * (fin - start)), 2) / wide) AS v FROM mv JOIN pr ON pr.file_id = mv.file_id AND pr.level = mv.level AND qrt >= a AND qrt < b AND abs(rrt - (start + (qrt - a) / (b - a) * (fin - start))) <= reach),
    si AS MATERIALIZED (SELECT mv.file_id, mv.level, mv.src_start, mv.src_end, coalesce(sum(v), 0) AS similarity FROM mv LEFT JOIN ov USING (file_id, level, src_start, src_end) GROUP BY ALL)"""


@query("peaks", sql="WITH " + _WARPED + " SELECT file_id, level, src_start, src_end, round(similarity, 4) AS similarity FROM si")
def warped_similarities(k):
    return rounded(warp.warped_similarities(k, 0, _SMALL), 4, "similarity")


#: Backward dynamic programming, a level after the other: the best end of every start, ties to the first one.
_BEST = "".join(
    f""",
    v{k} AS (SELECT si.file_id, si.src_start, si.src_end, similarity{f" + coalesce(n.total, 0)" if k < 5 else ""} AS v FROM si{f" LEFT JOIN b{k + 1} n ON n.file_id = si.file_id AND n.src_start = si.src_end" if k < 5 else ""} WHERE level = {k}),
    b{k} AS MATERIALIZED (SELECT file_id, src_start, greatest(max(v), 0) AS total, CASE WHEN max(v) > 0 THEN (list(src_end ORDER BY v DESC, src_end))[1] ELSE (min(src_end) + max(src_end)) // 2 END AS step FROM v{k} GROUP BY file_id, src_start)"""
    for k in (5, 4, 3, 2, 1, 0)
)
_PATH = ", ".join(["CAST(0 AS BIGINT) AS n0", *[f"b{k}.step AS n{k + 1}" for k in range(6)]])
_JOINS = "b0" + "".join(f" JOIN b{k} ON b{k}.file_id = b0.file_id AND b{k}.src_start = b{k - 1}.step" for k in range(1, 6)) + " WHERE b0.src_start = 0"


@query("peaks", sql="WITH " + _WARPED + _BEST + f""", path AS (SELECT b0.file_id, {_PATH} FROM {_JOINS}),
    seg_ AS (""" + " UNION ALL ".join(f"SELECT file_id, CAST({k} AS BIGINT) AS segment, n{k} AS x, n{k + 1} AS y FROM path" for k in range(6)) + """)
    SELECT q.file_id, segment, round(rt_min + segment * 10 * delta, 6) AS rt_start, round(rt_min + (segment + 1) * 10 * delta, 6) AS rt_end, round(rt_min + x * delta, 6) AS sample_rt_start, round(rt_min + y * delta, 6) AS sample_rt_end FROM seg_ q JOIN rg ON rg.file_id = q.file_id""")
def segment_time_maps(k):
    """Whole alignment of all peaks over six segments."""
    return rounded(warp.time_map(k, 0, _SMALL), 6, "rt_start", "rt_end", "sample_rt_start", "sample_rt_end")


@query("peaks", "time_map", sql="SELECT p.file_id, peak_id, fitted_rt, round(rt_start + (fitted_rt - sample_rt_start) / (sample_rt_end - sample_rt_start) * (rt_end - rt_start) - fitted_rt, 8) AS rt_delta FROM peaks p JOIN time_map t ON t.file_id = p.file_id AND fitted_rt >= sample_rt_start AND fitted_rt < sample_rt_end")
def warp_peaks(k, t):
    return rounded(warp.warp_peaks(k, t).select("file_id", "peak_id", "fitted_rt", "rt_delta"), 8, "rt_delta")


@query("points", "time_map", sql="""SELECT p.file_id, p.rt, round(coalesce(t.rt_start, z.rt_start) + (p.rt - coalesce(t.sample_rt_start, z.sample_rt_start)) / (coalesce(t.sample_rt_end, z.sample_rt_end) - coalesce(t.sample_rt_start, z.sample_rt_start)) * (coalesce(t.rt_end, z.rt_end) - coalesce(t.rt_start, z.rt_start)), 8) AS warped_rt
    FROM points p LEFT JOIN time_map t ON t.file_id = p.file_id AND p.rt >= t.sample_rt_start AND p.rt < t.sample_rt_end JOIN time_map z ON z.file_id = p.file_id AND z.segment = 0""")
def warp_times(p, t):
    return rounded(warp.warp_times(p.select("file_id", "rt"), t), 8, "warped_rt")


@query("points", "time_map", sql="""SELECT file_id, rt, coalesce(s.segment, -1) AS segment, round(s.v, 8) AS warped_rt FROM (SELECT DISTINCT file_id, rt FROM points) p
    LEFT JOIN (SELECT p.file_id AS f, p.rt AS r, min(segment) AS segment, arg_min(rt_start + (p.rt - sample_rt_start) / (sample_rt_end - sample_rt_start) * (rt_end - rt_start), segment) AS v
               FROM (SELECT DISTINCT file_id, rt FROM points) p JOIN time_map t ON t.file_id = p.file_id AND p.rt BETWEEN sample_rt_start AND sample_rt_end GROUP BY ALL) s ON s.f = p.file_id AND s.r = p.rt""")
def segment_lookup(p, t):
    return rounded(summary.segment_of(p.select("file_id", "rt").distinct(), t), 8, "warped_rt")


# --- features ---------------------------------------------------------------------------------


# Both sides are materialised with their bins, so that no planner takes the bins' joins apart and pairs all peaks first.
@query("peaks", sql="""WITH a AS MATERIALIZED (SELECT file_id, peak_id, fitted_mz, fitted_rt, fitted_sigma_mz, fitted_sigma_rt, z, CAST(floor(fitted_mz + CAST(1.0033 AS DOUBLE) / z) AS BIGINT) + k AS bin FROM peaks, (VALUES (1), (2), (3)) c(z), (VALUES (-2), (-1), (0), (1), (2)) d(k)),
    b AS MATERIALIZED (SELECT file_id, peak_id, fitted_mz, fitted_rt, CAST(floor(fitted_mz) AS BIGINT) AS bin FROM peaks)
    SELECT a.file_id, z AS charge, a.peak_id AS lower, b.peak_id AS upper FROM a JOIN b ON a.bin = b.bin AND a.file_id = b.file_id
    WHERE abs(b.fitted_mz - (a.fitted_mz + CAST(1.0033 AS DOUBLE) / z)) < a.fitted_sigma_mz AND abs(b.fitted_rt - a.fitted_rt) < a.fitted_sigma_rt""")
def isotope_candidates(k):
    return features.candidate_graph(k, [1, 2, 3])


@query("peaks")
def detect_features(k):
    # Isotopes of charge 5 are 0.2 apart, less than the m/z sigma of the stand-in peaks.
    return features.detect(k.withColumn("fitted_sigma_mz", F.col("fitted_sigma_mz") / 5), [5, 4, 3, 2, 1])


_FEATURES = """c AS (SELECT *, peak_id // 3 AS first, peak_id % 3 AS pos FROM peaks)"""


def _triples(k):
    """Stand-in features: three consecutive peaks each."""
    g = k.groupBy("file_id", F.expr("peak_id div 3").alias("first_id")).agg(F.array_sort(F.collect_list("peak_id")).alias("peak_ids"))
    return g.select("file_id", "first_id", F.lit(2).alias("charge_state"), F.lit(1.0).alias("score"), "peak_ids")


@query("peaks", sql="WITH " + _FEATURES + """ SELECT file_id, 2 AS charge_state, round(avg(fitted_rt), 6) AS average_rt, round(sum(fitted_mz * fitted_height) / sum(fitted_height), 6) AS average_mz, round(sum(fitted_height), 6) AS total_height,
    max(fitted_height) AS max_height, round(sum(fitted_volume), 4) AS total_volume, arg_min(fitted_mz, pos) AS monoisotopic_mz, arg_min(fitted_height, pos) AS monoisotopic_height, count(*) AS isotopes FROM c GROUP BY file_id, first""")
def feature_table(k):
    t = features.table_of(_triples(k), k).withColumn("isotopes", F.size("peak_ids").cast("long"))
    t = t.select("file_id", "charge_state", "average_rt", "average_mz", "total_height", "max_height", "total_volume", "monoisotopic_mz", "monoisotopic_height", "isotopes")
    return rounded(rounded(t, 6, "average_rt", "average_mz", "total_height"), 4, "total_volume")


@query("peaks", sql="SELECT file_id, peak_id AS monoisotopic_id, row_number() OVER (PARTITION BY file_id ORDER BY fitted_volume DESC, peak_id) - 1 AS feature_id, fitted_volume AS total_volume FROM peaks")
def feature_ids(k):
    """Features of one peak each, so that sums are exact and ties real."""
    one = k.select("file_id", F.col("peak_id").alias("first_id"), F.lit(1).alias("charge_state"), F.lit(1.0).alias("score"), F.array("peak_id").alias("peak_ids"))
    return features.table_of(one, k).select("file_id", F.get("peak_ids", F.lit(0)).alias("monoisotopic_id"), "feature_id", "total_volume")


_AVERAGINE = ", ".join(f"({i}, {m!r}, {len(p)}, {p[0]!r}, {p[1] if len(p) > 1 else 0.0!r})" for i, (m, p) in enumerate(features.averagine_table()))


@query("peaks", sql="WITH t AS (SELECT CAST(k AS BIGINT) AS k, CAST(m AS DOUBLE) AS m, n, CAST(p0 AS DOUBLE) AS p0, CAST(p1 AS DOUBLE) AS p1 FROM (VALUES " + _AVERAGINE + """) v(k, m, n, p0, p1)),
    a AS (SELECT file_id, peak_id, z, fitted_mz * z - z * CAST(1.00728 AS DOUBLE) AS mass FROM peaks, (VALUES (1), (2), (3)) c(z)),
    b AS (SELECT a.*, up.k AS ku, up.m AS mu FROM a ASOF JOIN t up ON a.mass <= up.m),
    d AS (SELECT b.*, CASE WHEN t.m IS NOT NULL AND mass - t.m < mu - mass THEN ku - 1 ELSE ku END AS k FROM b LEFT JOIN t ON t.k = ku - 1)
    SELECT file_id, peak_id, z AS charge, t.m AS averagine_mass, CAST(t.n AS INT) AS isotopes, t.p0 AS first, t.p1 AS second FROM d JOIN t ON t.k = d.k""")
def averagine_patterns(k):
    return features.with_pattern(k.select("file_id", "peak_id", "fitted_mz", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("charge"))).select(
        "file_id", "peak_id", "charge", "averagine_mass", F.size("pattern").alias("isotopes"), F.get("pattern", F.lit(0)).alias("first"), F.coalesce(F.get("pattern", F.lit(1)), F.lit(0.0)).alias("second"))


@query("peaks", sql="WITH " + _FEATURES + ", n AS (SELECT file_id, first, count(*) AS isotopes FROM c GROUP BY ALL) SELECT file_id, isotopes, count(*) AS features FROM n GROUP BY ALL")
def isotope_counts(k):
    return summary.isotope_counts(_triples(k)).withColumn("isotopes", F.col("isotopes").cast("long"))


@query("peaks", sql="WITH " + _FEATURES + ", n AS (SELECT file_id, first, count(*) AS n FROM c GROUP BY ALL) SELECT file_id, count(*) AS count, round(avg(n), 6) AS mean, median(n) AS median, max(n) AS max FROM n GROUP BY file_id")
def isotope_summary(k):
    out = rounded(summary.isotope_summary(_triples(k)), 6, "mean")
    return out.withColumn("max", F.col("max").cast("long"))


# --- links ------------------------------------------------------------------------------------


def _link_sql(events: str, key: str, mz: str) -> str:
    s = "0.1 * power({0} / 200, 1.5) / (2 * sqrt(2 * ln(2)))".format(f"e.{mz}")
    return f"""WITH j AS (SELECT e.file_id, e.{key}, p.peak_id, p.fitted_mz, abs(e.{mz} - fitted_mz) AS dm, abs(e.rt - fitted_rt) AS dr, fitted_sigma_mz AS sm, fitted_sigma_rt AS sr
        FROM {events} e JOIN peaks p ON p.file_id = e.file_id AND fitted_mz BETWEEN e.{mz} - 3 * {s} AND e.{mz} + 3 * {s}),
    d AS (SELECT *, sqrt(power(dm / sm, 2) + power(dr / sr, 2)) AS distance, dm <= 3 * sm AND dr <= 3 * sr AS ok FROM j),
    b AS (SELECT *, row_number() OVER (PARTITION BY file_id, {key} ORDER BY distance, fitted_mz, peak_id) AS k FROM d)
    SELECT file_id, {key}, peak_id, round(distance, 6) AS distance FROM b WHERE k = 1 AND ok"""


@query("peaks", "msms", sql=_link_sql("msms", "event_id", "mz"))
def link_peaks(k, e):
    return rounded(link.link_peaks(k, e, RUN), 6, "distance")


@query("peaks", "psms", sql=_link_sql("psms", "psm_index", "theoretical_mz"))
def link_psm(k, e):
    return rounded(link.link_psm(k, e, RUN), 6, "distance")


@query("psms", "msms", sql="""WITH s AS (SELECT *, 0.1 * power(mz / 200, 1.5) / (2 * sqrt(2 * ln(2))) AS sm FROM psms),
    j AS (SELECT s.file_id, psm_index, e.event_id, e.mz, abs(s.mz - e.mz) AS dm, abs(s.rt - e.rt) AS dr, e.rt AS ert, sm FROM s JOIN msms e ON e.file_id = s.file_id AND e.mz BETWEEN s.mz - 3 * sm AND s.mz + 3 * sm),
    d AS (SELECT *, sqrt(power(dm / mz, 2) + power(dr / ert, 2)) AS distance, dm <= 3 * sm AND dr <= 3 * 20 / (2 * sqrt(2 * ln(2))) AS ok FROM j WHERE ert <> 0),
    b AS (SELECT *, row_number() OVER (PARTITION BY file_id, psm_index ORDER BY distance, mz, event_id) AS k FROM d)
    SELECT file_id, psm_index, event_id, round(distance, 6) AS distance FROM b WHERE k = 1 AND ok""")
def link_idents(q, e):
    return rounded(link.link_idents(q, e, RUN), 6, "distance")


@query("peaks", "msms", sql="""WITH j AS (SELECT e.file_id, e.event_id AS target_id, p.peak_id, abs(e.mz - fitted_mz) AS dm, abs(e.rt - fitted_rt - rt_delta) AS dr, fitted_sigma_mz AS sm, fitted_sigma_rt AS sr FROM msms e JOIN peaks p ON p.file_id = e.file_id AND abs(e.mz - fitted_mz) <= 4 * (0.5 + fitted_sigma_mz)),
    d AS (SELECT *, sqrt(power(dr / (10 + sr), 2) + power(dm / (0.5 + sm), 2)) AS distance, dm <= 1.5 AND dr <= 30 AS ok FROM j),
    b AS (SELECT *, row_number() OVER (PARTITION BY file_id, target_id ORDER BY distance, peak_id) AS k FROM d)
    SELECT file_id, target_id, peak_id, round(distance, 6) AS distance FROM b WHERE k = 1 AND ok""")
def closest_peaks(k, e):
    t = e.select("file_id", F.col("event_id").alias("target_id"), F.col("mz").alias("t_mz"), F.col("rt").alias("t_rt"), F.lit(0.5).alias("t_sigma_mz"), F.lit(10.0).alias("t_sigma_rt"))
    return rounded(summary.closest_peak(t, k, width=4.0), 6, "distance")


# --- matching ---------------------------------------------------------------------------------


def _groups(k):
    return k.select("file_id").distinct().withColumn("group_id", (F.col("file_id") % 2).cast("int"))


@query("peaks", sql="""WITH a AS MATERIALIZED (SELECT file_id, peak_id, fitted_mz, fitted_rt + rt_delta AS rt, fitted_sigma_mz * 1.5 AS hm, fitted_sigma_rt * 1.5 AS hr, CAST(floor(fitted_mz) AS BIGINT) + k AS bin FROM peaks, (VALUES (-3), (-2), (-1), (0), (1), (2), (3)) d(k)),
    b AS MATERIALIZED (SELECT file_id, peak_id, fitted_mz, fitted_rt + rt_delta AS rt, CAST(floor(fitted_mz) AS BIGINT) AS bin FROM peaks)
    SELECT a.file_id AS file_a, a.peak_id AS peak_a, b.file_id AS file_b, b.peak_id AS peak_b FROM a JOIN b ON a.bin = b.bin
    WHERE b.fitted_mz BETWEEN a.fitted_mz - hm AND a.fitted_mz + hm AND b.rt BETWEEN a.rt - hr AND a.rt + hr""")
def match_candidates(k):
    e = match.candidates(match.peak_items(k, _groups(k)), 1.5, 1.5, 1.0)
    part = F.lit(1 << 40)
    return e.select((F.expr(f"ref div {1 << 40}")).cast("int").alias("file_a"), (F.col("ref") % part).alias("peak_a"), (F.expr(f"other div {1 << 40}")).cast("int").alias("file_b"), (F.col("other") % part).alias("peak_b"))


@query("peaks")
def peak_clusters(k):
    return match.clusters(match.peak_items(k, _groups(k)), {0: 4, 1: 3}, 0.5)


@query("peaks")
def feature_clusters(k):
    f = features.table_of(_triples(k), k)
    return match.clusters(match.feature_items(f, _groups(k)), {0: 4, 1: 3}, 0.5)


@query("peaks")
def match_within_sigma(k):
    k = k.select("peak_id", F.col("fitted_mz").alias("mz"), F.col("fitted_rt").alias("rt"), F.col("fitted_sigma_mz").alias("s_mz"), F.col("fitted_sigma_rt").alias("s_rt"), F.col("fitted_height").alias("height"), "file_id")
    a, b = k, k.withColumn("file_id", (F.col("file_id") + 6) % 7)  # every file with the next one
    return rounded(match.match_within_sigma(a, b), 6, "distance", "log2_ratio")


# --- proteins ---------------------------------------------------------------------------------

_CLASSES = """n AS (SELECT protein, count(*) AS n FROM edges GROUP BY protein),
    big AS (SELECT e.*, n FROM edges e JOIN n USING (protein)),
    w AS (SELECT *, count(*) OVER (PARTITION BY peptide) AS np, max(n) OVER (PARTITION BY peptide) AS most FROM big),
    v AS (SELECT *, sum(CASE WHEN n = most THEN 1 ELSE 0 END) OVER (PARTITION BY peptide) AS at_most FROM w),
    classes AS (SELECT protein, peptide, n AS n_peptides, np AS n_proteins, CASE WHEN np = 1 THEN 'unique' WHEN n = most AND at_most = 1 THEN 'razor' WHEN n = most THEN 'ambiguous' ELSE 'shared' END AS kind FROM v)"""


@query("edges")
def protein_inference(e):
    return proteins.razor(e.select("protein", F.col("peptide").alias("psm")))


@query("edges", sql="SELECT protein, peptide FROM edges WHERE protein IN (SELECT protein FROM edges GROUP BY protein HAVING count(DISTINCT peptide) >= 2)")
def protein_min_peptides(e):
    return proteins.enough_peptides(e, 2)


@query("edges", sql="""WITH n AS (SELECT protein, count(*) AS n FROM edges GROUP BY protein), s AS (SELECT a.protein AS a, b.protein AS b, count(*) AS k FROM edges a JOIN edges b ON a.peptide = b.peptide AND a.protein <> b.protein GROUP BY ALL)
    SELECT protein, peptide FROM edges WHERE protein NOT IN (SELECT a FROM s JOIN n x ON x.protein = a JOIN n y ON y.protein = b WHERE k = x.n AND x.n < y.n)""")
def protein_subsets(e):
    return proteins.without_subsets(e)


@query("edges", sql="WITH " + _CLASSES + " SELECT * FROM classes")
def peptide_classes(e):
    return proteins.peptide_classes(e)


@query("edges", sql="WITH " + _CLASSES + """, single AS (SELECT DISTINCT protein FROM classes WHERE kind = 'unique'), rest AS (SELECT * FROM classes WHERE protein NOT IN (SELECT protein FROM single)),
    step AS (SELECT DISTINCT a.protein AS a, b.protein AS b FROM rest a JOIN rest b USING (peptide)),
    reach AS (SELECT a, b FROM step UNION SELECT r.a, s.b FROM reach r JOIN step s ON s.a = r.b)
    SELECT protein, protein AS leader FROM single UNION ALL SELECT a, min(b) FROM reach GROUP BY a""")
def protein_groups(e):
    return proteins.protein_groups(proteins.peptide_classes(e))


@query("edges", sql="WITH kept AS (SELECT * FROM edges WHERE protein NOT IN (SELECT a FROM (SELECT a.protein AS a, b.protein AS b, count(*) AS k FROM edges a JOIN edges b ON a.peptide = b.peptide AND a.protein <> b.protein GROUP BY ALL) s JOIN (SELECT protein, count(*) AS n FROM edges GROUP BY protein) x ON x.protein = a JOIN (SELECT protein, count(*) AS n FROM edges GROUP BY protein) y ON y.protein = b WHERE k = x.n AND x.n < y.n)), " + _CLASSES.replace("FROM edges", "FROM kept") + """,
    single AS (SELECT DISTINCT protein FROM classes WHERE kind = 'unique'), rest AS (SELECT * FROM classes WHERE protein NOT IN (SELECT protein FROM single)),
    step AS (SELECT DISTINCT a.protein AS a, b.protein AS b FROM rest a JOIN rest b USING (peptide)),
    reach AS (SELECT a, b FROM step UNION SELECT r.a, s.b FROM reach r JOIN step s ON s.a = r.b),
    grp AS (SELECT protein, protein AS leader, 0 AS late FROM single UNION ALL SELECT a, min(b), 1 FROM reach GROUP BY a),
    ids AS (SELECT leader, row_number() OVER (ORDER BY late, leader) - 1 AS group_id FROM (SELECT DISTINCT leader, late FROM grp) d),
    picked AS (SELECT DISTINCT group_id, leader, protein, peptide FROM classes JOIN grp USING (protein) JOIN ids USING (leader) WHERE kind IN ('unique', 'razor')),
    own AS (SELECT peptide, max(group_id) AS group_id FROM picked GROUP BY peptide)
    SELECT p.group_id, p.leader, max(h) AS height, string_agg(DISTINCT CAST(peptide AS VARCHAR), '.|.' ORDER BY CAST(peptide AS VARCHAR)) AS sequences, string_agg(DISTINCT CAST(protein AS VARCHAR), '.|.' ORDER BY CAST(protein AS VARCHAR)) AS proteins,
           string_agg(DISTINCT 'protein ' || CAST(protein AS VARCHAR), '.|.' ORDER BY 'protein ' || CAST(protein AS VARCHAR)) AS descriptions, count(DISTINCT protein) AS n_proteins
    FROM picked p LEFT JOIN (SELECT group_id, CAST(sum(peptide) AS DOUBLE) AS h FROM own GROUP BY group_id) o ON o.group_id = p.group_id GROUP BY p.group_id, p.leader""")
def protein_quantities(e):
    data = e.select(F.col("peptide").alias("cluster_id"), F.col("peptide").cast("double").alias("height")).distinct()
    notes = e.select(F.col("peptide").alias("cluster_id"), "peptide", "protein", F.concat(F.lit("protein "), F.col("protein").cast("string")).alias("description"))
    sums, about = proteins.quantify(data, notes, ["height"], least_peptides=1)
    return sums.join(about, ["group_id", "leader"], "full")


# --- quantification ---------------------------------------------------------------------------


_BLOCK_GROUPS = "kept AS (SELECT * FROM block_edges WHERE protein NOT IN (SELECT a FROM (SELECT a.protein AS a, b.protein AS b, count(*) AS k FROM block_edges a JOIN block_edges b ON a.peptide = b.peptide AND a.protein <> b.protein GROUP BY ALL) s JOIN (SELECT protein, count(*) AS n FROM block_edges GROUP BY protein) x ON x.protein = a JOIN (SELECT protein, count(*) AS n FROM block_edges GROUP BY protein) y ON y.protein = b WHERE k = x.n AND x.n < y.n)), " + _CLASSES.replace("FROM edges", "FROM kept") + """,
    single AS (SELECT DISTINCT protein FROM classes WHERE kind = 'unique'), rest AS (SELECT * FROM classes WHERE protein NOT IN (SELECT protein FROM single)),
    step AS (SELECT DISTINCT a.protein AS a, b.protein AS b FROM rest a JOIN rest b USING (peptide)),
    reach AS (SELECT a, b FROM step UNION SELECT r.a, s.b FROM reach r JOIN step s ON s.a = r.b),
    grp AS (SELECT protein, protein AS leader, 0 AS late FROM single UNION ALL SELECT a, min(b), 1 FROM reach GROUP BY a),
    ids AS (SELECT leader, row_number() OVER (ORDER BY late, leader) - 1 AS group_id FROM (SELECT DISTINCT leader, late FROM grp) d),
    picked AS (SELECT DISTINCT group_id, leader, protein, peptide FROM classes JOIN grp USING (protein) JOIN ids USING (leader) WHERE kind IN ('unique', 'razor', 'ambiguous')),
    own AS (SELECT CAST(floor(peptide / 32.0) AS BIGINT) * 16 + peptide % 16 AS cluster_id, max(group_id) AS group_id FROM picked GROUP BY cluster_id)"""


@query("block_edges", sql="WITH " + _BLOCK_GROUPS + """
    SELECT p.group_id, p.leader, max(h) AS height, max(c) AS clusters, string_agg(DISTINCT CAST(peptide AS VARCHAR), '.|.' ORDER BY CAST(peptide AS VARCHAR)) AS sequences, string_agg(DISTINCT CAST(protein AS VARCHAR), '.|.' ORDER BY CAST(protein AS VARCHAR)) AS proteins,
           count(DISTINCT protein) AS n_proteins
    FROM picked p LEFT JOIN (SELECT group_id, CAST(sum(cluster_id) AS DOUBLE) AS h, CAST(count(*) AS DOUBLE) AS c FROM own GROUP BY group_id) o ON o.group_id = p.group_id GROUP BY p.group_id, p.leader""")
def competing_protein_groups(e):
    """Many groups; a cluster holds the peptides of two blocks of proteins, so that groups compete for it."""
    cluster = (F.floor(F.col("peptide") / 32).cast("long") * 16 + F.col("peptide") % 16).alias("cluster_id")
    data = e.select(cluster).distinct().select("cluster_id", F.col("cluster_id").cast("double").alias("height"), F.lit(1.0).alias("clusters"))
    notes = e.select(cluster, "peptide", "protein", F.lit("about it").alias("description"))
    sums, about = proteins.quantify(data, notes, ["height", "clusters"], add_ambiguous=True)
    return about.join(sums, ["group_id", "leader"], "left").select("group_id", "leader", "height", "clusters", "sequences", "proteins", "n_proteins")


@query("peaks", sql="SELECT file_id, peak_id, fitted_mz AS mz, fitted_rt AS rt, rt_delta, fitted_height AS height, fitted_sigma_mz AS sigma_mz, fitted_sigma_rt AS sigma_rt, fitted_volume AS volume, fitted_rt + rt_delta AS aligned_rt FROM peaks")
def peak_table(k):
    return quant.peak_table(k)


@query("peaks", "msms", "psms", sql=_link_sql("msms", "event_id", "mz").replace("SELECT file_id, event_id, peak_id, round(distance, 6) AS distance FROM b WHERE k = 1 AND ok", """, pe AS (SELECT file_id, event_id, peak_id FROM b WHERE k = 1 AND ok)
    SELECT p.file_id, p.peak_id, pe.event_id, s.psm_index, s.sequence FROM peaks p LEFT JOIN pe ON pe.file_id = p.file_id AND pe.peak_id = p.peak_id LEFT JOIN psms s ON s.file_id = pe.file_id AND s.psm_index = pe.event_id"""))
def annotate_peaks(k, e, q):
    links = q.select("file_id", "psm_index", F.col("psm_index").alias("event_id"))
    got = quant.annotate_peaks(k.select("file_id", "peak_id"), link.link_peaks(k, e, RUN), q.select("file_id", "psm_index", "sequence"), links, "msms_event")
    return got.select("file_id", "peak_id", "event_id", "psm_index", "sequence")


@query("peaks", "psms", sql="WITH " + _FEATURES + ", n AS (SELECT file_id, first, peak_id FROM c) SELECT n.file_id, n.first AS feature_id, n.peak_id, s.psm_charge_state, s.sequence FROM n LEFT JOIN psms s ON s.file_id = n.file_id AND s.psm_index = n.peak_id WHERE psm_charge_state IS NULL OR psm_charge_state = 2")
def annotate_features(k, q):
    f = _triples(k).withColumnRenamed("first_id", "feature_id")
    told = q.select("file_id", F.col("psm_index").alias("peak_id"), "psm_charge_state", "sequence")
    return quant.annotate_features(f, told).select("file_id", "feature_id", "peak_id", "psm_charge_state", "sequence")


def _members(k):
    """Stand-in clusters: equal ranks in every file."""
    return k.select(F.col("peak_id").alias("cluster_id"), F.col("file_id").alias("file"), F.col("fitted_mz").alias("mz"), F.col("fitted_rt").alias("rt"), F.col("fitted_height").alias("height"), F.col("fitted_volume").alias("volume"))


@query("peaks", sql="SELECT peak_id AS cluster_id, file_id AS place, max(fitted_height) AS height FROM peaks WHERE fitted_height <> 0 GROUP BY ALL")
def cluster_height_blocks(k):
    """The same matrix in blocks of files, read back cell by cell."""
    places = k.select(F.col("file_id").alias("file"), F.col("file_id").alias("place")).distinct()
    b = quant.block_matrix(_members(k), "height", places, ("height", "volume"))
    cells = b.select("cluster_id", "block", F.posexplode("values").alias("at", "height")).where("height <> 0")
    return cells.select("cluster_id", (F.col("block") * quant.BLOCK + F.col("at")).alias("place"), "height")


@query("peaks", sql="SELECT peak_id AS cluster_id, " + ", ".join(f'coalesce(max(fitted_height) FILTER (file_id = {f}), 0) AS "{f}"' for f in FILES) + " FROM peaks GROUP BY peak_id")
def cluster_heights(k):
    return quant.wide_matrix(_members(k), "height", FILES, ("height", "volume"))


@query("peaks", sql="SELECT peak_id AS cluster_id, round(avg(fitted_mz), 6) AS mz, round(avg(fitted_rt), 6) AS rt, round(avg(fitted_height), 6) AS avg_height, round(avg(fitted_volume), 5) AS avg_volume, count(*) AS n_files FROM peaks GROUP BY peak_id")
def cluster_metadata(k):
    return rounded(rounded(quant.cluster_metadata(_members(k)), 6, "mz", "rt", "avg_height"), 5, "avg_volume")


@query("annotations", sql="SELECT cluster_id, string_agg(DISTINCT sequence, '.|.' ORDER BY sequence) AS sequence, string_agg(DISTINCT protein, '.|.' ORDER BY protein) AS protein FROM annotations GROUP BY cluster_id")
def aggregate_annotations(a):
    return quant.aggregate_annotations(a, columns=["sequence", "protein"])


_CONSENSUS = "n AS (SELECT cluster_id, sequence, count(DISTINCT file_id) AS count FROM annotations WHERE sequence IS NOT NULL GROUP BY ALL), c AS (SELECT * FROM (SELECT *, max(count) OVER (PARTITION BY cluster_id) AS top FROM n) x WHERE count = top AND count >= 1)"


@query("annotations", sql="WITH " + _CONSENSUS + " SELECT cluster_id, sequence, count FROM c")
def sequence_consensus(a):
    return quant.sequence_consensus(a)


@query("annotations", sql="WITH " + _CONSENSUS + " SELECT c.cluster_id, c.sequence, c.count, p.protein FROM c LEFT JOIN (SELECT DISTINCT cluster_id, sequence, protein FROM annotations) p ON p.cluster_id = c.cluster_id AND p.sequence = c.sequence")
def consensus_proteins(a):
    return quant.consensus_proteins(quant.sequence_consensus(a), a)


@query("peaks", "psms", sql="SELECT sequence, round(sum(fitted_height), 6) AS height FROM peaks p JOIN (SELECT psm_index, sequence FROM psms WHERE sequence <> '') s ON s.psm_index = p.peak_id GROUP BY sequence")
def peptide_quantities(k, q):
    notes = q.select(F.col("psm_index").alias("cluster_id"), "sequence")
    return rounded(quant.peptide_table(_members(k), notes, ["height"]), 6, "height")


@query("annotations", sql="WITH " + _CONSENSUS + " SELECT sequence, string_agg(DISTINCT cluster_id, '.|.' ORDER BY cluster_id) AS cluster_id, string_agg(DISTINCT protein, '.|.' ORDER BY protein) AS protein FROM annotations WHERE sequence IN (SELECT sequence FROM c) GROUP BY sequence")
def peptide_metadata(a):
    wanted = quant.sequence_consensus(a).select("sequence").distinct()
    return quant.peptide_metadata(a.select("sequence", "cluster_id", "protein"), wanted)


# --- summaries --------------------------------------------------------------------------------


@query("peaks", sql="SELECT file_id, count(*) AS count, round(avg(fitted_height), 6) AS mean, round(median(fitted_height), 6) AS median, round(stddev_pop(fitted_height), 6) AS std FROM peaks GROUP BY file_id")
def peak_summary(k):
    return rounded(summary.describe(k, "fitted_height", "file_id"), 6, "mean", "median", "std")


@query("peaks", sql="WITH s AS (SELECT file_id, count(*) AS count, avg(fitted_height) AS mean, median(fitted_height) AS median, stddev_pop(fitted_height) AS std FROM peaks GROUP BY file_id) SELECT count(*) AS n_files, round(avg(count), 6) AS count, round(avg(mean), 6) AS mean, round(avg(median), 6) AS median, round(avg(std), 6) AS std FROM s")
def peak_summary_over_files(k):
    return rounded(summary.over_files(summary.describe(k, "fitted_height", "file_id")), 6, "count", "mean", "median", "std")


def _efficiency_sql(links: str, key: str, every: str) -> str:
    return f"""SELECT n.file_id, n.n, coalesce(l.linked, 0) AS linked, round(coalesce(l.linked, 0) * 100.0 / n.n, 6) AS percent FROM (SELECT file_id, count(*) AS n FROM {every} GROUP BY file_id) n
        LEFT JOIN (SELECT file_id, count({key}) AS linked FROM ({links}) x GROUP BY file_id) l USING (file_id)"""


@query("peaks", "msms", sql=(lambda with_, _, last: with_ + ", " + "found AS (SELECT" + last + ") " + _efficiency_sql("SELECT * FROM found", "event_id", "msms"))(*_link_sql("msms", "event_id", "mz").rpartition("SELECT")))
def linking_efficiency(k, e):
    return rounded(summary.linking_efficiency(link.link_peaks(k, e, RUN), e), 6, "percent")


@query("peaks", "psms", sql=(lambda with_, _, last: with_ + ", " + "found AS (SELECT" + last + ") " + _efficiency_sql("SELECT * FROM found", "psm_index", "psms"))(*_link_sql("psms", "psm_index", "theoretical_mz").rpartition("SELECT")))
def identification_efficiency(k, e):
    return rounded(summary.linking_efficiency(link.link_psm(k, e, RUN), e), 6, "percent")


@query("points", sql="SELECT file_id, min(mz) AS min_mz, max(mz) AS max_mz, min(rt) AS min_rt, max(rt) AS max_rt, count(DISTINCT rt) AS n_scans, count(*) AS n_points FROM points GROUP BY file_id")
def raw_summary(p):
    return summary.raw_summary(p)


@query("peaks", sql="WITH m AS (SELECT a.file_id, log2(a.fitted_height / b.fitted_height) AS m FROM peaks a JOIN peaks b ON b.file_id = (a.file_id + 1) % 7 AND b.peak_id = a.peak_id) SELECT file_id, round(avg(m), 6) AS mean, round(median(m), 6) AS median, round(stddev_samp(m), 6) AS std, round(quantile_cont(m, 0.05), 6) AS p5, round(quantile_cont(m, 0.95), 6) AS p95 FROM m GROUP BY file_id")
def ratio_summary(k):
    k = materialise(k.select("file_id", "peak_id", "fitted_height"))
    a = k.select("file_id", "peak_id", F.col("fitted_height").alias("a"))
    b = k.select(F.pmod(F.col("file_id") - 1, F.lit(7)).alias("file_id"), "peak_id", F.col("fitted_height").alias("b"))
    return rounded(summary.ma_summary(a.join(b, ["file_id", "peak_id"])), 6, "mean", "median", "std", "p5", "p95")


@query("points", sql="""WITH u AS (SELECT DISTINCT file_id, rt, mz, intensity FROM points), n AS MATERIALIZED (SELECT *, lead(mz) OVER (PARTITION BY file_id, rt ORDER BY mz) AS nx FROM (SELECT file_id, rt, mz, max(intensity) AS intensity FROM u GROUP BY ALL) q)
    SELECT file_id, rt, mz, intensity FROM n UNION ALL SELECT file_id, rt, mz + (nx - mz) / 2, 0.0 FROM n WHERE nx - mz > CAST(8 AS DOUBLE) * CAST(1.3 AS DOUBLE) AND nx - mz < 16
    UNION ALL SELECT file_id, rt, mz + 8, 0.0 FROM n WHERE nx - mz >= 16 UNION ALL SELECT file_id, rt, nx - 8, 0.0 FROM n WHERE nx - mz >= 16""")
def fill_gaps(p):
    return summary.fill_gaps(p.groupBy("file_id", "rt", "mz").agg(F.max("intensity").alias("intensity")), 8.0)


# --- smaller operators ------------------------------------------------------------------------


@query("peaks", sql="SELECT file_id, peak_id FROM peaks WHERE fitted_rt >= 500 AND fitted_rt < 800")
def peaks_in_rt_range(k):
    return warp.peaks_in_rt_range(k, 500, 800).select("file_id", "peak_id")


@query("peaks", sql="""WITH o AS (SELECT file_id, min(fitted_rt) AS lo, max(fitted_rt) AS hi FROM peaks GROUP BY file_id), r AS (SELECT lo, hi FROM o WHERE file_id = 0),
    b AS (SELECT file_id, least(o.lo, r.lo) AS a, greatest(o.hi, r.hi) AS b FROM o, r), m AS (SELECT file_id, b, a - (b - a) * CAST(0.2 AS DOUBLE) AS rt_min FROM b)
    SELECT file_id, round(rt_min, 6) AS rt_min, round(b + (b - rt_min) * CAST(0.2 AS DOUBLE), 6) AS rt_max FROM m""")
def warp_rt_range(k):
    return rounded(warp.rt_range(k, 0, 0.2), 6, "rt_min", "rt_max")


@query("peaks", sql="""WITH p AS (SELECT *, CAST(floor(fitted_rt / CAST(100 AS DOUBLE)) AS BIGINT) AS segment FROM peaks), k AS (SELECT *, row_number() OVER (PARTITION BY file_id, segment ORDER BY fitted_height DESC, peak_id) AS k FROM p)
    SELECT file_id, segment, peak_id FROM k WHERE k <= 100 AND segment >= 0 AND segment < 20""")
def segment_top_peaks(k):
    ranges = k.select("file_id").distinct().select("file_id", F.lit(0.0).alias("rt_min"), F.lit(1999.0).alias("rt_max"))
    return warp.segment_peaks(k, ranges, 20, 2000, 100, 100).select("file_id", "segment", "peak_id")


@query("peaks", sql="SELECT file_id, peak_id, round(100 + (fitted_rt - 80) / CAST(60 AS DOUBLE) * 50, 9) AS fitted_rt, round(100 + (fitted_rt - 80) / CAST(60 AS DOUBLE) * 50 - fitted_rt, 9) AS rt_delta FROM peaks WHERE fitted_rt >= 80 AND fitted_rt < 140")
def interpolate_segment(k):
    return rounded(warp.interpolate(k, 80, 140, 100, 150).select("file_id", "peak_id", "fitted_rt", "rt_delta"), 9, "fitted_rt", "rt_delta")


@query("points", sql="SELECT DISTINCT file_id, CASE WHEN file_id % 2 = 0 THEN 0 ELSE 1 END AS group_id FROM points")
def group_numbers(p):
    files = p.select("file_id").distinct().withColumn("group", F.when(F.col("file_id") % 2 == 0, "zeta").otherwise("alpha"))
    return match.group_numbers(files)


@query("peaks", "msms", sql="""SELECT p.file_id, p.peak_id, e.event_id, round(sqrt(power((p.fitted_rt - e.rt) / (p.fitted_sigma_rt + 10), 2) + power((p.fitted_mz - e.mz) / (p.fitted_sigma_mz + 0.5), 2)), 6) AS distance
    FROM peaks p JOIN msms e ON e.file_id = p.file_id AND e.event_id = p.peak_id""")
def normalised_distance(k, e):
    j = k.join(e.withColumnRenamed("event_id", "peak_id"), ["file_id", "peak_id"])
    d = X.normalised_distance("fitted_mz", "fitted_rt", "fitted_sigma_mz", "fitted_sigma_rt", "mz", "rt", 0.5, 10.0)
    return j.select("file_id", "peak_id", F.col("peak_id").alias("event_id"), F.round(d, 6).alias("distance"))


@query("peaks", sql="SELECT file_id, peak_id, round((1 - 0.25) * fitted_mz + 0.25 * fitted_rt, 9) AS value FROM peaks")
def linear_interpolation(k):
    return k.select("file_id", "peak_id", F.round(X.lerp("fitted_mz", "fitted_rt", F.lit(0.25)), 9).alias("value"))


@query("signal", sql="WITH " + _SPLAT + " SELECT file_id, i, j, round(value, 5) AS value FROM cells WHERE i >= 10 AND i < 40 AND j >= 5 AND j < 60")
def grid_subset(s):
    cells = grid.subset(grid.splat(s, _bounds(s), GRID_RUN, GRID), 10, 40, 5, 60)
    return rounded(cells, 5, "value")


@query("signal", sql="WITH " + _SPLAT + " SELECT DISTINCT c.file_id, i, round(min_mz + i * (max_mz - min_mz) / (n - 1), 6) AS mz, j, round(min_rt + j * (max_rt - min_rt) / (m - 1), 2) AS rt FROM cells c JOIN g ON g.file_id = c.file_id")
def grid_positions(s):
    b = _bounds(s)
    cells = grid.locate(grid.splat(s, b, GRID_RUN, GRID), b, GRID_RUN, GRID)
    return rounded(rounded(cells.select("file_id", "i", "mz", "j", "rt"), 6, "mz"), 2, "rt")


@query("signal")
def find_peaks_serial(p):
    return peaks.find_peaks(p, _maxima(p), _ROI_RUN, 100, bin_mz=4.0, serial=True).drop("fit")


@query("psms", sql="WITH t AS (SELECT *, 'monoisotopic_mass_delta: 15.99491, average_mass_delta: 15.9994, residues: M, location: ' || CAST(psm_index % 20 AS VARCHAR) || ', id: UNIMOD:35|Oxidation; XL:1|again' AS one, 'monoisotopic_mass_delta: 42.01057, average_mass_delta: 0.0, residues: , location: -1, id: UNIMOD:1|Acetyl' AS two FROM psms) SELECT file_id, psm_index, CASE WHEN psm_index % 3 = 0 THEN '' WHEN psm_index % 3 = 1 THEN one ELSE one || ' / ' || two END AS modifications, CAST(psm_index % 3 AS INT) AS n FROM t")
def modification_text(q):
    mod = lambda mono, avg, residues, at, *ids: F.struct(F.lit(mono).alias("monoisotopic_mass_delta"), F.lit(avg).cast("double").alias("average_mass_delta"), F.lit(residues).cast("string").alias("residues"), at.cast("int").alias("location"), F.array(*map(F.lit, ids)).alias("id"))
    both = F.array(mod(15.99491, 15.9994, "M", F.col("psm_index") % 20, "UNIMOD:35|Oxidation", "XL:1|again"), mod(42.01057, None, None, F.lit(-1), "UNIMOD:1|Acetyl"))
    q = q.withColumn("modifications", F.slice(both, F.lit(1), (F.col("psm_index") % 3).cast("int")))
    return q.select("file_id", "psm_index", quant.modification_text().alias("modifications"), F.size("modifications").alias("n"))


@query("edges", "psms", sql="SELECT s.file_id, s.psm_index, e.protein, concat('protein ', CAST(e.protein AS VARCHAR)) AS description FROM psms s JOIN edges e ON e.peptide = s.psm_index")
def evidence_joins(e, q):
    told = q.select("file_id", "psm_index", F.col("psm_index").alias("peptide_id"))
    proof = e.select(F.col("peptide").alias("peptide_id"), F.col("protein").alias("db_sequence_id"))
    seqs = e.select(F.col("protein").alias("db_sequence_id"), F.col("protein"), F.concat(F.lit("protein "), F.col("protein").cast("string")).alias("description")).distinct()
    return quant.with_proteins(told, proof, seqs).select("file_id", "psm_index", "protein", "description")


@query("peaks", sql="WITH " + _FEATURES + " SELECT file_id, first AS feature_id, 2 AS charge_state, peak_id FROM c")
def feature_peaks(k):
    return quant.feature_peaks(_triples(k).withColumnRenamed("first_id", "feature_id"))


@query("peaks", sql="SELECT file_id, CAST(floor(fitted_height) AS BIGINT) AS bin, count(*) AS peaks FROM peaks GROUP BY ALL")
def height_histogram(k):
    return summary.histogram(k, "fitted_height", 1.0).withColumnRenamed("count", "peaks")


@query("peaks", sql="SELECT file_id, peak_id, fitted_rt AS rt, rt_delta, fitted_mz AS mz, fitted_sigma_mz AS sigma_mz FROM peaks WHERE peak_id < 200000")
def scatter_points(k):
    return summary.scatter(k, 200_000)


@query("msms", sql="SELECT event_id, CAST((event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id % 600) / CAST(10 AS DOUBLE) AS DOUBLE) AS seconds FROM msms")
def durations(e):
    text = F.concat(F.lit("PT"), (F.col("event_id") % 24).cast("string"), F.lit("H"), (F.col("event_id") % 60).cast("string"), F.lit("M"), ((F.col("event_id") % 600) / 10).cast("string"), F.lit("S"))
    return e.select("event_id", X.duration_seconds(text).alias("seconds"))


# --- sources ----------------------------------------------------------------------------------


def _encoded(p, write):
    s = p.groupBy("file_id", "rt").agg(F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("v"))
    s = s.select(F.col("file_id").cast("string").alias("path"), F.col("rt").cast("long").alias("number"), "rt", F.col("v.mz").alias("mz"), F.col("v.intensity").alias("intensity"))
    return encode.pieces(s.withColumn("number", F.col("number") + 1), write)


def _decoded(pieces, parse, **limits):
    s = spectra.decode_pieces(pieces, parse, **limits).withColumn("file_id", F.col("path").cast("int"))
    return spectra.to_points(s).select("file_id", "rt", "mz", "intensity")


@query("points", sql="SELECT file_id, rt, mz, intensity FROM points WHERE mz BETWEEN 400 AND 900 AND rt BETWEEN 100 AND 2000 AND intensity <> 0")
def read_mzxml(p):
    return _decoded(_encoded(p, encode.mzxml_scan), spectra.parse_mzxml, min_mz=400.0, max_mz=900.0, min_rt=100.0, max_rt=2000.0)


@query("points", sql="SELECT file_id, rt, mz, intensity FROM points WHERE intensity <> 0")
def read_mzml(p):
    return _decoded(_encoded(p, encode.mzml_spectrum), spectra.parse_mzml, polarity="+", ms_level=1)


def _from_files(p, kind):
    """Points written as a file per run in the shared folder, and read back through the spectrum source."""
    spark = files.register(p.sparkSession)
    out = f"{shared_dir(spark)}/spectra-{uuid.uuid4().hex}"
    s = p.groupBy("file_id", "rt").agg(F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("v"))
    s = s.select(F.col("file_id").cast("string").alias("path"), (F.col("rt").cast("long") + 1).alias("number"), "rt", F.col("v.mz").alias("mz"), F.col("v.intensity").alias("intensity"))
    encode.write_files(s, out, kind)
    return spark.read.format("spectra").option("format", kind).load(out).withColumn("file_id", F.regexp_extract("path", "path=([0-9]+)/", 1).cast("int"))


@query("points", sql="SELECT file_id, rt, mz, intensity FROM points WHERE rt BETWEEN 100 AND 2000 AND intensity <> 0")
def spectrum_files_mzxml(p):
    return spectra.to_points(_from_files(p, "mzxml").where("retention_time between 100 and 2000 and ms_level = 1")).select("file_id", "rt", "mz", "intensity")


@query("points", sql="SELECT file_id, rt, count(*) AS num_points, max(intensity) AS max_intensity, sum(intensity) AS total_intensity FROM points WHERE intensity <> 0 GROUP BY file_id, rt")
def spectrum_files_mzml(p):
    return _from_files(p, "mzml").where("polarity = 'positive'").select("file_id", F.col("retention_time").alias("rt"), "num_points", "max_intensity", "total_intensity")


@query("peaks", sql="SELECT file_id, peak_id, fitted_mz, fitted_rt, rt_delta, fitted_height, fitted_sigma_mz, fitted_sigma_rt, fitted_volume FROM peaks")
def csv_round_trip(k):
    """A result table as CSV in the shared folder, read back with its types."""
    out = f"{shared_dir(k.sparkSession)}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(k, out)
    return sinks.read_csv(k.sparkSession, out, ", ".join(f"{c} {kind}" for c, kind in k.dtypes))


@query("peaks", sql="SELECT file_id, count(*) AS n, min(fitted_mz) AS least, max(peak_id) AS last FROM peaks GROUP BY file_id")
def stage_round_trip(k):
    """A stage table by file with its digest, taken up by a second call."""
    out = f"{shared_dir(k.sparkSession)}/stages-{uuid.uuid4().hex}"
    sinks.Stages(k.sparkSession, out).table("peaks", lambda: k, uses=[1.5, "both"])
    again = sinks.Stages(k.sparkSession, out).table("peaks", lambda: k.limit(0), uses=[1.5, "both"])
    return again.groupBy("file_id").agg(F.count("*").alias("n"), F.min("fitted_mz").alias("least"), F.max("peak_id").alias("last"))


#: Results of one mzIdentML file.
FILE_ROWS = 50_000


def _identification_files(q, compression: str = "none") -> str:
    """Identifications as mzIdentML files of the runs: two ranks a spectrum, a protein each, some decoys and some below the threshold."""
    out = f"{shared_dir(q.sparkSession)}/identifications-{uuid.uuid4().hex}"
    i, attribute = F.col("psm_index").cast("string"), lambda name, value: F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"'))
    name, decoy, good = F.concat(F.lit("P"), (F.col("psm_index") % 50).cast("string")), F.col("psm_index") % 7 == 0, F.col("psm_index") % 5 != 0

    def item(kind, rank):
        masses = attribute("experimentalMassToCharge", F.col("mz")), attribute("calculatedMassToCharge", F.col("theoretical_mz"))
        return F.concat(F.lit("<SpectrumIdentificationItem"), attribute("id", F.concat(F.lit(kind), i)), attribute("peptide_ref", F.concat(F.lit("p"), i)), attribute("passThreshold", good), attribute("rank", F.lit(rank)), attribute("chargeState", F.col("psm_charge_state")), *masses, F.lit("/>"))

    text = F.concat(
        F.lit("<DBSequence"), attribute("id", F.concat(F.lit("d"), i)), attribute("accession", name), F.lit(' searchDatabase_ref="s"><cvParam accession="MS:1001088" name="protein description"'), attribute("value", F.concat(F.lit("about "), name)), F.lit("/></DBSequence><Peptide"),
        attribute("id", F.concat(F.lit("p"), i)), F.lit("><PeptideSequence>"), F.col("sequence"), F.lit("</PeptideSequence></Peptide><PeptideEvidence"), attribute("id", F.concat(F.lit("e"), i)), attribute("peptide_ref", F.concat(F.lit("p"), i)),
        attribute("dBSequence_ref", F.concat(F.lit("d"), i)), attribute("isDecoy", decoy), F.lit("/><SpectrumIdentificationResult"), attribute("id", F.concat(F.lit("r"), i)), attribute("spectrumID", F.concat(F.lit("scan="), i)), F.lit(">"),
        item("second", 2), item("m", 1), F.lit('<cvParam accession="MS:1000016" name="time" unitAccession="UO:0000010"'), attribute("value", F.col("rt")), F.lit("/></SpectrumIdentificationResult>"),
    )
    # A run's file is one task's work, so a run has as many files as hold about ``FILE_ROWS`` results each; all elements of a result are in the same one.
    parts = q.groupBy("file_id").agg(F.ceil(F.count("*") / FILE_ROWS).alias("parts"))
    told = ["psm_index", "mz", "rt", "theoretical_mz", "psm_charge_state", "sequence"]
    rows = q.select("file_id", *told).join(F.broadcast(parts), "file_id").withColumn("part", F.pmod(F.xxhash64("psm_index"), "parts")).drop("parts")  # one row per run
    rows = rows.withColumns({"place": F.lit(0), "k": F.col("psm_index")})
    ends = parts.select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("place"))
    # Files get their rows as columns; the text, about ten times as long, is made behind the shuffle.
    rows = rows.unionByName(ends, allowMissingColumns=True).repartition("file_id", "part").sortWithinPartitions("file_id", "part", "place", "k")
    value = F.when(F.col("place") < 0, F.lit('<?xml version="1.0"?><MzIdentML>')).when(F.col("place") > 0, F.lit("</MzIdentML>")).otherwise(text)
    rows.select("file_id", "part", value.alias("value")).write.partitionBy("file_id", "part").text(out, compression=compression)
    return out


_IDENTIFIED = """SELECT file_id, 'm' || CAST(psm_index AS VARCHAR) AS match_id, sequence, CAST(psm_charge_state AS INT) AS charge_state, mz AS experimental_mz, theoretical_mz, rt, 1 AS rank, 'P' || CAST(psm_index % 50 AS VARCHAR) AS accession, 'about P' || CAST(psm_index % 50 AS VARCHAR) AS description
    FROM psms WHERE psm_index % 5 <> 0 AND psm_index % 7 <> 0 AND mz BETWEEN 350 AND 900"""


@query("psms", sql=_IDENTIFIED)
def identification_files(q):
    return _identified(identifications.read_mzidentml(q.sparkSession, _identification_files(q, "gzip"), min_mz=350.0, max_mz=900.0))


@query("psms", sql=_IDENTIFIED)
def identification_files_in_one_pass(q):
    return _identified(identifications.read_mzidentml(q.sparkSession, _identification_files(q, "gzip"), min_mz=350.0, max_mz=900.0, one_pass=True))


def _identified(d):
    m = d.spectrum_matches.join(d.peptides, ["path", "peptide_id"]).join(d.peptide_evidence, ["path", "peptide_id"]).join(d.db_sequences, ["path", "db_sequence_id"])
    return m.select(F.regexp_extract("path", "file_id=([0-9]+)/", 1).cast("int").alias("file_id"), "match_id", "sequence", "charge_state", "experimental_mz", "theoretical_mz", "rt", "rank", "accession", "description")
