"""From local maxima to fitted peaks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mzloom.functions.exprs import sigma_mz, sigma_rt
from mzloom.operators.rangejoin import boxed
from mzloom.params import Run

#: One text per failure bit, in bit order.
FAILURES = [
    "Weight sum is zero",
    "NaN detected in parameter 'a'", "NaN detected in parameter 'b'", "NaN detected in parameter 'c'", "NaN detected in parameter 'd'", "NaN detected in parameter 'e'",
    "Infinity detected in parameter 'a'", "Infinity detected in parameter 'b'", "Infinity detected in parameter 'c'", "Infinity detected in parameter 'd'", "Infinity detected in parameter 'e'",
    "Parameter 'c' is non-negative", "Parameter 'e' is non-negative",
    "NaN detected in fitted height", "NaN detected in fitted mz", "NaN detected in fitted sigma_mz", "NaN detected in fitted rt", "NaN detected in fitted sigma_rt",
    "Infinity detected in fitted height", "Infinity detected in fitted mz", "Infinity detected in fitted sigma_mz", "Infinity detected in fitted rt", "Infinity detected in fitted sigma_rt",
    "Fitted height is non-positive", "Fitted sigma_mz is non-positive", "Fitted sigma_rt is non-positive", "Fitted mz is non-positive", "Fitted rt is non-positive",
    "Raw ROI sigma_mz is non-positive", "Raw ROI sigma_rt is non-positive", "Fitted height exceeds twice the raw ROI max height",
    "Fitted mz is outside the expected range", "Fitted mz is outside the expected range", "Fitted rt is outside the expected range", "Fitted rt is outside the expected range",
    "Fitted sigma_mz is too small", "Fitted sigma_rt is too small", "Fitted sigma_mz is too large", "Fitted sigma_rt is too large",
]


def regions(maxima: DataFrame, run: Run) -> DataFrame:
    """Region of interest of local maxima (file_id, mz, rt, value): two theoretical sigma each way."""
    s_mz, s_rt = sigma_mz("mz", run), F.lit(sigma_rt(run))
    return maxima.select(
        "file_id", F.col("mz").alias("local_max_mz"), F.col("rt").alias("local_max_rt"), F.col("value").alias("local_max_height"),
        s_mz.alias("theory_mz"), s_rt.alias("theory_rt"),
        (F.col("mz") - 2 * s_mz).alias("roi_min_mz"), (F.col("mz") + 2 * s_mz).alias("roi_max_mz"),
        (F.col("rt") - 2 * s_rt).alias("roi_min_rt"), (F.col("rt") + 2 * s_rt).alias("roi_max_rt"),
    )


def in_regions(points: DataFrame, rois: DataFrame, bin_mz: float, bin_rt: float) -> DataFrame:
    """Every point of every region, equal points as one row with their number n; regions are identified by (file_id, local_max_mz, local_max_rt).

    Both axes are binned and crowded cells split, so that neither a dense range of m/z nor a short time is one task. ``opens`` marks the
    point of the lowest m/z that a region has of a scan, so that scans are counted without telling their times apart again.
    """
    box = ("roi_min_mz", "roi_max_mz", "roi_min_rt", "roi_max_rt")
    merged = points.groupBy("file_id", "mz", "rt", "intensity").agg(F.count("*").alias("n"))
    merged = merged.withColumn("before", F.lag("mz").over(W.partitionBy("file_id", "rt").orderBy("mz")))
    j = boxed(merged, rois, ["file_id"], "mz", "rt", box, (bin_mz, bin_rt))
    opens = F.col("p.before").isNull() | (F.col("p.before") < F.col("r.roi_min_mz"))
    return j.select(*[F.col(f"r.{c}").alias(c) for c in rois.columns], *[F.col(f"p.{c}").alias(c) for c in ("mz", "rt", "intensity", "n")], opens.alias("opens"))


ROI_KEY = ["file_id", "local_max_mz", "local_max_rt", "local_max_height", "theory_mz", "theory_rt", "roi_min_mz", "roi_max_mz", "roi_min_rt", "roi_max_rt"]


def raw_moments(members: DataFrame) -> DataFrame:
    """Intensity-weighted mean, sigma, skewness and kurtosis of every region, and the sums for the fit.

    Powers of offsets from the local maximum, in theoretical sigmas, are summed in one aggregation and
    turned into central moments; offsets are small, so nothing is lost by not taking a second pass.
    Regions with fewer than three scans are dropped.
    """
    u, v = (F.col("mz") - F.col("local_max_mz")) / F.col("theory_mz"), (F.col("rt") - F.col("local_max_rt")) / F.col("theory_rt")
    m = members.withColumn("u", u).withColumn("v", v)
    w2 = F.when(F.col("intensity") > 0, F.pow(F.col("intensity") * F.exp(-0.5 * (F.col("u") * F.col("u") + F.col("v") * F.col("v"))), F.lit(2.0))).otherwise(0.0)
    y = F.when(F.col("intensity") > 0, F.log(F.col("intensity"))).otherwise(0.0)
    m = m.withColumn("w2", w2).withColumn("y", y)

    def power(c, k):
        out = F.lit(1.0)
        for _ in range(k):
            out = out * F.col(c)
        return out

    n = F.col("n") if "n" in members.columns else F.lit(1)
    scans = F.sum(F.col("opens").cast("long")) if {"n", "opens"} <= set(members.columns) else F.countDistinct("rt")
    sums = [F.sum(n * F.col("intensity") * power(c, k)).alias(f"s_{c}{k}") for c in "uv" for k in (1, 2, 3, 4)]
    fit = [F.sum(n * F.col("w2") * power("u", p) * power("v", q)).alias(f"m{p}{q}") for p, q in MOMENTS]
    fit += [F.sum(n * F.col("w2") * F.col("y") * power("u", p) * power("v", q)).alias(f"y{p}{q}") for p, q in TERMS]
    g = m.groupBy(*ROI_KEY).agg(
        F.sum(n * F.col("intensity")).alias("raw_roi_total_intensity"), F.greatest(F.lit(0.0), F.max("intensity")).alias("raw_roi_max_height"),
        F.sum(n).cast("long").alias("raw_roi_num_points"), scans.alias("raw_roi_num_scans"), *sums, *fit,
    ).where("raw_roi_num_scans >= 3")
    for c, axis in (("u", "mz"), ("v", "rt")):
        a = [F.try_divide(F.col(f"s_{c}{k}"), F.col("raw_roi_total_intensity")) for k in (1, 2, 3, 4)]
        m2 = a[1] - a[0] * a[0]
        m3 = a[2] - 3 * a[0] * a[1] + 2 * a[0] * a[0] * a[0]
        m4 = a[3] - 4 * a[0] * a[2] + 6 * a[0] * a[0] * a[1] - 3 * a[0] * a[0] * a[0] * a[0]
        g = g.withColumn(f"raw_roi_mean_{axis}", F.col(f"local_max_{axis}") + a[0] * F.col(f"theory_{axis}"))
        g = g.withColumn(f"raw_roi_sigma_{axis}", F.sqrt(F.greatest(m2, F.lit(0.0))) * F.col(f"theory_{axis}"))
        g = g.withColumn(f"raw_roi_skewness_{axis}", F.try_divide(m3, F.pow(F.greatest(m2, F.lit(0.0)), F.lit(1.5))))
        g = g.withColumn(f"raw_roi_kurtosis_{axis}", F.try_divide(m4, F.pow(m2, F.lit(2.0))))
    return g.drop(*[f"s_{c}{k}" for c in "uv" for k in (1, 2, 3, 4)])


#: Powers (u, v) of the model's terms 1, u, u^2, v, v^2, and of all their products.
TERMS = [(0, 0), (1, 0), (2, 0), (0, 1), (0, 2)]
MOMENTS = sorted({(a + c, b + d) for a, b in TERMS for c, d in TERMS})


def solve(sums: np.ndarray, rhs: np.ndarray, centroid: bool = False) -> np.ndarray:
    """Least-squares parameters (a, b, c, d, e) of ln I = a + b u + c u^2 + d v + e v^2, row by row.

    ``sums`` has the columns of MOMENTS. With ``centroid``, b is 0 and c is -1/2 (the theoretical width).
    """
    at = {m: k for k, m in enumerate(MOMENTS)}
    a = np.stack([np.stack([sums[:, at[p + r, q + s]] for r, s in TERMS], 1) for p, q in TERMS], 1)
    use = [0, 3, 4] if centroid else [0, 1, 2, 3, 4]
    if centroid:
        rhs = rhs + 0.5 * a[:, :, 2]
    # A scaled system: its diagonal is one, so the rank test doesn't depend on intensities.
    d = np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))[:, use]
    scaled = a[:, use][:, :, use] / d[:, :, None] / d[:, None, :]
    out = np.zeros((len(a), 5))
    out[:, use] = np.einsum("nij,nj->ni", np.linalg.pinv(scaled, rcond=1e-12, hermitian=True), rhs[:, use] / d) / d if len(a) else 0
    if centroid:
        out[:, 2] = -0.5
    return out


def fit(moments: DataFrame, centroid: bool = False) -> DataFrame:
    """Adds the parameters a to e (in sigma units) and the fitted height, mz, rt, sigmas and volume."""
    cols = [f"m{p}{q}" for p, q in MOMENTS] + [f"y{p}{q}" for p, q in TERMS]

    @F.pandas_udf("a double, b double, c double, d double, e double")
    def parameters(x: pd.DataFrame) -> pd.DataFrame:
        v = x.to_numpy(float)
        return pd.DataFrame(solve(v[:, : len(MOMENTS)], v[:, len(MOMENTS) :], centroid), columns=list("abcde"))

    m = moments.withColumn("fit", parameters(F.struct(*cols)))
    a, b, c, d, e = (F.col(f"fit.{x}") for x in "abcde")
    width = lambda q, s: F.when(q < 0, F.sqrt(F.try_divide(F.lit(-0.5), q)) * F.col(s)).otherwise(F.lit(math.nan))
    center = lambda p, q, at, s: F.when(q != 0, F.col(at) - p / (2 * q) * F.col(s)).otherwise(F.lit(math.nan))
    m = m.withColumn("fitted_height", F.exp(log_height()))
    m = m.withColumn("fitted_mz", center(b, c, "local_max_mz", "theory_mz")).withColumn("fitted_rt", center(d, e, "local_max_rt", "theory_rt"))
    m = m.withColumn("fitted_sigma_mz", width(c, "theory_mz")).withColumn("fitted_sigma_rt", width(e, "theory_rt"))
    m = m.withColumn("fitted_volume", F.col("fitted_height") * F.col("fitted_sigma_mz") * F.col("fitted_sigma_rt") * (2 * math.pi))
    m = m.withColumn("fit_failure_code", failure_code())
    return m.withColumn("peak_fit_failure", F.col("fit_failure_code") != 0).drop(*cols)


def log_height() -> Column:
    """Logarithm of the fitted height; it stays finite where the height itself is beyond what a double holds."""
    a, b, c, d, e = (F.col(f"fit.{x}") for x in "abcde")
    return a - F.try_divide(b * b, 4 * c) - F.try_divide(d * d, 4 * e)


def _bad(c: Column) -> tuple[Column, Column]:
    return F.isnan(c) | c.isNull(), F.coalesce(F.abs(c) == math.inf, F.lit(False))


def failure_code(parameters: bool = True) -> Column:
    """Bits of everything wrong with a fit, from the columns of ``fit``."""
    bits: dict[int, Column] = {0: F.col("raw_roi_total_intensity") == 0}
    if parameters:
        for k, x in enumerate("abcde"):
            bits[1 + k], bits[6 + k] = _bad(F.col(f"fit.{x}"))
        bits[11], bits[12] = F.col("fit.c") >= 0, F.col("fit.e") >= 0
    order = ["fitted_height", "fitted_mz", "fitted_sigma_mz", "fitted_rt", "fitted_sigma_rt"]
    for k, x in enumerate(order):
        bits[13 + k], bits[18 + k] = _bad(F.col(x))
    for k, x in enumerate(["fitted_height", "fitted_sigma_mz", "fitted_sigma_rt", "fitted_mz", "fitted_rt"]):
        bits[23 + k] = F.col(x) <= 0
    bits |= quality_bits()
    code = F.lit(0).cast("long")
    for n, c in sorted(bits.items()):
        code = code.bitwiseOR(F.when(F.coalesce(c, F.lit(False)), F.lit(1 << n)).otherwise(F.lit(0).cast("long")))
    return code


def quality_bits() -> dict[int, Column]:
    """Tests of a fitted peak against its region and the theoretical widths (NaN fails none)."""
    c = F.col
    tests: dict[int, Column] = {28: c("raw_roi_sigma_mz") <= 0, 29: c("raw_roi_sigma_rt") <= 0, 30: (c("fitted_height") > 2 * c("raw_roi_max_height")) & ~F.isnan("fitted_height")}
    for n, axis in ((31, "mz"), (33, "rt")):
        x, at, s = c(f"fitted_{axis}"), c(f"local_max_{axis}"), c(f"theory_{axis}")
        tests[n], tests[n + 1] = (x < at - 3 * s), (x > at + 3 * s) & ~F.isnan(x)
    for k, axis in enumerate(("mz", "rt")):
        x, s = c(f"fitted_sigma_{axis}"), c(f"theory_{axis}")
        tests[35 + k], tests[37 + k] = x <= s / 3, (x >= s * 3) & ~F.isnan(x)
    return tests


def failure_text(code) -> Column:
    """The decoded mask as text: a heading and a line for every bit."""
    code = F.col(code) if isinstance(code, str) else code
    said = F.filter(F.transform(F.array(*[F.lit(x) for x in FAILURES]), lambda m, i: F.when(F.call_function("shiftright", code, i).bitwiseAND(F.lit(1)) == 1, m)), lambda x: x.isNotNull())
    lines = F.when(code == 0, F.array(F.lit("No errors detected."))).otherwise(F.transform(said, lambda x: F.concat(F.lit("- "), x)))
    return F.concat(F.array_join(F.concat(F.array(F.lit("Fit Failure Errors:")), lines), "\n"), F.lit("\n"))


def rank(peaks: DataFrame, max_peaks: int, by: str = "fitted_height") -> DataFrame:
    """peak_id by descending ``by`` per file (ties: lower mz, then rt), cut at ``max_peaks``."""
    order = W.partitionBy("file_id").orderBy(F.desc(by), "local_max_mz", "local_max_rt")
    return peaks.withColumn("peak_id", F.row_number().over(order).cast("long") - 1).where(F.col("peak_id") < max_peaks)


def find_peaks(points: DataFrame, maxima: DataFrame, run: Run, max_peaks: int = 1000, centroid: bool = False, failed: bool = False, bin_mz: float = 1.0, serial: bool = False) -> DataFrame:
    """Fitted peaks of local maxima. With ``failed``, failed fits stay, with their failure code.

    ``serial`` numbers the successes by local maximum instead of fitted height.
    """
    fitted = fit(raw_moments(in_regions(points, regions(maxima, run), bin_mz, 4 * sigma_rt(run))), centroid)
    if not failed:
        fitted = fitted.where("fit_failure_code = 0")
    return rank(fitted.withColumn("rt_delta", F.lit(0.0)), max_peaks, "local_max_height" if serial else "fitted_height")


def from_arrays(df: DataFrame, sigma_mz: float | Column | None = 0.01, sigma_rt: float | Column | None = 15.0, roi: float = 3.0) -> DataFrame:
    """Peaks from rows (file_id, mz, rt, intensity): fitted = given, region of ``roi`` sigma, full volume."""
    s_mz = sigma_mz if isinstance(sigma_mz, Column) else F.lit(float(sigma_mz))
    s_rt = sigma_rt if isinstance(sigma_rt, Column) else F.lit(float(sigma_rt))
    c = F.col
    out = df.withColumn("fitted_sigma_mz", s_mz).withColumn("fitted_sigma_rt", s_rt)
    for axis in ("mz", "rt"):
        s = c(f"fitted_sigma_{axis}")
        out = out.withColumn(f"local_max_{axis}", c(axis)).withColumn(f"fitted_{axis}", c(axis))
        out = out.withColumn(f"roi_min_{axis}", c(axis) - roi * s).withColumn(f"roi_max_{axis}", c(axis) + roi * s)
    out = out.withColumn("fitted_height", c("intensity")).withColumn("local_max_height", c("intensity")).withColumn("rt_delta", F.lit(0.0))
    return out.withColumn("fitted_volume", c("intensity") * (2 * math.pi) * c("fitted_sigma_mz") * c("fitted_sigma_rt")).drop("mz", "rt", "intensity")
