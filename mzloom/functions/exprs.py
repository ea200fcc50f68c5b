"""Column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from mzloom.params import Run, instrument

SIGMA = 2 * math.sqrt(2 * math.log(2))
EXPONENT = {"orbitrap": 1.5, "fticr": 2.0, "tof": 1.0, "quad": 0.0}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c))


def theoretical_fwhm(mz, run: Run) -> Column:
    """Peak width in m/z at ``mz``; the MS1 resolution is used at every level."""
    base = run.reference_mz / run.resolution_ms1
    return F.lit(base) * F.pow(col(mz) / run.reference_mz, F.lit(EXPONENT[instrument(run.instrument)]))


def fwhm_to_sigma(fwhm) -> Column:
    return col(fwhm) / SIGMA


def sigma_mz(mz, run: Run) -> Column:
    return fwhm_to_sigma(theoretical_fwhm(mz, run))


def sigma_rt(run: Run) -> float:
    return run.fwhm_rt / SIGMA


def lerp(y0, y1, x) -> Column:
    return (1 - col(x)) * col(y0) + col(x) * col(y1)


def x_index(mz, min_mz, run: Run, k: int, guard: float = 0.0) -> Column:
    """Grid column of ``mz``: bins hold a constant number of samples per peak width."""
    mz, low, ref = col(mz), col(min_mz), run.reference_mz
    fwhm = ref / run.resolution_ms1
    kind = instrument(run.instrument)
    if kind == "orbitrap":
        at = k * 2 / (fwhm / ref**1.5) * (1 / F.sqrt(low) - 1 / F.sqrt(mz))
    elif kind == "fticr":
        at = k * (1 - low / mz) * ref**2 / (F.lit(fwhm) * low)
    elif kind == "tof":
        at = F.lit(k * ref / fwhm) * F.log(mz / low)
    else:
        at = k * (mz - low) / fwhm
    return F.floor(at + guard if guard else at).cast("long")


def mz_at(i, min_mz, max_mz, n, run: Run, k: int) -> Column:
    i, low, ref = col(i), col(min_mz), run.reference_mz
    fwhm = ref / run.resolution_ms1
    kind = instrument(run.instrument)
    if kind == "orbitrap":
        return F.pow(1 / F.sqrt(low) - i * (fwhm / ref**1.5 / (2 * k)), F.lit(-2.0))
    if kind == "fticr":
        return low / (1 - i * fwhm * low / (k * ref**2))
    if kind == "tof":
        return low * F.exp(i * (fwhm / (k * ref)))
    return low + i * (col(max_mz) - low) / (col(n) - 1)


def y_index(rt, min_rt, run: Run, k: int) -> Column:
    """Grid row of ``rt``; the spacing follows the number of samples in m/z."""
    return F.ceil((col(rt) - col(min_rt)) / (run.fwhm_rt / k)).cast("long")


def rt_at(j, min_rt, max_rt, m) -> Column:
    return col(min_rt) + col(j) * (col(max_rt) - col(min_rt)) / (col(m) - 1)


def overlap(a: str, b: str) -> Column:
    """Shared volume of two Gaussian peaks ``a.*`` and ``b.*``; 0 unless their 3-sigma boxes touch."""

    def axis(x, y, sx, sy):
        vx, vy = sx * sx, sy * sy
        return vx * vy * F.exp(-0.5 * F.pow(x - y, F.lit(2.0)) / (vx + vy)) / F.sqrt(vx + vy)

    def c(t, n):
        return F.col(f"{t}.{n}")

    rta, rtb = c(a, "fitted_rt") + c(a, "rt_delta"), c(b, "fitted_rt") + c(b, "rt_delta")
    product = axis(rta, rtb, c(a, "fitted_sigma_rt"), c(b, "fitted_sigma_rt")) * axis(c(a, "fitted_mz"), c(b, "fitted_mz"), c(a, "fitted_sigma_mz"), c(b, "fitted_sigma_mz"))
    return F.when(boxes_touch(a, b), product * c(a, "fitted_height") * c(b, "fitted_height")).otherwise(0.0)


def boxes_touch(a: str, b: str, n: float = 3.0) -> Column:
    def c(t, x):
        return F.col(f"{t}.{x}")

    rt = F.abs(c(a, "fitted_rt") + c(a, "rt_delta") - c(b, "fitted_rt") - c(b, "rt_delta")) <= n * (c(a, "fitted_sigma_rt") + c(b, "fitted_sigma_rt"))
    return rt & (F.abs(c(a, "fitted_mz") - c(b, "fitted_mz")) <= n * (c(a, "fitted_sigma_mz") + c(b, "fitted_sigma_mz")))


def duration_seconds(c) -> Column:
    """Seconds of an xs:duration such as PT1H2M3.5S."""
    c = col(c)

    def part(unit):
        found = F.regexp_extract(c, rf"([0-9]*\.?[0-9]+){unit}", 1)
        return F.when(found == "", 0.0).otherwise(found.cast("double"))

    return part("H") * 3600 + part("M") * 60 + part("S")


def normalised_distance(mz_a, rt_a, s_mz_a, s_rt_a, mz_b, rt_b, s_mz_b, s_rt_b) -> Column:
    """Distance of two peaks in units of their summed sigmas."""
    dr = (col(rt_a) - col(rt_b)) / (col(s_rt_a) + col(s_rt_b))
    dm = (col(mz_a) - col(mz_b)) / (col(s_mz_a) + col(s_mz_b))
    return F.sqrt(dr * dr + dm * dm)
