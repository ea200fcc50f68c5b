"""Resampling of points onto a sparse grid, smoothing, and local maxima.

Cells are rows (file_id, i, j, value); absent cells are 0. A run's bounds come in a one-row-per-file frame
``bounds`` (file_id, min_mz, max_mz, min_rt, max_rt), which is small (one row per run).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mzloom.functions.exprs import SIGMA, mz_at, rt_at, sigma_mz, x_index, y_index
from mzloom.operators.tiles import TILE, tiled
from mzloom.params import Resampling, Run


def bounds_of(points: DataFrame) -> DataFrame:
    return points.groupBy("file_id").agg(F.min("mz").alias("min_mz"), F.max("mz").alias("max_mz"), F.min("rt").alias("min_rt"), F.max("rt").alias("max_rt"))


def shape(bounds: DataFrame, run: Run, how: Resampling) -> DataFrame:
    """Adds the grid's number of columns n and rows m."""
    k = how.num_samples_mz
    return bounds.withColumn("n", x_index("max_mz", "min_mz", run, k) + 1).withColumn("m", y_index("max_rt", "min_rt", run, k) + 1)


def half_widths(run: Run, how: Resampling) -> tuple[int, int]:
    """Kernel half widths (m/z, rt): seven sigma in bins, five at least."""
    rt = int(7 * run.fwhm_rt / SIGMA * how.smoothing_coef_rt / math.sqrt(2) / (run.fwhm_rt / how.num_samples_rt))
    fwhm = run.reference_mz / run.resolution_ms1
    mz = int(7 * fwhm / SIGMA * how.smoothing_coef_mz / math.sqrt(2) / (fwhm / how.num_samples_mz))
    return (5 if mz <= 4 else mz), (5 if rt <= 4 else rt)


def _near(at: str, hw: int, size: str):
    return F.explode(F.sequence(F.greatest(F.col(at) - hw, F.lit(0)), F.least(F.col(at) + hw, F.col(size) - 1)))


def splat(points: DataFrame, bounds: DataFrame, run: Run, how: Resampling) -> DataFrame:
    """Spread every point over its neighbourhood with Gaussian weights that sum to one, and add up.

    A point's weights are kept in an array, so they are normalised in its row without a shuffle.
    """
    k = how.num_samples_mz
    hw_mz, hw_rt = half_widths(run, how)
    s_rt = run.fwhm_rt / SIGMA * how.smoothing_coef_rt / math.sqrt(2)
    g = shape(bounds, run, how)
    p = points.join(F.broadcast(g), "file_id")  # one row per run
    p = p.withColumn("ci", x_index("mz", "min_mz", run, k)).withColumn("cj", y_index("rt", "min_rt", run, k))
    center = mz_at("ci", "min_mz", "max_mz", "n", run, k)
    p = p.withColumn("s", sigma_mz(center, run) * (how.smoothing_coef_mz / math.sqrt(2)))
    span = lambda c, hw, n: F.sequence(F.greatest(F.col(c) - hw, F.lit(0)), F.least(F.col(c) + hw, F.col(n) - 1))

    def gauss(x):
        return F.exp(-0.5 * x * x)

    wi = F.transform(span("ci", hw_mz, "n"), lambda i: F.struct(i.alias("at"), gauss((mz_at(i, "min_mz", "max_mz", "n", run, k) - F.col("mz")) / F.col("s")).alias("w")))
    wj = F.transform(span("cj", hw_rt, "m"), lambda j: F.struct(j.alias("at"), gauss((rt_at(j, "min_rt", "max_rt", "m") - F.col("rt")) / s_rt).alias("w")))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["w"])
    # The kernel is a product, so its sum is the product of the sums.
    p = p.select("file_id", "intensity", wi.alias("wi"), wj.alias("wj"))
    p = p.withColumn("t", total("wi") * total("wj")).withColumn("scale", F.col("intensity") / F.when(F.col("t") == 0, 1.0).otherwise(F.col("t")))
    p = p.select("file_id", "scale", "wj", F.explode("wi").alias("a")).select("file_id", "scale", "a", F.explode("wj").alias("b"))
    return p.groupBy("file_id", F.col("a.at").alias("i"), F.col("b.at").alias("j")).agg(F.sum(F.col("scale") * F.col("a.w") * F.col("b.w")).alias("value"))


def smooth_rt(cells: DataFrame, bounds: DataFrame, run: Run, how: Resampling) -> DataFrame:
    """Kernel-weighted mean along time; absent cells count as 0 and borders are clipped."""
    return _smooth(cells, shape(bounds, run, how), run, how, along_rt=True)


def smooth_mz(cells: DataFrame, bounds: DataFrame, run: Run, how: Resampling) -> DataFrame:
    return _smooth(cells, shape(bounds, run, how), run, how, along_rt=False)


def _smooth(cells: DataFrame, g: DataFrame, run: Run, how: Resampling, along_rt: bool) -> DataFrame:
    hw = half_widths(run, how)[along_rt]
    axis, size = ("j", "m") if along_rt else ("i", "n")
    k = how.num_samples_mz
    c = cells.join(F.broadcast(g), "file_id").withColumn("to", _near(axis, hw, size))

    def position(x):
        return rt_at(x, "min_rt", "max_rt", "m") if along_rt else mz_at(x, "min_mz", "max_mz", "n", run, k)

    def kernel(target, source):
        s = F.lit(run.fwhm_rt / SIGMA * how.smoothing_coef_rt / math.sqrt(2)) if along_rt else sigma_mz(position(target), run) * (how.smoothing_coef_mz / math.sqrt(2))
        d = (position(source) - position(target)) / s
        return F.exp(-0.5 * d * d)

    around = F.sequence(F.greatest(F.col("to") - hw, F.lit(0)), F.least(F.col("to") + hw, F.col(size) - 1))
    norm = F.aggregate(around, F.lit(0.0), lambda a, x: a + kernel(F.col("to"), x))
    keep = "i" if along_rt else "j"
    c = c.groupBy("file_id", keep, F.col("to").alias(axis)).agg(F.sum(F.col("value") * kernel(F.col("to"), F.col(axis))).alias("up"))
    c = c.join(F.broadcast(g), "file_id").withColumnRenamed(axis, "to").withColumn("value", F.col("up") / norm).withColumnRenamed("to", axis)
    return c.select("file_id", "i", "j", "value")


def resample(points: DataFrame, bounds: DataFrame, run: Run, how: Resampling, tile: int = TILE) -> DataFrame:
    """Splat, then smooth along time, then along m/z: all three within dense tiles, after one shuffle of the points."""
    return tiled(points, shape(bounds, run, how), run, how, half_widths(run, how), tile=tile)


def maxima_of(points: DataFrame, bounds: DataFrame, run: Run, how: Resampling, digits: int | None = None, tile: int = TILE) -> DataFrame:
    """The local maxima of the smoothed grid without its cells; the same as ``local_maxima`` of ``resample``, with values rounded to ``digits``."""
    return tiled(points, shape(bounds, run, how), run, how, half_widths(run, how), True, digits, tile)


def locate(cells: DataFrame, bounds: DataFrame, run: Run, how: Resampling) -> DataFrame:
    """Adds the mz and rt of every cell."""
    g = shape(bounds, run, how)
    c = cells.join(F.broadcast(g), "file_id")
    return c.select("file_id", "i", "j", mz_at("i", "min_mz", "max_mz", "n", run, how.num_samples_mz).alias("mz"), rt_at("j", "min_rt", "max_rt", "m").alias("rt"), "value")


def local_maxima(cells: DataFrame, dims: DataFrame) -> DataFrame:
    """Interior cells strictly above their four neighbours; ``dims`` has file_id, n, m.

    Every cell is sent to itself and its neighbours, and one aggregation compares them. That spreads
    by cell, while windows along an axis would put a whole row in one task.
    """
    moves = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    sent = cells.select("file_id", F.explode(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), F.lit(a == b == 0).alias("own"), "value") for a, b in moves])).alias("c"))
    best = sent.groupBy("file_id", "c.i", "c.j").agg(
        F.max(F.when(F.col("c.own"), F.col("c.value"))).alias("value"), F.max(F.when(~F.col("c.own"), F.col("c.value"))).alias("other"))
    found = best.where((F.col("value") != 0) & (F.col("value") > F.coalesce("other", F.lit(0.0))) & (F.col("value") > 0))
    found = found.join(F.broadcast(dims), "file_id").where("i between 1 and n - 2 and j between 1 and m - 2")
    return found.select("file_id", "i", "j", "value")


def subset(cells: DataFrame, i_from: int, i_to: int, j_from: int, j_to: int) -> DataFrame:
    """Cells of a half-open index box."""
    return cells.where((F.col("i") >= i_from) & (F.col("i") < i_to) & (F.col("j") >= j_from) & (F.col("j") < j_to))


def marginals(cells: DataFrame, axis: str) -> DataFrame:
    """Sums along one axis (``i`` or ``j``)."""
    return cells.groupBy("file_id", axis).agg(F.sum("value").alias("value"))
