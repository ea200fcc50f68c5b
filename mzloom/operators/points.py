"""Filters and chromatograms on raw points (file_id, scan_number, rt, mz, intensity)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mzloom.operators.rangejoin import binned, boxed


def raw_points(points: DataFrame, min_mz: float, max_mz: float, min_rt: float, max_rt: float) -> DataFrame:
    """Points inside the inclusive box."""
    return points.where(F.col("mz").between(min_mz, max_mz) & F.col("rt").between(min_rt, max_rt))


def count_points(points: DataFrame) -> DataFrame:
    """Per file: num_points and num_scans (scans with a point)."""
    return points.groupBy("file_id").agg(F.count("*").alias("num_points"), F.countDistinct("rt").alias("num_scans"))


def xic(points: DataFrame, min_mz: float = 0, max_mz: float = math.inf, min_rt: float = 0, max_rt: float = math.inf, method: str = "sum") -> DataFrame:
    """One row per non-empty scan in the time range; 0 if none of its points is in the m/z range."""
    hit = F.when(F.col("mz").between(min_mz, max_mz), F.col("intensity")).otherwise(0.0)
    if method not in ("sum", "max"):
        raise ValueError(f"unknown xic method: {method}")
    value = F.sum(hit) if method == "sum" else F.greatest(F.lit(0.0), F.max(hit))
    return points.where(F.col("rt").between(min_rt, max_rt)).groupBy("file_id", "rt").agg(value.alias("intensity"))


def peak_xic(points: DataFrame, peaks: DataFrame, bin_rt: float, method: str = "sum") -> DataFrame:
    """Chromatogram of every peak over its region: (file_id, peak_id, rt, intensity), zero rows included.

    Scans (not points) are paired with the regions' times for the zero rows; points only with the regions that hold them, after points of equal m/z in
    a scan are put together. So pairs grow with the result, not with the points of all scans that a region crosses.
    """
    if method not in ("sum", "max"):
        raise ValueError(f"unknown xic method: {method}")
    fold = F.sum if method == "sum" else F.max
    rois = peaks.select("file_id", "peak_id", "roi_min_mz", "roi_max_mz", "roi_min_rt", "roi_max_rt")
    scans = points.groupBy("file_id", "rt").agg(F.count("*").alias("n"))
    crossed = binned(scans, rois, ["file_id"], F.col("rt"), F.col("roi_min_rt"), F.col("roi_max_rt"), bin_rt)
    # Cells of four mean regions along either axis.
    size = rois.agg(*[F.avg(F.col(f"roi_max_{x}") - F.col(f"roi_min_{x}")) for x in ("mz", "rt")]).first()
    widths = tuple(4 * w if w and 0 < w < math.inf else bin_rt for w in size)
    merged = points.groupBy("file_id", "rt", "mz").agg(fold("intensity").alias("intensity"), F.count("*").alias("n"))
    held = boxed(merged, rois, ["file_id"], "mz", "rt", ("roi_min_mz", "roi_max_mz", "roi_min_rt", "roi_max_rt"), widths)
    key = ["r.file_id", "r.peak_id", "p.rt"]
    rows = crossed.select(*key, F.lit(None).cast("double").alias("intensity"), "p.n").unionByName(held.select(*key, "p.intensity", (-F.col("p.n")).alias("n")))
    # n is left over if a scan has points outside the region: they count as zero.
    out = rows.groupBy("file_id", "peak_id", "rt").agg(fold("intensity").alias("_v"), F.sum("n").alias("_outside"))
    value = F.when(F.col("_outside") > 0, F.coalesce("_v", F.lit(0.0))).otherwise(F.col("_v"))
    return out.select("file_id", "peak_id", "rt", (value if method == "sum" else F.greatest(F.lit(0.0), "_v")).alias("intensity"))


def peak_points(points: DataFrame, peaks: DataFrame, bin_mz: float, bin_rt: float) -> DataFrame:
    """Raw points of every peak's region, as a plot of a peak shows them: (file_id, peak_id, mz, rt, intensity, shade); shade is the root of the intensity."""
    rois = peaks.select("file_id", "peak_id", "roi_min_mz", "roi_max_mz", "roi_min_rt", "roi_max_rt")
    j = boxed(points.select("file_id", "mz", "rt", "intensity"), rois, ["file_id"], "mz", "rt", ("roi_min_mz", "roi_max_mz", "roi_min_rt", "roi_max_rt"), (bin_mz, bin_rt))
    return j.select("r.file_id", "r.peak_id", "p.mz", "p.rt", "p.intensity", F.sqrt("p.intensity").alias("shade"))
