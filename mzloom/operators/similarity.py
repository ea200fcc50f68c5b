"""Overlap of peak lists and similarity of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mzloom.functions.exprs import boxes_touch, overlap
from mzloom.operators.components import materialise
from mzloom.operators.rangejoin import touching


#: Parts that a run's peaks are ranked in before the run itself.
PARTS = 64


def top_peaks(peaks: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n highest peaks per file (and ``keys``); ties go to the lower peak_id. Parts of a run are cut first, so no task holds a run."""
    p = peaks.withColumn("_part", F.pmod(F.xxhash64("peak_id"), F.lit(PARTS)))
    for part in (["_part"], []):
        order = W.partitionBy("file_id", *keys, *part).orderBy(F.desc("fitted_height"), "peak_id")
        p = p.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k", *part)
    return p


def overlaps(peaks: DataFrame, width: float = 5.0, width_rt: float = 60.0) -> DataFrame:
    """Cumulative overlap of every pair of files a <= b: (file_a, file_b, overlap)."""
    rt = F.col("fitted_rt") + F.col("rt_delta")
    axes = [(x, 3.0 * F.col(s), x, 3.0 * F.col(s), w) for x, s, w in ((F.col("fitted_mz"), "fitted_sigma_mz", width), (rt, "fitted_sigma_rt", width_rt))]
    j = touching(peaks, peaks, [], axes).where(boxes_touch("a", "b") & (F.col("a.file_id") <= F.col("b.file_id")))
    return j.groupBy(F.col("a.file_id").alias("file_a"), F.col("b.file_id").alias("file_b")).agg(F.sum(overlap("a", "b")).alias("overlap"))


def similarity(peaks: DataFrame, n_peaks: int = 2000, width: float = 5.0) -> DataFrame:
    """(file_a, file_b, self_a, self_b, overlap, geometric_ratio, mean_ratio) of all pairs of files a <= b."""
    # One row per pair of runs, used three times: written once, so the peaks are joined once. Every
    # run with peaks overlaps itself, so its own rows name all runs.
    o = materialise(overlaps(top_peaks(peaks, n_peaks), width))
    own = o.where("file_a = file_b").select(F.col("file_a").alias("f"), F.col("overlap").alias("s"))
    pairs = own.select(F.col("f").alias("file_a")).join(own.select(F.col("f").alias("file_b")), F.col("file_a") <= F.col("file_b"))
    p = pairs.join(o, ["file_a", "file_b"], "left")
    p = p.join(own.select(F.col("f").alias("file_a"), F.col("s").alias("self_a")), "file_a", "left").join(own.select(F.col("f").alias("file_b"), F.col("s").alias("self_b")), "file_b", "left")
    p = p.fillna(0.0, ["overlap", "self_a", "self_b"])
    both = F.col("self_a") * F.col("self_b") != 0
    return p.select(
        "file_a", "file_b", "self_a", "self_b", "overlap",
        F.when(both, F.col("overlap") / F.sqrt(F.col("self_a") * F.col("self_b"))).otherwise(0.0).alias("geometric_ratio"),
        F.when(both, 2 * F.col("overlap") / (F.col("self_a") + F.col("self_b"))).otherwise(0.0).alias("mean_ratio"),
    )


def similarity_matrix(sim: DataFrame, files: list[int], value: str = "geometric_ratio") -> DataFrame:
    """Symmetric wide matrix: file_id and a column f<id> per file."""
    s = sim.select("file_a", "file_b", value)
    s = s.unionByName(s.where("file_a <> file_b").select(F.col("file_b").alias("file_a"), F.col("file_a").alias("file_b"), value))
    m = s.groupBy(F.col("file_a").alias("file_id")).pivot("file_b", files).agg(F.first(value))
    return m.select("file_id", *[F.col(f"`{f}`").alias(f"f{f}") for f in files])


def reference_run(sim: DataFrame, candidates: list[int] | None = None) -> DataFrame:
    """The candidate with the largest summed similarity to all runs; ties go to the first file."""
    s = sim.select("file_a", "file_b", "geometric_ratio")
    s = s.unionByName(s.where("file_a <> file_b").select(F.col("file_b").alias("file_a"), F.col("file_a").alias("file_b"), "geometric_ratio"))
    total = s.groupBy("file_a").agg(F.sum("geometric_ratio").alias("total"))
    if candidates is not None:
        total = total.where(F.col("file_a").isin(candidates))
    return total.agg(F.max_by("file_a", F.struct("total", (-F.col("file_a")).alias("k"))).alias("file_id"))
