"""Retention-time alignment by correlation-optimised warping."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mzloom.params import Warping
from mzloom.storage import materialise


def levels(spark: SparkSession, segments: int, window: int, slack: int) -> DataFrame:
    """Node range [start, end] of every level 0..segments."""
    n_points = segments * window
    i = F.col("level")
    rest = segments - i
    start = F.greatest(i * (window - slack), n_points - rest * (window + slack))
    end = F.least(i * (window + slack), n_points - rest * (window - slack))
    return spark.range(segments + 1).select(F.col("id").alias("level")).select("level", start.alias("start"), end.alias("end"))


def warpings(spark: SparkSession, segments: int, window: int, slack: int) -> DataFrame:
    """Edges (level, src_start, src_end): a source segment of every allowed length."""
    at = levels(spark, segments, window, slack)
    nxt = at.select((F.col("level") - 1).alias("level"), F.col("start").alias("next_start"), F.col("end").alias("next_end"))
    e = at.join(nxt, "level").withColumn("src_start", F.explode(F.sequence("start", "end")))
    e = e.withColumn("u", F.explode(F.sequence(F.lit(-slack), F.lit(slack)))).withColumn("src_end", F.col("src_start") + window + F.col("u"))
    return e.where((F.col("src_end") >= F.col("next_start")) & (F.col("src_end") <= F.col("next_end"))).select("level", "src_start", "src_end")


def rt_range(peaks: DataFrame, reference: int, expand: float) -> DataFrame:
    """Common range (file_id, rt_min, rt_max) of every file with the reference; the end is widened from the widened start."""
    own = peaks.groupBy("file_id").agg(F.min("fitted_rt").alias("lo"), F.max("fitted_rt").alias("hi"))
    ref = own.where(F.col("file_id") == reference).select(F.col("lo").alias("rlo"), F.col("hi").alias("rhi"))
    both = own.crossJoin(F.broadcast(ref)).select("file_id", F.least("lo", "rlo").alias("a"), F.greatest("hi", "rhi").alias("b"))  # one row per run
    both = both.withColumn("rt_min", F.col("a") - (F.col("b") - F.col("a")) * expand)
    return both.select("file_id", "rt_min", (F.col("b") + (F.col("b") - F.col("rt_min")) * expand).alias("rt_max"))


def segment_peaks(peaks: DataFrame, ranges: DataFrame, segments: int, n_points: int, window: int, most: int) -> DataFrame:
    """The ``most`` highest peaks of every reference-length segment: adds segment, rt_min and delta."""
    p = peaks.join(F.broadcast(ranges), "file_id").withColumn("delta", (F.col("rt_max") - F.col("rt_min")) / (n_points - 1))
    p = p.withColumn("segment", F.floor((F.col("fitted_rt") - F.col("rt_min")) / (F.col("delta") * window)).cast("long"))
    order = W.partitionBy("file_id", "segment").orderBy(F.desc("fitted_height"), "peak_id")
    p = p.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")
    return p.where((F.col("segment") >= 0) & (F.col("segment") < segments))


def overlap_sum(ref: np.ndarray, src: np.ndarray) -> float:
    """Summed overlap; columns mz, rt, sigma_mz, sigma_rt, height."""
    if not len(ref) or not len(src):
        return 0.0
    a, b = ref[:, None, :], src[None, :, :]
    touch = (np.abs(a[..., 0] - b[..., 0]) <= 3 * (a[..., 2] + b[..., 2])) & (np.abs(a[..., 1] - b[..., 1]) <= 3 * (a[..., 3] + b[..., 3]))
    i, j = np.nonzero(touch)
    if not len(i):
        return 0.0
    p, q = ref[i], src[j]

    def axis(x, s):
        vp, vq = p[:, s] ** 2, q[:, s] ** 2
        return vp * vq * np.exp(-0.5 * (p[:, x] - q[:, x]) ** 2 / (vp + vq)) / np.sqrt(vp + vq)

    return float((axis(1, 3) * axis(0, 2) * p[:, 4] * q[:, 4]).sum())


_COLUMNS = ["fitted_mz", "fitted_rt", "fitted_sigma_mz", "fitted_sigma_rt", "fitted_height"]
#: Peaks that the segments of the reference run may keep in one range, ``peaks_per_window`` each; a task holds those of one segment.
REFERENCE_PEAKS = 4_000_000


def touching_pairs(ref: np.ndarray, src: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs within three sigmas of each other in m/z, by a sweep over the sorted masses."""
    order = np.argsort(ref[:, 0], kind="stable")
    at = ref[order, 0]
    reach = 3 * (src[:, 2] + (ref[:, 2].max() if len(ref) else 0.0))
    lo, hi = np.searchsorted(at, src[:, 0] - reach, "left"), np.searchsorted(at, src[:, 0] + reach, "right")
    n = hi - lo
    j = np.repeat(np.arange(len(src)), n)
    i = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[j]]
    near = np.abs(ref[i, 0] - src[j, 0]) <= 3 * (ref[i, 2] + src[j, 2])
    return i[near], j[near]


def level_similarities(ref: np.ndarray, src: np.ndarray, rt_min: float, delta: float, level: int, starts: np.ndarray, ends: tuple[int, int], window: int, slack: int):
    """(src_start, src_end, similarity) of the edges from ``starts`` to nodes within ``ends``.

    Which peaks touch in m/z doesn't depend on the warping, so those pairs are found once for all edges; an
    edge only moves their times. ``src`` is sorted by time.
    """
    i, j = touching_pairs(ref, src)
    by_time = np.argsort(j, kind="stable")
    p, q = ref[i[by_time]], src[j[by_time]]
    vp, vq, rp, rq = p[:, 2] ** 2, q[:, 2] ** 2, p[:, 3] ** 2, q[:, 3] ** 2
    fixed = vp * vq * np.exp(-0.5 * (p[:, 0] - q[:, 0]) ** 2 / (vp + vq)) / np.sqrt(vp + vq) * p[:, 4] * q[:, 4] * rp * rq / np.sqrt(rp + rq)
    wide, reach = rp + rq, 3 * (p[:, 3] + q[:, 3])
    start, end = rt_min + level * window * delta, rt_min + (level + 1) * window * delta
    out = []
    for s in starts.tolist():
        to = np.arange(max(s + window - slack, ends[0]), min(s + window + slack, ends[1]) + 1)
        if not len(to):
            continue
        a, b = rt_min + s * delta, rt_min + to * delta
        lo, hi = np.searchsorted(q[:, 1], [a, b[-1]]) if len(q) else (0, 0)
        rt = q[lo:hi, 1]
        moved = start + (rt - a) / (b - a)[:, None] * (end - start)
        off = np.abs(p[lo:hi, 1] - moved)
        ok = (rt < b[:, None]) & (off <= reach[lo:hi])
        value = np.where(ok, fixed[lo:hi] * np.exp(-0.5 * off**2 / wide[lo:hi]), 0.0).sum(1)
        out.append((np.full(len(to), s), to, value))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def warped_similarities(peaks: DataFrame, reference: int, how: Warping, parts: int = 8) -> DataFrame:
    """(file_id, level, src_start, src_end, similarity) of every edge of every file.

    Segments of both runs are cut to ``peaks_per_window`` by shuffles, so the reference run may be of any size; it is cut once for all files
    of the same range. Source segments are grouped by file and level, and their start nodes are dealt to ``parts`` tasks.
    """
    segments = how.num_points // how.window
    n_points = segments * how.window
    ranges = materialise(rt_range(peaks, reference, how.expand))  # one row per run
    spans = materialise(ranges.groupBy("rt_min", "rt_max").agg(F.min("file_id").alias("file_id")))
    own = peaks.where(F.col("file_id") == reference).select(*_COLUMNS, "peak_id").crossJoin(F.broadcast(spans.select("file_id")))
    own = materialise(segment_peaks(own, spans, segments, n_points, how.window, how.peaks_per_window).select("rt_min", "rt_max", F.col("segment").alias("level"), F.struct(*_COLUMNS, "peak_id").alias("p")))
    if (n := own.groupBy("rt_min", "rt_max").count().agg(F.max("count")).first()[0] or 0) > REFERENCE_PEAKS:
        raise ValueError(f"the segments of the reference run have {n} peaks: {REFERENCE_PEAKS} at most")
    own = own.groupBy("rt_min", "rt_max", "level").agg(F.collect_list("p").alias("ref"))
    source = segment_peaks(peaks, ranges, segments, n_points, how.window, how.peaks_per_window).select("file_id", "segment", F.struct(*_COLUMNS).alias("p"))
    # A source segment starts within level * slack points of its place, so only nearby segments matter.
    span = [math.ceil(how.slack * (k + 1) / how.window) + 1 for k in range(segments)]
    widths = F.element_at(F.array(*[F.lit(x) for x in span]), (F.col("segment") + 1).cast("int")).cast("long") * 2 + 2
    near = source.withColumn("level", F.explode(F.sequence(F.greatest(F.col("segment") - widths, F.lit(0)), F.least(F.col("segment") + widths, F.lit(segments - 1)))))
    near = near.groupBy("file_id", "level").agg(F.collect_list("p").alias("src"))
    jobs = ranges.withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(segments - 1).cast("long")))).join(near, ["file_id", "level"], "left").join(own, ["rt_min", "rt_max", "level"], "left")
    jobs = jobs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition("file_id", "level", "part")
    window, slack = how.window, how.slack
    kind = peaks.schema["file_id"].dataType.simpleString()

    def bounds(level: int) -> tuple[int, int]:
        rest = segments - level
        return max(level * (window - slack), n_points - rest * (window + slack)), min(level * (window + slack), n_points - rest * (window - slack))

    def table(found, *columns: str) -> np.ndarray:
        return np.array([[q[c] for c in columns] for q in found], float).reshape(-1, len(columns)) if found is not None else np.zeros((0, len(columns)))

    def run(batches):
        for x in batches:
            out = []
            for r in x.itertuples(index=False):
                delta = (r.rt_max - r.rt_min) / (n_points - 1)
                src, ref = table(r.src, *_COLUMNS), table(r.ref, *_COLUMNS, "peak_id")
                src, ref = src[np.argsort(src[:, 1], kind="stable")], ref[np.lexsort((ref[:, 5], -ref[:, 4]))][:, :5]
                a, b = bounds(r.level)
                s, e, v = level_similarities(ref, src, r.rt_min, delta, r.level, np.arange(a + r.part, b + 1, parts), bounds(r.level + 1), window, slack)
                out.append(pd.DataFrame({"file_id": r.file_id, "level": r.level, "src_start": s, "src_end": e, "similarity": v}))
            yield pd.concat(out)

    return jobs.select("file_id", "level", "part", "src", "ref", "rt_min", "rt_max").mapInPandas(run, f"file_id {kind}, level long, src_start long, src_end long, similarity double")


def best_path(edges: pd.DataFrame, segments: int) -> list[int]:
    """Node of every level on the path of greatest similarity, by backward dynamic programming.

    A node's choice changes only for a strictly better sum; untouched nodes go to the smallest slack.
    """
    total: dict[int, float] = {}
    step: list[dict[int, int]] = [{} for _ in range(segments)]
    for level in range(segments - 1, -1, -1):
        now: dict[int, float] = {}
        part = edges[edges.level == level].sort_values(["src_start", "src_end"])
        ends = part.groupby("src_start").src_end.agg(["min", "max"])
        for s in ends.index:
            now[s], step[level][s] = 0.0, int((ends.loc[s, "min"] + ends.loc[s, "max"]) // 2)
        for s, e, f in zip(part.src_start, part.src_end, part.similarity, strict=True):
            v = f + total.get(e, 0.0)
            if v > now[s]:
                now[s], step[level][s] = v, int(e)
        total = now
    path = [0]
    for level in range(segments):
        path.append(step[level][path[-1]])
    return path


def time_map(peaks: DataFrame, reference: int, how: Warping = Warping()) -> DataFrame:
    """(file_id, segment, rt_start, rt_end, sample_rt_start, sample_rt_end) of every file, the reference included."""
    segments = how.num_points // how.window
    n_points = segments * how.window
    edges = warped_similarities(peaks, reference, how).join(F.broadcast(rt_range(peaks, reference, how.expand)), "file_id")
    window = how.window

    def run(x: pd.DataFrame) -> pd.DataFrame:
        lo, hi = x.rt_min.iloc[0], x.rt_max.iloc[0]
        delta = (hi - lo) / (n_points - 1)
        path = best_path(x, segments)
        rows = [(x.file_id.iloc[0], k, lo + k * window * delta, lo + (k + 1) * window * delta, lo + path[k] * delta, lo + path[k + 1] * delta) for k in range(segments)]
        return pd.DataFrame(rows, columns=["file_id", "segment", "rt_start", "rt_end", "sample_rt_start", "sample_rt_end"])

    # One group per run; its size depends on the warping parameters, not on the data.
    return edges.groupBy("file_id").applyInPandas(run, "file_id int, segment long, rt_start double, rt_end double, sample_rt_start double, sample_rt_end double")


def warp_rt(rt: str) -> Column:
    """Time on the reference axis for ``rt`` within its segment's columns."""
    c = F.col
    return c("rt_start") + (c(rt) - c("sample_rt_start")) / (c("sample_rt_end") - c("sample_rt_start")) * (c("rt_end") - c("rt_start"))


def warp_peaks(peaks: DataFrame, maps: DataFrame) -> DataFrame:
    """Sets rt_delta; peaks in no segment are dropped. ``maps`` has a few rows per run."""
    m = maps.select("file_id", "rt_start", "rt_end", "sample_rt_start", "sample_rt_end")
    j = peaks.join(F.broadcast(m), (peaks.file_id == m.file_id) & (peaks.fitted_rt >= m.sample_rt_start) & (peaks.fitted_rt < m.sample_rt_end)).drop(m.file_id)
    j = j.withColumn("rt_delta", warp_rt("fitted_rt") - F.col("fitted_rt"))
    return j.select(*peaks.columns)


def warp_times(times: DataFrame, maps: DataFrame) -> DataFrame:
    """Adds warped_rt to (file_id, rt); outside all segments the first one is extrapolated."""
    m = maps.select("file_id", "segment", "rt_start", "rt_end", "sample_rt_start", "sample_rt_end")
    first = m.where("segment = 0").select(F.col("file_id").alias("_f"), *[F.col(c).alias(f"_{c}") for c in ("rt_start", "rt_end", "sample_rt_start", "sample_rt_end")])
    j = times.join(F.broadcast(m), (times.file_id == m.file_id) & (times.rt >= m.sample_rt_start) & (times.rt < m.sample_rt_end), "left").drop(m.file_id)
    j = j.join(F.broadcast(first), j.file_id == F.col("_f"))
    for c in ("rt_start", "rt_end", "sample_rt_start", "sample_rt_end"):
        j = j.withColumn(c, F.coalesce(c, f"_{c}"))
    return j.withColumn("warped_rt", warp_rt("rt")).select(*times.columns, "warped_rt")


def peaks_in_rt_range(peaks: DataFrame, start: float, end: float) -> DataFrame:
    """Peaks with start <= fitted_rt < end."""
    return peaks.where((F.col("fitted_rt") >= start) & (F.col("fitted_rt") < end))


def interpolate(peaks: DataFrame, src_start: float, src_end: float, ref_start: float, ref_end: float) -> DataFrame:
    """Moves the peaks of a source segment onto a reference segment; widths stay."""
    p = peaks_in_rt_range(peaks, src_start, src_end)
    new = ref_start + (F.col("fitted_rt") - src_start) / (src_end - src_start) * (ref_end - ref_start)
    return p.withColumn("_new", new).withColumn("rt_delta", F.col("_new") - F.col("fitted_rt")).withColumn("fitted_rt", F.col("_new")).drop("_new")
