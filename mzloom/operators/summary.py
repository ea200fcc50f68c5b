"""Summaries, distributions and the small analytics around a pipeline run."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mzloom.operators.rangejoin import bin_of, touching
from mzloom.storage import materialise


#: Bins that a range of values is split into per pass.
BINS = 1024


def quantiles(df: DataFrame, value: str, probabilities: list[float], *keys: str) -> DataFrame:
    """``keys`` and an array q of exact quantiles of ``value``, interpolated between neighbours as ``percentile`` does.

    Every wanted order statistic has a range of values that holds it. A pass splits all ranges into bins, counts, and keeps the bin
    with the wanted rank, with the least and greatest value in it; so no buffer holds more than BINS counts, whatever the number
    of values, and all keys and quantiles share the passes. Nulls and NaN are left out.
    """
    keys_ = list(keys)
    v = df.select(*keys_, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    whole = v.groupBy(*keys_).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    places = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(probabilities)]))
    wanted = whole.withColumn("_q", places).withColumn("_at", (F.col("_n") - 1) * F.col("_q.p"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), f("_at").cast("long").alias("rank")) for s, f in ((0, F.floor), (1, F.ceil))]))
    # One row per key, quantile and side; rank counts from the range's least value.
    open_ = materialise(wanted.withColumn("_s", sides).select(*keys_, F.col("_q.k").alias("_k"), "_at", F.col("_s.side").alias("_side"), F.col("_s.rank").alias("_rank"), "_lo", "_hi"))
    same = lambda a, b: reduce(and_, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys_], F.lit(True))
    done = []
    while True:
        done.append(open_.where("_lo = _hi"))
        left = open_.where("_lo < _hi")
        if left.isEmpty():
            break
        ranges = left.select(*keys_, "_lo", "_hi").distinct()
        width = F.col("t._hi") / BINS - F.col("t._lo") / BINS
        at = F.when(width > 0, F.floor(F.least((F.col("p._v") - F.col("t._lo")) / width, F.lit(float(BINS))))).otherwise((F.col("p._v") == F.col("t._hi")).cast("long"))
        inside = v.alias("p").join(F.broadcast(ranges).alias("t"), same("p", "t") & F.col("p._v").between(F.col("t._lo"), F.col("t._hi")))
        counts = inside.groupBy(*[F.col(f"t.{k}").alias(k) for k in keys_], "t._lo", "t._hi", at.alias("_bin")).agg(F.count("*").alias("_c"), F.min("p._v").alias("_least"), F.max("p._v").alias("_most"))
        before = F.sum("_c").over(W.partitionBy(*keys_, "_lo", "_hi").orderBy("_bin")) - F.col("_c")  # BINS + 1 rows a range
        counts = counts.withColumn("_before", before)
        hit = left.alias("l").join(counts.alias("c"), same("l", "c") & (F.col("l._lo") == F.col("c._lo")) & (F.col("l._hi") == F.col("c._hi")) & (F.col("l._rank") >= F.col("c._before")) & (F.col("l._rank") < F.col("c._before") + F.col("c._c")))
        open_ = materialise(hit.select(*[F.col(f"l.{k}").alias(k) for k in keys_], "l._k", "l._at", "l._side", (F.col("l._rank") - F.col("c._before")).alias("_rank"), F.col("c._least").alias("_lo"), F.col("c._most").alias("_hi")))
    found = reduce(DataFrame.unionByName, done)
    both = found.groupBy(*keys_, "_k", "_at").agg(F.max(F.when(F.col("_side") == 0, F.col("_lo"))).alias("_a"), F.max(F.when(F.col("_side") == 1, F.col("_lo"))).alias("_b"))
    share = F.col("_at") - F.floor("_at")
    one = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.ceil("_at") - F.col("_at")) * F.col("_a") + share * F.col("_b"))
    return both.groupBy(*keys_).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", one.alias("v")))), lambda x: x["v"]).alias("q"))


def _with_quantiles(summary: DataFrame, q: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``summary`` with quantiles as columns ``names``."""
    if not keys:
        joined = summary.crossJoin(F.broadcast(q)) if not q.isEmpty() else summary.withColumn("q", F.lit(None).cast("array<double>"))  # one row each
    else:
        named = q.select(*[F.col(k).alias(f"_{k}") for k in keys], "q")
        joined = summary.join(named, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left").drop(*[f"_{k}" for k in keys])
    return joined.withColumns({n: F.get("q", F.lit(k)) for k, n in enumerate(names)}).drop("q")


def describe(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """count, mean, median and population deviation of ``value`` per key."""
    out = df.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return _with_quantiles(out, quantiles(df, value, [0.5], *keys), list(keys), ["median"]).select(*keys, "count", "mean", "median", "std")


def describe_all(df: DataFrame, values: list[str]) -> dict[str, DataFrame]:
    """``describe`` per file_id of several columns, whose quantiles share their passes."""
    each = df.select("file_id", F.explode(F.array(*[F.struct(F.lit(v).alias("what"), F.col(v).cast("double").alias("v")) for v in values])).alias("x")).select("file_id", "x.what", "x.v")
    told = materialise(describe(each, "v", "file_id", "what"))
    return {v: told.where(F.col("what") == v).drop("what") for v in values}


def over_files(per_file: DataFrame) -> DataFrame:
    """Unweighted mean of per-file summaries."""
    return per_file.agg(F.count("*").alias("n_files"), *[F.avg(c).alias(c) for c in ("count", "mean", "median", "std")])


def linking_efficiency(linked: DataFrame, every: DataFrame) -> DataFrame:
    """Per file how many of ``every`` (events or identifications) there are, how many links (one each at most), and their percentage."""
    n = every.groupBy("file_id").agg(F.count("*").alias("n"))
    m = linked.groupBy("file_id").agg(F.count("*").alias("linked"))
    have = F.coalesce("linked", F.lit(0))
    return n.join(m, "file_id", "left").select("file_id", "n", have.alias("linked"), (have / F.col("n") * 100.0).alias("percent"))


def raw_summary(points: DataFrame) -> DataFrame:
    return points.groupBy("file_id").agg(F.min("mz").alias("min_mz"), F.max("mz").alias("max_mz"), F.min("rt").alias("min_rt"), F.max("rt").alias("max_rt"), F.countDistinct("rt").alias("n_scans"), F.count("*").alias("n_points"))


def event_summary(events: DataFrame) -> DataFrame:
    """The same of fragmentation events (file_id, mz, rt)."""
    return events.groupBy("file_id").agg(F.count("*").alias("n_scans"), F.min("mz").alias("min_mz"), F.max("mz").alias("max_mz"), F.min("rt").alias("min_rt"), F.max("rt").alias("max_rt"))


def isotope_counts(features: DataFrame) -> DataFrame:
    """How many features have how many isotopes, per file."""
    return features.groupBy("file_id", F.size("peak_ids").alias("isotopes")).agg(F.count("*").alias("features"))


def isotope_summary(features: DataFrame) -> DataFrame:
    n = features.select("file_id", F.size("peak_ids").alias("n"))
    out = n.groupBy("file_id").agg(F.count("*").alias("count"), F.avg("n").alias("mean"), F.max("n").alias("max"))
    return _with_quantiles(out, quantiles(n, "n", [0.5], "file_id"), ["file_id"], ["median"]).select("file_id", "count", "mean", "median", "max")


def ma_summary(pairs: DataFrame) -> DataFrame:
    """log2 ratios of (file_id, a, b): mean, median, sample deviation, 5th and 95th percentile."""
    # Written once: every pass of the quantiles reads the ratios, not what made them.
    m = materialise(pairs.where("a > 0 and b > 0").select("file_id", F.log2(F.col("a") / F.col("b")).alias("m")))
    out = m.groupBy("file_id").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"))
    return _with_quantiles(out, quantiles(m, "m", [0.5, 0.05, 0.95], "file_id"), ["file_id"], ["median", "p5", "p95"]).select("file_id", "mean", "median", "std", "p5", "p95")


def _cells(targets: DataFrame, peaks: DataFrame, reach: float, otherwise: tuple[float, float]) -> tuple[tuple[float, float], tuple[float, float]]:
    """Widths of cells that hold about four peaks on average, at least 1/16 of the farthest search, and the largest sigmas of the peaks."""
    axes = (("fitted_mz", "fitted_sigma_mz", "t_sigma_mz"), ("_rt", "fitted_sigma_rt", "t_sigma_rt"))
    f = peaks.groupBy("file_id").agg(F.count("*").alias("n"), *[F.max(x) - F.min(x) for x, _, _ in axes], *[F.max(s) for _, s, _ in axes])
    f = f.agg(*[F.max(f"`{x}`") for x in f.columns[1:]]).first()
    t = targets.agg(*[F.max(s) for _, _, s in axes]).first()
    n, spans, most, own = f[0], f[1:3], [x or 0.0 for x in f[3:]], [x or 0.0 for x in t]
    units = [a + b for a, b in zip(most, own, strict=True)]
    if not n or not all(x and 0 < x < math.inf for x in (*spans, *units)):
        return otherwise, (most[0], most[1])
    scale = max(math.sqrt(4 / n * spans[0] * spans[1] / (units[0] * units[1])), reach / 16)
    return (scale * units[0], scale * units[1]), (most[0], most[1])


def closest_peak(targets: DataFrame, peaks: DataFrame, n_mz: float = 3.0, n_rt: float = 3.0, width: float = 5.0, width_rt: float = 60.0) -> DataFrame:
    """(target_id, peak_id, distance): the nearest peak in units of both sigmas, then a tolerance box.

    A peak in the box is at most sqrt(n_mz^2 + n_rt^2) away, and at most as far as any peak of the target's own cell. Cells hold a few peaks at every
    density, so the pairs grow with the targets; equal peaks are one, the first by id.
    """
    r = math.hypot(n_mz, n_rt) * (1 + 1e-9)
    c = F.col
    t = materialise(targets.select("file_id", "target_id", "t_mz", "t_rt", "t_sigma_mz", "t_sigma_rt"))
    p = peaks.select("file_id", "peak_id", "fitted_mz", (c("fitted_rt") + c("rt_delta")).alias("_rt"), "fitted_sigma_mz", "fitted_sigma_rt")
    p = materialise(p.groupBy("file_id", "fitted_mz", "_rt", "fitted_sigma_mz", "fitted_sigma_rt").agg(F.min("peak_id").alias("peak_id")))
    dm, dr = F.abs(c("t_mz") - c("fitted_mz")), F.abs(c("t_rt") - c("_rt"))
    d = F.sqrt(F.pow(dr / (c("t_sigma_rt") + c("fitted_sigma_rt")), F.lit(2.0)) + F.pow(dm / (c("t_sigma_mz") + c("fitted_sigma_mz")), F.lit(2.0)))
    (wx, wy), (sx, sy) = _cells(t, p, r, (width, width_rt))
    bound = None
    for k in (1, 4):  # the own cell, then a larger one for those whose own is empty
        at = lambda mz, rt, k=k: {"_cx": bin_of(c(mz), k * wx), "_cy": bin_of(c(rt), k * wy)}
        left = t if bound is None else t.join(bound, ["file_id", "target_id"], "left_anti")
        found = left.withColumns(at("t_mz", "t_rt")).join(p.withColumns(at("fitted_mz", "_rt")), ["file_id", "_cx", "_cy"]).groupBy("file_id", "target_id").agg(F.min(d).alias("_bound"))
        found = materialise(found.where("_bound is not null"))
        bound = found if bound is None else bound.unionByName(found)
    t = t.join(bound, ["file_id", "target_id"], "left").withColumn("_bound", F.least(F.coalesce("_bound", F.lit(r)) * (1 + 1e-9), F.lit(r)))
    reach = lambda s, most: c("_bound") * (c(s) + most) + 1e-9
    j = touching(t, p, ["file_id"], [(c("t_mz"), reach("t_sigma_mz", sx), c("fitted_mz"), F.lit(0.0), wx), (c("t_rt"), reach("t_sigma_rt", sy), c("_rt"), F.lit(0.0), wy)])
    j = j.withColumn("_d", d).where(c("_d") <= c("_bound"))
    ok = (dm <= n_mz * c("t_sigma_mz")) & (dr <= n_rt * c("t_sigma_rt"))
    best = j.groupBy(c("a.file_id").alias("file_id"), "target_id").agg(F.min_by(F.struct("peak_id", c("_d").alias("d"), ok.alias("ok")), F.struct("_d", "peak_id")).alias("b"))
    return best.where("b.ok").select("file_id", "target_id", c("b.peak_id").alias("peak_id"), c("b.d").alias("distance"))


def segment_of(times: DataFrame, maps: DataFrame) -> DataFrame:
    """Adds the first segment whose closed source interval holds rt (-1 if none) and the time there (null if none)."""
    m = maps.select(F.col("file_id").alias("_f"), "segment", "rt_start", "rt_end", "sample_rt_start", "sample_rt_end")
    j = times.join(F.broadcast(m), (times.file_id == F.col("_f")) & times.rt.between(F.col("sample_rt_start"), F.col("sample_rt_end")), "left")
    at = F.col("rt_start") + (F.col("rt") - F.col("sample_rt_start")) / (F.col("sample_rt_end") - F.col("sample_rt_start")) * (F.col("rt_end") - F.col("rt_start"))
    return j.groupBy(*times.columns).agg(F.coalesce(F.min("segment"), F.lit(-1)).alias("segment"), F.min_by(at, "segment").alias("warped_rt"))


def fill_gaps(points: DataFrame, spacing: float = 0.0035, factor: float = 1.3) -> DataFrame:
    """Zero points in the gaps of a scan's spectrum, where the distance exceeds ``factor`` spacings.

    Below two spacings there is one zero in the middle, else one a spacing inside either end. The spacing would only
    widen at a distance that is no gap and yet above ``factor`` spacings, so it stays.
    """
    w = W.partitionBy("file_id", "rt").orderBy("mz")
    p = points.withColumn("_next", F.lead("mz").over(w))
    wide = p.withColumn("_gap", F.col("_next") - F.col("mz")).where(F.col("_gap") > spacing * factor)
    at = F.when(F.col("_gap") < 2 * spacing, F.array(F.col("mz") + F.col("_gap") / 2)).otherwise(F.array(F.col("mz") + spacing, F.col("_next") - spacing))
    zeros = wide.select("file_id", "rt", F.explode(at).alias("mz"), F.lit(0.0).alias("intensity"))
    return points.select("file_id", "rt", "mz", "intensity").unionByName(zeros)


def smoothed_xic(cells: DataFrame, min_mz: float, max_mz: float, min_rt: float, max_rt: float) -> DataFrame:
    """Sums over m/z of located grid cells in an open box, per time."""
    c = cells.where((F.col("mz") > min_mz) & (F.col("mz") < max_mz) & (F.col("rt") > min_rt) & (F.col("rt") < max_rt))
    return c.groupBy("file_id", "j", "rt").agg(F.sum("value").alias("intensity"))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """(file_id, bin, count) for density plots."""
    return df.groupBy("file_id", F.floor(F.col(value) / width).cast("long").alias("bin")).agg(F.count("*").alias("count"))


def scatter(peaks: DataFrame, most: int = 200_000) -> DataFrame:
    """Values for drift and width plots: the ``most`` highest peaks of every run."""
    k = peaks.where(F.col("peak_id") < most)
    return k.select("file_id", "peak_id", F.col("fitted_rt").alias("rt"), "rt_delta", F.col("fitted_mz").alias("mz"), F.col("fitted_sigma_mz").alias("sigma_mz"))
