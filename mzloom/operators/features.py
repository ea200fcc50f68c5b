"""Isotope envelopes: candidate graph, greedy walks, theoretical patterns, feature tables."""

from __future__ import annotations

import math
from bisect import bisect_left
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mzloom.operators.components import connected_components, dealt, materialise
from mzloom.operators.rangejoin import boxed

ISOTOPE_STEP = 1.0033
PROTON = 1.00728
#: Averagine composition and its mass, atomic masses, natural isotope abundances by mass shift.
AVERAGINE = {"C": 4.9384, "H": 7.7583, "N": 1.3577, "O": 1.4773, "S": 0.0417}
AVERAGINE_MASS = 111.1254
ATOM_MASS = {"C": 12.011, "H": 1.008, "N": 14.007, "O": 15.999, "S": 32.066}
ISOTOPES = {
    "C": [0.9893, 0.0107],
    "H": [0.999885, 0.000115],
    "N": [0.99632, 0.00368],
    "O": [0.99757, 0.00038, 0.00205],
    "S": [0.9493, 0.0076, 0.0429, 0.0, 0.0002],
}


def _power(p: list[float], n: int, most: int = 24) -> np.ndarray:
    out, base = np.array([1.0]), np.array(p)
    while n:
        if n & 1:
            out = np.convolve(out, base)[:most]
        base = np.convolve(base, base)[:most]
        n >>= 1
    return out


@lru_cache(maxsize=4)
def averagine_table(low: int = 100, high: int = 4000, step: int = 10) -> list[tuple[float, list[float]]]:
    """(mass, isotope percentages of the largest, above 0.01) for averagine peptides."""
    rows = []
    for mass in range(low, high + 1, step):
        ideal = {a: n / AVERAGINE_MASS * mass for a, n in AVERAGINE.items()}
        atoms = {a: round(n) for a, n in ideal.items()}
        weight = lambda: sum(ATOM_MASS[a] * n for a, n in atoms.items())  # noqa: B023, E731
        missing = round(mass - weight())
        if missing < 0:
            atoms = {a: math.floor(n) for a, n in ideal.items()}
            missing = round(mass - weight())
        atoms["H"] += missing
        p = np.array([1.0])
        for a, n in atoms.items():
            p = np.convolve(p, _power(ISOTOPES[a], n))[:24]
        p = 100 * p / p.max()
        rows.append((round(weight(), 3), [round(float(x), 2) for x in p if x > 0.01]))
    return rows


def nearest_pattern(mass: float, table: list[tuple[float, list[float]]]) -> list[float] | None:
    """Pattern of the nearest mass (ties: the larger one); None beyond the last."""
    k = bisect_left(table, mass, key=lambda row: row[0])
    if k == len(table):
        return None
    if k and mass - table[k - 1][0] < table[k][0] - mass:
        k -= 1
    return table[k][1]


def with_pattern(peaks: DataFrame) -> DataFrame:
    """Adds averagine_mass and pattern, the nearest averagine peptide of (fitted_mz, charge); peaks beyond the last mass are dropped."""
    table = averagine_table()
    masses = [m for m, _ in table]

    @F.pandas_udf("averagine_mass double, pattern array<double>")
    def looked_up(mass: pd.Series) -> pd.DataFrame:
        up = np.searchsorted(masses, mass)
        near = np.minimum(up, len(masses) - 1)
        low = np.maximum(near - 1, 0)
        at = np.where((near > 0) & (mass - np.take(masses, low) < np.take(masses, near) - mass), low, near)
        found = up < len(masses)
        return pd.DataFrame({"averagine_mass": np.where(found, np.take(masses, at), np.nan), "pattern": [table[k][1] if ok else None for k, ok in zip(at, found, strict=True)]})

    z = F.col("charge")
    out = peaks.withColumn("_p", looked_up(F.col("fitted_mz") * z - z * PROTON)).where("_p.pattern is not null")
    return out.withColumns({"averagine_mass": F.col("_p.averagine_mass"), "pattern": F.col("_p.pattern")}).drop("_p")


def rolling_cosine(a: list[float], b: list[float], ratio: float = 4.0) -> tuple[float, int, int]:
    """Best (score, first, last) of laying the top of ``b`` on each place of ``a``.

    From the top outwards the window grows while both sides, relative to their tops, agree within
    ``ratio``. The score is the cosine times the share of ``b`` that is covered.
    """
    a, b = np.asarray(a, float), np.asarray(b, float)
    nothing = (0.0, 0, 0)
    if len(a) < 2 or len(b) < 2 or (np.abs(a) < 1e-12).any() or (np.abs(b) < 1e-12).any():
        return nothing
    top, best = int(b.argmax()), nothing
    for k in range(len(a)):
        lo, hi = max(0, k - top), min(len(a) - 1, k + len(b) - 1 - top)
        at = np.arange(lo, hi + 1)
        rel = (b[at - k + top] / b[top]) / (a[at] / a[k])
        ok = (rel < ratio) & (rel >= 1 / ratio)
        left = at[(at < k) & ~ok]
        right = at[(at >= k) & ~ok]
        lo = int(left.max()) + 1 if len(left) else lo
        hi = int(right.min()) - 1 if len(right) else hi
        if hi <= lo:
            continue
        x, y = a[lo : hi + 1], b[lo - k + top : hi + 1 - k + top]
        score = float(x @ y) * ((hi - lo + 1) / len(b)) / (float(np.sqrt(x @ x)) * float(np.sqrt(y @ y)))
        if score > best[0]:
            best = (score, lo, hi)
    return best


#: Rows of whole components that one task walks through.
WALKED = 5_000
#: Peaks of a run that a cell of the isotope search holds on average, and cells that one box may meet along an axis.
HELD, MET = 12.0, 64


def cell_widths(peaks: DataFrame, most: tuple[float, float], reach: float = 0.0) -> tuple[float, float]:
    """Widths of cells (m/z, time) of about HELD peaks in the shape of the mean box, at most ``most``; boxes are ``reach`` longer in m/z than two sigmas.

    With fixed widths the peaks that each box is compared with would grow with their number.
    """
    axes = (("fitted_mz", "fitted_sigma_mz", reach), ("fitted_rt", "fitted_sigma_rt", 0.0))
    about = [x for c, s, more in axes for x in (F.max(c) - F.min(c), more + 2 * F.avg(s), more + 2 * F.max(s))]
    n, files, *about = peaks.agg(F.count("*"), F.count_distinct("file_id"), *about).first()
    if not n or not all(x is not None and 0 < x < math.inf for x in about):
        return most
    mz, box_mz, longest_mz, rt, box_rt, longest_rt = about
    scale = math.sqrt(HELD * mz * rt * files / n / (box_mz * box_rt))
    return min(most[0], max(scale * box_mz, longest_mz / MET)), min(most[1], max(scale * box_rt, longest_rt / MET))


def candidate_graph(peaks: DataFrame, charges: list[int], width: float = 4.0, width_rt: float = 30.0) -> DataFrame:
    """Edges (file_id, charge, lower, upper): the next isotope lies one step on, within the lower peak's sigmas (strict).

    A peak asks once for the steps of all charges, which lie side by side, so that it isn't shuffled for each of them.
    ``width`` and ``width_rt`` are the largest cells of the search; dense peaks get smaller ones.
    """
    p = peaks.select("file_id", "peak_id", "fitted_mz", "fitted_rt", "fitted_sigma_mz", "fitted_sigma_rt")
    c, charges = F.col, [z for z in charges if z != 0]
    steps = [ISOTOPE_STEP / z for z in charges]
    first, last = min(steps, default=0.0), max(steps, default=0.0)
    lo = p.select("file_id", c("peak_id").alias("lower"), c("fitted_mz").alias("m"), c("fitted_rt").alias("at"), c("fitted_sigma_mz").alias("sm"), c("fitted_sigma_rt").alias("sr"))
    lo = lo.withColumns({"lo_mz": c("m") + first - c("sm"), "hi_mz": c("m") + last + c("sm"), "lo_rt": c("at") - c("sr"), "hi_rt": c("at") + c("sr")})
    up = p.select("file_id", c("peak_id").alias("upper"), c("fitted_mz").alias("um"), c("fitted_rt").alias("ur"))
    j = boxed(up, lo, ["file_id"], "um", "ur", ("lo_mz", "hi_mz", "lo_rt", "hi_rt"), cell_widths(p, (width, width_rt), last - first))

    def near(step):
        want = c("m") + step
        return (F.abs(c("um") - want) < c("sm")) & c("um").between(want - c("sm"), want + c("sm"))

    j = j.where((F.abs(c("ur") - c("at")) < c("sr")) & reduce(or_, map(near, steps), F.lit(False)))
    j = j.select(c("r.file_id").alias("file_id"), "m", "sm", "um", "lower", "upper", F.explode(F.array(*map(F.lit, charges)).cast("array<int>")).alias("charge"))
    return j.where(near(F.lit(ISOTOPE_STEP) / c("charge"))).select("file_id", "charge", "lower", "upper")


def walk(peaks: pd.DataFrame, edges: dict[int, tuple[dict, dict]], charges: list[int]) -> list[tuple[int, float, list[int]]]:
    """Greedy (charge, score, peak ids) by descending height; ``edges`` has (next, previous) per charge.

    A path takes a peak once, also where sigmas wider than the isotope step make a peak its own neighbour.
    """
    table = averagine_table()
    info = {r.peak_id: r for r in peaks.itertuples(index=False)}
    order = peaks.sort_values(["fitted_height", "peak_id"], ascending=[False, True]).peak_id
    used: set[int] = set()
    out = []
    for seed in order:
        if seed in used:
            continue
        s, best = info[seed], (0.0, 0, [])
        for z in charges:
            nxt, prev = edges.get(z, ({}, {}))
            path, on_path = [seed], {seed}
            for links, forward in ((prev, False), (nxt, True)):
                at = seed
                while True:
                    free = [(abs(info[u].fitted_rt - s.fitted_rt), info[u].fitted_mz, u) for u in links.get(at, []) if u not in used and u not in on_path]
                    free = [x for x in free if x[0] <= s.fitted_sigma_rt]
                    if not free:
                        break
                    at = min(free)[2]
                    on_path.add(at)
                    path = [*path, at] if forward else [at, *path]
            if len(path) < 2:
                continue
            pattern = nearest_pattern(s.fitted_mz * z - z * PROTON, table)
            if pattern is None:
                continue
            score, lo, hi = rolling_cosine([info[u].fitted_height for u in path], pattern)
            if score > best[0]:
                best = (score, z, path[lo : hi + 1])
        if len(best[2]) >= 2:
            used.update(best[2])
            out.append((best[1], best[0], best[2]))
    return out


def detect(peaks: DataFrame, charges: list[int], width_rt: float = 30.0) -> DataFrame:
    """Features of every file: score, charge, averages, sums, monoisotopic values, peak_ids, feature_id by volume."""
    peaks = materialise(peaks)
    edges = materialise(candidate_graph(peaks, charges, width_rt=width_rt))
    files = peaks.select("file_id").distinct().withColumn("_f", F.dense_rank().over(W.orderBy("file_id")).cast("long"))  # one row per run
    # Nodes are numbers: smallest ones of structs would be found by sorting.
    uid = lambda c: (F.col("_f") * F.lit(1 << 40) + F.col(c))
    told = edges.join(F.broadcast(files), "file_id")
    comp = connected_components(told.select(uid("lower").alias("a"), uid("upper").alias("b")))
    comp = comp.withColumns({"_f": F.expr(f"node div {1 << 40}"), "peak_id": F.col("node") % F.lit(1 << 40)}).join(F.broadcast(files), "_f").select("file_id", "peak_id", "component")
    after = edges.groupBy("file_id", F.col("lower").alias("peak_id")).agg(F.collect_list(F.struct("charge", "upper")).alias("next"))
    members = materialise(peaks.join(comp, ["file_id", "peak_id"]).join(after, ["file_id", "peak_id"], "left"))

    def one_file(f: int, x: pd.DataFrame) -> list[tuple]:
        links: dict[int, tuple[dict, dict]] = {}
        for u, nxt in zip(x.peak_id, x.next, strict=True):
            for e in nxt if nxt is not None else ():
                fwd, back = links.setdefault(e["charge"], ({}, {}))
                fwd.setdefault(u, []).append(e["upper"])
                back.setdefault(e["upper"], []).append(u)
        return [(f, int(p[0]), z, s, [int(u) for u in p]) for z, s, p in walk(x, links, charges)]

    def run(x: pd.DataFrame) -> pd.DataFrame:
        rows = [r for f, part in x.groupby("file_id") for r in one_file(int(f), part)]
        return pd.DataFrame(rows, columns=["file_id", "first_id", "charge_state", "score", "peak_ids"])

    need = ["file_id", "peak_id", "fitted_mz", "fitted_rt", "fitted_height", "fitted_sigma_rt", "component", "next"]
    found = materialise(dealt(members.select(*need), rows=WALKED).groupBy("_bucket").applyInPandas(run, "file_id int, first_id long, charge_state int, score double, peak_ids array<long>"))
    return table_of(found, members.select(*peaks.columns))  # a feature's peaks have edges


def table_of(found: DataFrame, peaks: DataFrame) -> DataFrame:
    """Aggregates of features (file_id, first_id, charge_state, score, peak_ids) over their peaks."""
    key = ["file_id", "first_id", "charge_state", "score", "peak_ids"]
    m = found.select(*key, F.posexplode("peak_ids").alias("pos", "peak_id")).join(peaks, ["file_id", "peak_id"])
    mono = lambda c: F.min_by(c, "pos")
    g = m.groupBy(*key).agg(
        F.avg("fitted_rt").alias("average_rt"), F.avg("rt_delta").alias("average_rt_delta"), F.avg("fitted_sigma_rt").alias("average_rt_sigma"), F.avg("fitted_sigma_mz").alias("average_mz_sigma"),
        (F.sum(F.col("fitted_mz") * F.col("fitted_height")) / F.sum("fitted_height")).alias("average_mz"),
        F.sum("fitted_height").alias("total_height"), F.max("fitted_height").alias("max_height"), F.sum("fitted_volume").alias("total_volume"), F.max("fitted_volume").alias("max_volume"),
        mono("fitted_mz").alias("monoisotopic_mz"), mono("fitted_rt").alias("monoisotopic_rt"), mono("fitted_height").alias("monoisotopic_height"), mono("fitted_volume").alias("monoisotopic_volume"),
    )
    order = W.partitionBy("file_id").orderBy(F.desc("total_volume"), "first_id")
    return g.withColumn("feature_id", F.row_number().over(order).cast("long") - 1).drop("first_id")
