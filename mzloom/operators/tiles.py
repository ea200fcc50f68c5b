"""The grid in dense tiles: points are dealt once to tiles with a halo, and a tile is filled, smoothed and searched as one array.

A cell of the smoothed grid depends on points within two kernel half widths, and a local maximum on the next cells as well. So
every point goes to the tile that holds its cell and to those within that reach, in one shuffle of points; no cell is ever shuffled.
A task streams over its points, sorted by tile, and holds one tile and one batch, however many points a tile has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mzloom.functions.exprs import EXPONENT, SIGMA, x_index, y_index
from mzloom.params import Resampling, Run, instrument

#: Cells of a tile along either axis.
TILE = 256
_KEY = ["file_id", "ti", "tj"]
_DIMS = ["n", "m", "min_mz", "max_mz", "min_rt", "max_rt"]


@dataclass(frozen=True)
class Mesh:
    """Positions and kernels of a run's grid, as arrays."""

    run: Run
    how: Resampling
    n: int
    m: int
    min_mz: float
    max_mz: float
    min_rt: float
    max_rt: float

    def mz(self, i: np.ndarray) -> np.ndarray:
        """m/z of columns: the widths of columns follow the instrument's peak widths."""
        k, ref, low = self.how.num_samples_mz, self.run.reference_mz, self.min_mz
        fwhm, kind = ref / self.run.resolution_ms1, instrument(self.run.instrument)
        with np.errstate(divide="ignore", invalid="ignore"):
            if kind == "orbitrap":
                return (1 / math.sqrt(low) - i * (fwhm / ref**1.5 / (2 * k))) ** -2.0
            if kind == "fticr":
                return low / (1 - i * fwhm * low / (k * ref**2))
            if kind == "tof":
                return low * np.exp(i * (fwhm / (k * ref)))
            return low + i * (self.max_mz - low) / (self.n - 1) if self.n > 1 else np.full(np.shape(i), np.nan)

    def rt(self, j: np.ndarray) -> np.ndarray:
        return self.min_rt + j * (self.max_rt - self.min_rt) / (self.m - 1) if self.m > 1 else np.full(np.shape(j), np.nan)

    def sigma_mz(self, mz: np.ndarray) -> np.ndarray:
        fwhm = self.run.reference_mz / self.run.resolution_ms1 * (mz / self.run.reference_mz) ** EXPONENT[instrument(self.run.instrument)]
        return fwhm / SIGMA * (self.how.smoothing_coef_mz / math.sqrt(2))

    @property
    def sigma_rt(self) -> float:
        return self.run.fwhm_rt / SIGMA * self.how.smoothing_coef_rt / math.sqrt(2)


def _smoothed(data: np.ndarray, at: np.ndarray, sigma: np.ndarray, hw: int) -> np.ndarray:
    """Kernel-weighted means along the first axis; neighbours beyond the array don't count."""
    up, down = np.zeros_like(data), np.zeros(len(at))
    for d in range(-hw, hw + 1):
        to, source = slice(max(0, -d), len(at) - max(0, d)), slice(max(0, d), len(at) - max(0, -d))
        if to.start >= to.stop:
            continue
        w = np.exp(-0.5 * ((at[source] - at[to]) / sigma[to]) ** 2)
        up[to] += w[:, None] * data[source]
        down[to] += w
    return up / down[:, None]


class Tile:
    """One tile with its halo, cut at the borders of the grid."""

    def __init__(self, mesh: Mesh, ti: int, tj: int, tile: int, hw: tuple[int, int], more: int):
        self.mesh, self.hw = mesh, hw
        self.own = (ti * tile, min(mesh.n, (ti + 1) * tile)), (tj * tile, min(mesh.m, (tj + 1) * tile))
        (i0, i1), (j0, j1) = (
            (max(0, lo - 2 * h - more), min(size, hi + 2 * h + more)) for (lo, hi), h, size in zip(self.own, hw, (mesh.n, mesh.m), strict=True)
        )
        self.i0, self.j0 = i0, j0
        self.data = np.zeros((i1 - i0, j1 - j0))
        self.touched = np.zeros((i1 - i0 + 1, j1 - j0 + 1), np.int64)

    def add(self, ci: np.ndarray, cj: np.ndarray, mz: np.ndarray, rt: np.ndarray, intensity: np.ndarray) -> None:
        """Spread points over their neighbourhoods with weights that sum to one within the grid."""
        mesh, (hi, hj) = self.mesh, self.hw
        i, j = ci[:, None] + np.arange(-hi, hi + 1), cj[:, None] + np.arange(-hj, hj + 1)
        s = mesh.sigma_mz(mesh.mz(ci.astype(float)))[:, None]
        wi = np.where((i >= 0) & (i < mesh.n), np.exp(-0.5 * ((mesh.mz(i.astype(float)) - mz[:, None]) / s) ** 2), 0.0)
        wj = np.where((j >= 0) & (j < mesh.m), np.exp(-0.5 * ((mesh.rt(j.astype(float)) - rt[:, None]) / mesh.sigma_rt) ** 2), 0.0)
        total = wi.sum(1) * wj.sum(1)
        wi *= (intensity / np.where(total == 0, 1.0, total))[:, None]
        n, m = self.data.shape
        i, j = i - self.i0, j - self.j0
        wi[(i < 0) | (i >= n)] = 0.0
        wj[(j < 0) | (j >= m)] = 0.0
        flat = np.clip(i, 0, n - 1)[:, :, None] * m + np.clip(j, 0, m - 1)[:, None, :]
        self.data += np.bincount(flat.ravel(), (wi[:, :, None] * wj[:, None, :]).ravel(), n * m).reshape(n, m)
        # Cells that a point reaches through both passes, as corners of rectangles that are summed up at the end.
        a, b = np.clip(ci - 2 * hi - self.i0, 0, n), np.clip(ci + 2 * hi + 1 - self.i0, 0, n)
        c, d = np.clip(cj - 2 * hj - self.j0, 0, m), np.clip(cj + 2 * hj + 1 - self.j0, 0, m)
        for rows, cols, sign in ((a, c, 1), (b, c, -1), (a, d, -1), (b, d, 1)):
            np.add.at(self.touched, (rows, cols), sign)

    def smoothed(self) -> np.ndarray:
        n, m = self.data.shape
        mesh, (hi, hj) = self.mesh, self.hw
        out = _smoothed(self.data.T, mesh.rt(np.arange(self.j0, self.j0 + m, dtype=float)), np.full(m, mesh.sigma_rt), hj).T
        at = mesh.mz(np.arange(self.i0, self.i0 + n, dtype=float))
        return _smoothed(out, at, mesh.sigma_mz(at), hi)

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, value) of the tile's own cells that some point reaches."""
        (i0, i1), (j0, j1) = self.own
        inner = slice(i0 - self.i0, i1 - self.i0), slice(j0 - self.j0, j1 - self.j0)
        reached = self.touched.cumsum(0).cumsum(1)[:-1, :-1][inner] > 0
        i, j = np.nonzero(reached)
        return i + i0, j + j0, self.smoothed()[inner][i, j]

    def maxima(self, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, value) of the tile's own cells inside the grid's border that exceed their four neighbours."""
        v = self.smoothed()
        v = v if digits is None else np.round(v, digits)
        up = np.zeros(v.shape, bool)
        mid = v[1:-1, 1:-1]
        up[1:-1, 1:-1] = (mid > 0) & (mid > v[:-2, 1:-1]) & (mid > v[2:, 1:-1]) & (mid > v[1:-1, :-2]) & (mid > v[1:-1, 2:])
        i, j = np.nonzero(up)
        i, j, found = i + self.i0, j + self.j0, v[i, j]
        keep = np.ones(len(i), bool)
        for x, (lo, hi), size in ((i, self.own[0], self.mesh.n), (j, self.own[1], self.mesh.m)):
            keep &= (x >= max(lo, 1)) & (x < min(hi, size - 1))
        return i[keep], j[keep], found[keep]


def tiled(points: DataFrame, grids: DataFrame, run: Run, how: Resampling, hw: tuple[int, int], maxima: bool = False, digits: int | None = None, tile: int = TILE) -> DataFrame:
    """(file_id, i, j, value) of the smoothed grid, or of its local maxima only.

    ``grids`` has one row per run: file_id, n, m and the bounds. ``digits`` rounds values before they are compared.
    """
    kind = points.schema["file_id"].dataType.simpleString()
    g = F.broadcast(grids.select("file_id", *_DIMS))  # one row per run
    # A point's spread is in proportion to its intensity, so points at the same place are one.
    points = points.groupBy("file_id", "mz", "rt").agg(F.sum("intensity").cast("double").alias("intensity"))
    p = points.join(g, "file_id").select("file_id", "mz", "rt", "intensity", "n", "m", x_index("mz", "min_mz", run, how.num_samples_mz).alias("ci"), y_index("rt", "min_rt", run, how.num_samples_mz).alias("cj"))
    more = int(maxima)

    def meets(at: str, h: int, size: str):
        reach, last = 2 * h + more, F.floor((F.col(size) - 1) / tile)
        return F.explode(F.sequence(F.greatest(F.floor((F.col(at) - reach) / tile), F.lit(0)), F.least(F.floor((F.col(at) + reach) / tile), last)))

    p = p.withColumn("ti", meets("ci", hw[0], "n")).withColumn("tj", meets("cj", hw[1], "m")).drop("n", "m")
    p = p.repartition(*_KEY).join(g, "file_id").sortWithinPartitions(*_KEY)
    columns = [*_KEY, "ci", "cj", "mz", "rt", "intensity", *_DIMS]
    file_type = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]

    def finished(key, t: Tile) -> pa.RecordBatch:
        i, j, v = t.maxima(digits) if maxima else t.cells()
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(i), file_type), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(v, pa.float64())], names=["file_id", "i", "j", "value"])

    def work(batches) -> Iterator[pa.RecordBatch]:
        key, t = None, None
        for b in batches:
            ids = b.column(0).to_pylist()
            num = [b.column(k).to_numpy(zero_copy_only=False) for k in range(1, len(columns))]
            at = 0
            while at < b.num_rows:
                here = (ids[at], int(num[0][at]), int(num[1][at]))
                # Rows are sorted, so the end of the tile's rows is where its key ends.
                same = (num[0][at:] == here[1]) & (num[1][at:] == here[2])
                end = at + (int(same.argmin()) if not same.all() else len(same))
                while ids[end - 1] != here[0]:
                    end = at + ids[at:end].index(ids[end - 1])
                if here != key:
                    if t is not None:
                        yield finished(key, t)
                    dims = [c[at] for c in num[7:]]
                    key, t = here, Tile(Mesh(run, how, int(dims[0]), int(dims[1]), *map(float, dims[2:])), here[1], here[2], tile, hw, more)
                for lo in range(at, end, 4096):
                    t.add(*(c[lo : min(end, lo + 4096)] for c in num[2:7]))
                at = end
        if t is not None:
            yield finished(key, t)

    return p.select(*columns).mapInArrow(work, f"file_id {kind}, i long, j long, value double")
