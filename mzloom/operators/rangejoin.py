"""Range joins by bins: an equi-join instead of a nested loop."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mzloom.storage import materialise


def binned(points: DataFrame, intervals: DataFrame, keys: list[str], x: Column, low: Column, high: Column, width: float | Column, how: str = "inner") -> DataFrame:
    """Join ``points`` (aliased p) with ``intervals`` (aliased r) where low <= x <= high and ``keys`` agree.

    Every point lies in one bin of ``width`` and every interval is repeated for the bins it meets, so
    no pair appears twice. ``width`` near the usual interval length keeps the repetition at two. Bins
    also spread a hot key over many tasks.
    """
    p = points.withColumn("_bin", F.floor(x / width).cast("long"))
    r = intervals.withColumn("_low", low).withColumn("_high", high)
    r = r.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_low") / width).cast("long"), F.floor(F.col("_high") / width).cast("long"))))
    p, r = p.withColumn("_x", x).alias("p"), r.alias("r")
    same = reduce(and_, [F.col(f"p.{k}") == F.col(f"r.{k}") for k in [*keys, "_bin"]])
    return p.join(r, same & (F.col("p._x") >= F.col("r._low")) & (F.col("p._x") <= F.col("r._high")), how)


def bin_of(x: Column, width: float) -> Column:
    return F.floor(x / width).cast("long")


def bins(low: Column, high: Column, width: float) -> Column:
    """One row for each bin of ``width`` that [low, high] meets."""
    return F.explode(F.sequence(bin_of(low, width), bin_of(high, width)))


def touching(a: DataFrame, b: DataFrame, keys: list[str], axes: list[tuple[Column, Column, Column, Column, float]]) -> DataFrame:
    """Pairs (aliased a, b) with equal ``keys`` whose intervals touch on every axis.

    An axis is (centre and half width in a, centre and half width in b, bin width). Both sides are repeated for the
    bins they meet; a pair is kept in the first bin the two share, so it appears once.
    """

    def dealt(df: DataFrame, name: str, side: int) -> DataFrame:
        for k, axis in enumerate(axes):
            c, h = axis[2 * side], axis[2 * side + 1]
            df = df.withColumns({f"_low{k}": c - h, f"_high{k}": c + h})
            df = df.withColumn(f"_first{k}", bin_of(F.col(f"_low{k}"), axis[4])).withColumn(f"_bin{k}", bins(F.col(f"_low{k}"), F.col(f"_high{k}"), axis[4]))
        return df.alias(name)

    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*keys, *[f"_bin{k}" for k in range(len(axes))]]]
    for k in range(len(axes)):
        on.append(F.col(f"a._bin{k}") == F.greatest(F.col(f"a._first{k}"), F.col(f"b._first{k}")))
        on.append((F.col(f"a._low{k}") <= F.col(f"b._high{k}")) & (F.col(f"b._low{k}") <= F.col(f"a._high{k}")))
    return dealt(a, "a", 0).join(dealt(b, "b", 1), reduce(and_, on))


#: Points that one cell of a box join may hold before it is split.
FULL = 20_000
#: Parts of a full cell along either axis, at most.
PARTS = 64


def boxed(points: DataFrame, boxes: DataFrame, keys: list[str], x: str, y: str, box: tuple[str, str, str, str], widths: tuple[float, float], full: int | None = None) -> DataFrame:
    """Pairs (points aliased p, boxes aliased r) with equal ``keys`` and the point inside the box, borders included.

    ``box`` names the columns low x, high x, low y, high y. Cells of ``widths`` adapt to the data: a cell with more than
    ``full`` points is split into parts along both axes, and a part that is still too full (points too close to be told apart) deals its points
    to salted copies that every box asks. So each join key has a bounded number of points, however uneven the density is; boxes are repeated for
    the cells and parts that they meet, and a point lies in one of them.
    """
    full, (wx, wy) = full or FULL, widths
    cell, part = ["_cx", "_cy"], ["_px", "_py"]
    p = points.withColumns({"_cx": bin_of(F.col(x), wx), "_cy": bin_of(F.col(y), wy)})
    r = boxes.withColumn("_cx", bins(F.col(box[0]), F.col(box[1]), wx)).withColumn("_cy", bins(F.col(box[2]), F.col(box[3]), wy))
    on = [*keys, *cell]
    crowded = p.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > full)
    crowded = materialise(crowded.select(*on, F.least(F.ceil(F.sqrt(F.col("_n") / full)), F.lit(PARTS)).cast("int").alias("_parts")))
    if not crowded.isEmpty():
        n = F.coalesce("_parts", F.lit(1))

        def place(value: str, c: str, width: float):
            """The part of a cell that holds a value; values beyond the cell belong to its first or last part."""
            at = F.floor((F.col(value) - F.col(c) * width) / (width / n))
            return F.greatest(F.least(at, n - 1), F.lit(0)).cast("int")

        span = lambda lo, hi, c, w: F.explode(F.sequence(place(lo, c, w), place(hi, c, w)))
        p = p.join(crowded, on, "left").withColumns({"_px": place(x, "_cx", wx), "_py": place(y, "_cy", wy)}).drop("_parts")
        r = r.join(crowded, on, "left").withColumn("_px", span(box[0], box[1], "_cx", wx)).withColumn("_py", span(box[2], box[3], "_cy", wy)).drop("_parts")
        on = [*on, *part]
        close = p.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > full).select(*on, F.ceil(F.col("_n") / full).cast("int").alias("_salts"))
        close = materialise(close)
        if not close.isEmpty():
            some = F.coalesce("_salts", F.lit(1))
            p = p.join(close, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*[c for c, kind in points.dtypes if "map<" not in kind]), some)).drop("_salts")
            r = r.join(close, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), (some - 1).cast("long")))).drop("_salts")
            on = [*on, "_salt"]
    p, r = p.alias("p"), r.alias("r")
    same = reduce(and_, [F.col(f"p.{k}") == F.col(f"r.{k}") for k in on])
    return p.join(r, same & F.col(f"p.{x}").between(F.col(f"r.{box[0]}"), F.col(f"r.{box[1]}")) & F.col(f"p.{y}").between(F.col(f"r.{box[2]}"), F.col(f"r.{box[3]}")))
