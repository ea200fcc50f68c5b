"""Quantiles by refined histograms are those that sort all values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mzloom.operators import summary

KINDS = {
    "uniform": lambda r: r.uniform(-5, 5, 700), "heavy": lambda r: np.exp(r.normal(0, 30, 700)), "few": lambda r: r.integers(0, 3, 700).astype(float), "one": lambda r: np.full(300, 2.5), "single": lambda r: np.array([7.0]),
    "close": lambda r: 1.0 + r.integers(0, 5, 200) * 2.0**-52, "huge": lambda r: np.array([-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1.0]), "hot": lambda r: np.concatenate([np.zeros(5000), r.normal(size=50)]),
}


@pytest.mark.parametrize("bins", [1024, 4])
def test_quantiles_are_exact(spark, monkeypatch, bins):
    monkeypatch.setattr(summary, "BINS", bins)
    r, wanted = np.random.default_rng(3), [0.0, 0.05, 0.37, 0.5, 0.95, 1.0]
    data = {k: f(r) for k, f in KINDS.items() if bins > 4 or k != "heavy"}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [(None, 1.0), (None, 3.0), ("none", None), ("none", math.nan)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {x.k: x.q for x in summary.quantiles(frame, "v", wanted, "k").collect()}
    assert got.keys() == {*data, None} and got[None][3] == 2.0
    sql = {x.k: x.q for x in frame.where("k <> 'none'").groupBy("k").agg(F.percentile("v", F.lit(wanted)).alias("q")).collect()}
    for k in data:
        assert got[k] == pytest.approx(sql[k], rel=1e-12), k


def test_summaries_of_nothing_and_without_keys(spark):
    frame = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "v double")
    x = summary.describe(frame, "v").first()
    assert (x["count"], x.median) == (3, 2.0) and math.isclose(x.mean, 7 / 3)
    empty = summary.describe(frame.limit(0), "v").first()
    assert empty["count"] == 0 and empty.median is None
    assert summary.describe(frame.limit(0).withColumn("file_id", F.lit(1)), "v", "file_id").count() == 0
