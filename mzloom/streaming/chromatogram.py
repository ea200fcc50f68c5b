"""Chromatograms of a growing folder of points: a stateless filter and one windowed aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file_id int, arrived timestamp, rt double, mz double, intensity double"


def points_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def xic_stream(points: DataFrame, min_mz: float, max_mz: float, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Intensity sum per file, scan and arrival window; state is dropped behind the watermark."""
    hit = F.when(F.col("mz").between(min_mz, max_mz), F.col("intensity")).otherwise(0.0)
    p = points.withWatermark("arrived", late)
    return p.groupBy(F.window("arrived", window), "file_id", "rt").agg(F.sum(hit).alias("intensity"))
