import datetime as dt

from mzloom.streaming.chromatogram import SCHEMA, points_stream, xic_stream


def test_streamed_chromatogram(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(0, at, 1.0, 400.0, 5.0), (0, at, 1.0, 500.0, 7.0), (0, at, 2.0, 900.0, 3.0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    q = xic_stream(points_stream(spark, str(tmp_path / "in")), 390, 600).writeStream.outputMode("complete").format("memory").queryName("xic").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.rt, r.intensity) for r in spark.table("xic").collect()} == {(1.0, 12.0), (2.0, 0.0)}
