"""Tables in the folder that all executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder; a temporary one only under a local master."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Whether Spark deletes the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; then the materialised tables ``spent`` are deleted.

    Nothing reads the shuffle files of the write again, so they go with it: otherwise those of all rounds add up until the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage = path
    discard(*spent)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes materialised tables that nothing reads any more; other frames are left alone."""
    for df in tables:
        path = df.__dict__.pop("_stage", None) if df is not None else None
        if path:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
