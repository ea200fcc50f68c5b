"""Stage tables and result files."""

from __future__ import annotations

import dataclasses
import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mzloom.params import Parameters


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table lies at ``path``, in any store."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def fingerprint(spark: SparkSession, path: str) -> list:
    """Path, size and time of an input file, in any store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
    return [path, status.getLen(), status.getModificationTime()]


class Stages:
    """Stage tables in a folder, each with the digest of what it was made from.

    A digest covers the values that the stage uses (parameters, input files) and the digests of the stages it reads. It
    is written beside the table once that is complete, so a table is taken up only if nothing it depends on
    has changed and if it was finished; after a crash or a change the affected stages are made anew, the others stay.
    """

    def __init__(self, spark: SparkSession, out: str, force: bool = False):
        self.spark, self.out, self.force = spark, out, force
        self.digests: dict[str, str] = {}
        self.made: list[str] = []

    def table(self, name: str, make, uses: object = None, parents: tuple[str, ...] = (), by_file: bool = True) -> DataFrame:
        told = json.dumps([name, uses, by_file, [self.digests[p] for p in parents]], sort_keys=True, default=str)
        digest = self.digests[name] = hashlib.sha256(told.encode()).hexdigest()
        path, mark = f"{self.out}/{name}", f"{self.out}/stages/{name}.sha256"
        if self.force or read_text(self.spark, mark) != digest or not exists(self.spark, path):
            self.made.append(name)
            write_text(self.spark, "", mark)  # from here on the old table doesn't count
            df = make()
            if by_file and "file_id" in df.columns:
                # A file's rows meet in few tasks, so that there aren't tasks x files small ones; large files are split.
                df.hint("rebalance", "file_id").write.mode("overwrite").partitionBy("file_id").parquet(path)
            else:
                df.write.mode("overwrite").parquet(path)
            write_text(self.spark, digest, mark)
        return self.spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, as many as there are tasks; arrays are joined by blanks, maps and structs become JSON."""
    flat = [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) if k.startswith("array<") and "struct" not in k else F.to_json(c).alias(c) if k.startswith(("struct", "map", "array")) else F.col(c) for c, k in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def write_wide_csv(lines: DataFrame, keys: list[str], names: list[str], path: str) -> None:
    """CSV files of rows (keys, line), where line has the values of the columns ``names``: no plan has these as columns, however many there are."""
    head = ",".join(_quoted(c) for c in [*keys, *names])
    schema = lines.sparkSession.createDataFrame([], "value string").schema

    def run(batches):
        begun = False
        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(len(keys) + 1)]
            rows = [",".join([*[_quoted("" if v is None else str(v)) for v in r[:-1]], r[-1]]) for r in zip(*columns, strict=True)]
            if rows and not begun:
                rows, begun = [head, *rows], True
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])

    lines.select(*keys, "line").mapInArrow(run, schema).write.mode("overwrite").option("lineSep", "\n").text(path)


def _quoted(text: str) -> str:
    return '"' + text.replace('"', '\\"') + '"' if any(c in text for c in ',"\n\r') else text


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A result table written by ``write_csv``; without a schema types are found by reading."""
    return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text file on the driver's account, in any store."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, or None if it isn't there."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where):
        return None
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def parameters_json(params: Parameters) -> str:
    return json.dumps(dataclasses.asdict(params), indent=2)
