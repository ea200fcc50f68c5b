"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mzloom.storage import discard, materialise, shared_dir

__all__ = ["SPACE", "WORD", "bounded_ids", "byte_words", "discard", "labelled_texts", "materialise", "one_thread", "release_memory", "row_key", "shared_dir", "slices", "spread_lookup", "table"]

#: Words are maximal runs without blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> Column:
    """(doc_id, 64-bit hash of the text): rows with equal keys are repeated rows, whatever doc_id is."""
    return F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"))


def bounded_ids(labels: DataFrame, bound: int, seed: int = 0) -> DataFrame:
    """At most ``bound`` rows of ``labels``, one per doc_id, chosen by a hash of doc_id.

    Of several labels of one doc_id the smallest counts, column by column. The result is small by
    construction, so it may be broadcast.
    """
    ids = labels.where(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long"))
    values = [F.min(c).alias(c) for c in labels.columns if c != "doc_id"]
    one = ids.groupBy("doc_id").agg(*values) if values else ids.distinct()
    return one.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(bound)


def labelled_texts(docs: DataFrame, labels: DataFrame, bound: int, seed: int = 0) -> DataFrame:
    """doc_id, text and the columns of ``labels`` for at most ``bound`` documents, one row each.

    Of several texts of one doc_id the smallest counts, so repeated rows neither exceed the bound nor leave
    anything to chance.
    """
    chosen = bounded_ids(labels, bound, seed)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", *[c for c in labels.columns if c != "doc_id"])


def spread_lookup(rows: DataFrame, keys: list[str], values: DataFrame, spread: Column, how: str = "inner", salts: int = 256) -> DataFrame:
    """``rows`` joined with ``values``, which has one row per ``keys``, without sending all rows of a key to one task.

    Rows of a key are dealt to ``salts`` parts by the hash of ``spread``; each part that a key has asks once for its value.
    ``how`` may be left_semi. Keys must not be null.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    told = dealt.select(*keys, "_salt").distinct().join(values, keys)
    return dealt.join(told, [*keys, "_salt"], how).drop("_salt")


def byte_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if text else []


def one_thread() -> None:
    """Keep numpy's bundled linear algebra to one thread per Python worker: tasks share the cores already."""
    import ctypes
    import glob
    import os

    import numpy as np

    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break


def slices(batches, rows: int = 512):
    """Arrow batches of at most ``rows`` rows, so that only so many texts become Python strings at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def release_memory() -> None:
    """Give freed memory back to the system; fitting on the driver leaves large gaps otherwise."""
    import contextlib
    import ctypes
    import gc

    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
