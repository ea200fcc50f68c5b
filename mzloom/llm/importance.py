"""Quality by importance resampling.

Two generative models over hashed word unigrams and bigrams (``BUCKETS`` buckets) are counted: one for the
target (texts labelled good), one for all raw text. A text's log weight is the sum over its n-grams of
log p_target / p_raw. Adding a Gumbel variate to each log weight and taking the k largest keys
samples k texts without replacement in proportion to their weights (Gumbel top-k). The variate
comes from a hash of doc_id (of the text where doc_id is null) and the seed, so recomputed tasks repeat it.

The target model uses at most ``TARGETS`` labelled texts, chosen by a hash of doc_id; raw counts cover all
rows. k is ``share`` of the texts that have words (default: the share of good labels among labelled doc_ids; of
conflicting labels the smallest counts). The k-th key is found exactly by histogram refinement, never by sorting on one node.

Null and empty texts and those without words are never kept and have weight 0. Repeated rows have
equal keys; rows that tie with the k-th key are all kept. Without good labels the target equals the raw
model. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mzloom.llm.common import bounded_ids, byte_words, materialise

BUCKETS = 10_000
TARGETS = 20_000
BINS = 2_000


def buckets_of(text: str | None) -> np.ndarray:
    """Buckets of all word unigrams and bigrams of a whole text."""
    words = byte_words(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.int64)
    crc = zlib.crc32
    h = np.array([crc(w) for w in words], dtype=np.uint64)
    two = h[:-1] * np.uint64(0x9E3779B1) + h[1:]
    return np.concatenate([h % np.uint64(BUCKETS), (two ^ (two >> np.uint64(29))) % np.uint64(BUCKETS)]).astype(np.int64)


def count_ngrams(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(target, raw) counts per bucket; ``docs`` has text and target (boolean)."""

    def run(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for text, good in zip(b.column("text").to_pylist(), b.column("target").to_pylist(), strict=True):
                h = buckets_of(text)
                if len(h):
                    n = np.bincount(h, minlength=BUCKETS)
                    counts[1] += n
                    if good:
                        counts[0] += n
        hit = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(counts[0][hit]), pa.array(counts[1][hit])], names=["bucket", "target", "raw"])

    out = np.zeros((2, BUCKETS))
    got = docs.select("text", "target").mapInArrow(run, "bucket long, target long, raw long")
    for r in got.groupBy("bucket").agg(F.sum("target").alias("t"), F.sum("raw").alias("r")).collect():  # BUCKETS rows at most
        out[:, r.bucket] = r.t, r.r
    return out[0], out[1]


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target / p_raw per bucket; one smoothed observation per bucket follows the raw model."""
    if not target.sum():
        return np.zeros(BUCKETS)
    p = (raw + 1) / (raw + 1).sum()
    q = (target + BUCKETS * p) / (target.sum() + BUCKETS)
    return np.log(q / p)


def weigh(docs: DataFrame, ratios: np.ndarray, seed: int = 11) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key (null without n-grams)."""

    def run(batches):
        for b in batches:
            h = [buckets_of(t) for t in b.column("text").to_pylist()]
            n = np.array([len(x) for x in h], np.int64)
            w = np.array([float(ratios[x].sum()) for x in h])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(w), b.column("hash")], names=["doc_id", "n_grams", "log_weight", "hash"])

    who = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(seed))).otherwise(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)))
    out = docs.select(F.col("doc_id").cast("long"), "text", who.alias("hash")).mapInArrow(run, "doc_id long, n_grams long, log_weight double, hash long")
    u = (F.shiftrightunsigned("hash", 11) + 0.5) / float(1 << 53)
    out = out.withColumn("gumbel_key", F.when(F.col("n_grams") > 0, F.col("log_weight") - F.log(-F.log(u))))
    return out.drop("hash")


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The exact k-th largest value (null values aside), by repeated histograms of ``BINS`` bins."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    if k <= 0:
        return None
    low, high = values.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return None
    while low < high:
        width = (high - low) / BINS
        if not width or low + width == low:
            break
        at = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1)).alias("bin")
        bins = values.where((F.col("v") >= low) & (F.col("v") <= high)).groupBy(at).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        for r in sorted(bins.collect(), key=lambda r: -r["bin"]):
            if k <= r.n:
                low, high = r.a, r.b
                break
            k -= r.n
        else:
            return low
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, bound: int = TARGETS, seed: int = 11) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key, kept for every row of ``docs``."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good, n = known.agg(F.sum((F.col("quality") == 1).cast("int")), F.count("*")).first()
    if share is None:
        share = good / n if n else 1.0
    chosen = bounded_ids(known.where("quality = 1").select("doc_id"), bound).withColumn("target", F.lit(True))
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left")
    keys = materialise(weigh(docs, log_ratios(*count_ngrams(marked)), seed))
    least = kth_largest(keys, "gumbel_key", round(share * keys.where("gumbel_key is not null").count()))
    kept = F.lit(False) if least is None else F.coalesce(F.col("gumbel_key") >= F.lit(least), F.lit(False))
    return keys.withColumn("kept", kept)
