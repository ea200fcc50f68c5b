"""A corpus pipeline of five operators; every stage works on all that the one before it kept.

Stages but the last keep the columns of ``documents``, with any further columns. A row is known by its doc_id and
its text: texts that share a doc_id, or have none, are judged each on their own. Of rows that repeat both, and
are not copies of an earlier one, near-duplicate removal keeps the least by their other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mzloom.llm import decontaminate, packing, secrets, simhash, toxicity
from mzloom.llm.common import discard, materialise, row_key, table


def _keyed(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` with (left_semi) or without (left_anti) their key in ``keys`` (row)."""
    return docs.alias("the_documents").join(keys.select("row").distinct().alias("the_keys"), row_key() == F.col("the_keys.row"), how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain takes for toxic go."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies stays, the one with the smallest doc_id."""
    groups = materialise(simhash.near_copies(docs))
    kept = _keyed(docs, groups.where("not kept"), "left_anti")
    again = materialise(groups.where("kept").groupBy("row").count().where("count > 1"))
    if again.isEmpty():
        return kept
    order = F.struct(*[c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    one = _keyed(docs, again, "left_semi").groupBy(row_key().alias("the_key")).agg(F.min_by(F.struct(*docs.columns), order).alias("the_row"))
    return _keyed(kept, again, "left_anti").unionByName(one.select("the_row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.find(docs.select(row_key().alias("row"), "text"), table(spark, sf_dir, "benchmark"), "row")
    return _keyed(docs, materialise(found.select("row").distinct()), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark."""
    return secrets.redact(docs, secrets.fit())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        done = docs
        docs = materialise(stage(spark, docs, sf_dir))
        discard(done)
    return docs


#: Learned models and fingerprints aren't expressible in SQL; a test compares run() with plain Python.
ORACLE_SQL = None
