"""How filters interact: what each one removes alone, after others, and on average over all orders.

Every document gets a mask of the filters that it fails, counts by mask give every figure for every order. Exact
copies are found by partition refinement: documents are split by the number of code points, then by the hashes of successive
blocks of the text (``FIRST`` code points, then 15 times as many as all before, and so on), and whoever is
alone in its part drops out. One scan makes a slim row of each text (no text in it), so refinement moves hashes only.
Texts of parts that survive all blocks are compared in full: they are grouped by the text itself, which joins copies within every task before
they are sent. A part with one text gives its least doc_id to all; a part whose texts differ in spite of equal hashes
is told apart by the text. Documents that aren't the least of their text are marked.

Parts of any size: counts of parts are pre-aggregated, and rows ask for their part's verdict in salted keys.

Null texts are empty. Documents without doc_id have no smaller one and are nobody's smaller one: they never fail E. Rows that repeat a
doc_id don't make each other copies; each is counted. Of several labels of one doc_id the largest counts, column by
column. A null lang and an empty one are the same part. An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mzloom.llm.common import SPACE, materialise, spread_lookup

FILTERS = "ABCDE"
#: Code points of the first block; block k ends at FIRST * (16 ** (k + 1) - 1) / 15.
FIRST = 64
STARTS = [FIRST * (16**k - 1) // 15 for k in range(8)]


def failures(text: Column) -> Column:
    """Mask of the filters A to D (bits 1, 2, 4, 8) that a text fails."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    checks = [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.char_length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(checks)), F.lit(0)).cast("int")


def block_hashes(text: Column, bits: int = 64) -> Column:
    """Hashes of successive blocks; ``bits`` below 64 keeps so many of each (for tests of equal hashes)."""
    starts = F.filter(F.array(*map(F.lit, STARTS)), lambda s: s < F.char_length(text))
    hashed = lambda s: F.xxhash64(F.substring(text, (s + 1).cast("int"), (15 * s + FIRST).cast("int")))
    return F.transform(starts, (lambda s: hashed(s).bitwiseAND(F.lit((1 << bits) - 1))) if bits < 64 else hashed)


def chained(key: Column, block: Column) -> Column:
    return F.xxhash64(key, block)


def _start(length: Column) -> Column:
    return length.cast("long")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose part (key) has more than one row."""
    many = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return spread_lookup(rows, ["key"], many, F.col("doc_id"), "left_semi")


def refine(slim: DataFrame) -> DataFrame:
    """Rows of ``slim`` (doc_id, length, hashes and more) that share length and all hashes with another; key names their part."""
    live, level, spent = slim.withColumn("key", _start(F.col("length"))), 0, None
    while True:
        live = materialise(_shared(live), spent)
        spent = live
        if live.where(F.size("hashes") > level).isEmpty():
            return live
        # All rows of a part are equally long, so their blocks end together.
        step = F.when(F.size("hashes") > level, chained(F.col("key"), F.get("hashes", F.lit(level)))).otherwise(F.col("key"))
        live, level = live.withColumn("key", step), level + 1


def copies(docs: DataFrame, slim: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, part, mask) of rows whose text is that of a smaller doc_id: ``slim`` has them with length and hashes, ``docs`` with the text, never null."""
    live = refine(slim)
    keyed = docs.withColumn("key", F.aggregate(block_hashes(F.col("text"), bits), _start(F.char_length("text")), chained))
    # Both sides meet by salted keys at every size: the surviving parts grow with the input, so they are never broadcast.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(256)).cast("int")
    asked = live.select("key", salt.alias("salt")).distinct()
    texts = keyed.withColumn("salt", salt).join(asked.hint("shuffle_hash"), ["key", "salt"], "left_semi").drop("salt")
    least = materialise(texts.groupBy("key", "text").agg(F.min("doc_id").alias("least")))
    of_key = materialise(least.groupBy("key").agg(F.count("*").alias("texts"), F.min("least").alias("least")))
    alike = spread_lookup(live, ["key"], of_key.where("texts = 1").select("key", "least"), F.col("doc_id"))
    marked = alike.where("doc_id > least").select("doc_id", "part", "mask")
    apart = of_key.where("texts > 1").select("key")
    if not apart.isEmpty():
        told = spread_lookup(texts, ["key"], apart, F.col("doc_id"), "left_semi").join(least, ["key", "text"]).where("doc_id > least")
        marked = marked.unionByName(told.select("doc_id", "part", failures(F.col("text")).alias("mask")))
    return marked


def audit(docs: DataFrame, labels: DataFrame, bits: int = 64) -> DataFrame:
    """One row per part, order of the filters and step: what is kept, removed, redundant, failed only here, lost, and the Shapley sum."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    text = F.col("text")
    slim = materialise(docs.select("doc_id", "part", failures(text).alias("mask"), F.char_length(text).alias("length"), block_hashes(text, bits).alias("hashes")))
    known = "doc_id is not null"
    marked = copies(docs.where(known), slim.where(known), bits)
    rows = slim.select("doc_id", "part", "mask", F.lit(1).alias("n"))
    rows = rows.unionByName(marked.select("doc_id", "part", F.explode(F.array(F.struct("mask", F.lit(-1).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.lit(1).alias("n")))).alias("x")).select("doc_id", "part", "x.mask", "x.n"))
    rows = rows.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).where("n <> 0")
    told = labels.where(known).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max((F.coalesce(c, F.lit(0)) == 1).cast("long")).alias(c) for c in ("quality", "toxic")])
    one = rows.join(told, "doc_id", "left")
    counts = one.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("quality", "toxic")])
    return interactions(counts)


def interactions(counts: DataFrame) -> DataFrame:
    """The figures of every order and step from counts (part, mask, n, quality, toxic); at most 32 masks a part."""
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "quality", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    bits = lambda of: sum((F.when(F.contains(of, F.lit(f)), F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(FILTERS)), F.lit(0))
    steps = steps.select("part", "filter_order", "step", "cells", letter.alias("letter"), bits(letter).alias("here"), bits(earlier).alias("before"))

    def total(what: str, condition) -> Column:
        kept = F.filter("cells", lambda c: condition(c["mask"]))
        return F.aggregate(kept, F.lit(0).cast("long"), lambda a, c: a + c[what])

    here, before = F.col("here"), F.col("before")
    fails, passed = (lambda m: m.bitwiseAND(here) != 0), (lambda m: m.bitwiseAND(before) == 0)
    removed = lambda m: fails(m) & passed(m)
    out = steps.select(
        "part", "filter_order", "step", "letter",
        total("n", lambda m: passed(m) & ~fails(m)).alias("kept"), total("n", removed).alias("removed"), total("n", lambda m: fails(m) & ~passed(m)).alias("redundant"),
        total("n", lambda m: m == here).alias("unique_fails"), total("quality", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
    )
    # 120 rows a part and letter.
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "letter"))).drop("letter")
