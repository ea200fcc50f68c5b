"""Packing by cutting-stock column generation.

Every document is tokenized, cut into full sequences and one remainder, and remainders are put into
length classes. A linear program over patterns (how many remainders of each class share one
sequence) is solved by column generation: the simplex keeps one basis matrix, a knapsack dynamic
program prices new patterns, and generation ends when the value is within ``GAP`` of a
lower bound (the tokens' volume, or the Lagrangian bound). Patterns are rounded down; what is left (fewer remainders than patterns times pattern
size, whatever the input) is packed first-fit decreasing by class. Only the histogram reaches the
driver. Pieces are ranked within their class by distributed prefix counts over blocks, whose number grows with
the input, and the rank decides the sequence.

Null and empty texts are the single end token. Copies and ties are ranked by doc_id, start and
checksum. Repeated rows are packed each. An empty table packs nothing. Extra columns aren't read.

Ids are those of the tokenizers library for the given vocabulary file; tiktoken, which is four
times as fast, is fed the same vocabulary and merges (a test compares both). Texts whose runs of white space are too long
for its pattern (about a million characters) are left to the tokenizers library itself.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mzloom.llm.common import materialise

LENGTH = 2048
END = 1
GAP = 0.002
#: Pieces of a class are dealt to blocks for ranking: about this many pieces a block, and so many blocks at least.
BLOCK_ROWS, BLOCKS = 100_000, 64


def sizes(length: int = LENGTH) -> list[int]:
    """Upper bounds of the length classes: every length up to 64, then steps of 8."""
    return [*range(1, min(64, length) + 1), *range(72, length + 1, 8)]


# --- tokens -----------------------------------------------------------------------------------


def _byte_of() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow 255."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in keep}
    rest = [b for b in range(256) if b not in set(keep)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """A tiktoken encoding with the vocabulary and special tokens of a byte-level tokenizers file."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def library(path: str):
    """The tokenizers library's own encoder."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: str | None, path: str, end: int = END) -> np.ndarray:
    try:
        ids = encoder(path).encode(text, allowed_special="all") if text else []
    except ValueError:  # the pattern's backtracking has run out of stack
        ids = library(path).encode(text, add_special_tokens=False).ids
    return np.array([*ids, end], dtype="<u4")


def pieces(docs: DataFrame, path: str, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids): full sequences, then the remainder."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * keep_ids

    def run(batches):
        for b in batches:
            rows: list[list] = [[] for _ in range(5 + keep_ids)]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = token_ids(text, path)
                for at in range(0, len(ids), length):
                    part = ids[at : at + length]
                    values = [doc, at, len(part), zlib.crc32(part.tobytes()), len(ids)] + [part.tolist()] * keep_ids
                    for r, v in zip(rows, values, strict=True):
                        r.append(v)
            types = [pa.int64()] * 5 + [pa.list_(pa.int64())] * keep_ids
            names = [f.split()[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


# --- patterns ---------------------------------------------------------------------------------


def knapsack(value: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: best total value and the counts that reach it."""
    use = np.flatnonzero(value > 1e-12)
    counts = np.zeros(len(value), np.int64)
    if len(use) == 0:
        return 0.0, counts
    use = use[np.argsort(size[use], kind="stable")]
    v, s = value[use], size[use]
    best = np.zeros(room + 1)
    pick = np.full(room + 1, -1)
    upto = np.searchsorted(s, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        k = upto[c]
        best[c] = best[c - 1]
        if k:
            t = best[c - s[:k]] + v[:k]
            j = int(t.argmax())
            if t[j] > best[c] + 1e-12:
                best[c], pick[c] = t[j], j
    c = room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[use[pick[c]]] += 1
            c -= int(s[pick[c]])
    return float(best[room]), counts


def column_generation(size: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP, rounds: int = 3000):
    """Patterns (columns) and their amounts for min sum(x), patterns @ x >= demand."""
    m = len(size)
    cols = np.diag(room // size).astype(float)
    inverse = np.diag(1.0 / np.diag(cols))
    cost = np.ones(m)
    x = inverse @ demand
    bound = float(size @ demand) / room  # no packing has fewer sequences than tokens fill
    for _ in range(rounds):
        if float(cost @ x) - bound <= gap * bound:
            break
        dual = cost @ inverse
        low = int(dual.argmin())
        if dual[low] < -1e-9:  # a surplus column helps
            new, c = -np.eye(m)[low], 0.0
        else:
            got, counts = knapsack(np.maximum(dual, 0), size, room)
            value = float(cost @ x)
            bound = max(bound, float(demand @ np.maximum(dual, 0)) / max(got, 1.0))
            if got <= 1 + 1e-9 or value - bound <= gap * value:
                break
            new, c = counts.astype(float), 1.0
        u = inverse @ new
        up = u > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, u, 1), np.inf)
        r = int(ratio.argmin())
        x = np.maximum(x - ratio[r] * u, 0)
        x[r] = ratio[r]
        inverse[r] /= u[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(u[others], inverse[r])
        cols[:, r], cost[r] = new, c
    real = cost > 0
    return cols[:, real].astype(np.int64), x[real]


def first_fit(size: np.ndarray, left: np.ndarray, room: int) -> dict[tuple[int, ...], int]:
    """First-fit decreasing over class counts: patterns and how often each is used."""
    left, used = left.copy(), {}
    order = np.argsort(-size, kind="stable")
    while left.any():
        counts, free = np.zeros(len(size), np.int64), room
        for k in order:
            if left[k] and size[k] <= free:
                n = min(int(left[k]), free // int(size[k]))
                counts[k] += n
                free -= n * int(size[k])
        times = int((left[counts > 0] // counts[counts > 0]).min())
        used[tuple(counts)] = used.get(tuple(counts), 0) + times
        left -= counts * times
    return used


def plan(histogram: dict[int, int], room: int = LENGTH) -> list[tuple[np.ndarray, int]]:
    """Rounded patterns [(count per class, times)] that take every remainder exactly once.

    ``histogram`` has the number of remainders per class size.
    """
    size = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[int(s)] for s in size], dtype=np.int64)
    if len(size) == 0:
        return []
    cols, x = column_generation(size, demand.astype(float), room)
    left, used = demand.copy(), {}
    for k in np.argsort(-x, kind="stable"):
        col = cols[:, k]
        have = col > 0
        times = min(int(np.floor(x[k] + 1e-7)), int((left[have] // col[have]).min()))
        if times > 0:
            used[tuple(col)] = used.get(tuple(col), 0) + times
            left -= col * times
    for p, t in first_fit(size, left, room).items():
        used[p] = used.get(p, 0) + t
    return [(np.array(p), t) for p, t in used.items()]


def _class_of(length: int = LENGTH):
    """Column: the class size of a remainder."""
    n = F.col("length")
    return F.when(n <= 64, n).otherwise(F.least(F.ceil(n / 8) * 8, F.lit(length))).cast("long")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (ids), sequence_id, offset."""
    spark: SparkSession = docs.sparkSession
    cut = materialise(pieces(docs, path or default_path(), length, keep_ids))
    cut = cut.withColumn("class", _class_of(length))
    # Blocks spread a class that holds most pieces; the rank within a block is made global below.
    blocks = max(BLOCKS, cut.count() // BLOCK_ROWS)
    cut = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)))
    counts = cut.groupBy("class", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("class").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    bases = materialise(counts.select("class", "block", "n", F.coalesce(before, F.lit(0)).alias("base")))
    totals = {r["class"]: r.n for r in bases.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # one row per class
    full = totals.pop(length, 0)
    spans: dict[int, list] = {length: [(0, full, 0, 1)]}
    order = sorted(totals)
    start_of = dict.fromkeys(order, 0)
    seq = full
    for counts_p, times in plan(totals, length):
        for k, a in zip(order, counts_p.tolist(), strict=True):
            if a:
                spans.setdefault(k, []).append((start_of[k], start_of[k] + a * times, seq, a))
                start_of[k] += a * times
        seq += times
    # Bounded by the number of classes and patterns, not by the input; a piece finds its span in its row.
    told = spark.createDataFrame(sorted(spans.items()), "class long, spans array<struct<rank_from:long,rank_to:long,first:long,each:long>>")
    ids = ["ids"] * keep_ids
    rank = F.row_number().over(W.partitionBy("class", "block").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = cut.withColumn("rank", rank).join(bases.drop("n"), ["class", "block"]).withColumn("rank", F.col("rank") + F.col("base"))
    span = F.get(F.filter("spans", lambda s: (F.col("rank") >= s["rank_from"]) & (F.col("rank") < s["rank_to"])), F.lit(0))
    dealt = ranked.join(F.broadcast(told), "class").withColumn("span", span).withColumn("sequence_id", F.expr("span.first + (rank - span.rank_from) div span.each"))
    order_in = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank").rowsBetween(W.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(order_in), F.lit(0).cast("long"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", *ids, "sequence_id", "offset"
    )
