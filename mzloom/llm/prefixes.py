"""The trie of conversation prefixes.

Conversations that share their first turns share work: a prefix is read once, whoever goes on from it. Every
conversation is rebuilt (see ``rebuilt``), each of its prefixes gets a chained digest, SHA-256 of the digest before
it and of the turn, and (depth, digest) names a node of the trie. Digests of turns are made where the texts are; texts
themselves are never shuffled. A conversation's chain is computed by a stream over its sorted turns that holds one digest, so it may be
of any length.

Sums over subtrees: nodes with the same smallest member are a run, one below the other, since the smallest member of a node that goes
on stays the smallest. Runs are summed up first, then every run is exploded to all its ancestors, which
are the prefixes of that member above it. There are never more such rows than prefixes, however long a conversation is. Nodes
that many conversations share (the root above all) are pre-aggregated in every task; ids of members that end in
one node are joined in blocks first, and the blocks are hashed as a stream.

Turns are ordered by turn, null first; ties are ordered by role and the digest of their text. Null roles and
texts are empty. Repeated rows are turns of their own. Rows without a conv_id belong to no conversation and
are left out. A conversation may end up without turns; it is a member of the root only. An empty table gives
no node. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mzloom.llm.common import WORD, materialise, spread_lookup

FAMILY, MOST = 20, 4
#: Ids of conversations that end in one node are joined in blocks of so many consecutive numbers.
BLOCK = 8_192
ROOT = hashlib.sha256(b"").digest()
NODE = ["depth", "digest"]


def kept_turns(conv_id: int) -> int:
    """How many turns of its family's first conversation a conversation starts with."""
    return zlib.crc32(str(conv_id).encode()) % MOST


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, parent, words, last): all prefixes of every rebuilt conversation, the empty one included.

    Conversation c starts with the first crc32(c) % 4 turns of conversation c - c % 20 and goes on with its own after as
    many of them. A family (20 conversations) is one stream, its first conversation ahead, of which three turns are kept.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.sha2(text, 256).alias("said"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    # The length of the role keeps (role, text) apart from any other split of the same characters.
    turn = F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "said"), 256))
    family = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family")
    order = [F.col("family"), (F.col("conv_id") != F.col("family")).alias("later"), F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("said")]
    dealt = turns.select(family, "conv_id", "turn", "role", "said", "words", turn.alias("hash")).repartition("family").sortWithinPartitions(*order)

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True))
        out = _Rows()
        for _, same in groupby(rows, key=lambda r: r[0]):
            first: list[tuple[bytes, int]] = []
            for conv, own in groupby(same, key=lambda r: r[1]):
                out.start(conv)
                least, head = kept_turns(conv), conv == _family_of(conv)
                for h, words in first[:least]:
                    out.add(h, words)
                for at, (_, _, h, words) in enumerate(own):
                    if head and at < MOST - 1:
                        first.append((h, words))
                    if head or at >= least:
                        out.add(h, words)
                    if out.full:
                        yield out.take()
                out.end()
        yield out.take()

    return dealt.select("family", "conv_id", "hash", "words").mapInArrow(run, "conv_id long, depth long, digest binary, parent binary, words long, last boolean")


def _family_of(conv_id: int) -> int:
    """As in SQL: the remainder has the sign of the number."""
    return conv_id - (abs(conv_id) % FAMILY) * (1 if conv_id >= 0 else -1)


class _Rows:
    """Prefixes of one conversation after the other, given away in batches; the newest waits until it's known whether it's the last."""

    def __init__(self, size: int = 8_192):
        self.size, self.rows, self.open = size, [], None

    @property
    def full(self) -> bool:
        return len(self.rows) >= self.size

    def start(self, conv: int) -> None:
        self.open = (conv, 0, ROOT, None, 0)

    def add(self, turn: bytes, words: int) -> None:
        conv, depth, digest, _, _ = self.open
        self.rows.append((*self.open, False))
        self.open = (conv, depth + 1, hashlib.sha256(digest + turn).digest(), digest, words)

    def end(self) -> None:
        self.rows.append((*self.open, True))

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "depth", "digest", "parent", "words", "last"])


def _ends(prefixes: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256) of nodes in which conversations end: ids ascending, joined by commas.

    Blocks of ids are joined by an aggregation; a node's blocks are one stream, so no list of all ids is ever held.
    """
    block = F.floor(F.col("conv_id") / BLOCK).alias("block")
    ids = F.array_join(F.transform(F.array_sort(F.collect_set("conv_id")), lambda c: c.cast("string")), ",")
    blocks = prefixes.where("last").groupBy(*NODE, block).agg(ids.alias("ids"))

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        out = []
        for (depth, digest), same in groupby(rows, key=lambda r: r[:2]):
            h = hashlib.sha256(next(same)[2].encode())
            for _, _, ids in same:
                h.update(b"," + ids.encode())
            out.append((depth, digest, h.hexdigest()))
            if len(out) >= 8_192:
                yield _batch(out)
                out = []
        yield _batch(out)

    def _batch(out):
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.string()), strict=True)], names=[*NODE, "ends_sha256"])

    ordered = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block")
    return ordered.select(*NODE, "ids").mapInArrow(run, "depth long, digest binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prefixes = materialise(rebuilt(conversations))
    nodes = materialise(prefixes.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("words").alias("words")))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    told = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    told = materialise(told.withColumns({"leaf": leaf, "saved": saved}).withColumns(_run_sums()), nodes)
    # A run and what hangs below it within the run is known; now every run goes to all ancestors above its top.
    runs = told.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    above = prefixes.select("conv_id", *NODE).join(runs, "conv_id").where("depth < top")
    sums = above.groupBy(*NODE).agg(F.sum("leaf").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    tops = told.where("depth = top and depth > 0").select("conv_id", F.col("depth").alias("at"), (F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest"))
    parents = spread_lookup(tops, NODE, told.select(*NODE, F.col("conv_id").alias("parent_conv_id")), F.col("conv_id"))
    parents = parents.select("conv_id", F.col("at").alias("depth"), F.col("parent_conv_id").alias("upper"))
    out = told.join(sums, NODE, "left").join(_ends(prefixes), NODE, "left").join(parents, ["conv_id", "depth"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("upper")).alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("below_leaf") + F.coalesce("more_leaves", F.lit(0))).cast("long").alias("n_leaves"), (F.col("below_saved") + F.coalesce("more_saved", F.lit(0))).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def _run_sums() -> dict[str, Column]:
    """Sums from a node down to the end of its run, and the depth of the run's top; a run is as long as its conversation at most."""
    down = W.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    return {"below_leaf": F.sum("leaf").over(down), "below_saved": F.sum("saved").over(down), "top": F.min("depth").over(W.partitionBy("conv_id"))}
