"""SimHash near-duplicate detection with a generalised pigeonhole index.

Every text becomes a 64-bit fingerprint. Two fingerprints link when at most ``tau`` bits
differ. Bits are grouped so that correlated bits share a partition; dynamic programming
gives partition i a threshold t_i (-1: not probed) with sum(t_i + 1) = tau + 1, minimising
the estimated number of candidates and probes. If every probed partition differed in more than
t_i bits, more than tau bits would differ in all, so probing each partition for values within
t_i bits finds every link. Candidates are verified on all 64 bits.

Groups of equal fingerprints are reduced to one representative before any join. A bucket with
more than ``PAIR_LIMIT`` distinct fingerprints isn't paired: all fingerprints that probe it are linked to the
smallest one that agrees outside of ``tau`` masked bits, at most t of them in the partition. Two fingerprints that
the probe would pair agree under such a mask, so the same ones are connected, by rows linear in the bucket.

Null and empty texts have fingerprint zero and link like any other. Repeated rows share a
fingerprint. An empty table gives an empty result. Null doc_ids are kept and don't count for the
smallest id. Other columns of the input aren't read.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mzloom.llm.common import discard, materialise, row_key, slices
from mzloom.operators.components import connected_components

PAIR_LIMIT = 1500
SAMPLE = 10_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of XXH64 (seed 42) over word shingles, repeats included."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(b" ".join(words), 42)]
    else:
        hashes = [digest(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(width)))]
    return majority(np.array(hashes, dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes ``h``."""
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    ones = (2 * counts.ravel() > len(h)).astype(np.uint8)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def bit_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """Split the 64 bits into m groups of near-equal size, each grown from the most correlated bits."""
    free = list(range(64))
    if len(sample) > 1:
        bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
        bits -= bits.mean(0)
        sd = bits.std(0)
        corr = np.abs(bits.T @ bits / len(bits)) / np.maximum(np.outer(sd, sd), 1e-9)
        np.fill_diagonal(corr, 0)
    else:
        corr = np.zeros((64, 64))
    groups = []
    for k in range(m):
        size = len(free) // (m - k)
        if k == m - 1:
            groups.append(free)
            break
        group = [free[int(np.argmax(corr[np.ix_(free, free)].sum(0)))]]
        free.remove(group[0])
        while len(group) < size:
            best = free[int(np.argmax(corr[np.ix_(group, free)].mean(0)))]
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _collisions(values: np.ndarray, width: int, radius: int) -> float:
    """Chance that two fingerprints lie within ``radius`` in this partition, from a sample."""
    n = len(values)
    ball = sum(math.comb(width, r) for r in range(radius + 1))
    floor = ball / 2.0**width
    if n < 2:
        return floor
    c = np.unique(values, return_counts=True)[1].astype(float)
    same = float((c * (c - 1)).sum()) / (n * (n - 1))
    return max(floor, same * (1 + radius))


def plan(sample: np.ndarray, total: int, tau: int, most: int = 4) -> list[tuple[int, int]]:
    """Masks and thresholds [(mask, t)] of least estimated cost over 1 to ``most`` partitions."""
    total = max(total, 2)  # else all plans would cost the same
    best = None
    for m in range(1, most + 1):
        groups = bit_groups(sample, m)
        table = {0: (0.0, [])}
        for g in groups:
            mask = _mask(g)
            values = sample & np.uint64(mask)
            nxt: dict = {}
            for used, (cost, chosen) in table.items():
                for t in range(-1, tau - used + 1):
                    if t > len(g):
                        continue
                    probes = sum(math.comb(len(g), r) for r in range(t + 1))
                    more = probes * total * 4.0 + (total**2 / 2 * _collisions(values, len(g), t) if t >= 0 else 0)
                    key = used + t + 1
                    if key <= tau + 1 and (key not in nxt or cost + more < nxt[key][0]):
                        nxt[key] = (cost + more, chosen + ([(mask, t)] if t >= 0 else []))
            table = nxt
        if tau + 1 in table and (best is None or table[tau + 1][0] < best[0]):
            best = table[tau + 1]
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _flips(mask: int, t: int) -> list[int]:
    bits = [b for b in range(64) if mask >> b & 1]
    return [_signed(_mask(c)) for r in range(t + 1) for c in combinations(bits, r)]


def _crowd_masks(mask: int, t: int, tau: int) -> list[int]:
    """Masks that leave out ``tau`` bits, at most ``t`` of them within the partition."""
    inside, free = [b for b in range(64) if mask >> b & 1], [b for b in range(64) if not mask >> b & 1]
    most = min(tau, 64)
    out = []
    for k in range(min(t, len(inside)) + 1):
        # A smaller choice is within a larger one, unless no bits are left to choose.
        n = min(most - k, len(free))
        if n == most - k or k == min(t, len(inside)):
            out += [_signed(~_mask(x + y) & (1 << 64) - 1) for x in combinations(inside, k) for y in combinations(free, n)]
    return out


def _bucket_links(distinct: DataFrame, mask: int, t: int, tau: int) -> DataFrame:
    """Links (a > b) between distinct fingerprints that this partition's probe finds."""
    base = distinct.select("fp", F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
    large = base.groupBy("key").count().where(F.col("count") > PAIR_LIMIT).select("key")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= tau
    build = base.select("key", F.col("fp").alias("other"))
    probe = base
    if t > 0:
        probe = base.select("fp", F.explode(F.array(*[F.lit(x) for x in _flips(mask, t)])).alias("flip"))
        probe = probe.select("fp", F.col("fp").bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.col("flip")).alias("key"))
    crowded = not large.isEmpty()
    small = probe.join(large, "key", "left_anti") if crowded else probe
    pairs = small.join(build, "key").where((F.col("fp") > F.col("other")) & near).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    if not crowded:
        return pairs
    crowd = probe.join(large, "key", "left_semi").select("fp").distinct()
    crowd = crowd.select("fp", F.explode(F.array(*[F.lit(x) for x in _crowd_masks(mask, t, tau)])).alias("m"))
    crowd = crowd.select("fp", "m", F.col("fp").bitwiseAND(F.col("m")).alias("v"))
    least = crowd.groupBy("m", "v").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = crowd.join(least, ["m", "v"]).where("fp > b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.unionByName(stars)


def links(distinct: DataFrame, tau: int = 2, sample: int = SAMPLE) -> DataFrame:
    """All links, or within crowded buckets a set that connects the same fingerprints: a > b."""
    total = distinct.count()
    if total < 2:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    rows = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    values = np.array([r.fp for r in rows], dtype=np.int64).view(np.uint64)
    out = None
    for mask, t in plan(values, total, tau):
        found = _bucket_links(distinct, mask, t, tau)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def group(fps: DataFrame, tau: int) -> DataFrame:
    """(fp, n, component_id) of every distinct fingerprint of ``fps`` (doc_id, fp)."""
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    member = connected_components(links(distinct, tau)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    member = member.join(distinct.select("fp", "least"), "fp")
    roots = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(roots, "root").select("fp", "component_id")
    named = distinct.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return materialise(named, distinct)


def spread(rows: DataFrame, named: DataFrame, key: str = "fp") -> DataFrame:
    """``rows`` with the columns of ``named`` (``key``, n, others) for its key, whatever share of the rows one key holds."""
    total = rows.count()
    others = [c for c in named.columns if c not in (key, "n")]
    # At most 200 keys can each hold more than a 200th of the rows: small enough to broadcast.
    hot = named.where(F.col("n") * 200 > total).drop("n")
    common = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(named.drop("n"), key)
    return common.unionByName(rest).select(*rows.columns, *others)


def near_duplicates(docs: DataFrame, tau: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable through links, itself included."""
    fps = materialise(fingerprints(docs, width))
    return spread(fps, group(fps, tau))


# --- verified near copies ---------------------------------------------------------------------


def shingle_hashes(text: str | None, width: int = 5) -> list[int]:
    """Distinct hashes of all word shingles of a whole text (fewer words: of the whole sequence)."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if text else []
    parts = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
    return sorted(_signed(xxhash.xxh64_intdigest(x)) for x in parts)


#: Bits of a parity bitmap: it rules pairs out while their sets have fewer than about 4.5 x BITMAP elements together.
BITMAP = 1024
#: Counters of the table by which common shingles are put last.
COUNTERS = 1 << 18


def _shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.array(shingle_hashes(text, shingle), dtype=np.int64).view(np.uint64)


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(8)).astype(np.int64) & COUNTERS - 1


def _parity(h: np.ndarray) -> np.ndarray:
    """BITMAP parity bits of a set: two bitmaps differ in no more bits than their sets in elements."""
    odd = np.bincount((h & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _frequencies(docs: DataFrame, shingle: int) -> np.ndarray:
    """Texts per counter of their shingles, summed over all of ``docs``: a task hands on its counters that aren't zero."""

    def run(batches):
        out = np.zeros(COUNTERS, np.int64)
        for b in slices(batches):
            for t in b.column("text").to_pylist():
                np.add.at(out, _counter(_shingle_set(t, shingle)), 1)
        hit = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(out[hit])], names=["counter", "n"])

    found = np.zeros(COUNTERS, np.int64)
    # COUNTERS rows at most, summed map-side per task and by counter in the shuffle.
    sums = docs.select("text").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    found[got.column("counter").to_numpy()] = got.column("n").to_numpy()
    return found


def shingle_sets(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """row (``row_key``), set (128-bit digest of the shingles), fp (their SimHash), size, b0 to b15 (parity bitmap) and prefix.

    The prefix holds the rarest |s| - ceil(similarity |s|) + 1 shingles. Sets of Jaccard similarity ``similarity``
    share that part of either, so their prefixes meet. Any fixed order will do; the rarest first give few candidates.
    """
    common = _frequencies(docs, shingle)
    words = BITMAP // 64
    names = ["row", "set", "fp", "size", *[f"b{i}" for i in range(words)], "prefix"]

    def run(batches):
        import xxhash

        for b in slices(batches):
            digest, fp, size, bits, prefix = [], [], [], [], []
            for t in b.column("text").to_pylist():
                h = _shingle_set(t, shingle)
                k = len(h) - math.ceil(similarity * len(h) - 1e-6) + 1
                prefix.append(h[np.lexsort((h, common[_counter(h)]))[:k]].view(np.int64))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                fp.append(majority(h))
                size.append(len(h))
                bits.append(_parity(h))
            bits = np.array(bits, np.int64).reshape(-1, words)
            columns = [b.column("row"), pa.array(digest, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(size, pa.int32())]
            columns += [pa.array(bits[:, i]) for i in range(words)] + [pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "row struct<id:long,t:long>, set binary, fp long, size int, " + ", ".join(f"b{i} long" for i in range(words)) + ", prefix array<long>"
    return docs.select(row_key().alias("row"), "text").mapInArrow(run, schema)


def _similar(docs: DataFrame, heads: DataFrame, pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Those of ``pairs`` (x, y: ids of ``heads``) whose whole texts share enough shingles."""
    wanted = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct()
    wanted = wanted.join(heads.select("id", "row"), "id")

    def hashes(batches):
        seen: set[int] = set()
        for t in slices(batches):
            ids = t.column("id").to_pylist()
            new = [k for k, i in enumerate(ids) if not (i in seen or seen.add(i))]
            t = t.take(pa.array(new, pa.int64()))
            found = [_shingle_set(x, shingle).view(np.int64) for x in t.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column("id"), pa.array(found, pa.list_(pa.int64()))], names=["id", "s"])

    # Merging puts repeated rows side by side, so that each task hands on one of them.
    texts = docs.select(row_key().alias("row"), "text").join(wanted.hint("merge"), "row").select("id", "text")
    sets = materialise(texts.mapInArrow(hashes, "id long, s array<long>"))
    both = pairs.join(sets.select(F.col("id").alias("x"), F.col("s").alias("sx")), "x").join(sets.select(F.col("id").alias("y"), F.col("s").alias("sy")), "y")
    shared = F.size(F.array_intersect("sx", "sy"))
    return materialise(both.where(shared >= similarity * (F.size("sx") + F.size("sy") - shared) - 1e-6).select("x", "y"), sets)


def _may_match(a: str, b: str, similarity: float):
    """False only for pairs whose bitmaps or sizes rule ``similarity`` out."""
    both = F.col(f"{a}.size") + F.col(f"{b}.size")
    differ = sum((F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}"))) for i in range(BITMAP // 64)), F.lit(0))
    sizes = F.least(f"{a}.size", f"{b}.size") + 1e-6 >= similarity * F.greatest(f"{a}.size", f"{b}.size")
    return sizes & (differ <= both * (1 - similarity) / (1 + similarity) + 1e-6)


def _pair(x, y):
    return F.least(x, y).alias("x"), F.greatest(x, y).alias("y")


def _fingerprint_pairs(heads: DataFrame, tau: int) -> DataFrame:
    """Pairs of sets whose SimHashes link, one for each linked pair of fingerprints, and stars of sets with the same one."""
    first = materialise(heads.groupBy("fp").agg(F.min("id").alias("least")))
    same = heads.select("id", "fp").join(first, "fp").where("id <> least").select(*_pair("id", "least"))
    far = links(first, tau).join(first.select(F.col("fp").alias("a"), F.col("least").alias("one")), "a").join(first.select(F.col("fp").alias("b"), F.col("least").alias("other")), "b")
    return same.unionByName(far.select(*_pair("one", "other")))


def _bounded_pairs(pairs: DataFrame, heads: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs that sizes and bitmaps don't rule out."""
    info = heads.select("id", "size", *[f"b{i}" for i in range(BITMAP // 64)])
    j = pairs.distinct().alias("k").join(info.alias("p"), F.col("k.x") == F.col("p.id")).join(info.alias("q"), F.col("k.y") == F.col("q.id"))
    return materialise(j.where(_may_match("p", "q", similarity)).select("k.x", "k.y"))


#: Sets of an open bucket that are compared with the whole bucket in one task.
SALT_ROWS = 1000
#: Open buckets of a set, its smallest, that its rows list.
LISTED = 64


def _open_pairs(members: DataFrame, comp: DataFrame, heads: DataFrame, similarity: float) -> DataFrame:
    """All pairs of a bucket's sets in different components; crowded buckets are dealt to several tasks."""
    m = materialise(members.select("h", "id").join(comp, F.col("id") == F.col("node"), "left").select("h", "id", F.coalesce("component", "id").alias("comp")))
    mark = lambda k: F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"mark{k}")
    open_ = m.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), mark(0), mark(1)).where("lo < hi")
    # Groups of copies share many shingles: buckets of the same sets count once.
    once = open_.groupBy("n", "mark0", "mark1").agg(F.min("h").alias("h")).select("h", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))
    m = materialise(m.join(once, "h"), m)
    # Near copies share many buckets: a pair is made in the first one that both sets list, or wherever they meet if their lists have none in common.
    listed = m.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("h")), 1, LISTED).alias("listed"))
    m = materialise(m.join(listed, "id").join(heads.select("id", "size", *[f"b{i}" for i in range(BITMAP // 64)]), "id"), m)
    first = F.coalesce(F.array_min(F.array_intersect("p.listed", "q.listed")), F.col("p.h")) == F.col("p.h")
    p = m.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    q = m.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    on = (F.col("p.h") == F.col("q.h")) & (F.col("p.salt") == F.col("q.salt")) & (F.col("p.id") < F.col("q.id")) & (F.col("p.comp") != F.col("q.comp"))
    return materialise(p.alias("p").join(q.alias("q"), on & F.when(_may_match("p", "q", similarity), first)).select(*_pair("p.id", "q.id")).distinct(), m)


def similar_pairs(docs: DataFrame, heads: DataFrame, similarity: float, shingle: int, tau: int) -> DataFrame:
    """(x, y) that connect all sets of ``similarity`` or more, as all such pairs would: none is missed.

    First come the pairs that SimHash finds, and of the sets that share a shingle of their prefixes each with the
    first and the last of them; then all pairs of a prefix bucket whose components still differ. A set that has been
    linked stays a candidate for the others. Every pair is verified on whole texts.
    """
    held = heads.select("id", F.explode("prefix").alias("h"))
    buckets = held.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    members = materialise(held.join(buckets, "h"))
    stars = members.select("id", F.explode(F.array("lo", "hi")).alias("hub")).where("id <> hub").select(*_pair("id", "hub"))
    pairs = _bounded_pairs(_fingerprint_pairs(heads, tau).unionByName(stars), heads, similarity)
    first = _similar(docs, heads, pairs, similarity, shingle)
    comp = materialise(connected_components(first.select(F.col("x").alias("a"), F.col("y").alias("b"))), pairs)
    pairs = _open_pairs(members, comp, heads, similarity)
    discard(members, comp)
    rest = _similar(docs, heads, pairs, similarity, shingle)
    discard(pairs)
    return first.unionByName(rest)


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, tau: int = 3) -> DataFrame:
    """row (``row_key``), component_id (least doc_id of its group), kept (the first row of its group) for every row.

    Two texts are near copies if the Jaccard similarity of their ``shingle``-word shingles is ``similarity`` or
    more, or if a chain of such pairs joins them. SimHashes within ``tau`` bits give the first candidates; an exact
    prefix join gives those that are farther apart in bits. Each is verified on whole texts: no pair is missed and
    none is merged unverified. Texts of equal shingles are reduced to the first before. Rows without doc_id come
    last in their group; repeated rows have the same key and are kept or not together.
    """
    sets = materialise(shingle_sets(docs, similarity, shingle))
    place = F.struct(F.col("row.id").isNull().alias("last"), F.col("row.id").alias("id"), F.col("row.t").alias("t"))
    same = [c for c in sets.columns if c not in ("row", "set")]
    heads = sets.groupBy("set").agg(F.min(place).alias("first"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in same])
    # The numbers are fixed by writing them: a set is one long from here on.
    heads = materialise(heads.withColumn("row", F.struct("first.id", "first.t")).withColumn("id", F.monotonically_increasing_id()))
    rows = materialise(sets.select("row", "set"), sets)
    good = similar_pairs(docs, heads, similarity, shingle, tau)
    comp = connected_components(good.select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = materialise(heads.select("set", "n", "first", "id").join(comp, F.col("id") == F.col("node"), "left").select("set", "n", "first", F.coalesce("component", "id").alias("comp")), heads)
    best = named.groupBy("comp").agg(F.min("first").alias("best"))
    named = materialise(named.join(best, "comp").select("set", "n", F.struct("best.id", "best.t").alias("best")), named)
    out = spread(rows, named, "set")
    return out.select("row", F.col("best.id").alias("component_id"), (F.col("row") == F.col("best")).alias("kept"))
