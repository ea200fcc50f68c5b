"""Benchmark decontamination by latent semantic retrieval.

Texts become TF-IDF passages of ``WIDTH`` words (every ``STRIDE`` words) over hashed terms. Document
frequencies are counted over all documents. A randomised singular value decomposition, computed by
the executors in blocks, maps passages to ``RANK`` whitened latent coordinates; it's fitted on the
benchmark and all passages of all distinct texts, and every passage of every document is scored. The subspace
that its pass over the texts starts from comes from the benchmark and ``START_DOCS`` texts (chosen by a hash of the text). A passage is a candidate for an item if their latent
cosine reaches ``COSINE`` and it shares ``WEIGHT`` of an item passage's idf weight. A candidate counts when the longest common subsequence of words covers
``LCS`` of the item, or ``LCS_ANSWER`` of it and the item's answer (its last sentence) as well.

Null and empty texts match nothing; items without words are ignored. Repeated rows are reported each.
Every matching item of a document is reported once, with its best passage; ties go to the first.
An empty table gives an empty result. Extra columns are ignored. Items are searched for in blocks of about
``ITEMS``, each of which is sent to the executors; a larger benchmark takes more passes over the texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mzloom.llm.common import discard, materialise, one_thread, release_memory, slices

WIDTH, STRIDE = 32, 16
TERMS = 1 << 14
RANK, OVER = 96, 8
COSINE = 0.35
#: A candidate must share this part of the item passage's idf weight before subsequences are computed.
WEIGHT = 0.3
#: Words projected at once, and words whose vectors fit the processor's cache.
AT_ONCE = 1 << 15
IN_CACHE = 1 << 12
#: Places of a term in as many words beyond which it is added up by a matrix.
OFTEN = 16
LCS, LCS_ANSWER, ANSWER = 0.7, 0.55, 0.8
START_DOCS = 1500
#: Tasks of a pass, and bytes of term ids beyond which there are more of them: each gives a whole matrix back.
TASKS, TASK_BYTES = 8, 16 << 20
ITEMS = 8192
#: Cosines computed at once, and blocks in which partial matrices are added up.
COSINES, BLOCKS = 1 << 23, 512
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_PLAIN).split() if text else []


def term_ids(words: list[bytes]) -> np.ndarray:
    crc = zlib.crc32
    return np.array([crc(w) for w in words], dtype=np.uint32) & np.uint32(TERMS - 1)


def encoded(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds k, the hash of every row's ``text``, and ids, the terms of its words, two bytes each."""
    texts = texts.withColumn("k", F.xxhash64(text))
    schema = StructType([*texts.schema, *StructType.fromDDL("ids binary")])

    def run(batches):
        for b in slices(batches):
            ids = [term_ids(words_of(t)).astype("<u2").tobytes() for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], names=schema.names)

    return texts.mapInArrow(run, schema)


def _ids(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in b.column("ids").to_pylist()]


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows (ids) and rows per hashed term."""

    def run(batches):
        n, df = 0, np.zeros(TERMS, np.int64)
        for b in batches:
            for ids in _ids(b):
                n += 1
                df[np.unique(ids)] += 1
        hit = np.flatnonzero(df)
        terms, counts = np.append(hit, -1), np.append(df[hit], n)
        yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int64)), pa.array(counts)], names=["term", "n"])

    got = rows.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(TERMS)
    for r in got:  # TERMS + 1 rows at most
        if r.term >= 0:
            df[r.term] = r.n
    return sum(r.n for r in got if r.term < 0), df


def starts(n: int) -> range:
    """Passage starts: the last passage may be short, none adds nothing new."""
    return range(0, max(n - WIDTH + STRIDE, 1), STRIDE) if n else range(0)


def project(texts: list[np.ndarray], table: np.ndarray):
    """Latent sums of every passage of several texts given as term ids.

    Yields (text number, passage start, vector, padded ids of the passage) as arrays, some texts at a
    time. ``table`` has a zero row last, for padding.
    """
    pad, steps = len(table) - 1, WIDTH // STRIDE
    held, owner, size = [], [], 0
    for k, ids in enumerate([*texts, None]):
        if ids is not None and len(ids):
            n = -(-len(ids) // STRIDE) * STRIDE
            held.append(np.append(ids, np.full(n - len(ids), pad, ids.dtype)))
            owner.append((k, n // STRIDE))
            size += n
        if held and (ids is None or size >= AT_ONCE):
            flat = np.concatenate([*held, np.full(WIDTH, pad, held[0].dtype)])
            count = np.array([c for _, c in owner])
            who = np.repeat([k for k, _ in owner], count)
            ends = np.cumsum(count)
            place = np.arange(ends[-1]) - np.repeat(ends - count, count)
            left = np.repeat(count, count) - place
            blocks = np.concatenate([np.einsum("bsr->br", table[flat[lo : lo + IN_CACHE]].reshape(-1, STRIDE, table.shape[1])) for lo in range(0, len(flat), IN_CACHE)])
            total = blocks[: ends[-1]].copy()
            for j in range(1, steps):
                more = left > j
                total[more] += blocks[j : ends[-1] + j][more]
            keep = (place == 0) | (left >= steps)
            i = np.flatnonzero(keep)
            window = flat[i[:, None] * STRIDE + np.arange(WIDTH)]
            window[np.arange(WIDTH)[None, :] >= left[i][:, None] * STRIDE] = pad
            yield who[i], place[i] * STRIDE, total[i], window
            held, owner, size = [], [], 0


def _omega(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(TERMS, RANK + OVER)).astype(np.float32)


def _add_rows(out: np.ndarray, terms: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds ``values[rows]`` to ``out[terms]``; ``terms`` are sorted. Rare terms are added up in rounds, frequent ones by a matrix of counts."""
    cuts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
    n = np.diff(np.append(cuts, len(terms)))
    most = np.argsort(-n, kind="stable")
    cuts, n = cuts[most], n[most]
    often = int((n > OFTEN).sum())
    total = np.empty((len(cuts), values.shape[1]), values.dtype)
    total[often:] = values[rows[cuts[often:]]]
    for k in range(1, OFTEN):
        end = int((n > k).sum())
        if end <= often:
            break
        total[often:end] += values[rows[cuts[often:end] + k]]
    if often:
        at = np.concatenate([rows[c : c + m] + k * len(values) for k, (c, m) in enumerate(zip(cuts[:often], n[:often], strict=True))])
        total[:often] = np.bincount(at, minlength=often * len(values)).reshape(often, -1).astype(values.dtype) @ values
    out[terms[cuts]] += total


def _add_passages(texts: list[np.ndarray], weighted: np.ndarray, squares: np.ndarray, out: np.ndarray) -> None:
    """Adds A'(A T) / idf of several texts' passages to ``out``; ``weighted`` is T times idf, ``squares`` idf squared, both with a zero row last."""
    pad, steps = len(weighted) - 1, WIDTH // STRIDE
    assert steps == 2  # a passage is a block of words and the next one
    count = np.array([-(-len(t) // STRIDE) for t in texts])
    flat = np.full(count.sum() * STRIDE, pad, np.uint16)
    for t, at in zip(texts, (np.cumsum(count) - count) * STRIDE, strict=True):
        flat[at : at + len(t)] = t
    flat = flat.reshape(-1, STRIDE)
    ends = np.cumsum(count) - 1
    more, first = np.ones(len(flat), bool), np.zeros(len(flat), bool)
    more[ends], first[ends - count + 1] = False, True
    sums = np.concatenate([np.einsum("bsr->br", weighted[flat[lo : lo + IN_CACHE // STRIDE]]) for lo in range(0, len(flat), IN_CACHE // STRIDE)])
    i, after = np.flatnonzero(more), np.flatnonzero(~first)
    window = np.full((len(flat), WIDTH), pad, np.uint16)
    window[:, :STRIDE], window[i, STRIDE:] = flat, flat[i + 1]
    window.sort(axis=1)
    # The square of a passage's length: a term that it holds n times counts n times n, once for each and twice for each pair.
    each = squares[window]
    length = each.sum(1, dtype=float)
    for gap in range(1, WIDTH):
        pairs = window[:, gap:] == window[:, :-gap]
        if not pairs.any():
            break
        length += 2 * np.einsum("br,br->b", pairs, each[:, gap:])
    total = sums.copy()
    total[i] += sums[i + 1]
    total *= ((more | first) / np.maximum(length, 1e-24))[:, None]  # a text's last block begins no passage, unless it is the only one
    both = total.copy()
    both[after] += total[after - 1]
    order = np.argsort(flat.ravel(), kind="stable")
    terms = flat.ravel()[order]
    order, terms = order[terms < pad], terms[terms < pad]
    _add_rows(out, terms, order // STRIDE, both)


def _product(texts: DataFrame, idf: np.ndarray, table: np.ndarray | int, tasks: int = TASKS) -> np.ndarray:
    """A'(A T) over the passages of all ``texts`` (ids), in one distributed pass of at most ``tasks`` tasks, each of which gives a matrix. Rows of A have unit length.

    Where T is random, its seed is given and the executors draw it, so nothing large is sent.
    """
    r = RANK + OVER

    def run(batches):
        one_thread()
        t_rows = _omega(table) if isinstance(table, int) else table
        weighted = np.vstack([t_rows * idf[:, None], np.zeros((1, r))]).astype(np.float32)
        squares, out, seen = np.append(idf * idf, 0.0).astype(np.float32), np.zeros((TERMS, r), np.float32), False
        held, size = [], 0
        for b in batches:
            for ids in _ids(b):
                for lo in range(0, max(len(ids) - STRIDE, 1), AT_ONCE):  # pieces that share a block have no passage in common
                    piece = ids[lo : lo + AT_ONCE + STRIDE]
                    if len(piece):
                        held.append(piece)
                        size += len(piece)
                    if size >= 2 * AT_ONCE:
                        _add_passages(held, weighted, squares, out)
                        held, size, seen = [], 0, True
        if held:
            _add_passages(held, weighted, squares, out)
        parts = np.split(out * idf[:, None], BLOCKS) if seen or held else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], names=["block", "data"])

    def add(key, rows):
        total = sum(np.frombuffer(d, np.float32).astype(float) for d in rows.column("data").to_pylist())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    parts = texts.select("ids").coalesce(tasks).mapInArrow(run, "block int, data binary").groupBy("block").applyInArrow(add, "block int, data binary").collect()
    return np.concatenate([np.frombuffer(p.data) for p in sorted(parts, key=lambda p: p.block)]).reshape(-1, r) if parts else np.zeros((TERMS, r))


def fit(rows: DataFrame, items: DataFrame, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(term table, idf) of the ``encoded`` texts ``rows``: a row of the table is a term's whitened latent vector times its idf.

    A'A of all passages is taken as Y (Q'Y)^-1 Y' with Y = A'A Q, so that one pass over all texts is enough (Nystrom); Q comes from a start of few texts.
    """
    rows = rows.select("k", "ids")
    n, df = document_frequencies(rows)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    asked = encoded(items.select("text")).select("k", "ids")
    known = rows.where("length(ids) > 0").distinct()
    least = rows.where("length(ids) > 0").select(F.xxhash64("k", F.lit(seed)).alias("place"), "k").distinct().orderBy("place", "k").limit(START_DOCS)
    few = rows.join(F.broadcast(least.select("k")), "k", "left_semi").distinct()
    few = materialise(few.unionByName(asked).repartition(TASKS))  # read twice
    q = np.linalg.qr(_product(few, idf, seed))[0].astype(np.float32)
    q = np.linalg.qr(_product(few, idf, q))[0].astype(np.float32)
    size = rows.agg(F.sum(F.length("ids"))).first()[0] or 0
    y = _product(known.unionByName(asked), idf, q, max(TASKS, size // TASK_BYTES))
    discard(few)
    inner = q.T @ y
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    held = value > 1e-9 * max(value.max(), 1e-12)
    half = (y @ vector[:, held]) / np.sqrt(value[held])  # half times its transpose is A'A
    terms, length, _ = np.linalg.svd(half, full_matrices=False)
    value = length[:RANK] ** 2
    scale = 1 / np.sqrt(np.maximum(value, 1e-3 * max(value.max(initial=0.0), 1e-12)))
    table = (terms[:, :RANK] * scale * idf[:, None]).astype(np.float32)
    del q, y, half, terms
    release_memory()
    return np.vstack([table, np.zeros((1, table.shape[1]), np.float32)]), idf


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def answer_of(text: str) -> list[bytes]:
    """Words of the last sentence or line that has any."""
    return next((w for s in reversed(_SENTENCE.split(text)) if (w := words_of(s))), [])


def find(docs: DataFrame, benchmark: DataFrame, *keep: str) -> DataFrame:
    """``keep`` (doc_id by default), item_id, lcs (share of the item), answer (share), start_word, n_words."""
    names = keep or ("doc_id",)
    texts = docs.select(*[F.col(c).cast("long").alias(c) if c == "doc_id" else c for c in names], F.col("text").alias("_text"))
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    n = items.count()
    if n:  # terms are looked up once, for the fit and for the search
        texts = materialise(encoded(texts, "_text"))
    table, idf = fit(texts, items) if n else (None, None)
    blocks = -(-n // ITEMS)
    found = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        got = _search(texts, [(r.item_id, words_of(r.text), answer_of(r.text)) for r in part if words_of(r.text)], table, idf)
        found = got if found is None else found.unionByName(got)
    return _search(encoded(texts, "_text"), [], None, None) if found is None else found


def _search(docs: DataFrame, items: list[tuple], table: np.ndarray | None, idf: np.ndarray | None) -> DataFrame:
    """The matches of one block of items (item_id, words, answer); ``docs`` ends with _text, k and ids."""
    kept = docs.schema.fields[:-3]
    schema = StructType([*kept, *StructType.fromDDL("item_id long, lcs double, answer double, start_word long, n_words long").fields])
    if not items:
        return docs.sparkSession.createDataFrame([], schema)
    owner, _, query, terms = map(np.concatenate, zip(*project([term_ids(w) for _, w, _ in items], table), strict=True))
    query = np.ascontiguousarray(_unit(query).T)
    weight = np.append(idf, 0)[terms]
    for r in range(1, WIDTH):  # a repeated term of a passage counts once
        weight[:, r][(terms[:, :r] == terms[:, r : r + 1]).any(1)] = 0
    need = WEIGHT * weight.sum(1)
    at_once = max(16, COSINES // query.shape[1])

    def candidates(ids):
        """(text, item, start) for passages close to one of the item and sharing enough of its weight."""
        for who, at, v, window in project(ids, table):
            v = _unit(v)
            for lo in range(0, len(v), at_once):
                p, j = np.nonzero(v[lo : lo + at_once] @ query >= COSINE)
                p += lo
                for c in range(0, len(p), 2048):
                    pp, jj = p[c : c + 2048], j[c : c + 2048]
                    shared = (window[pp][:, :, None] == terms[jj][:, None, :]).any(1)
                    good = (shared * weight[jj]).sum(1) >= need[jj]
                    yield from zip(who[pp[good]].tolist(), owner[jj[good]].tolist(), at[pp[good]].tolist(), strict=True)

    def matches(texts, ids):
        """(text number, item id, its item id and details) of every match."""
        places: dict = {}
        for k, item, start in candidates(ids):
            places.setdefault((k, item), set()).add(start)
        said_by: dict = {}
        for (k, item), at in sorted(places.items()):
            name, said, answer = items[item]
            if k not in said_by:
                said_by = {k: words_of(texts[k].as_py())}
            words, best = said_by[k], None
            have = Counter(said)
            for start in sorted(at):
                lo, hi = max(0, start - len(said)), start + WIDTH + len(said)
                part = words[lo:hi]
                if sum((have & Counter(part)).values()) < LCS_ANSWER * len(said):
                    continue
                share = lcs(said, part) / len(said)
                told = lcs(answer, part) / len(answer) if answer else 0.0
                if share >= LCS or (share >= LCS_ANSWER and told >= ANSWER):
                    if best is None or share > best[0]:
                        best = (share, told, lo, len(part))
                    if share == 1:
                        break
            if best:
                yield (k, name, *best)

    def run(batches):
        one_thread()
        types = [pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        for b in slices(batches, 256):
            got = list(matches(b.column("_text"), _ids(b)))
            who = pa.array([k for k, *_ in got], pa.int64())
            columns = list(zip(*[m for _, *m in got], strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(who) for i in range(len(kept))], *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=schema.names)

    return docs.mapInArrow(run, schema)
