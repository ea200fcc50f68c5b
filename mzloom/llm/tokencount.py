"""Token counts of whole texts by a two-tier lookup on the map side.

A text falls into pre-tokens at places that no piece of the vocabulary crosses, so its number of tokens is the
sum of those of its pre-tokens. One pass over all texts finds the frequent pre-tokens: every task keeps a
bounded heavy-hitter sketch (Misra-Gries: what is trimmed away is taken off what stays), sketches are merged
in a tree, and no pre-token is ever shuffled. The lengths of the at most ``FREQUENT`` winners, none longer than ``LONGEST``
characters, are broadcast as a table of at most 4.2 MB. A second pass sums lengths up: pre-tokens outside the table are
encoded once a worker and remembered in a cache of ``CACHE`` entries, which starts anew when it is full; longer pre-tokens are
encoded each time. Tables and caches save time only: counts are exact whatever they hold.

Model files must keep texts as they are but for white space (no normalisation), which is checked, as is that
no piece crosses from another character to a word mark. Control symbols inside texts are ordinary text, which is the library's default.

Null and empty texts have no tokens. Texts may be of any length. Repeated rows give a row each; doc_id may be
null and is not used. An empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mzloom.llm.common import slices

#: Entries of the broadcast table, of a task's sketch when it is sent, and of a sketch while it grows.
FREQUENT, SKETCH, GROWING = 32_768, 8_192, 131_072
#: Pre-tokens of more characters are neither counted nor remembered.
LONGEST = 32
CACHE = 500_000
#: Longer texts (characters) are split piece by piece; about so many pre-tokens are looked up at once.
LONG_TEXT = 200_000
MARK = "▁"
PROBE = "Ａﬁ  x "


class Pretokens:
    """Splits texts into pre-tokens for a sentencepiece model, and gives the number of tokens of one."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        if m.normalize(PROBE) != (MARK + PROBE).replace(" ", MARK):
            raise ValueError(f"{path} changes texts beyond white space")
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        joined = [p for p in pieces if len(p) > 1]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in joined):
            raise ValueError(f"{path} has pieces that go on past a word")
        inside = set("".join(joined))
        # ASCII characters that no longer piece holds stand alone: each is one token, as a piece or as a byte.
        self.alone = [c for c in map(chr, range(128)) if c not in inside and c != " " and len(m.encode(c)) == 2]
        single = "".join(map(re.escape, self.alone))
        self.pattern = re.compile(rf"[ {MARK}]*[^ {MARK}{single}]+|[ {MARK}]+" + rf"|[{single}]+" * bool(single))
        self._alone = set(self.alone)

    def split(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a non-empty text, the mark that every text begins with included; of a long text in several lists."""
        if len(text) <= LONG_TEXT:
            yield self.pattern.findall(" " + text)
        else:
            found = self.pattern.finditer(" " + text)
            while part := [m[0] for m in islice(found, LONG_TEXT)]:
                yield part

    def lengths(self, tokens: list[str]) -> list[int]:
        """Numbers of tokens of pre-tokens."""
        out = [len(t) if t[0] in self._alone else 1 for t in tokens]
        # Encoding puts a mark in front: it stands for a pre-token's own first blank, or is told apart by a character that stands alone.
        marked = [k for k, t in enumerate(tokens) if t[0] in (" ", MARK) and len(t) > 1]
        bare = [k for k, t in enumerate(tokens) if t[0] not in self._alone and t[0] not in (" ", MARK)]
        got = self.model.encode([tokens[k][1:] for k in marked] + [self.alone[0] + tokens[k] for k in bare], num_threads=1) if marked or bare else []
        for at, k in enumerate([*marked, *bare]):
            out[k] = len(got[at]) - 2 * (at >= len(marked))
        return out


@lru_cache(maxsize=2)
def pretokens(path: str) -> Pretokens:
    return Pretokens(path)


class Lengths:
    """Numbers of tokens by pre-token: the broadcast table, and the worker's cache of what it lacks."""

    def __init__(self, tokens: list[str], lengths: bytes, path: str):
        self.table, self.encode = dict(zip(tokens, lengths, strict=True)), pretokens(path).lengths
        self.live = dict(self.table)

    def total(self, tokens: list[list[str]]) -> list[int]:
        """The sum of every list; what neither table nor cache holds is encoded once for all lists."""
        if len(self.live) > len(self.table) + CACHE:
            self.live = dict(self.table)
        new = list(set().union(*tokens).difference(self.live))
        self.live.update(zip(new, self.encode(new), strict=True))
        out = [sum(map(self.live.__getitem__, t)) for t in tokens]
        for t in new:
            if len(t) > LONGEST:
                del self.live[t]
        return out


_workers: dict[tuple[str, int], Lengths] = {}


def _lengths(path: str, table) -> Lengths:
    """One table a worker process, kept between tasks."""
    names, lengths = table.value
    key = (path, hash((names, lengths)))
    if key not in _workers:
        _workers.clear()
        _workers[key] = Lengths(names.split("\n") if lengths else [], lengths, path)
    return _workers[key]


def trim(counts: dict[str, int], keep: int) -> Counter:
    """At most ``keep`` entries: the largest count that must go is taken off all."""
    if len(counts) <= keep:
        return Counter(counts)
    values = np.fromiter(counts.values(), np.int64, len(counts))
    off = int(np.partition(values, len(values) - keep - 1)[len(values) - keep - 1])
    return Counter({t: n - off for t, n in counts.items() if n > off})


def frequent(docs: DataFrame, path: str, most: int = FREQUENT) -> dict[str, int]:
    """At most ``most`` pre-tokens of all texts, with lower bounds of how often they occur."""

    def sketch(batches):
        split, counts = pretokens(path).split, Counter()
        for b in slices(batches, 64):
            for text in b.column("text").to_pylist():
                for part in split(text) if text else ():
                    counts.update([t for t in part if len(t) <= LONGEST])
                    if len(counts) > GROWING:
                        counts = trim(counts, SKETCH)
        counts = trim({t: n for t, n in counts.items() if "\n" not in t}, SKETCH)
        yield pa.RecordBatch.from_arrays([pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))], names=["tokens", "counts"])

    def merge(a: Counter, b) -> Counter:
        a.update(b if isinstance(b, Counter) else dict(zip(b.tokens, b.counts, strict=True)))
        return trim(a, most)

    # A tree of merges: at most SKETCH entries leave a task, at most ``most`` reach the driver.
    return dict(docs.select("text").mapInArrow(sketch, "tokens array<string>, counts array<long>").rdd.treeAggregate(Counter(), merge, merge, depth=3))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, keep: tuple[str, ...] = ("doc_id",), most: int = FREQUENT) -> DataFrame:
    """Columns ``keep`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every text."""
    sc = docs.sparkSession.sparkContext
    found = frequent(docs, path, most)
    known = {t: n for t, n in zip(found, pretokens(path).lengths(list(found)), strict=True) if n < 256}
    table = sc.broadcast(("\n".join(known), bytes(known.values())))
    rows = docs.select(*keep, "text")
    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes[:-1]) + ", n_bytes long, n_tokens long, over_limit boolean"

    def run(batches):
        split, lengths = pretokens(path).split, _lengths(path, table)
        for b in slices(batches, 64):
            n, size = [0] * b.num_rows, [0] * b.num_rows
            at, held, room = [], [], LONG_TEXT
            for k, text in enumerate(b.column("text").to_pylist()):
                size[k] = len(text.encode()) if text else 0
                for part in split(text) if text else ():
                    at.append(k)
                    held.append(part)
                    room -= len(part)
                    if room < 0:
                        _add(n, at, lengths.total(held))
                        at, held, room = [], [], LONG_TEXT
            _add(n, at, lengths.total(held))
            columns = [b.column(k) for k in range(len(keep))]
            columns += [pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, schema)


def _add(sums: list[int], at: list[int], values: list[int]) -> None:
    for k, v in zip(at, values, strict=True):
        sums[k] += v


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
