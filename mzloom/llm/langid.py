"""Language identification by a bidirectional gated recurrent network over bytes.

Whole texts are cut into windows of ``WINDOW`` bytes (the last one is shorter). Within a window a
forward and a backward GRU read the bytes; a softmax over both states labels every position, and
a document's probabilities are the mean over all its positions. Trained in numpy by
backpropagation through time with Adam. The bounded sample: of at most ``PER_LANGUAGE`` whole texts of each
language, chosen by a hash of doc_id and text, at most ``SAMPLE`` / languages windows (16 at least), chosen by a hash
as well. Training goes through shuffled epochs, in which every window of the sample is read, those of rarer
languages more than once, until ``STEPS`` batches of ``BATCH`` windows are done and the epoch is over. All languages are learned.
States start anew in every window, in training as in use, so a text of any length is read in parallel.

Null texts and texts without a letter (Unicode categories L) get ``und`` and score 0, and so does every text
if nothing can be learned. Repeated rows are labelled alike and learned once; ties go to the alphabetically
first language. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from mzloom.llm.common import one_thread

WINDOW = 64
HIDDEN = 8
PER_LANGUAGE = 120
#: Windows that are learned from, batches at least, windows of a batch.
SAMPLE, STEPS, BATCH = 16_384, 160, 96
NAMES = ("E", "U", "b", "O", "c")


@dataclass
class Model:
    """E: byte to gate inputs (257, 6h); U: recurrent (2h, 6h), block-diagonal by direction; O, c: output."""

    languages: list[str]
    E: np.ndarray
    U: np.ndarray
    b: np.ndarray
    O: np.ndarray  # noqa: E741
    c: np.ndarray


def _mask(h: int) -> np.ndarray:
    """Which recurrent weights exist: forward units see forward units, backward see backward."""
    side = np.repeat([0, 1], h)
    return (side[:, None] == np.tile(side, 3)[None, :]).astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _states(m: Model, x: np.ndarray, keep: bool = False):
    """States for windows x (B, T) of bytes (256: padding). The columns of a step are
    [update, reset, candidate] by [forward at t, backward at T - 1 - t]."""
    B, T = x.shape
    h2 = m.U.shape[0]
    h = h2 // 2
    s = np.zeros((B, h2), np.float32)
    out = np.empty((T, B, h2), np.float32)
    back = x[:, ::-1]
    saved = []
    front_cols = np.concatenate([np.arange(h) + k * h2 for k in range(3)])
    table_f = np.zeros_like(m.E)
    table_f[:, front_cols] = (m.E + m.b)[:, front_cols]
    table_b = m.E + m.b
    table_b = table_b.copy()
    table_b[:, front_cols] = 0
    Ug, Uc = m.U[:, : 2 * h2], m.U[:, 2 * h2 :]
    for t in range(T):
        a = table_f[x[:, t]]
        a += table_b[back[:, t]]
        g = a[:, : 2 * h2]
        g += s @ Ug
        np.negative(g, out=g)
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        z, r = g[:, :h2], g[:, h2:]
        rs = r * s
        cand = np.tanh(a[:, 2 * h2 :] + rs @ Uc)
        new = s + z * (cand - s)
        if keep:
            saved.append((s, z, r, rs, cand))
        s = new
        out[t] = s
    both = np.empty_like(out)
    both[:, :, :h] = out[:, :, :h]
    both[:, :, h:] = out[::-1, :, h:]
    return both, saved


def _softmax(a):
    a = a - a.max(-1, keepdims=True)
    np.exp(a, out=a)
    return a / a.sum(-1, keepdims=True)


def position_probabilities(m: Model, x: np.ndarray) -> np.ndarray:
    """(T, B, languages): the label distribution of every position."""
    both, _ = _states(m, x)
    return _softmax(both @ m.O + m.c)


def _gradients(m: Model, x: np.ndarray, y: np.ndarray):
    both, saved = _states(m, x, keep=True)
    T, B, h2 = both.shape
    h = h2 // 2
    p = _softmax(both @ m.O + m.c)
    loss = -np.log(np.maximum(p[:, np.arange(B), y], 1e-9)).mean()
    d = p
    d[:, np.arange(B), y] -= 1
    d /= T * B
    flat = d.reshape(-1, d.shape[2])
    gO, gc = both.reshape(-1, h2).T @ flat, flat.sum(0)
    dboth = d @ m.O.T
    dout = np.empty_like(dboth)
    dout[:, :, :h] = dboth[:, :, :h]
    dout[:, :, h:] = dboth[::-1, :, h:]
    gU, gE = np.zeros_like(m.U), np.zeros_like(m.E)
    front = np.tile(np.arange(h2) < h, 3)
    Ug, Uc = m.U[:, : 2 * h2], m.U[:, 2 * h2 :]
    ds = np.zeros((B, h2), np.float32)
    back = x[:, ::-1]
    for t in range(T - 1, -1, -1):
        s, z, r, rs, cand = saved[t]
        ds = ds + dout[t]
        dcand = ds * z * (1 - cand**2)
        dz = ds * (cand - s) * z * (1 - z)
        drs = dcand @ Uc.T
        dr = drs * s * r * (1 - r)
        da = np.concatenate([dz, dr, dcand], 1)
        gU[:, : 2 * h2] += s.T @ da[:, : 2 * h2]
        gU[:, 2 * h2 :] += rs.T @ dcand
        for bytes_t, cols in ((x[:, t], front), (back[:, t], ~front)):
            one = np.zeros((m.E.shape[0], B), np.float32)
            one[bytes_t, np.arange(B)] = 1
            gE[:, cols] += one @ da[:, cols]
        ds = ds * (1 - z) + drs * r + da[:, : 2 * h2] @ Ug.T
    gU *= _mask(h)
    return loss, [gE, gU, gE.sum(0), gO, gc]


def epoch(by: list[np.ndarray], rng: np.random.Generator) -> np.ndarray:
    """A shuffled order in which every index of ``by`` (one array a language) comes up, each language equally often."""
    most = max(map(len, by))
    return rng.permutation(np.concatenate([np.resize(rng.permutation(k), most) for k in by]))


def train(windows: np.ndarray, target: np.ndarray, languages: list[str], steps: int = STEPS, batch: int = BATCH, hidden: int = HIDDEN, seed: int = 5) -> Model:
    """Adam on the mean cross-entropy of all positions, in whole epochs of at least ``steps`` batches together."""
    one_thread()
    rng = np.random.default_rng(seed)
    by = [k for k in (np.flatnonzero(target == j) for j in range(len(languages))) if len(k)]
    per_epoch = -(-max(map(len, by)) * len(by) // batch)
    steps = -(-steps // per_epoch) * per_epoch
    h2, L = 2 * hidden, len(languages)
    f = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    m = Model(languages, f(257, 3 * h2) * 4, f(h2, 3 * h2) * _mask(hidden), np.zeros(3 * h2, np.float32), f(h2, L), np.zeros(L, np.float32))
    first = [np.zeros_like(getattr(m, k)) for k in NAMES]
    second = [np.zeros_like(v) for v in first]
    for step in range(1, steps + 1):
        at = (step - 1) % per_epoch
        order = epoch(by, rng) if at == 0 else order
        take = order[at * batch : (at + 1) * batch]
        _, grads = _gradients(m, windows[take], target[take])
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, (name, g) in enumerate(zip(NAMES, grads, strict=True)):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            change = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            setattr(m, name, (getattr(m, name) - rate * change).astype(np.float32))
    return m


def _windows(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    n = -(-len(a) // WINDOW)
    out = np.full(n * WINDOW, 256, np.int16)
    out[: len(a)] = a
    return out.reshape(n, WINDOW)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from rows with non-null lang; ``docs`` holds the rows to learn from."""
    key = F.xxhash64("doc_id", "text")
    known = docs.where("lang is not null and text is not null")
    # Only keys are ranked, and at most ``per_language`` of a language leave each task.
    # A language of a third of all rows is ranked in parts first, so that the last ranking sees few rows.
    keys = known.select("lang", key.alias("k")).distinct().withColumn("part", F.pmod("k", F.lit(64)))
    for group in (["lang", "part"], ["lang"]):
        order = W.partitionBy(*group).orderBy("k")
        keys = keys.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    keys = keys.select("lang", "k")
    rows = known.select("lang", key.alias("k"), "text").join(keys, ["lang", "k"], "left_semi").groupBy("lang", "k").agg(F.min("text").alias("text"))

    def run(batches):
        for b in batches:
            for lang, k, text in zip(*(b.column(c).to_pylist() for c in ("lang", "k", "text")), strict=True):
                w = _windows(text.encode("utf-8", "replace"))
                for at in range(0, len(w), 8_192):
                    part = w[at : at + 8_192]
                    columns = [pa.array([lang] * len(part)), pa.array([k] * len(part), pa.int64()), pa.array(range(at, at + len(part)), pa.int64()), pa.array([x.tobytes() for x in part], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "k", "at", "bytes"])

    n = keys.select("lang").distinct().count()
    place = W.partitionBy("lang").orderBy(F.xxhash64("k", "at"), "k", "at")
    windows = rows.mapInArrow(run, "lang string, k long, at long, bytes binary").withColumn("n", F.row_number().over(place)).where(F.col("n") <= max(16, SAMPLE // max(n, 1)))
    got = sorted(windows.select("lang", "k", "at", "bytes").collect(), key=lambda r: (r.lang, r.k, r.at))
    if not got:
        return None
    languages = sorted({r.lang for r in got})
    y = np.array([languages.index(r.lang) for r in got])
    return train(np.frombuffer(b"".join(r.bytes for r in got), np.int16).reshape(-1, WINDOW), y, languages)


def pooled(m: Model, texts: list[bytes], at_once: int = 1024) -> np.ndarray:
    """Mean position probabilities per text; zero rows for empty texts."""
    total = np.zeros((len(texts), len(m.languages)))
    waiting, owner, n = [], [], 0

    def flush():
        x, who = np.concatenate(waiting), np.concatenate(owner)
        for lo in range(0, len(x), at_once):
            part = x[lo : lo + at_once]
            p = position_probabilities(m, part)
            p *= (part.T < 256)[:, :, None]
            np.add.at(total, who[lo : lo + at_once], p.sum(0))

    for k, t in enumerate(texts):
        if t:
            w = _windows(t)
            waiting.append(w)
            owner.append(np.full(len(w), k))
            n += len(w)
            if n >= 4 * at_once:
                flush()
                waiting, owner, n = [], [], 0
    if waiting:
        flush()
    return total / np.maximum(total.sum(1, keepdims=True), 1e-12)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predict(docs: DataFrame, m: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for every row."""

    def run(batches):
        one_thread()
        for b in batches:
            texts = b.column("text").to_pylist()
            lettered = [m is not None and has_letter(t) for t in texts]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if any(lettered):
                p = pooled(m, [t.encode("utf-8", "replace") if ok else b"" for t, ok in zip(texts, lettered, strict=True)])
                best = p.argmax(1)
                lang = [m.languages[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)]
                score = np.clip(np.where(lettered, p.max(1), 0.0), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
