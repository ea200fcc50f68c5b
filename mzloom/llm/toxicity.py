"""Toxicity by a classifier chain.

Categories are predicted in a fixed order; the model of each category is a logistic regression
over word counts, text statistics and the probabilities of all earlier categories. While fitting,
those probabilities are out-of-fold predictions, so later models see what they will see in use.
The decision threshold has the best F0.5 (precision counts more: clean documents stay) on
out-of-fold probabilities.

Categories here, from the labels: ``junk`` (quality 0), ``toxic`` (toxic 1), ``toxic_junk`` (both).
Words and word beginnings come from the labelled texts: those whose presence is most associated
with a category.

Every distinct text of a labelled doc_id counts once, in the words, in all models and in the threshold; of conflicting
labels of one doc_id the smallest counts, of one text the largest. The models are the optima over all of them: each Newton step adds up
gradients and curvatures over all rows, by Spark where there are more than ``AT_ONCE`` rows. Those steps start from the models of ``START`` rows,
which save rounds and don't change the optimum. Folds go by a hash of doc_id.
Null and empty texts have no features and get the base rates; they're never rejected. Repeated rows are
judged alike. Without labels of both kinds nothing is rejected. Extra columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from mzloom.llm.common import discard, materialise, one_thread, release_memory, slices

#: Labelled texts that are added up in one place; the sums over more of them are Spark jobs.
AT_ONCE = 8_000
START = 2_000
#: Newton steps are cut to this length.
STRIDE = 8.0
WORDS = 400
#: Least association of a feature word with a category, in roughly standard deviations.
LIFT = 5.0
FOLDS = 5
#: Thresholds that are tried, and partial sums that one group adds up.
CUTS = np.linspace(0.2, 0.8, 31)
ADDED = 32
CATEGORIES = ("junk", "toxic", "toxic_junk")
_LETTERS = re.compile(r"[^\W\d_]+")
_UPPER = string.ascii_uppercase.encode()
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")
_STATS = 4
PREFIXES = (4, 5, 6, 7)


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def marks_of(words: list[str]) -> list[str]:
    """The words and their beginnings of PREFIXES letters: inflected forms share a stem."""
    return words + [w[:k] + "*" for k in PREFIXES for w in words if len(w) > k]


def upper_case(text: str) -> int:
    """Upper-case letters in all of ``text``; the ASCII ones by deletion, which is many times faster than a loop."""
    raw = text.encode("utf-8", "replace")
    count = len(raw) - len(raw.translate(None, _UPPER))
    return count if text.isascii() else count + sum(map(str.isupper, _BEYOND_ASCII.findall(text)))


def statistics(text: str, n_words: int) -> list[float]:
    n = max(len(text), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = sum(map(text.count, "#*$%&|<>!"))
    return [min(symbols / n * 10, 2.0), upper_case(text) / n, 1 - len(set(lines)) / max(len(lines), 1), 1 / (1 + n_words)]


@dataclass
class Chain:
    """Vocabulary, one weight vector per category (bias last), and the threshold of ``toxic``."""

    words: dict[str, int]
    weights: list[np.ndarray]
    threshold: float
    categories: tuple[str, ...] = CATEGORIES

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        for w in self.weights:
            x = np.column_stack([x, _sigmoid(np.column_stack([x, np.ones(len(x))]) @ w)])
        return x[:, x.shape[1] - len(self.weights) :]


def features(text: str | None, vocabulary: dict[str, int]) -> np.ndarray:
    x = np.zeros(len(vocabulary) + _STATS)
    if text:
        words = words_of(text)
        get = vocabulary.get
        for j in [k for k in map(get, marks_of(words)) if k is not None]:
            x[j] += 1
        np.minimum(x, 4, out=x)
        x[: len(vocabulary)] = np.log1p(x[: len(vocabulary)])
        x[len(vocabulary) :] = statistics(text, len(words))
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def with_ones(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x), x.dtype)])


def chained(x: np.ndarray, fold: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    """``x`` with a column of out-of-fold probabilities for each of the ``earlier`` categories, given as the weights of each fold."""
    for w in earlier:
        p = _sigmoid(np.einsum("ij,ij->i", x, w[fold, :-1]) + w[fold, -1])
        x = np.column_stack([x, p.astype(x.dtype)])
    return x


def sums_of(x: np.ndarray, y: np.ndarray, fold: np.ndarray, models: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(gradient, curvature) of the log-likelihood for each model (weights, fold left out or -1); ``x`` ends with ones."""
    out = [(np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))) for _ in models]
    for lo in range(0, len(x), 1024):  # in blocks, so that no second copy of x is held
        part, inside, wide = x[lo : lo + 1024], fold[lo : lo + 1024], x[lo : lo + 1024].astype(float)
        for (w, left), (gradient, curvature) in zip(models, out, strict=True):
            p, used = _sigmoid(wide @ w), inside != left
            scaled = part * np.sqrt(np.maximum(p * (1 - p), 1e-4) * used)[:, None].astype(x.dtype)
            gradient += ((y[lo : lo + 1024] - p) * used) @ wide
            curvature += scaled.T @ scaled
    return out


def newton(starts: list[np.ndarray], sums: Callable, penalty: float = 0.3, rounds: int = 12) -> list[np.ndarray]:
    """Ridge-penalised logistic regressions by Newton steps, those of all models in the same passes; the bias (last) isn't penalised.

    ``sums`` takes (model number, weights) of the models that still move and gives ``sums_of`` for them.
    """
    w, moving = list(starts), list(range(len(starts)))
    for _ in range(rounds):
        if not moving:
            break
        got, still = sums([(k, w[k]) for k in moving]), []
        for k, (gradient, curvature) in zip(moving, got, strict=True):
            ridge = np.full(len(w[k]), penalty)
            ridge[-1] = 1e-6
            step = np.linalg.solve(curvature + np.diag(ridge), gradient - ridge * w[k])
            length = np.abs(step).max()
            w[k] = w[k] + step * min(1.0, STRIDE / max(length, 1e-12))
            if length >= 1e-4:
                still.append(k)
        moving = still
    return w


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, rounds: int = 12) -> np.ndarray:
    x, fold = with_ones(x), np.zeros(len(x), int)
    return newton([np.zeros(x.shape[1])], lambda models: sums_of(x, y, fold, [(w, -1) for _, w in models]), penalty, rounds)[0]


def cut_counts(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of CUTS, the rows with a probability that reaches it and those of them in the category."""
    return np.array([[(p >= c).sum(), ((p >= c) & (y > 0)).sum()] for c in CUTS])


def _chain(words: dict[str, int], width: int, counts: np.ndarray, sums: Callable, reached: Callable, starts: list[np.ndarray] | None = None) -> Chain:
    """The models in order, from ``counts`` (a row per fold: rows, then rows of each category) and sums over all rows.

    ``sums(k, earlier, models)`` are ``sums_of``, ``reached(k, earlier)`` the ``cut_counts`` of category k.
    """
    total, earlier, weights, threshold = counts.sum(0), [], [], 0.5
    for k, name in enumerate(CATEGORIES):
        if not total[0]:
            weights.append(np.zeros(width + k + 1))
            continue
        inside, hits = total[0] - counts[:, 0], total[k + 1] - counts[:, k + 1]
        left = [-1, *[f for f in range(len(counts)) if 0 < hits[f] < inside[f]]]
        start = starts[k] if starts else np.zeros(width + k + 1)
        made = newton([start] * len(left), lambda models, k=k, left=left, known=list(earlier): sums(k, known, [(w, left[m]) for m, w in models]))
        weights.append(made[0])
        # A fold whose other rows are all of one kind gets the share of the category in all rows.
        base = np.zeros(width + k + 1)
        base[-1] = np.log(max(total[k + 1], 1e-13) / max(total[0] - total[k + 1], 1e-13))
        by_fold = np.tile(base, (len(counts), 1))
        by_fold[left[1:]] = made[1:] or by_fold[left[1:]]
        earlier.append(by_fold)
        if name == "toxic" and total[k + 1]:
            n, good = reached(k, list(earlier)).T
            f = 1.25 * good / np.maximum(n + 0.25 * total[k + 1], 1)
            # Inside the best stretch: a flat optimum leaves room on both sides.
            best = np.flatnonzero(f >= f.max() - 0.01)
            threshold = float(CUTS[best[len(best) // 3]])
    return Chain(words, weights, threshold)


def fit_chain(x: np.ndarray, y: np.ndarray, words: dict[str, int], folds: int = FOLDS, fold: np.ndarray | None = None) -> Chain:
    """Fit the models in order; ``y`` has a 0/1 column per category. Rows are dealt to folds by position unless ``fold`` is given."""
    one_thread()
    fold = np.arange(len(x)) % folds if fold is None else fold
    y = y.reshape(len(x), len(CATEGORIES)).astype(float)
    counts = np.array([[(fold == f).sum(), *y[fold == f].sum(0)] for f in range(folds)])
    sums = lambda k, earlier, models: sums_of(with_ones(chained(x, fold, earlier)), y[:, k], fold, models)
    return _chain(words, x.shape[1], counts, sums, lambda k, earlier: cut_counts(chained(x, fold, earlier)[:, -1], y[:, k]))


def _described(batches):
    """The marks of each text with their counts (4 at most) and its statistics: all that counts and features need of it."""
    names = ["doc_id", "toxic", "junk", "digest", "marks", "times", "stats"]
    for b in slices(batches):
        marks, times, stats = [], [], []
        for text in b.column("text").to_pylist():
            words = words_of(text)
            got = Counter(marks_of(words))
            marks.append(list(got))
            times.append([min(n, 4) for n in got.values()])
            stats.append(statistics(text, len(words)) if text else [0.0] * _STATS)
        made = [pa.array(marks, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int8())), pa.array(stats, pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:4]], *made], names=names)


def labelled_marks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, fold, toxic, junk, marks, times, stats: one row for each distinct text of a labelled doc_id.

    Texts are told apart by their SHA-256, and described before they are shuffled.
    """
    labelled = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), (F.coalesce(F.col("quality"), F.lit(1)) == 0).cast("int").alias("junk"))
    labelled = labelled.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("junk").alias("junk"))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(labelled, "doc_id").select("doc_id", "toxic", "junk", F.sha2("text", 256).alias("digest"), "text")
    rows = texts.mapInArrow(_described, "doc_id long, toxic int, junk int, digest string, marks array<string>, times array<tinyint>, stats array<float>")
    one = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.max("junk").alias("junk"), F.first(F.struct("marks", "times", "stats")).alias("of"))
    return one.select("digest", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), "toxic", "junk", "of.*")


def matrix(b: pa.RecordBatch, words: dict[str, int]) -> np.ndarray:
    """The ``features`` of texts that are given as marks, times and stats."""
    marks, x = b.column("marks"), np.zeros((b.num_rows, len(words) + _STATS), np.float32)
    flat = marks.flatten()
    at = pc.fill_null(pc.index_in(flat, value_set=pa.array(list(words), flat.type)), -1).to_numpy(zero_copy_only=False)
    row, known = np.repeat(np.arange(b.num_rows), pc.list_value_length(marks).to_numpy(zero_copy_only=False)), at >= 0
    x[row[known], at[known]] = np.log1p(b.column("times").flatten().to_numpy(zero_copy_only=False)[known].astype(float))
    x[:, len(words) :] = b.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, _STATS)
    return x


def _parts(batches, k: int, earlier: list[np.ndarray]):
    """(chained features, 0/1 of category k, folds) of some rows at a time."""
    for b in slices(batches, 1024):
        x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.float32).reshape(b.num_rows, -1)
        toxic, junk, fold = (b.column(c).to_numpy() for c in ("toxic", "junk", "fold"))
        yield chained(x, fold, earlier), (junk, toxic, junk * toxic)[k].astype(float), fold


def _added(key, rows):
    """One row for the partial sums of a model: those of a group in the order of their parts."""
    model, part = (v.as_py() for v in key)
    rows = rows.sort_by("source")
    total = sum(np.frombuffer(d) for d in rows.column("data").to_pylist())
    return pa.table({"model": pa.array([model], pa.int32()), "part": pa.array([part], pa.int32()), "source": pa.array([part], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})


def spread_sums(rows: DataFrame, k: int, earlier: list[np.ndarray], models: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``sums_of`` over all ``rows``: each task adds up its rows, and a tree of groups of ADDED adds up the tasks."""
    kind, d = "model int, part int, source int, data binary", len(models[0][0])

    def run(batches):
        one_thread()
        total = None
        for x, y, fold in _parts(batches, k, earlier):
            got = [np.append(h, g) for g, h in sums_of(with_ones(x), y, fold, models)]
            total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
        task = TaskContext.get().partitionId()
        for m, data in enumerate(total or []):
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (m, task // ADDED, task)] + [pa.array([data.tobytes()], pa.binary())], names=["model", "part", "source", "data"])

    sums, tasks = rows.mapInArrow(run, kind), rows.rdd.getNumPartitions()
    while tasks > 1:
        sums = sums.groupBy("model", "part").applyInArrow(_added, kind)
        sums, tasks = sums.withColumn("part", (F.col("source") / ADDED).cast("int")), -(-tasks // ADDED)
    got = [np.frombuffer(r.data) for r in sorted(sums.collect(), key=lambda r: r.model)]
    return [(v[d * d :], v[: d * d].reshape(d, d)) for v in got]


def spread_cuts(rows: DataFrame, k: int, earlier: list[np.ndarray]) -> np.ndarray:
    """``cut_counts`` over all ``rows``."""

    def run(batches):
        total = sum((cut_counts(x[:, -1], y) for x, y, _ in _parts(batches, k, earlier)), np.zeros((len(CUTS), 2), int))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(CUTS)), pa.int32()), *[pa.array(c, pa.int64()) for c in total.T]], names=["cut", "n", "good"])

    got = rows.mapInArrow(run, "cut int, n long, good long").groupBy("cut").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("cut").collect()
    return np.array([(r.n, r.good) for r in got], float)


def _fit_rows(rows: DataFrame, words: dict[str, int]) -> Chain:
    """``fit_chain`` of all ``rows``, which are few."""
    got = sorted(rows.collect(), key=lambda r: (r.doc_id, r.digest))
    x = np.stack([np.frombuffer(r.x, np.float32) for r in got]).astype(float)
    return fit_chain(x, np.array([(r.junk, r.toxic, r.junk * r.toxic) for r in got]), words, fold=np.array([r.fold for r in got]))


def fit(docs: DataFrame, labels: DataFrame, at_once: int = AT_ONCE, n_words: int = WORDS) -> Chain | None:
    """Fit from all labelled rows; None without both kinds of label."""
    rows = materialise(labelled_marks(docs, labels))  # read for counts, vocabulary and features
    both = F.col("toxic") * F.col("junk")
    by_fold = {r.fold: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("junk").alias("j"), F.sum("toxic").alias("t"), F.sum(both).alias("b")).collect()}
    counts = np.array([(r.n, r.j, r.t, r.b) if (r := by_fold.get(f)) else (0, 0, 0, 0) for f in range(FOLDS)])
    n, junk, toxic, _ = counts.sum(0).tolist()
    if not toxic or toxic == n:
        discard(rows)
        return None
    by_word = rows.select("toxic", "junk", F.explode("marks").alias("w")).groupBy("w").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"), F.sum("junk").alias("j"))

    def lift(hit, base):  # signed root of a chi-square-like statistic for presence in the category
        expected = F.col("n") * (base / n)
        return (F.col(hit) - expected) / F.sqrt(expected + 1)

    by_word = by_word.where("n >= 5").withColumn("score", F.greatest(lift("t", toxic), lift("j", junk)))
    words = {r.w: i for i, r in enumerate(by_word.where(F.col("score") >= LIFT).orderBy(F.desc("score"), "w").limit(n_words).select("w").collect())}

    def run(batches):
        for b in slices(batches):
            x = pa.array([v.tobytes() for v in matrix(b, words)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "digest", "fold", "toxic", "junk")], x], names=["doc_id", "digest", "fold", "toxic", "junk", "x"])

    described = rows.mapInArrow(run, "doc_id long, digest string, fold int, toxic int, junk int, x binary")
    if n > at_once:
        described = materialise(described, rows)  # read once for each Newton step
        starts = _fit_rows(described.orderBy("digest").limit(START), words).weights
        chain = _chain(words, len(words) + _STATS, counts, partial(spread_sums, described), partial(spread_cuts, described), starts)
        discard(described)
    else:
        chain = _fit_rows(described, words)
        discard(rows)
    release_memory()
    return chain


def _probabilities(texts: list[str | None], chain: Chain | None) -> np.ndarray:
    if not chain or not texts:
        return np.zeros((len(texts), len(CATEGORIES)))
    return chain.probabilities(np.stack([features(t, chain.words) for t in texts]))


def _judged(texts: list[str | None], p: np.ndarray, chain: Chain | None) -> list[bool]:
    at = CATEGORIES.index("toxic")
    return [bool(t) and chain is not None and q >= chain.threshold for t, q in zip(texts, p[:, at], strict=True)]


def score(docs: DataFrame, chain: Chain | None, *keep: str) -> DataFrame:
    """``keep`` plus p_<category> and toxic for every row."""
    out = StructType([*[docs.schema[c] for c in keep], *[StructField(f"p_{c}", DoubleType()) for c in CATEGORIES], StructField("toxic", BooleanType())])

    def run(batches):
        one_thread()
        for b in slices(batches):
            texts = b.column(b.num_columns - 1).to_pylist()
            p = _probabilities(texts, chain)
            columns = [b.column(k) for k in range(len(keep))] + [pa.array(p[:, k]) for k in range(p.shape[1])] + [pa.array(_judged(texts, p, chain), pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, out)


def reject(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """``docs`` without the rows that the chain takes for toxic; all columns stay as they are."""

    def run(batches):
        one_thread()
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            yield b.filter(pa.array([not j for j in _judged(texts, _probabilities(texts, chain), chain)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
