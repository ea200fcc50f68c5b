"""Learned decision lists over text statistics, emitted as ordered Spark conditional expressions.

``text_stats`` computes statistics of whole texts with built-in functions only. ``learn_rules``
does sequential covering: on labelled statistics it grows a conjunction of thresholds by
information gain on two thirds of the rows, prunes it on the other third, accepts it if it's
precise enough there, removes what it covers and goes on. ``verdict`` turns the ordered rules
into one CASE expression.

Null and empty texts have no words and fail the base test. Repeated rows are judged alike; ties
between candidate thresholds go to the first feature and lowest threshold. Without labels or
with one class only the list is empty and only the base test decides. Extra columns are ignored.
The learner sees at most ``LABELLED`` labelled rows, one per doc_id, chosen by a hash of it; of conflicting
labels or texts of one doc_id the smallest counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mzloom.llm.common import SPACE, labelled_texts

LABELLED = 12_000
WINDOW = 5
SYMBOLS = "#*$%&|<>"
FEATURES = ["n_words", "mean_word", "symbol_share", "upper_share", "dup_line_share", "repeat_share", "mark_share"]


def _covered(positions: Column, width: int) -> Column:
    """Words covered by windows that start at the sorted, distinct ``positions``."""
    steps = F.zip_with(positions, F.slice(positions, 2, F.size(positions)), lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)


def text_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """Per row: ``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and FEATURES.

    Windows are first compared by 64-bit hashes; only texts in which hashes repeat are counted
    by the window strings themselves, so the count is exact.
    """
    text = F.coalesce("text", F.lit(""))
    df = docs.select(*keep, text.alias("_t"))
    df = df.withColumn("_w", F.array_remove(F.split("_t", SPACE), ""))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    # Loops are kept to one or two small steps each: the JVM compiles deep ones at a great cost of memory.
    n = F.col("n_words").cast("int")
    df = df.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    df = df.withColumn("_p", F.zip_with("_h", F.slice("_h", 2, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_q", F.zip_with("_p", F.slice("_p", 3, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_q", F.zip_with("_q", F.slice("_h", 5, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_h", F.slice("_q", 1, F.greatest(n - (WINDOW - 1), F.lit(0))))
    df = df.withColumn("_again", F.size(F.array_distinct("_h")) < F.size("_h"))
    spelt = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.struct(F.array_join(F.slice(F.col("_w"), i + 1, WINDOW), " ").alias("s"), i.cast("long").alias("i")),
    )
    df = df.withColumn("_s", F.when(F.col("_again"), F.sort_array(spelt)))
    df = df.withColumn("_t2", F.slice("_s", 2, F.greatest(n, F.lit(1))))
    first = F.zip_with("_s", "_t2", lambda a, b: F.when(a["s"] == b["s"], a["i"]))
    second = F.zip_with("_s", "_t2", lambda a, b: F.when(a["s"] == b["s"], b["i"]))
    df = df.withColumn("_at", F.sort_array(F.array_compact(F.array_distinct(F.concat(first, second)))))
    df = df.withColumn("n_repeat_words", F.when(F.col("_again"), _covered(F.col("_at"), WINDOW)).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"))
    chars, words = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    upper = F.length("_t") - F.length(F.regexp_replace("_t", r"\p{Lu}", ""))
    marks = F.length("_t") - F.length(F.translate("_t", "!?|", ""))
    out = df.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / words).alias("mean_word"),
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (upper / chars).alias("upper_share"),
        (F.col("n_dup_lines") / F.greatest(F.size("_l"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (marks / chars).alias("mark_share"),
    )
    # A generator stops later filters from being pushed into (and repeated within) the loops above.
    stats = [c for c in out.columns if c not in keep]
    return out.select(*keep, F.inline(F.array(F.struct(*stats))))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '>=' or '<', threshold); rows that meet it are rejected."""

    tests: tuple[tuple[str, str, float], ...]

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, op, v in self.tests:
            c = x[:, names.index(f)]
            out &= (c >= v) if op == ">=" else (c < v)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, op, v in self.tests:
            out = out & ((F.col(f) >= v) if op == ">=" else (F.col(f) < v))
        return out


def _precision(bad: np.ndarray, hit: np.ndarray) -> float:
    return (bad[hit].sum() + 1.0) / (hit.sum() + 2.0)


def _grow(x, bad, names, cuts, most):
    tests: list = []
    hit = np.ones(len(x), bool)
    while len(tests) < most and not bad[hit].all():
        p, n = bad[hit].sum(), (~bad[hit]).sum()
        base = np.log2((p + 1e-9) / (p + n + 1e-9))
        best = (1e-6, None, None)
        for j, f in enumerate(names):
            for v in cuts[j]:
                for op in (">=", "<"):
                    h = hit & ((x[:, j] >= v) if op == ">=" else (x[:, j] < v))
                    p1, n1 = bad[h].sum(), (~bad[h]).sum()
                    if p1 < 5:
                        continue
                    gain = p1 * (np.log2(p1 / (p1 + n1)) - base)
                    if gain > best[0]:
                        best = (gain, (f, op, float(v)), h)
        if best[1] is None:
            break
        tests.append(best[1])
        hit = best[2]
    return tests


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], least_precision: float = 0.8, most_rules: int = 8, most_tests: int = 3) -> list[Rule]:
    """Sequential covering of the rows with ``bad``; rows are dealt to grow and prune sets by position."""
    rules: list[Rule] = []
    if len(x) == 0 or bad.all() or not bad.any():
        return rules
    prune = np.arange(len(x)) % 3 == 2
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 25))) for j in range(len(names))]
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and bad[left & ~prune].sum() >= 5:
        g = left & ~prune
        tests = _grow(x[g], bad[g], names, cuts, most_tests)
        if not tests:
            break
        p = left & prune
        options = [Rule(tuple(tests[:k])) for k in range(len(tests), 0, -1)]
        rule = max(options, key=lambda r: _precision(bad[p], r.holds(x[p], names)))
        hit = rule.holds(x, names) & left
        if _precision(bad[p], hit[p]) < least_precision or _precision(bad[g], hit[g]) < least_precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """0 if no rule rejects the row, else the number of the first rule that does."""
    out = None
    for k, r in enumerate(rules, 1):
        out = F.when(r.column(), F.lit(k)) if out is None else out.when(r.column(), F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> list[Rule]:
    """Learn rules that reject quality 0, from at most ``bound`` labelled rows."""
    rows = text_stats(labelled_texts(docs, labels.where("quality is not null").select("doc_id", "quality"), bound), "doc_id", "quality")
    rows = rows.where((F.col("n_words") >= 10) & (F.col("n_repeat_words") * 100 <= F.col("n_words") * 20)).select("doc_id", "quality", *FEATURES)
    got = sorted(tuple(r) for r in rows.collect())
    x = np.array([r[2:] for r in got], float).reshape(len(got), len(FEATURES))
    return learn_rules(x, np.array([r[1] == 0 for r in got], bool), FEATURES)


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the statistics, base_failed, rule (the first that rejects, else 0) and kept."""
    s = text_stats(docs, "doc_id")
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    s = s.withColumn("base_failed", base).withColumn("rule", F.when(F.col("base_failed"), F.lit(0)).otherwise(verdict(rules)))
    s = s.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    return s.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
