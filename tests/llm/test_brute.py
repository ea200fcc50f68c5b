"""Operators that SQL cannot express, against plain loops."""

import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import xxhash

from mzloom.llm import decontaminate, importance, langid, pii, rules, secrets, toxicity
from tests.llm.data import DATA, docs_frame, needs_data


def spark_hash(seed, value):
    """xxhash64 as Spark chains it: the hash of one column is the seed of the next."""
    return xxhash.xxh64_intdigest(struct.pack("<q", value), seed=seed) if seed == 42 else xxhash.xxh64_intdigest(struct.pack("<i", value), seed=seed)


def test_importance_against_plain_loops(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["good", "fine", "nice", "text", f"w{k % 7}"]) for _ in range(r.randint(1, 40))) for k in range(60)]
    texts += [" ".join(r.choice(["junk", "##", "text"]) for _ in range(r.randint(1, 40))) for _ in range(60)] + [None, "", "  \n", "Good"]
    labels = spark.createDataFrame([(k, int(k < 60), 0) for k in range(0, 120, 2)] + [(1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    docs = docs_frame(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 3"))
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3])]

    def grams(text):
        w = [x.lower().encode() for x in (text or "").split()]
        one = [zlib.crc32(x) for x in w]
        two = [(a * 0x9E3779B1 + b) % 2**64 for a, b in zip(one, one[1:])]
        return [h % 10_000 for h in one] + [(h ^ h >> 29) % 10_000 for h in two]

    good = {k for k in range(0, 60, 2)}
    raw, target = Counter(), Counter()
    for k, t in rows:
        raw.update(grams(t))
        if k in good:
            target.update(grams(t))
    total = sum(raw.values()) + 10_000
    weight = {b: math.log((target[b] + 10_000 * (n + 1) / total) / (sum(target.values()) + 10_000) / ((n + 1) / total)) for b, n in raw.items()}
    keys = []
    for k, t in rows:
        if grams(t):
            u = ((spark_hash(spark_hash(42, k), 11) >> 11) + 0.5) / 2**53
            keys.append((sum(weight[b] for b in grams(t)) - math.log(-math.log(u)), k))
    share = 30 / 61
    least = sorted(keys, reverse=True)[round(share * len(keys)) - 1][0]
    got = importance.resample(docs, labels).collect()
    assert len(got) == len(rows)
    want = dict((k, v) for v, k in keys)
    for x in got:
        assert (x.gumbel_key is None) == (x.doc_id not in want)
        if x.doc_id in want:
            assert abs(x.gumbel_key - want[x.doc_id]) < 1e-6 and x.kept == (want[x.doc_id] >= least - 1e-9)
    none = spark.createDataFrame([(None, "a b"), (None, "c d"), (None, "a b")], "doc_id long, text string")
    found = [x.gumbel_key for x in importance.resample(none, labels.limit(0)).collect()]
    assert len(set(found)) == 2  # rows without doc_id draw by their text


def test_language_network_against_plain_loops():
    m = langid.train(np.random.default_rng(2).integers(97, 122, (30, 16)), np.arange(30) % 3, ["aa", "bb", "cc"], steps=4, hidden=2)
    h = 2
    sig = lambda v: 1 / (1 + math.exp(-v))

    def run(data, side):
        """States of one direction, at every position."""
        s, out = [0.0] * h, []
        own = [side * h + k for k in range(h)]
        for byte in data if side == 0 else data[::-1]:
            gate = lambda g, k, v: m.E[byte, g * 2 * h + own[k]] + m.b[g * 2 * h + own[k]] + sum(v[j] * m.U[own[j], g * 2 * h + own[k]] for j in range(h))  # noqa: B023, E731
            z, r = [sig(gate(0, k, s)) for k in range(h)], [sig(gate(1, k, s)) for k in range(h)]
            rs = [a * b for a, b in zip(r, s)]
            c = [math.tanh(gate(2, k, rs)) for k in range(h)]
            s = [a + g * (b - a) for a, g, b in zip(s, z, c)]
            out.append(s)
        return out if side == 0 else out[::-1]

    def probabilities(text):
        total = [0.0] * 3
        for at in range(0, len(text), langid.WINDOW):
            part = text[at : at + langid.WINDOW]
            padded = list(part) + [256] * (langid.WINDOW - len(part))
            for f, b in list(zip(run(padded, 0), run(padded, 1)))[: len(part)]:
                a = [sum(v * m.O[j, k] for j, v in enumerate([*f, *b])) + m.c[k] for k in range(3)]
                e = [math.exp(x - max(a)) for x in a]
                total = [t + x / sum(e) for t, x in zip(total, e)]
        return [t / len(text) for t in total]

    texts = [b"hello there", b"a", bytes(range(97, 123)) * 6, b"x" * 64, b"yz" * 33]
    assert np.allclose(langid.pooled(m, texts), [probabilities(t) for t in texts], atol=1e-4)


def test_all_windows_and_languages_are_learned(spark):
    rows = [(k, (chr(97 + k % 26) + chr(97 + k // 26)) * 80, f"l{k:02d}") for k in range(70)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.languages == [f"l{k:02d}" for k in range(70)]
    odd = spark.createDataFrame([(1, "² ½ ① 12"), (2, "²a"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in langid.predict(odd, m).collect()} == {1: True, 2: False, 3: True}


def slow_rules(x, bad, names, least=0.8, most_rules=8, most_tests=3):
    """Sequential covering, one row at a time."""
    cuts = {f: sorted(set(np.quantile([r[j] for r in x], np.linspace(0.02, 0.98, 25)))) for j, f in enumerate(names)}
    holds = lambda tests, r: all((r[names.index(f)] >= v) == (op == ">=") for f, op, v in tests)
    left, out = list(range(len(x))), []
    while len(out) < most_rules:
        grow, prune = [i for i in left if i % 3 != 2], [i for i in left if i % 3 == 2]
        if sum(bad[i] for i in grow) < 5:
            break
        tests, hit = [], grow
        while len(tests) < most_tests and not all(bad[i] for i in hit):
            base = math.log2((sum(bad[i] for i in hit) + 1e-9) / (len(hit) + 1e-9))
            best = (1e-6, None)
            for f in names:
                for v in cuts[f]:
                    for op in (">=", "<"):
                        h = [i for i in hit if holds([(f, op, v)], x[i])]
                        p = sum(bad[i] for i in h)
                        if p >= 5 and p * (math.log2(p / len(h)) - base) > best[0] + 1e-12:
                            best = (p * (math.log2(p / len(h)) - base), (f, op, v))
            if best[1] is None:
                break
            tests.append(best[1])
            hit = [i for i in hit if holds([best[1]], x[i])]
        if not tests:
            break
        score = lambda t, rows: (sum(bad[i] for i in rows if holds(t, x[i])) + 1) / (sum(holds(t, x[i]) for i in rows) + 2)  # noqa: B023, E731
        rule = max((tests[:k] for k in range(len(tests), 0, -1)), key=lambda t: score(t, prune))
        if score(rule, prune) < least or score(rule, grow) < least:
            break
        out.append(rule)
        left = [i for i in left if not holds(rule, x[i])]
    return out


def test_rules_against_plain_loops():
    rng = np.random.default_rng(6)
    names = ["a", "b", "c"]
    x = rng.random((150, 3)).round(3)
    bad = ((x[:, 0] > 0.7) & (x[:, 1] < 0.6)) | (x[:, 2] > 0.85)
    got = [[(f, op, v) for f, op, v in r.tests] for r in rules.learn_rules(x, bad, names)]
    want = slow_rules(x.tolist(), bad.tolist(), names)
    assert len(got) == len(want) >= 2
    for g, w in zip(got, want):
        assert [t[:2] for t in g] == [t[:2] for t in w] and np.allclose([t[2] for t in g], [t[2] for t in w])


def test_chain_against_plain_loops(spark):
    texts = [f"fine words {k} here" for k in range(60)] + [f"you IDIOT number {k}!" for k in range(30)] + [f"### && {k}" for k in range(20)]
    labels = spark.createDataFrame([(k, int(k < 90), int(60 <= k < 90)) for k in range(110)], "doc_id long, quality int, toxic int")
    docs = docs_frame(spark, [*texts, None, "", "idiot", "fine"])
    twice = docs.unionByName(docs.where("doc_id < 40"))
    chain, again = toxicity.fit(docs, labels), toxicity.fit(twice, labels)
    assert chain.words == again.words and chain.threshold == again.threshold and all(np.array_equal(a, b) for a, b in zip(chain.weights, again.weights))

    def judged(text):
        words = [w for w in re.findall(r"[^\W\d_]+", text.lower())]
        marks = Counter(words + [w[:k] + "*" for w in words for k in (4, 5, 6, 7) if len(w) > k])
        lines = [x for x in text.split("\n") if x.strip()]
        x = [math.log1p(min(marks[w], 4)) for w in chain.words]
        n = max(len(text), 1)
        x += [min(sum(c in "#*$%&|<>!" for c in text) / n * 10, 2), sum(c.isupper() for c in text) / n, 1 - len(set(lines)) / max(len(lines), 1), 1 / (1 + len(words))]
        p = []
        for w in chain.weights:
            z = sum(a * b for a, b in zip([*x, *p], w[:-1])) + w[-1]
            p.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        return p

    for r in toxicity.score(twice, chain, "doc_id", "text").collect():
        if r.text:
            p = judged(r.text)
            assert np.allclose([r.p_junk, r.p_toxic, r.p_toxic_junk], p, atol=1e-6) and r.toxic == (p[1] >= chain.threshold)
        else:
            assert not r.toxic
    left = {r.doc_id for r in toxicity.reject(docs, chain).collect()}
    assert left == {r.doc_id for r in toxicity.score(docs, chain, "doc_id").where("not toxic").collect()} and toxicity.reject(docs.limit(0), chain).count() == 0


def test_logistic_reaches_the_optimum():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 4))
    y = (x[:, 0] + 0.5 * rng.normal(size=200) > 0).astype(float)
    w = toxicity.logistic(x, y, penalty=0.3, rounds=50)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(x.T @ (y - p) - 0.3 * w[:-1]).max() < 1e-3 and abs((y - p).sum()) < 1e-3


def test_forest_and_scan_against_plain_loops(spark):
    forest = secrets.fit()

    def one(tree, x):
        feature, cut, left, right, value = tree
        at = 0
        while feature[at] >= 0:
            at = left[at] if x[feature[at]] <= cut[at] else right[at]
        return value[at]

    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"

    def found(text):
        out, at = [], 0
        while at < len(text):
            end = at
            while end < len(text) and text[end] in chars:
                end += 1
            if end - at >= 16:
                tail = end
                while tail < len(text) and tail - end < 2 and text[tail] == "=":
                    tail += 1
                if tail < len(text) and text[tail] in chars:  # a run behind the padding: take less padding
                    tail = end if end == len(text) or text[end] not in chars else None
                s = text[at:tail] if tail else ""
                if s and (any(c.isdigit() for c in s) or re.search("[a-z][A-Z]|[A-Z][a-z]+[A-Z]", s) or s.startswith(secrets.PREFIXES)):
                    x = secrets.describe(text, at, tail)
                    p = sum(one(t, x) for t in forest.trees) / len(forest.trees)
                    if p >= 0.5:
                        out.append((at, tail, p))
            at = end + 1
        return out

    texts = [t for t, *_ in secrets.labelled_findings(200, 77)] + [None, "", "plain"]
    texts = [" ".join(filter(None, texts[k : k + 3])) for k in range(0, len(texts), 3)]
    got: dict = {}
    for r in secrets.scan(docs_frame(spark, texts), forest).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.score))
    for k, t in enumerate(texts):
        want = found(t)
        assert [g[:2] for g in sorted(got.get(k, []))] == [w[:2] for w in want] and np.allclose([g[2] for g in sorted(got.get(k, []))], [w[2] for w in want])


def test_surrogates_round_trip(spark):
    """Distinct entities get distinct surrogates, so that swapping back restores every text."""
    r = random.Random(4)
    given, family = ["Anna", "Berta", "Carl", "Dora", "Emil"], ["Stone", "Rivers", "Field", "Marsh"]
    texts = []
    for k in range(120):
        g, f = r.choice(given), r.choice(family)
        who = r.choice(["Mr.", "Mrs.", "Herr", "Frau"]) + f" {g} {f}"
        mail = f"{r.choice('abcdef')}{r.randrange(20)}@{r.choice(['gmail.com', 'x.org', 'mail1.example.com', 'a.b.net'])}"
        texts.append(f"{k}: {who} wrote to {mail} from 10.{r.randrange(3)}.0.{r.randrange(9)}, call +1 (555) 010-{r.randrange(1000, 1100)}; then {g} {f} and {f} left, card 4111 1111 1111 {r.randrange(1000, 1050)}. Other Words Stay.")
    pattern = re.compile(r"[\w.]+@[\w.]*\w|\d+\.\d+\.\d+\.\d+|\+1 \(\d+\) \d+-\d+(?:-\d+)?|(?:\d{4} ){3}\d{4}(?:-\d+)?|[^\W\d_]+(?:-[^\W\d_]+)?")
    out = {x.doc_id: x for x in pii.replace_entities(docs_frame(spark, texts), "key").collect()}
    back: dict = {}
    for k, t in enumerate(texts):
        old, new = pattern.findall(t), pattern.findall(out[k].text)
        assert len(old) == len(new) and pattern.split(t) == pattern.split(out[k].text) and out[k].n_entities == 8
        title = t.split()[1]
        for a, b in zip(old, new):
            # A given name is an entity together with its gender and family.
            who = (title in ("Mrs.", "Frau"), t.split()[3]) if a in given else None
            if who:
                b = (b, out[k].text.split()[3])
            assert back.setdefault((who is not None, b), (a, who)) == (a, who)
    plain = {a for a, _ in back.values()}
    assert {"Other", "Words", "Stay", "wrote"} <= plain
    replaced = {b for (named, b), (a, _) in back.items() if not named and a != b}
    assert not replaced & plain  # no surrogate is a real entity
    text = out[0].text
    assert text.split()[2] in text.split("then")[1] and text.split()[3] in text.split("then")[1]
    other = pii.replace_entities(docs_frame(spark, texts[:1]), "other key").first().text
    assert other != text


def test_many_names_and_long_texts(spark):
    from pyspark.sql import functions as F

    names = spark.range(70_000).select(F.lit("family").alias("kind"), F.concat(F.lit("name"), F.conv(F.col("id").cast("string"), 10, 36)).alias("norm"))
    few = spark.range(300).select(F.lit("given").alias("kind"), F.concat(F.lit("m:g"), F.col("id").cast("string"), F.lit(" smith")).alias("norm"))
    known = names.unionByName(few)
    special = pii.exceptions(known, "k")
    tried = known.join(special, ["kind", "norm"], "left").select("kind", F.array(F.struct("kind", "norm", F.coalesce("attempt", F.lit(0)).alias("attempt"))).alias("e"))
    assert tried.select("kind", F.explode(pii.normal_surrogates("e", "k")).alias("s")).distinct().count() == 70_300
    long = ["x@" + "a." * 500_000 + "com", "7" * 10**6, "a@" * 500_000, "Mr. " * 250_000, "1.2.3." * 160_000, "Aa" * 500_000, "+1 " * 300_000, "Mr. Smith " + "Word " * 200_000, "b" * 10**6 + "@x.com"]
    got = {r.doc_id: r for r in pii.replace_entities(docs_frame(spark, long), "k").select("doc_id", "n_entities", F.length("text").alias("n"), F.left("text", F.lit(40)).alias("head")).collect()}
    assert got[0].n_entities == 1 and got[7].n_entities >= 1 and got[8].n_entities == 1 and "Smith" not in got[7].head and got[1].n_entities == 0 and got[1].n == 10**6


def words_with_changes(words, rate, r):
    out = []
    for w in words:
        x = r.random()
        if x < rate * 0.6:
            out.append(r.choice([b"other", b"some", b"thing", b"new"]))
        elif x < rate * 0.8:
            continue
        else:
            out.append(w)
            if x > 1 - rate * 0.2:
                out.append(b"indeed")
    return out


@needs_data
def test_decontamination_against_all_pairs(spark):
    """Recall on 240 reworded items, against the common subsequences of every item with every document."""
    r = random.Random(12)
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(150).collect()]
    base = [decontaminate.words_of(t) for _, t in docs if t and len(t) > 300]
    for k in range(240):
        item = decontaminate.words_of(bench[k % len(bench)].text)
        around = r.choice(base)
        at = r.randrange(len(around))
        docs.append((10**6 + k, b" ".join([*around[:at], *words_with_changes(item, r.uniform(0.02, 0.45), r), *around[at:]]).decode("utf-8", "replace")))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find(frame, spark.createDataFrame(bench)).collect()}
    want, planted = set(), 0
    for item in bench:
        said, answer = decontaminate.words_of(item.text), decontaminate.answer_of(item.text)
        have = Counter(said)
        for doc, text in docs:
            words = decontaminate.words_of(text)
            if sum((have & Counter(words)).values()) < 0.55 * len(said):
                continue
            for start in decontaminate.starts(len(words)):
                part = words[max(0, start - len(said)) : start + decontaminate.WIDTH + len(said)]
                share = decontaminate.lcs(said, part) / len(said)
                if share >= 0.7 or (share >= 0.55 and decontaminate.lcs(answer, part) >= 0.8 * len(answer)):
                    want.add((doc, item.item_id))
                    break
    planted = {w for w in want if w[0] >= 10**6}
    print("recall", len(got & want), "of", len(want), "planted", len(planted))
    assert len(planted) >= 150 and got <= want and len(got & want) >= 0.95 * len(want)
