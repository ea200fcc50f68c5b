"""Packing, near duplicates, decontamination and the pipeline."""

import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

import corpus_pipeline
from mzloom.llm import decontaminate, packing, secrets, simhash, toxicity
from mzloom.operators.components import connected_components
from tests.llm.data import DATA, docs_frame, needs_data


def brute_components(values, ids, tau):
    root = list(range(len(values)))
    for _ in range(len(values)):
        moved = False
        for i, j in combinations(range(len(values)), 2):
            if (values[i] ^ values[j]).bit_count() <= tau and root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                moved = True
        if not moved:
            break
    return [min(ids[k] for k in range(len(root)) if root[k] == root[i]) for i in range(len(root))]


def test_fingerprint_by_definition():
    import xxhash

    text = "The quick BROWN fox É jumps\tover the quick brown fox"
    w = [x.encode() for x in text.replace("\t", " ").split(" ")]
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_links_find_every_pair(spark, tau, monkeypatch):
    rng = np.random.default_rng(tau)
    base = [int(x) for x in rng.integers(0, 2**63, 60, dtype=np.int64)]
    values = list(base)
    for b in base[:30]:
        for _ in range(3):
            v = b
            for bit in rng.choice(64, tau + 1, replace=False)[: rng.integers(1, tau + 2)]:
                v ^= 1 << int(bit)
            values.append(v)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = {frozenset((a, b)) for (a, x), (b, y) in combinations(zip(signed, values, strict=True), 2) if (x ^ y).bit_count() <= tau}
    assert {frozenset((r.a, r.b)) for r in simhash.links(df, tau).collect()} == want
    if tau < 3:  # crowded buckets are linked through masks: same components
        monkeypatch.setattr(simhash, "PAIR_LIMIT", 2)
        got = {r.node: r.component for r in connected_components(simhash.links(df, tau)).collect()}
        brute = dict(zip(signed, brute_components(values, signed, tau), strict=True))
        assert all(got.get(v, v) == brute[v] for v in signed if brute[v] != v or v in got)


def test_near_duplicates_of_odd_rows(spark):
    texts = [None, "", " ", "a b c d", "a b c d", "A B c d", "q r s t u", "z " * 9000]
    rows = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_frame(spark, texts)).collect()}
    assert rows == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}
    assert simhash.near_duplicates(docs_frame(spark, []).limit(0)).count() == 0
    none = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (5, "x y z")], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(none).collect()} == {5}


@needs_data
def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.collect()
    want = brute_components([simhash.fingerprint(r.text) for r in rows], [r.doc_id for r in rows], 2)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert [got[r.doc_id] for r in rows] == want


def test_plan_covers_the_threshold():
    rng = np.random.default_rng(0)
    for tau, rows, n in [(t, 500, 10**6) for t in (0, 1, 2, 3, 5)] + [(5, k, k) for k in (0, 1, 2)]:
        p = simhash.plan(rng.integers(0, 2**63, rows).astype(np.uint64), n, tau)
        assert sum(len(simhash._flips(m, t)) for m, t in p) < 10_000
        assert sum(t + 1 for _, t in p) == tau + 1
        assert all(a & b == 0 for (a, _), (b, _) in combinations(p, 2))


def test_tokens_are_those_of_tokenizers():
    from tokenizers import Tokenizer

    path = packing.default_path()
    t = Tokenizer.from_file(path)
    for text in ["Hello world", "é ß 𝛑 日本", "a<|endoftext|>b", "  two  spaces\n\n\ttab", "12345 don't I'll", "x" * 3000, "", "\x00\x7f"]:
        assert packing.token_ids(text, path).tolist() == [*t.encode(text, add_special_tokens=False).ids, 1], text


def test_knapsack_and_patterns():
    size, value = np.array([3, 5, 7]), np.array([0.3, 0.55, 0.7])
    best, counts = packing.knapsack(value, size, 10)
    want = max(a * 0.3 + b * 0.55 + c * 0.7 for a in range(4) for b in range(3) for c in range(2) if 3 * a + 5 * b + 7 * c <= 10)
    assert np.isclose(best, want) and counts @ size <= 10 and np.isclose(counts @ value, want)
    for seed in range(3):
        rng = np.random.default_rng(seed)
        hist = {int(s): int(rng.integers(1, 900)) for s in rng.choice(np.arange(1, 100), 25, replace=False)}
        got = packing.plan(hist, 100)
        sizes = sorted(hist)
        assert (sum(np.array(p) * t for p, t in got) == [hist[s] for s in sizes]).all() and all(np.array(p) @ sizes <= 100 for p, _ in got)
        least = -(-sum(s * n for s, n in hist.items()) // 100)
        cols, x = packing.column_generation(np.array(sizes), np.array([hist[s] for s in sizes], float), 100)
        assert least - 1e-6 <= x.sum() and sum(t for _, t in got) <= x.sum() * 1.01 + 26
    assert packing.plan({}) == []


def test_packing_round_trip(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", "word", "word", *[" ".join(f"tok{rng.integers(0, 99)}" for _ in range(int(n))) for n in rng.integers(1, 900, 60)], "long " * 5000]
    docs = docs_frame(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 2"))  # a repeated row
    rows = packing.pack(docs, keep_ids=True).collect()
    path = packing.default_path()
    whole: dict = {}
    for r in rows:
        whole.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for i, t in enumerate(texts):
        if i != 2:
            parts = sorted(whole[i], key=lambda r: r.start)
            assert [x for p in parts for x in p.ids] == packing.token_ids(t, path).tolist()
    assert len(whole[2]) == 2
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for s in seqs.values():
        end = 0
        for off, n in sorted(s):
            assert off == end
            end += n
        assert end <= 2048
    assert sum(r.length for r in rows) / (2048 * len(seqs)) > 0.93
    assert packing.pack(docs.limit(0)).count() == 0


def test_lcs():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = rng.integers(0, 5, rng.integers(0, 20)).tolist(), rng.integers(0, 5, rng.integers(0, 20)).tolist()
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = d[i, j] + 1 if a[i] == b[j] else max(d[i, j + 1], d[i + 1, j])
        assert decontaminate.lcs(a, b) == d[-1, -1]


def test_projection_is_a_sum_of_rows():
    rng = np.random.default_rng(4)
    table = np.vstack([rng.normal(size=(decontaminate.TERMS, 3)), np.zeros((1, 3))]).astype(np.float32)
    texts = [rng.integers(0, decontaminate.TERMS, n).astype(np.uint32) for n in (0, 1, 16, 31, 33, 100, 1)]
    got = {(int(w), int(a)): v for who, at, vec, _ in decontaminate.project(texts, table) for w, a, v in zip(who, at, vec, strict=True)}
    for k, ids in enumerate(texts):
        for s in decontaminate.starts(len(ids)):
            if (k, s) in got:
                assert np.allclose(got[k, s], table[ids[s : s + decontaminate.WIDTH]].sum(0), atol=1e-4)
        assert len(ids) == 0 or (k, 0) in got


@needs_data
def test_decontamination_recall_and_paraphrases(spark):
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    item = bench.orderBy("item_id").first()
    words = item.text.split()
    changed = " ".join("other" if k % 5 == 3 else w for k, w in enumerate(words))  # a fifth of the words replaced
    more = spark.createDataFrame([(10**6, "lead in words " * 9 + changed + " tail words" * 9), (10**6 + 1, None), (10**6 + 2, "")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs.select("doc_id", "text").unionByName(more), bench).collect()}
    w = {r.item_id: decontaminate.words_of(r.text) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        said = b" " + b" ".join(decontaminate.words_of(r.text)) + b" "
        want |= {(r.doc_id, i) for i, x in w.items() if b" " + b" ".join(x) + b" " in said}
    assert len(want & got) >= 0.9 * len(want) and len(want) > 5
    assert {g for g in got if g[0] < 10**6} <= want and (10**6, item.item_id) in got
    assert decontaminate.find(docs.limit(0), bench).count() == 0 and decontaminate.find(docs, bench.limit(0)).count() == 0


@needs_data
def test_pipeline_stages(spark):
    kept = spark.read.parquet(f"{DATA}/documents.parquet")
    names = kept.columns
    before = kept.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialise(stage(spark, kept, str(DATA)))
        assert kept.columns == names and 0 < kept.count() <= before, name
        before = kept.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(DATA))
    assert packed.select("doc_id").distinct().count() == kept.count()
    # Stage results against plain Python.
    groups = {r.doc_id for r in kept.collect()}
    assert len({simhash.fingerprint(r.text) for r in kept.collect()}) >= len(groups) - 5


def test_pipeline_on_odd_rows(spark, tmp_path):
    texts = [None, "", "fine words here", "fine words here", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and more words']
    docs = docs_frame(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 2"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {0, 2, 4} and len(rows) == 3
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("listed", [64, 3])
def test_open_pairs_are_made_once(spark, monkeypatch, listed):
    """Sets that share many buckets make one row a pair; with short lists some make more, but none is lost."""
    monkeypatch.setattr(simhash, "LISTED", listed)
    rng = np.random.default_rng(5)
    held = {i: sorted({int(x) for x in rng.choice(40, 12, replace=False)}) for i in range(60)}
    zero = [0] * (simhash.BITMAP // 64)
    heads = spark.createDataFrame([(i, 40, *zero) for i in held], "id long, size int, " + ", ".join(f"b{k} long" for k in range(len(zero))))
    members = spark.createDataFrame([(h, i) for i, hs in held.items() for h in hs], "h long, id long")
    comp = spark.createDataFrame([(1, 0), (2, 0), (0, 0)], "node long, component long")
    want = [(a, b) for a, b in combinations(sorted(held), 2) if set(held[a]) & set(held[b]) and b > 2]
    got = sorted((r.x, r.y) for r in simhash._open_pairs(members, comp, heads, 0.8).collect())
    assert got == want
    monkeypatch.setattr(DataFrame, "distinct", lambda df: df)
    made = simhash._open_pairs(members, comp, heads, 0.8).count()
    assert made == len(want) if listed == 64 else len(want) <= made < sum(len(set(held[a]) & set(held[b])) for a, b in want)


@needs_data
def test_near_copies_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    base = docs.where("length(text) > 900").orderBy("doc_id").limit(20).collect()
    near = [(10**6 + r.doc_id, " ".join(w for k, w in enumerate(r.text.split()) if k != 7)) for r in base]  # one word dropped
    docs = docs.unionByName(spark.createDataFrame(near, docs.schema))
    rows = docs.collect()
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text)) for r in rows}
    got = {r.row.id: r.component_id for r in simhash.near_copies(docs).collect()}
    pairs = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) >= 20 and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    linked = {x for p in pairs for x in p}
    assert sum(got[d] != d for d in got if d not in linked) <= 2


def plain_pipeline(rows, chain, items, forest):
    """What run() keeps of rows (doc_id, text), by plain loops: a list of (doc_id, text)."""
    rows = [(d, t) for d, t in rows if not (t and chain.probabilities(toxicity.features(t, chain.words)[None, :])[0, 1] >= chain.threshold)]
    sets = [set(simhash.shingle_hashes(t)) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    groups: dict = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i])
    rows = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]

    def leaks(text):
        words = decontaminate.words_of(text)
        for item in items:
            said, answer = decontaminate.words_of(item), decontaminate.answer_of(item)
            for start in decontaminate.starts(len(words)):
                part = words[max(0, start - len(said)) : start + decontaminate.WIDTH + len(said)]
                share = decontaminate.lcs(said, part) / len(said)
                if share >= 0.7 or (share >= 0.55 and decontaminate.lcs(answer, part) >= 0.8 * len(answer)):
                    return True
        return False

    out = []
    for d, t in rows:
        if not leaks(t):
            for a, b, _ in reversed(secrets.secrets_in(t, forest)):
                t = t[:a] + "[SECRET]" + t[b:]
            out.append((d, t))
    return out


@needs_data
def test_run_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(160)
    labels, bench = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").limit(6)
    items = [r.text for r in bench.collect()]
    base = [r.text for r in docs.where("length(text) between 800 and 3000").orderBy("doc_id").limit(12).collect()]
    near = [(10**6 + k, " ".join(w for j, w in enumerate(t.split()) if j != 5 + k)) for k, t in enumerate(base)]
    more = near + [(5, "one text under a doc_id that others have " + "and more of it " * 3), (5, "another text entirely, with words of its own, under the same number"), (None, "no number " + base[0]), (None, items[0]), (None, items[1] + " " + base[1])]
    more += [(10**6 + 50, base[2] + " " + items[2]), (10**6 + 51, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" in a text of its own'), (10**6 + 52, None), (10**6 + 53, ""), (10**6 + 54, "long " * 30_000), (None, "a row without number"), (None, "a row without number")]
    more += [(10**6 + 55, "a repeated row of the corpus here")] * 3
    whole = docs.unionByName(spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in more], docs.schema))
    whole.withColumn("row", F.lit("clash")).withColumn("_gone", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    chain = toxicity.fit(whole, labels)
    kept = plain_pipeline([(r.doc_id, r.text) for r in whole.collect()], chain, items, secrets.fit())
    path, want = packing.default_path(), []
    for d, t in kept:
        ids = packing.token_ids(t, path)
        want += [(d is None, d or 0, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for at in range(0, len(ids), 2048)]
    got = [(r.doc_id is None, r.doc_id or 0, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert {5} <= {d for d, _ in kept} and sum(d == 5 for d, _ in kept) >= 2 and sum(d is None for d, _ in kept) == 1


@pytest.mark.parametrize("space", [" ", "\n", " ", "　", " \t\n"])
def test_long_runs_of_white_space_are_packed(spark, space):
    path = packing.default_path()
    text = "start" + space * (2_000_000 // len(space)) + "end <|endoftext|> of it"
    want = packing.library(path).encode(text, add_special_tokens=False).ids
    assert packing.token_ids(text, path).tolist() == [*want, packing.END]


def test_counters_are_summed_over_all_tasks(spark):
    texts = ["a b c d e f g", "a b c d e", None, "", "x y", "a b c d e f g"] * 3
    want = np.zeros(simhash.COUNTERS, np.int64)
    for t in texts:
        np.add.at(want, simhash._counter(simhash._shingle_set(t, 5)), 1)
    docs = docs_frame(spark, texts)
    assert (simhash._frequencies(docs.repartition(5), 5) == want).all()
    assert not simhash._frequencies(docs.limit(0), 5).any()
