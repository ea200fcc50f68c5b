"""Token counts, prefix tries and filter audits against plain loops and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest

from mzloom.llm import audit, prefixes, tokencount
from mzloom.llm.queries import ORACLES, QUERIES
from tests.llm.data import DATA, docs_frame, needs_data

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@needs_data
@pytest.mark.parametrize("name", [n for n in ORACLES if n.startswith(("op11", "op13"))])
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_same_rows_as_sql(spark, name, size):
    con = duckdb.connect()
    for f in (DATA.parent / size).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    a, b = QUERIES[name](spark, str(DATA.parent / size)).toPandas(), con.sql(ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


# --- token counts -----------------------------------------------------------------------------


def _odd_texts():
    r = random.Random(5)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "\r\n", "▁", "7", "2024", "é", "漢字", "\U0001f600", "<s>", "</s>", "<unk>", "<0x0A>", "　", " ", "\x00", "́", "-", "|", "=", "w" * 40]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(300)]


def test_token_counts_of_odd_texts(spark):
    texts = [*_odd_texts(), None, "", " ", "\n", "▁", "5", "a" * 300_000, " " * 300_000, "\n" * 250_001, "word " * 120_000, " x\n1" * 90_000]
    path = tokencount.default_path()
    docs = docs_frame(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 3")).selectExpr("nullif(doc_id, 0) doc_id", "text", "fp", "1 n_tokens").repartition(3)
    model = tokencount.pretokens(path).model
    want = sorted((-1 if k == 0 else k, len((t or "").encode()), len(model.encode(t or ""))) for k, t in [*enumerate(texts), (3, texts[3])])
    for most in (tokencount.FREQUENT, 5):
        got = tokencount.count_tokens(docs, path, limit=10, most=most).collect()
        assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_bytes, x.n_tokens) for x in got) == want
        assert all(x.over_limit == (x.n_tokens > 10) for x in got)
    assert tokencount.count_tokens(docs.limit(0), path).collect() == []


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE", 3)
    path = tokencount.default_path()
    pre, lengths = tokencount.pretokens(path), tokencount.Lengths([" the"], b"\x01", path)
    for text in _odd_texts():
        parts = [t for part in pre.split(text) for t in part]
        assert lengths.total([parts]) == [len(pre.model.encode(text))]
    assert " the" in lengths.live and not any(len(t) > tokencount.LONGEST for t in lengths.live)


def test_frequent_pretokens_survive_trimming(spark, monkeypatch):
    monkeypatch.setattr(tokencount, "GROWING", 50)
    monkeypatch.setattr(tokencount, "SKETCH", 20)
    r = random.Random(1)
    words = [f"rare{k}" for k in range(3000)] + ["often"] * 900 + ["common"] * 600
    r.shuffle(words)
    docs = docs_frame(spark, [" ".join(words[k : k + 50]) for k in range(0, len(words), 50)]).repartition(4)
    found = tokencount.frequent(docs, tokencount.default_path(), 10)
    assert len(found) <= 10 and " often" in found and " common" in found
    assert found[" often"] <= 900


def test_trim_is_misra_gries():
    got = tokencount.trim({"a": 9, "b": 5, "c": 4, "d": 4, "e": 1}, 2)
    assert got == {"a": 5, "b": 1}


@needs_data
def test_token_counts_of_whole_tables(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    model = tokencount.pretokens(tokencount.default_path()).model
    got = {x.doc_id: x for x in QUERIES["op12_token_counts"](spark, str(DATA)).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for x in rows:
        n = len(model.encode(x.text or ""))
        assert (got[x.doc_id].n_bytes, got[x.doc_id].n_tokens, got[x.doc_id].over_limit) == (len((x.text or "").encode()), n, n > 4096)


# --- prefix trie ------------------------------------------------------------------------------


def _plain_trie(rows):
    told = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            told[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    for c in told:
        told[c] = [(x[2], x[4]) for x in sorted(told[c])]
    made = {}
    for c in told:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = tuple(told.get(base, [])[:h] + told[c][h:])
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = set()
    for node, held in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below) for x in below)
        saved = sum((len(members[x]) - 1) * (len(WORD.findall(x[-1][1])) if x else 0) for x in below)
        ends = ",".join(map(str, sorted(c for c in held if len(made[c]) == len(node))))
        out.add((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_trie_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK", 8)
    r = random.Random(11)
    rows = []
    for c in [*range(0, 90), *range(-25, -3), 2**40, 2**62]:
        if c in (40, 60):  # families without a first conversation
            continue
        n = r.choice([1, 1, 2, 3, 5])
        rows += [(c, r.choice([k, k, None]), r.choice(["user", "assistant", None, ""]), r.choice(["", None, "a b", "a", "b\n c d", "a b"])) for k in range(n)]
    rows += [(None, 0, "user", "lost"), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, 1, "user", "other")]
    frame = spark.createDataFrame([(*x, "x", 1) for x in rows], "conv_id long, turn long, role string, text string, digest string, depth int")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [tuple(x[n] for n in names) for x in prefixes.trie(frame.repartition(5)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == _plain_trie(rows)
    assert prefixes.trie(frame.limit(0)).collect() == []


def test_a_long_conversation_is_a_linear_job(spark):
    n = 3000
    rows = spark.range(n).selectExpr("0L conv_id", "id turn", "'user' role", "concat('t', id) text").unionByName(
        spark.range(n).selectExpr("20L + id * 20 conv_id", "0L turn", "'user' role", "'t0' text"))
    assert prefixes.rebuilt(rows).count() == (n + 1) + 2 * n
    got = {x.depth: x for x in prefixes.trie(rows).where("conv_id = 0").collect()}
    assert len(got) == n + 1
    assert (got[0].n_leaves, got[0].n_convs, got[0].saved_tokens) == (1, n + 1, n)
    assert (got[1].n_leaves, got[1].n_convs, got[n].saved_tokens) == (1, n + 1, 0)
    ends = ",".join(str(20 + 20 * k) for k in range(n))
    assert got[1].ends_sha256 == hashlib.sha256(ends.encode()).hexdigest()


# --- filter audit -----------------------------------------------------------------------------


def _plain_audit(rows, labels):
    good, bad = ({d for d, *q in labels if d is not None and q[k] == 1} for k in (0, 1))
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    docs = defaultdict(list)
    for d, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {f for f, x in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)))) if x}
        docs[lang or ""].append((fails | {"E"} if d is not None and d > first[t] else fails, d in good, d in bad))
    out, shapley = {}, Counter()
    for part, held in docs.items():
        for order in permutations("ABCDE"):
            left = held
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                early = sum(f in x[0] and bool(x[0] & set(order[: step - 1])) for x in held)
                left = [x for x in left if f not in x[0]]
                out[part, "".join(order), step] = (len(left), len(gone), early, sum(x[0] == {f} for x in held), sum(x[1] for x in gone), sum(x[2] for x in gone))
                shapley[part, f] += len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("bits", [64, 1])
def test_audit_against_plain_loops(spark, bits):
    r = random.Random(9)
    base = [" ".join(r.choice(["aB", "CD", "e", "f#", "ñ", f"w{k}"]) for k in range(n)) for n in (0, 1, 5, 60, 210, 250, 900, 9000)]
    base += [base[-1][:-1] + "!", base[-1][:40] + "?" + base[-1][41:], "x" * 20_000, "x" * 19_999 + "y", "é" * 70, "e" * 70, "a b", "b a", " \n", ""]
    rows = [(r.randrange(90), r.choice([*base, None, base[3]]), r.choice(["en", "de", None, ""])) for _ in range(150)]
    rows += [(None, base[4], "en"), (None, base[4], "fr"), (200, base[4], "en"), (200, base[4], "en"), (-5, base[4], "en"), (200, base[5], "en")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1])) for k in range(0, 100, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*x, "x", 7) for x in rows], "doc_id long, text string, lang string, part string, mask int").repartition(5)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = [tuple(x[n] for n in names) for x in audit.audit(docs, told, bits).collect()]
    assert len(got) == 600 * 4
    assert set(got) == _plain_audit(rows, labels)
    assert audit.audit(docs.limit(0), told).collect() == []


def test_refinement_drops_what_is_alone(spark):
    texts = ["a" * 100, "a" * 100, "a" * 99 + "b", "b" * 100, "a" * 64 + "c" * 36, "short", "a" * 64 + "c" * 36 + "d"]
    slim = docs_frame(spark, texts).select("doc_id", audit.F.char_length("text").alias("length"), audit.block_hashes(audit.F.col("text")).alias("hashes"))
    assert sorted(x.doc_id for x in audit.refine(slim).collect()) == [0, 1]
