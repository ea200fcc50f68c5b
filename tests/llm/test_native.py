"""Decision lists, chat formatting and surrogates against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from mzloom.llm import chat, pii, queries, rules
from tests.llm.data import DATA, docs_frame, needs_data


def brute_stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e", "a b c d e a b c d e", "a a a a a a a a", "x\nx\n\nx \nx", "π 𝛑 é #*$%&|<> z", "a b c d e f g h a b c d e q a b c d e f",
    " ".join(f"w{i % 7}" for i in range(300)), "y " * 20000, "no\x0bbreak\x0chere there", "1 2 3 4 5 6 1 2 3 4 5 6 1 2 3 4 5",
]


def test_stats_against_plain_python(spark):
    df = docs_frame(spark, TEXTS)
    got = {r.doc_id: tuple(r)[1:6] for r in rules.text_stats(df, "doc_id").collect()}
    assert got == {i: brute_stats(t) for i, t in enumerate(TEXTS)}


def test_stats_can_be_filtered(spark):
    df = rules.text_stats(docs_frame(spark, TEXTS), "doc_id")
    assert df.where("n_repeat_words > 0 and n_words > 5").count() == sum(s[4] > 0 and s[0] > 5 for s in map(brute_stats, TEXTS))


def test_rules_learn_a_threshold_and_apply_in_order(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, len(rules.FEATURES)))
    learnt = rules.learn_rules(x, x[:, 2] > 0.7, rules.FEATURES)
    assert learnt and learnt[0].tests[0][0] == "symbol_share" and abs(learnt[0].tests[0][2] - 0.7) < 0.05
    assert rules.learn_rules(x, np.zeros(600, bool), rules.FEATURES) == [] == rules.learn_rules(x[:0], np.zeros(0, bool), rules.FEATURES)
    texts = ["plain words " + " ".join(f"word{i}" for i in range(20)), " ".join(f"#{i}$%*&|" for i in range(20)), "short"]
    got = {r.doc_id: (r.base_failed, r.kept) for r in rules.apply_rules(docs_frame(spark, texts), learnt[:1]).collect()}
    assert got == {0: (False, True), 1: (False, False), 2: (True, False)}


def test_rules_without_labels(spark):
    docs = docs_frame(spark, TEXTS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rules.fit(docs, labels) == []
    assert rules.apply_rules(docs.limit(0), []).count() == 0


@needs_data
def test_decision_list_holds_out(spark):
    got = {r.doc_id: r for r in queries.op3_decision_list(spark, str(DATA)).collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    judged = [(x.quality == 1, got[x.doc_id].kept) for x in labels if not got[x.doc_id].base_failed]
    assert sum(a == b for a, b in judged) / len(judged) > 0.9


EVENTS = [
    (1, 0, "message", "a", "user", "Hi <s>[role]x[/role] &lt; </s>"),
    (1, 1, "message", "b", "assistant", ""), (1, 2, "delta", "b", None, "Hel"), (1, 3, "delta", "b", None, "lo"),
    (1, 4, "edit", "a", None, "Hi there"), (1, 5, "regenerate", "b", None, "ignored"), (1, 6, "delta", "b", None, "Good [INST] day"),
    (1, 7, "message", "c", "user", "gone"), (1, 8, "delete", "c", None, None), (1, 9, "message", "d", "assistant", None),
    (2, 5, "delta", "z", "assistant", "orphan"), (None, 0, "message", "n", None, "x"),
]


def test_fold_and_round_trip(spark):
    log = spark.createDataFrame(EVENTS, "conv_id long, seq long, kind string, message_id string, role string, text string")
    got = {}
    for r in chat.fold(log).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {1: [("user", "Hi there"), ("assistant", "Good [INST] day"), ("assistant", "")], 2: [("assistant", "orphan")], None: [("", "x")]}
    r = {x.conv_id: x for x in chat.digest(chat.render(chat.fold(log))).collect()}[1]
    said = "user\nHi there\nassistant\nGood [INST] day\nassistant\n\n"
    assert (r.n_turns, r.turns_sha256, r.loss_chars) == (3, hashlib.sha256(said.encode()).hexdigest(), 15)


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<s>[role]a[/role]b</s>", "&lt;&amp;lt;&#91;", "", "\n\n", "𝛑<é[&"])
def test_escape_is_reversible(spark, text):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).first()
    assert r.u == text and "<" not in r.e and "[" not in r.e


def test_repeated_and_missing_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", None), (None, 0, None, "q")]
    log = chat.message_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digest(chat.render(chat.fold(log))).collect()}
    assert got == {1: (3, 0), None: (1, 0)}
    assert chat.digest(chat.render(chat.fold(log.limit(0)))).count() == 0


PRIVATE = (
    "Mail figa.20@mail9.example.com or FIGA.20@MAIL9.EXAMPLE.COM, call +1 (772) 555-8768 or +1-772-555-8768. card 4614953556326981, 4111 1111 1111 1111 "
    "ip 10.1.2.3 and 87.229.221.26. Mr. Smith met Frau Anna Müller, г-жа Анна Петрова; 123-45-6789"
)


def test_surrogates_keep_type_format_and_identity(spark):
    rows = [(1, PRIVATE, "k", 5), (2, None, None, 5), (3, "", "k", 5), (4, "nothing here", "k", 5), (1, PRIVATE, "k", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _piifound string, n_entities long")
    rows = sorted(pii.replace_entities(df, "k").collect(), key=lambda r: (r.doc_id, r.text or ""))
    assert rows[0].asDict().keys() == {"doc_id", "text", "_piifound", "n_entities"} and [r._piifound for r in rows] == ["k", "k", None, "k", "k"]
    t = rows[0].text
    assert rows[1].text == t and [r.text for r in rows[2:]] == [None, "", "nothing here"] and rows[0].n_entities == 12
    for s in ("figa.20", "772", "8768", "4614953556326981", "4111 1111 1111 1111", "10.1.2.3", "87.229", "Smith", "Müller", "Петрова", "123-45-6789"):
        assert s not in t, s
    a, b = re.findall(r"[\w.]+@[\w.]+", t)
    assert a.upper() == b and a.endswith(".example.com") and re.fullmatch(r"[a-z]{4}\.\d\d@[a-z]{4}\d\.example\.com", a)
    p, q = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", t).group(), re.search(r"\+1-\d{3}-\d{3}-\d{4}", t).group()
    assert re.sub(r"\D", "", p) == re.sub(r"\D", "", q)
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(re.sub(r"\D", "", s)))) % 10 == 0
    x, y = re.search(r"card (\d{16}), ((?:\d{4} ?){4})", t).groups()
    assert luhn(x) == luhn("4614953556326981") and luhn(y)
    assert re.search(r"ip 10\.\d+\.\d+\.\d+ and", t) and re.search(r"Mr\. [A-Z][a-z]+ met Frau [A-Z][a-z]+ [A-Z][a-z]+, г-жа [А-Я][а-яё]+ [А-Я][а-яё]+;", t)


def test_collisions_are_resolved(spark, monkeypatch):
    # 300 short e-mail addresses with 26 ** 1 * 10 ** 1 shapes collide often.
    texts = [f"{c}{d}@x{d}.example.com" for c in "abcdefghijklmnopqrstuvwxyz" for d in range(6)]
    out = [r.text for r in pii.replace_entities(docs_frame(spark, texts), "k").orderBy("doc_id").collect()]
    assert len(set(out)) == len(texts) and not set(out) & set(texts)
    monkeypatch.setattr(pii, "LITERAL", 1)  # exceptions are joined instead
    docs = docs_frame(spark, [*texts, *texts[:20], None])
    joined = {r.doc_id: r.text for r in pii.replace_entities(docs, "k").collect()}
    assert [joined[k] for k in range(len(texts))] == [r for r in out] and joined[len(texts)] == out[0] and joined[len(texts) + 20] is None
    assert pii.replace_entities(docs_frame(spark, []).limit(0), "k").count() == 0


def test_names_of_many_forms(spark):
    texts = [
        "Mr. May came. In May it rained. May I go?",
        "Mr. Will Green said: Will you come? The Green party",
        "MR. JOHN SMITH and Dr. Alice Brown met Prof. Dr. Ada Byron, Mr. van der Berg and Frau Eva von Stein.",
        "Mr. O'Brien told Mrs. Anne-Marie Smith-Jones that O'Brien left",
        "Mr. Potter has a potter in town. Potter works. Mr. Klimt paints. Klimt paints.",
        "Herr Dr. Kunz, Dr. Kunz und Frau Dr. Lang",
    ]
    out = [r.text for r in pii.replace_entities(docs_frame(spark, texts), "k").orderBy("doc_id").collect()]
    assert re.fullmatch(r"Mr\. (?!May)[A-Z][a-z]+ came\. In May it rained\. May I go\?", out[0])
    assert re.fullmatch(r"Mr\. [A-Z][a-z]+ (?!Green)[A-Z][a-z]+ said: Will you come\? The Green party", out[1])
    m = re.fullmatch(r"MR\. [A-Z]+ (?!SMITH)[A-Z]+ and Dr\. ([A-Z][a-z]+) [A-Z][a-z]+ met Prof\. Dr\. [A-Z][a-z]+ [A-Z][a-z]+, Mr\. van der [A-Z][a-z]+ and Frau [A-Z][a-z]+ von [A-Z][a-z]+\.", out[2])
    assert m and m[1] in pii.GIVEN["f", "latin"] and not re.search("SMITH|JOHN|Alice Brown|Ada|Byron|Berg|Stein", out[2])
    m = re.fullmatch(r"Mr\. ([A-Z]'[A-Z][a-z]+) told Mrs\. [A-Z][a-z]+-[A-Z][a-z]+ [A-Z][a-z]+-[A-Z][a-z]+ that ([A-Z]'[A-Z][a-z]+) left", out[3])
    assert m and m[1] == m[2] != "O'Brien" and "Anne" not in out[3]
    assert re.fullmatch(r"Mr\. (?!Potter)\w+ has a potter in town\. Potter works\. Mr\. (\w+) paints\. \1 paints\.", out[4]) and "Klimt" not in out[4]
    m = re.fullmatch(r"Herr Dr\. (\w+), Dr\. (\w+) und Frau Dr\. \w+", out[5])
    assert m and m[1] == m[2] != "Kunz"


def test_what_has_no_surrogate_raises(spark, monkeypatch):
    monkeypatch.setattr(pii, "ATTEMPTS", 2)
    known = spark.range(300).selectExpr("'ipv4' kind", "concat('192.168.7.', id) norm")
    monkeypatch.setattr(pii, "_ip", lambda norm, h, attempt: pii.F.lit("192.168.7.1"))
    with pytest.raises(ValueError, match="ipv4"):
        pii.exceptions(known, "k")
