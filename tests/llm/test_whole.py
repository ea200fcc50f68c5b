"""Operators do the whole job: nothing is cut by length, size of a group or width of an index."""

import random
import string
from itertools import combinations
from pathlib import Path

import pytest

from mzloom.llm import secrets, simhash, toxicity
from tests.llm.data import docs_frame

LARGER = Path("/root/testdata/sf0.1")
needs_larger = pytest.mark.skipif(not LARGER.exists(), reason="no test tables here")


def jaccard(a, b):
    a, b = set(simhash.shingle_hashes(a)), set(simhash.shingle_hashes(b))
    return len(a & b) / len(a | b)


def test_drifting_copies_keep_all_links(spark):
    r = random.Random(5)
    words = [f"w{r.randrange(5000)}" for _ in range(300)]
    texts = []
    for k in range(200):
        texts.append(" ".join(words))
        for _ in range(1 + k % 7):
            words[r.randrange(300)] = f"n{r.randrange(10**6)}"
    r.shuffle(texts)
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in combinations(range(len(texts)), 2):
        if jaccard(texts[i], texts[j]) >= 0.8:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    got = {x.row.id: x.component_id for x in simhash.near_copies(docs_frame(spark, texts)).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


@needs_larger
def test_near_copies_far_apart_in_bits_are_found(spark):
    """Pairs of 0.8 or more whose word fingerprints differ in 6 to 8 bits."""
    pairs = [(4, 2540), (1004, 7065), (2789, 8154)]
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").where(f"doc_id in ({', '.join(str(x) for p in pairs for x in p)})")
    text = {x.doc_id: x.text for x in docs.collect()}
    assert all(jaccard(text[a], text[b]) >= 0.8 for a, b in pairs)
    got = {x.row.id: x.component_id for x in simhash.near_copies(docs).collect()}
    assert got == {x: a for a, b in pairs for x in (a, b)}


@needs_larger
def test_close_fingerprints_alone_do_not_merge(spark):
    """Pairs within 2 bits of each other's fingerprints, but below 0.8."""
    pairs = [(589, 6676), (385, 4738), (3, 212), (2528, 5966)]
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").where(f"doc_id in ({', '.join(str(x) for p in pairs for x in p)})")
    text = {x.doc_id: x.text for x in docs.collect()}
    for a, b in pairs:
        assert (simhash.fingerprint(text[a]) ^ simhash.fingerprint(text[b])).bit_count() <= 2 and jaccard(text[a], text[b]) < 0.8
    assert all(x.row.id == x.component_id and x.kept for x in simhash.near_copies(docs).collect())


def test_long_secrets_are_found_and_redacted(spark):
    r = random.Random(11)
    chars = string.ascii_letters + string.digits
    texts = [f'token = "{head}{"".join(r.choices(chars, k=n))}" and more words' for n in (513, 900, 1600, 4000) for head in ("", "ghp_", "eyJ")]
    forest = secrets.fit()
    assert all(len(secrets.candidates(t)) == 1 for t in texts)
    found = {x.doc_id: x for x in secrets.scan(docs_frame(spark, texts), forest).collect()}
    assert {k: (x.start, x.end) for k, x in found.items()} == {k: secrets.candidates(t)[0] for k, t in enumerate(texts)}
    assert {x.text for x in secrets.redact(docs_frame(spark, texts), forest).collect()} == {'token = "[SECRET]" and more words'}


def test_upper_case_share_covers_the_whole_text():
    for n in (100, 2001, 3999, 4000, 9000):
        text = "".join("A" if k % 4 == 1 else "É" if k % 4 == 3 and k < n // 2 else "b" for k in range(n))
        assert toxicity.statistics(text, 1)[1] == sum(c.isupper() for c in text) / n
