"""Sketch differences against multiset differences; the report against brute force."""
import hashlib
from collections import Counter

import numpy as np

from kestrel.llm import fingerprint as fp


def pieces(text):
    return Counter(fp._PIECE.findall(text))


def likeness(a, b):
    a, b = pieces(a), pieces(b)
    whole = sum((a | b).values())
    return 1.0 if whole == 0 else sum((a & b).values()) / whole


def test_differences_recover_exactly():
    rng = np.random.default_rng(1)
    texts = [". ".join(" ".join(map(str, rng.integers(0, 20, rng.integers(1, 4)))) for _ in range(k))
             for k in [0, 1, 2, 5, 30, 200, 2000] * 3]
    d = fp.Digests(texts)
    left, right = rng.integers(0, len(texts), 60), rng.integers(0, len(texts), 60)
    with np.errstate(over="ignore"):
        found = fp.differences(d, d, left, right)
    for (only_a, only_b), a, b in zip(found, left, right):
        x, y = pieces(texts[a]), pieces(texts[b])
        assert (len(only_a), len(only_b)) == (sum((x - y).values()), sum((y - x).values()))


def test_blocked_peeling_falls_back():
    """Two equal digests on one side can never be peeled; the difference is still found."""
    d = fp.Digests(["a", "b. c"])
    d.keys[1:] = d.keys[1]
    with np.errstate(over="ignore"):
        (only_a, only_b), = fp.differences(d, d, np.array([0]), np.array([1]))
    assert len(only_a) == 1 and len(only_b) == 1


def test_report_matches_brute_force(spark, odd_documents):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        got = fp.fingerprint_report(odd_documents).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    tie = {(r.doc_id, r.text): r.h for r in odd_documents.selectExpr("doc_id", "text", "xxhash64(text) h").collect()}
    rows = sorted(((r.doc_id, r.text) for r in odd_documents.collect()),
                  key=lambda r: (r[0] is None, -(r[0] or 0), tie[r]))
    expected = []
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = text[:len(text) - len(text) // 3] + after[:len(text) // 3]
        expected.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(),
                         round(likeness(text, edited), 12), round(likeness(text, after), 12)))
    found = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 12), round(r.near_next, 12)) for r in got]
    assert Counter(found) == Counter(expected)
    prints = {}
    for r in got:
        if r.doc_id in (100, 101):
            prints[r.doc_id] = r.fingerprint
    assert prints[100] == prints[101]
    alone = {r.doc_id: r.fingerprint for r in fp.fingerprint_documents(odd_documents).collect()}
    assert alone[100] == prints[100]


def test_empty_and_single(spark, no_documents):
    assert fp.fingerprint_report(no_documents).count() == 0
    one = spark.createDataFrame([(7, "abcdef.")], "doc_id long, text string")
    r = fp.fingerprint_report(one).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcdeab").hexdigest()
