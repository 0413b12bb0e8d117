"""Counts against a brute-force reading of the contract; thresholds; odd input."""
import re
from collections import Counter

from kestrel.llm import quality
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


def test_counts_match_brute_force(spark, odd_documents):
    got = quality.judge(odd_documents).collect()
    assert len(got) == odd_documents.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and not r.broken)


def test_repeats_lines_and_overlaps(spark):
    w = [f"u{i}" for i in range(40)]
    texts = [" ".join(w[:8] * 3), " ".join(w[:20] + w[5:16] + w[20:]), " ".join(["a"] * 25),
             "x\nx\n \ny\r\nx", " ".join(w[:9] + ["z"] + w[:9])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.judge(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])


def test_thresholds_and_clean_prose(spark):
    prose = "The ship left the harbour and the crew was glad to be on the open sea with a good wind. " \
            "It is a long way from here, and that makes the voyage one for patient sailors."
    junk = " ".join("buy*** now### $$$win %%%".split() * 2 + [f"k{i}$$$" for i in range(30)])
    df = spark.createDataFrame([(1, prose), (2, junk)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert got[1].kept and not got[1].broken
    assert not got[2].kept and "symbols_per_word" in got[2].broken
    lax = {r.doc_id: r.kept for r in quality.judge(df, thresholds=[("n_words", 20, None)]).collect()}
    assert lax == {1: True, 2: True}


def test_empty_table_and_clashing_columns(spark, no_documents):
    assert quality.judge(no_documents).count() == 0
    df = spark.createDataFrame([(1, ODD[3], "mine", "yours")], "doc_id long, text string, kept string, __text string")
    row = quality.judge(df).first()
    assert row["__text"] == "yours" and row.kept is False


def test_plan_has_no_python(spark, odd_documents):
    plan = quality.judge(odd_documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
