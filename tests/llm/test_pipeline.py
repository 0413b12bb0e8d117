"""The pipeline's stages on odd input, and their decisions on a small corpus."""
import corpus_pipeline as cp
import numpy as np

from kestrel.llm.common import written


def prose(rng, n, tag):
    words = ["the", "of", "and", "that"] * 25 + [f"{tag}{i}" for i in range(400)]
    return " ".join(rng.choice(words, n))


def test_stages(spark, odd_documents):
    rng = np.random.default_rng(2)
    # document 0 is one line, so that its near copy is no matter for the line dedup
    clean = [(i, ("\n" if i else " ").join(prose(rng, 30, f"d{i}x") for _ in range(3)), "en", f"s{i % 4}")
             for i in range(40)]
    near = clean[0][1].split(" ")
    near[10] = "changed"
    shared = "the and of " + " ".join(f"z{i}" for i in range(60))
    docs = clean + [(100, " ".join(near), "en", "s0"), (101, clean[1][1], "en", "s1"), (102, "too short", "en", "s0"),
                    (103, clean[2][1] + "\nown the line\n" + shared, "en", "s1"),
                    (104, shared + "\n" + prose(rng, 40, "q"), "en", "s2")]
    df = spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "bpe_encode"]
    seen = {}
    for name, stage in cp.STAGES:
        df = written(stage(spark, df, ""), name)
        seen[name] = df.collect()
        if name != "bpe_encode":
            assert tuple(df.columns) == cp.COLUMNS
    assert {r.doc_id for r in seen["quality_rules"]} == {d[0] for d in docs} - {102}
    lines = {r.doc_id: r for r in seen["line_dedup"]}
    assert 101 not in lines and lines[5].text == clean[5][1]
    assert shared in lines[103].text and shared not in lines[104].text
    assert all(r.n_chars == len(r.text) for r in lines.values())
    kept = {r.doc_id for r in seen["near_dedup"]}
    assert 100 not in kept and set(range(40)) <= kept
    assert {r.doc_id for r in seen["mix_sources"]} <= kept
    assert len(seen["bpe_encode"]) == len(seen["mix_sources"])
    assert all(r.n_tokens == len(r.ids) for r in seen["bpe_encode"])


def test_near_dedup_of_shared_doc_ids(spark):
    """Different texts that share a doc_id stay; only equal and near ones go."""
    rng = np.random.default_rng(6)
    a, b, c = (prose(rng, 80, t) for t in "abc")
    near_b = b.replace(b.split(" ")[40], "changed", 1)
    rows = [(7, a), (7, b), (7, c), (7, a), (8, near_b), (5, c), (None, a), (None, a)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0, r.text) for r in cp.near_dedup(spark, df, "").collect()))
    assert got == sorted([(7, a), (7, b), (5, c), (0, a), (0, a)])


def test_odd_and_empty(spark, odd_documents, no_documents):
    for df in (odd_documents, no_documents):
        for name, stage in cp.STAGES:
            out = stage(spark, df, "")
            n = out.count()
            assert n <= 2 * df.count()
            if name == "bpe_encode":
                assert n == df.count()
