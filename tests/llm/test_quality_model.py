"""Quality classifier: held-out accuracy, the class prior, and odd input."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import quality_model as qm


def auc(scores, good):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    for v in np.unique(scores):
        at = np.searchsorted(scores[order], [v, np.nextafter(v, np.inf)])
        rank[scores == v] = (at[0] + at[1] + 1) / 2
    n = good.sum()
    return (rank[good].sum() - n * (n + 1) / 2) / (n * (len(good) - n))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = qm.quality_scores(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert out.count() == docs.count()
    rows = out.where("held_out").join(labels, "doc_id").where("quality is not null").collect()
    score, good = np.array([r["score"] for r in rows]), np.array([r["quality"] == 1 for r in rows])
    assert auc(score, good) > 0.97
    predicted = np.array([r["predicted"] == 1 for r in rows])
    assert predicted[good].mean() > 0.97 and (~predicted[~good]).mean() > 0.75


def test_prior_and_risk(spark):
    """A mixture of known share: the prior comes near it."""
    rng = np.random.default_rng(3)
    def text(good):
        words = ["plain", "words", "of", "a", "sentence", "that", "goes", "on"]
        return " ".join(str(rng.choice(words)) + ("" if good else "###") for _ in range(rng.integers(20, 60)))
    rows = [(i, text(rng.random() < 0.7)) for i in range(3000)]
    good = {i: "###" not in t for i, t in rows}
    labels = spark.createDataFrame([(i, 1) for i, g in good.items() if g and rng.random() < 0.5], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    measured = qm.measure_documents(docs)
    *_, prior = qm.learn(measured, labels)
    assert abs(prior - 0.7) < 0.05
    got = {r["doc_id"]: r["predicted"] for r in qm.quality_scores(docs, labels).collect()}
    assert np.mean([got[i] == g for i, g in good.items()]) > 0.99


def test_labels_of_the_held_out_third_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn("quality", F.when(qm.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in qm.quality_scores(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in qm.quality_scores(docs, flipped).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_odd_input(spark, odd_documents, no_documents):
    kind = "doc_id long, quality int"
    labels = spark.createDataFrame([(i, 1) for i in range(12)] + [(None, 1), (5, None), (6, 0), (7, 1)], kind)
    df = odd_documents.withColumn("score", F.lit("x")).withColumn("quality", F.lit(0))
    out = qm.quality_scores(df, labels).collect()
    assert len(out) == odd_documents.count()
    assert all(0.0 <= r["score"] <= 1.0 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    none = qm.quality_scores(df, spark.createDataFrame([], kind)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert qm.quality_scores(no_documents, labels).count() == 0


@pytest.mark.parametrize("text", ["", "a", "\n", "é" * 3_000_000, "x y " * 400_000])
def test_measures_of_whole_texts(text):
    x = qm.measures_of(text)
    assert x.shape == (qm.WIDTH,) and np.isfinite(x).all()
    if text:
        assert abs(x[qm.OTHERS:qm.OTHERS + qm.KINDS].sum() - 1) < 1e-4
        assert len(text.encode()) < 2 or abs(x[qm.OTHERS + qm.KINDS:].sum() - 1) < 1e-4
