"""Detectors, clustering, vectors and rounds against numpy or plain readings."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import annotate as G
from kestrel.operators import causal as CA
from kestrel.operators import detectors as L
from kestrel.operators import metrics as J
from kestrel.operators import scoring as I
from kestrel.operators import text as D
from kestrel.plans import prepare as P


def test_pca_score_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) @ np.array([[2, 1, 0], [0, 1, 1], [0, 0, 0.5]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double, c double")
    got = {r.row_id: r.score for r in L.pca_score(df, ["a", "b", "c"]).collect()}
    z = (x - x.mean(0)) / x.std(0)
    vals, vecs = np.linalg.eigh(np.cov(z.T))
    possible = []
    for signs in range(8):  # the sign of a component is arbitrary
        s = [1 if signs >> k & 1 else -1 for k in range(3)]
        possible.append(sum(np.linalg.norm(z - s[i] * vecs[:, i], axis=1) / (vals[i] / vals.sum()) for i in range(3)))
    ours = np.array([got[i] for i in range(400)])
    assert min(np.abs(ours - f).max() for f in possible) < 1e-6


def test_clusters_and_entropy_sample(spark):
    rows = [(i, 10 * (i % 3), 7 * (i % 3) + (i % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, a int, b int")
    found = CA.cluster_rows(df, ["a", "b"], 3).collect()
    assert len({(r.row_id % 3, r.cluster) for r in found}) == 3
    sample = CA.cluster_entropy_sample(df, ["a", "b"], ["b"], 5).collect()
    assert len(sample) == 5 and {r.sampling for r in sample} == {"cluster"}
    few = CA.cluster_entropy_sample(df.limit(20), ["a", "b"], ["b"], 5).collect()
    assert len(few) == 5 and {r.sampling for r in few} == {"random"}


def test_mean_word_vectors(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "zzz"), (3, None)], "row_id long, t string")
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "word string, vec array<double>")
    got = {r.row_id: list(r.vec) for r in D.mean_word_vectors(df, "row_id", ["t"], vec, 2).collect()}
    assert got[1] == pytest.approx([2 / 3, 1.0]) and got[2] == [0.0, 0.0] and got[3] == [0.0, 0.0]


def test_centroid_distance(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(list(map(float, r)), i % 5 == 0) for i, r in enumerate(x)], "v array<double>, bad boolean")
    got = I.centroid_distance(df, "v", F.col("bad")).first()
    bad = np.arange(50) % 5 == 0
    assert got.n_anomalies == 10
    assert got.mean_sq_distance == pytest.approx(((x[bad] - x[~bad].mean(0)) ** 2).sum(1).mean())


def test_forests_find_outliers(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(500, 2)), [[9.0, -9.0]]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double")
    # a random projection may fold the outlier onto others, so there it only ranks high
    for scored, above in ((L.iforest(df, ["a", "b"], n_trees=40, psi=64), 0),
                          (L.iforest(df.repartition(5), ["a", "b"], n_trees=40, psi=64), 0),
                          (L.random_rep_iforest(df, ["a", "b"], n_features=8, n_trees=40, psi=64), 25)):
        got = {r.row_id: r.score for r in scored.collect()}
        assert len(got) == 501 and all(0 < s < 1 for s in got.values())
        assert sum(s > got[500] for s in got.values()) <= above


def test_benchmark_keeps_failures(spark):
    df = spark.range(40).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("a"))
    labels = df.select("row_id", (F.col("row_id") > 35).cast("int").alias("label"))

    def broken(data, cols):
        raise RuntimeError("no fit")
    out = L.run_benchmark({"d": lambda: (df, labels, ["a"])},
                          {"same": lambda data, cols: data.select("row_id", F.col("a").alias("score")), "broken": broken},
                          lambda s: J.evaluate(s, "score", "label", "row_id")).collect()
    assert {r.status for r in out if r.method == "same"} == {"ok"}
    failed, = [r for r in out if r.method == "broken"]
    assert failed.status == "RuntimeError: no fit" and failed.dataset == "d"


def test_rounds_stop_and_count(spark):
    rows = [(i, i % 2, (i + i // 7) % 2, i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, f1 int, f2 int, f3 int")
    proposals = spark.createDataFrame(
        [(1, "f1", [0, 1], False), (1, "f2", [0, 1], True), (2, "f2", [0, 1], True), (2, "f3", [0, 1, 2], False),
         (3, "f1", [0, 1], True)], "round int, name string, possible_values array<int>, focus boolean")
    out = G.run_rounds(df, proposals, lambda d, new: G.annotate_by_rules(d, {n: F.col(n) for n, _ in new}, keep=["row_id"]),
                       lambda a, names: set(names), lambda a, names: names, lambda a, names: len(names)).collect()
    assert [(r["round"], r.n_new, r.n_kept, r.stop_reason) for r in out] == [(1, 2, 2, None), (2, 1, 2, "few new factors")]
    assert math.isclose(sum(r.n_edges for r in out), 4)


def test_a_deleted_factor_comes_back(spark):
    """f3 is deleted in round 1 and proposed again in round 2, f1 is left out of round 2 and returns in
    round 3: each is annotated once, and all three rounds run."""
    rows = [(i, i % 2, (i + i // 7) % 2, i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, f1 int, f2 int, f3 int")
    plan = {1: ["f1", "f3"], 2: ["f2", "f3"], 3: ["f1", "f2", "f3"]}
    proposals = spark.createDataFrame([(r, n, [0, 1, 2], True) for r, names in plan.items() for n in names],
                                      "round int, name string, possible_values array<int>, focus boolean")
    asked, seen = [], []

    def annotate_round(d, new):
        asked.append(sorted(n for n, _ in new))
        return G.annotate_by_rules(d, {n: F.col(n) for n, _ in new}, keep=["row_id"])

    def confirm(a, names):
        seen.append(sorted(a.columns))
        assert a.select("row_id", *names).count() == 60
        return {n for n in names if n != "f3"} if len(seen) < 3 else set(names)
    out = G.run_rounds(df, proposals, annotate_round, confirm, lambda a, names: names, lambda a, names: len(names),
                       min_new=1).collect()
    assert asked == [["f1", "f3"], ["f2"]]
    assert seen == [["f1", "f3", "row_id"]] + [["f1", "f2", "f3", "row_id"]] * 2
    assert [(r["round"], r.n_new, r.n_kept, r.n_deleted, r.stop_reason) for r in out] == [
        (1, 2, 1, 1, None), (2, 2, 1, 1, None), (3, 2, 3, 0, None)]


def test_feature_matrix_text_encodings(spark):
    rows = [(i, "red" if i % 2 else "blue", float(i), "alpha beta " * 3 if i % 3 else "gamma gamma delta") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, colour string, size double, note string")
    for encoding, width in (("none", 0), ("tfidf", 4), ("bag_of_words", 4), ("word2vec", 6)):
        out = P.to_feature_matrix(df, "row_id", method="one_hot", text_encoding=encoding, text_cols=["note"],
                                  vector_size=6).collect()
        assert len(out) == 60 and {len(r.features) for r in out} == {2 + width}
        size = np.array([r.features[0] for r in sorted(out)])
        assert abs(size.mean()) < 1e-9 and size.std() == pytest.approx(1)


def test_rare_words_have_vectors(spark, tmp_path):
    """Rows made of words seen once get a vector in both queries that fit word vectors."""
    from kestrel.plans import catalog
    texts = ["only once", "never again", "here said", None]
    spark.createDataFrame([(1, i, ["user", "bot"][i % 2], t) for i, t in enumerate(texts)],
                          "conv_id long, turn int, role string, text string") \
        .write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.row_id: list(r.vec) for r in catalog.QUERIES["d04_mean_word_vectors"](spark, str(tmp_path)).collect()}
    assert all(any(got[1000 + i]) for i in range(3)) and not any(got[1003])
    rows = catalog.QUERIES["c12_feature_matrix_vectors"](spark, str(tmp_path)).collect()
    assert {r.row_id: any(list(r.features)[-16:]) for r in rows} == {1000: True, 1001: True, 1002: True, 1003: False}


def test_many_words_are_fitted_in_parts(spark, monkeypatch):
    """Word vectors of more words than a part holds are fitted by several tasks; few words by one."""
    import pyspark.ml.feature as ml
    from kestrel.operators import text as D
    parts = []

    fit = ml.Word2Vec.fit

    def recorded(self, data, params=None):
        parts.append(self.getNumPartitions())
        return fit(self, data, params)

    monkeypatch.setattr(ml.Word2Vec, "fit", recorded)
    monkeypatch.setattr(D, "PART_WORDS", 100, raising=False)
    df = spark.createDataFrame([(i, f"alpha w{i} beta w{i % 50}") for i in range(100)] + [(100, None)], "id long, t string")
    many = {r.word: r.vec for r in D.fit_word_vectors(df, ["t"], 4, min_count=1).collect()}
    assert len(many) == 102 and all(len(v) == 4 and any(v) for v in many.values())
    D.fit_word_vectors(df.where("id < 10"), ["t"], 4, min_count=1).count()
    D.fit_word_vectors(df.where("id = 100").unionByName(df.where("id = 5")), ["t"], 4, min_count=1).count()
    assert parts == [4, 1, 1]
