import random

from pyspark.sql import functions as F

from kestrel.operators import metrics as J


def brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def brute_ap(rows):
    P = sum(y for _, y in rows)
    ap = 0.0
    for t in sorted({s for s, _ in rows}, reverse=True):
        sel = [(s, y) for s, y in rows if s >= t]
        tp = sum(y for _, y in sel)
        new = sum(y for s, y in rows if s == t)
        ap += new / P * tp / len(sel)
    return ap


def test_auc_ap_match_brute_force_with_ties(spark):
    rnd = random.Random(7)
    rows = [(float(rnd.randint(0, 9)), int(rnd.random() < 0.3)) for _ in range(400)]
    df = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate(rows)],
                               "row_id long, score double, label int")
    auc = J.auc_roc(df).first().auc_roc
    ap = J.average_precision(df).first().auc_pr
    assert abs(auc - brute_auc(rows)) < 1e-12
    assert abs(ap - brute_ap(rows)) < 1e-12
    rev = J.auc_roc(df.withColumn("score", -F.col("score"))).first().auc_roc
    assert abs(rev - (1 - auc)) < 1e-12


def test_prf_at_k_hash_ties_and_nan_guard(spark):
    import hashlib
    rows = [(i, float(i % 3), int(i % 4 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, score double, label int")
    k = sum(y for _, _, y in rows)
    order = sorted(rows, key=lambda r: (-r[1], hashlib.md5(f"0|{r[0]}".encode()).hexdigest(), r[0]))
    tp = sum(y for _, _, y in order[:k])
    got = J.prf_at_k(df).first()
    assert abs(got.precision - tp / k) < 1e-12 and abs(got.recall - tp / k) < 1e-12
    pred = {r.row_id: r.predicted for r in J.predict_top_k(df).collect()}
    assert sum(pred.values()) == k
    assert {r[0] for r in order[:k]} == {i for i, p in pred.items() if p == 1}
    bad = df.withColumn("score", F.when(F.col("row_id") == 5, F.lit(float("nan")))
                        .otherwise(F.col("score")))
    vals = [r.value for r in J.evaluate(bad).collect()]
    assert vals == [0.0] * 5


def test_all_labels_equal_gives_null_auc_and_zero_f1(spark):
    df = spark.createDataFrame([(i, float(i), 0) for i in range(10)],
                               "row_id long, score double, label int")
    m = {r.metric: r.value for r in J.evaluate(df).collect()}
    assert m["F1"] == 0.0 and m["P"] == 0.0


def test_aggregate_splits_drops_incomplete_method(spark):
    rows = [("s1", "a", "AUC-ROC", 0.5), ("s2", "a", "AUC-ROC", 0.7), ("s1", "b", "AUC-ROC", 0.9)]
    m = spark.createDataFrame(rows, "split string, method string, metric string, value double")
    out = J.aggregate_splits(m).collect()
    assert [(r.method, round(r.mean, 9), round(r.std, 9)) for r in out] == [("a", 0.6, 0.1)]


def test_filter_methods_lora_rule(spark):
    rows = [("density_x_lora", 1.0), ("density_x", 2.0), ("density_y_lora", 3.0), ("raw_z", 4.0),
            ("rdp", 5.0), ("ecod", 6.0)]
    m = spark.createDataFrame(rows, "method string, value double")
    got = sorted((r.method, r.value) for r in J.filter_methods(m).collect())
    assert got == [("density_x", 2.0), ("density_y", 3.0), ("ecod", 6.0)]


def test_auc_matches_spark_ml_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rnd = random.Random(11)
    rows = [(i, rnd.random(), int(rnd.random() < 0.2)) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, score double, label int")
    ours = J.auc_roc(df).first().auc_roc
    ml = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label",
                                       metricName="areaUnderROC").evaluate(
        df.withColumn("label", F.col("label").cast("double")))
    assert abs(ours - ml) < 1e-9


def test_misclassified_all_covers_every_method(spark):
    """Every method with finite scores only has its rows; one method alone is ``j05_misclassified``."""
    from kestrel.plans import catalog
    from tests.conftest import SF001
    rows = [tuple(r) for r in catalog.QUERIES["j05_misclassified_all"](spark, SF001).collect()]
    one = [tuple(r) for r in catalog.QUERIES["j05_misclassified"](spark, SF001).collect()]
    assert {"zscore", "nation_rarity"} <= {r[2] for r in rows}
    assert sorted(r for r in rows if r[2] == "nation_rarity") == sorted(one)


def test_overlap_compares_values_exactly(spark):
    from kestrel.operators import metrics as J
    kind = "x string, y string"
    train = spark.createDataFrame([(None, "p"), ("a|b", "c"), ("u", "v")], kind)
    test = spark.createDataFrame([("", "p"), ("a", "b|c"), ("u", "v"), (None, "p")], kind)
    assert {tuple(r) for r in J.remove_overlap(train, test).collect()} == {("", "p"), ("a", "b|c")}
    assert J.overlap(test, train).count() == 2
    assert J.check_no_overlap(train, test.where("x = 'a'")).first()["n_overlap"] == 0


def test_top_anomalies_of_each_group(spark):
    scores = spark.createDataFrame([("m", i, float(i % 4)) for i in range(12)] + [("n", 3, 1.0)],
                                   "method string, row_id long, score double")
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(12)], "row_id long, name string")
    top = J.top_anomalies(scores, rows, "row_id", 4, ["method"])
    assert sorted((r.method, r["rank"], r.row_id, r.name) for r in top.collect()) == [
        ("m", 1, 3, "r3"), ("m", 2, 7, "r7"), ("m", 3, 11, "r11"), ("m", 4, 2, "r2"), ("n", 1, 3, "r3")]
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()
