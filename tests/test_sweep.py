import pytest
from pyspark.sql import functions as F

from kestrel.operators.sweep import RESULT, Method, run_sweep


def split(rows, s):
    return rows.withColumn("split", F.when(F.col("row_id") % 2 == s, "train").otherwise("test"))


def encode(rows, encoding):
    if encoding == "none such":
        raise ValueError("unknown encoding")
    return rows.select("row_id", (F.col("a") * (10 if encoding == "ordinal" else 1)).alias("a"))


@pytest.mark.parametrize("workers", [1, 3])
def test_sweep_restarts_where_it_stopped(spark, tmp_path, workers):
    rows = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") > 35).cast("int").alias("label"),
                                  F.col("id").cast("double").alias("a"))
    fits, mended = [], []

    def fit(train, columns):
        fits.append(columns)
        return train.agg(F.avg("a").alias("m"))

    def away(model, train, test, columns):
        return test.crossJoin(model).select("row_id", F.abs(F.col("a") - F.col("m")).alias("score"))

    def moody(model, train, test, columns):
        if not mended:
            raise RuntimeError("no memory")
        return test.select("row_id", F.col("a").alias("score"))
    methods = {"away": Method(away, fit), "moody": Method(moody, encoding="one_hot"),
               "lost": Method(away, fit, "none such")}

    def sweep():
        out = run_sweep(spark, {"d": rows}, (0, 1), methods, split, encode, str(tmp_path / "runs"), workers)
        assert [f.name for f in out.schema] == [c.split()[0] for c in RESULT.split(", ")]
        return out.collect()
    first = sweep()
    assert len(fits) == 2 and fits[0] == ["a"]
    status = {(r.method, r.split): r.status for r in first}
    assert status == {(m, s): t for s in (0, 1) for m, t in (
        ("away", "ok"), ("moody", "RuntimeError: no memory"), ("lost", "ValueError: unknown encoding"))}
    auc = {(r.method, r.split): r.value for r in first if r.metric == "AUC-ROC"}
    # the test rows of each split hold two anomalies at the top; as far below the mean lie two normal rows
    assert set(auc) == {("away", 0), ("away", 1)} and all(0.85 < v <= 1 for v in auc.values())
    assert all(r.metric is None and r.value is None for r in first if r.status != "ok")
    assert all(r.fit_seconds >= 0 and r.score_seconds >= 0 for r in first if r.status == "ok")
    mended.append(True)
    second = sweep()  # only what failed runs again
    assert len(fits) == 2
    assert {(r.method, r.split): r.value for r in second if r.metric == "AUC-ROC"} == auc | {("moody", 0): 1.0, ("moody", 1): 1.0}
    assert {r.status for r in second if r.method == "lost"} == {"ValueError: unknown encoding"}
