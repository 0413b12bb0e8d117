from pyspark.sql import functions as F

from kestrel.operators import recode as R
from kestrel.operators import sampling as E


def test_combine_date_parts_edges(spark):
    df = spark.createDataFrame([("Jan", "2", "Monday", "mar", "1", "0"),
                                ("DEC", "5", "sunday", "0", "3", "Friday")],
                               "m string, w string, d string, cm string, cw string, cd string")
    out = R.combine_date_parts(df, "m", "w", "d", "acc")
    out = R.combine_date_parts(out, "cm", "cw", "cd", "claim", unknown_on_zero=True)
    got = [(r.acc, r.claim) for r in out.collect()]
    assert got == [("1-8", "unknown"), ("12-35", "13-19")]


def test_coerce_and_label(spark):
    df = spark.createDataFrame([(" 2 ",), ("2.0",), ("unknown",), ("",), (None,), ("-1",)], "s string")
    assert [r.v for r in df.select(R.coerce_int(df, "s").alias("v")).collect()] == \
        [2, None, None, None, None, -1]
    fd = spark.createDataFrame([(1.9,), (float("nan"),)], "x double")
    assert [r.v for r in fd.select(R.coerce_int(fd, "x").alias("v")).collect()] == [1, None]
    lab = spark.createDataFrame([("Yes",), (" no",), ("TRUE",), ("0",), ("3",), ("abc",)], "y string")
    assert [r.y for r in R.encode_label(lab, "y").collect()] == [1, 0, 1, 0, 3, None]


def test_fill_unknown_and_missing_codes(spark):
    df = spark.createDataFrame([("  ", 1), (None, None), ("x", 3)], "s string, n int")
    got = [(r.s, r.n) for r in R.fill_unknown(df).collect()]
    assert got == [("unknown", "1"), ("unknown", "unknown"), ("x", "3")]
    f = spark.createDataFrame([(None, "2"), ("1", None)], "a string, b string")
    out = R.fill_missing_codes(f, [("a", [-1, 0, 1]), ("b", [1, 2]), ("c", [0])])
    out = R.all_missing(out, [("a", [-1, 0, 1]), ("b", [1, 2])])
    assert [(r.a, r.b, r.c, r.all_missing) for r in out.collect()] == [(-1, 2, 0, False), (1, 0, 0, False)]


def test_sampling_and_splits(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    assert E.sample_n(df, 37, seed=1).count() == 37
    assert E.sample_n(df, 5000, seed=1).count() == 1000
    big = E.sample_n(df, 20000 if False else 900, seed=2)
    assert big.count() == 900
    sp = E.split_half_by_label(df, "label", "row_id")
    c = {(r.label, r.split): r["count"] for r in sp.groupBy("label", "split").count().collect()}
    assert c == {(0, "train"): 450, (0, "test"): 450, (1, "train"): 50, (1, "test"): 50}
    pos = sorted(r.position for r in E.shuffle(df, 3).collect())
    assert pos == list(range(1000))
    ds = E.downsample_ratio(df, "label", 1, seed=0)
    assert ds.where("label = 1").count() == 100 and ds.where("label = 0").count() == 5
    b = E.plan_ratio_batches(df, "label", 8, 0.25, replicas=2)
    per = b.groupBy("replica", "batch_id").agg(F.count("*").alias("n"), F.sum((F.col("slot") >= 6).cast("int")).alias("a")).collect()
    assert all(r.n == 8 and r.a == 2 for r in per)


def test_ratio_batches_of_many_replicas(spark):
    """Slots of every replica against a plain loop, with too few anomalies on some, and one class only."""
    for n_norm, n_anom, size, ratio, replicas in ((41, 7, 8, 0.25, 4), (23, 6, 4, 1.0, 2), (9, 0, 4, 0.0, 3), (0, 0, 4, 0.5, 2)):
        rows = [(i, int(i >= n_norm)) for i in range(n_norm + n_anom)]
        df = spark.createDataFrame(rows, "row_id long, label int")
        got = E.plan_ratio_batches(df, "label", size, ratio, replicas=replicas).collect()
        a = int(size * ratio)
        for rep in range(replicas):
            norm, anom = (len(range(rep, n, replicas)) for n in (n_norm, n_anom))
            mine = sorted((r.batch_id, r.slot, r.row_id >= n_norm) for r in got if r.replica == rep)
            if norm < size - a or anom < a:
                assert mine == [(i // size, i % size, i >= norm) for i in range(norm + anom)]
                continue
            cycles = max(-(-norm // (size - a)) if size > a else 0, -(-anom // a) if a else 0)
            assert mine == [(b, s, s >= size - a) for b in range(cycles) for s in range(size)]
