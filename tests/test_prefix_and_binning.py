import math
import random

from pyspark.sql import functions as F

from kestrel.functions.exprs import chi2_sf, ordinal_words
from kestrel.functions.prefix import prefix_sums
from kestrel.operators import binning as C


def test_prefix_sums_matches_brute_force(spark):
    rnd = random.Random(1)
    rows = [(g, float(rnd.randint(0, 50)), rnd.randint(1, 5)) for g in ("a", "b") for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    d = df.groupBy("g", "v").agg(F.sum("w").alias("w"))
    out = {(r.g, r.v): r.w_before for r in prefix_sums(d, ["g"], "v", ["w"], buckets=7).collect()}
    for (g, v), before in out.items():
        assert before == sum(w for gg, vv, w in rows if gg == g and vv < v)
    desc = {(r.g, r.v): r.w_before for r in
            prefix_sums(d, ["g"], "v", ["w"], descending=True, buckets=5).collect()}
    for (g, v), before in desc.items():
        assert before == sum(w for gg, vv, w in rows if gg == g and vv > v)


def test_ordinal_suffixes(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 11, 12, 13, 20, 21, 22, 23, 100, 101, 111)],
                               "n long")
    got = [r.w for r in df.select(ordinal_words(F.col("n")).alias("w")).collect()]
    assert got == ["the 1st percentile", "the 2nd percentile", "the 3rd percentile",
                   "the 4th percentile", "the 11th percentile", "the 12th percentile",
                   "the 13th percentile", "the 20th percentile", "the 21st percentile",
                   "the 22nd percentile", "the 23rd percentile", "the 100th percentile",
                   "the 101st percentile", "the 111th percentile"]


def test_quantile_binning_counts_nulls_and_keeps_constants(spark):
    df = spark.createDataFrame([(1, 10.0, 5.0), (2, 20.0, 5.0), (3, 20.0, 5.0), (4, None, 5.0)],
                               "id int, x double, c double")
    out = {r.id: (r.x, r.c) for r in C.bin_quantile(df, ["x", "c"]).collect()}
    # n = 4 rows including the null; rank(min) of 10 is 1 -> 25, of 20 is 2 -> 50
    assert out[1][0] == "the 25th percentile"
    assert out[2][0] == out[3][0] == "the 50th percentile"
    assert out[4][0] == "NaN"
    assert out[1][1] == "5.0"  # one distinct value: not rewritten


def test_equal_width_half_even_and_language(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (0.75,), (1.0,)], "x double")
    ew = [r.x for r in C.bin_equal_width(df, ["x"], 4).orderBy("x").collect()]
    # x*4 = 0,1,2,3,4 -> /100 -> 2 decimals (10 % 4 != 0)
    assert ew == [0.0, 0.01, 0.02, 0.03, 0.04]
    df2 = spark.createDataFrame([(0.0,), (0.05,), (0.15,), (0.25,), (1.0,)], "x double")
    ew10 = sorted(r.x for r in C.bin_equal_width(df2, ["x"], 10).collect())
    # 0.5 -> 0 and 1.5 -> 2, 2.5 -> 2 under half-even
    assert ew10 == [0.0, 0.0, 0.2, 0.2, 1.0]
    dfl = spark.createDataFrame([(i, x) for i, x in enumerate([0.0, 0.05, 0.5, 0.9, 1.0])],
                                "id int, x double")
    lang = [r.x for r in C.bin_language(dfl, ["x"]).orderBy("id").collect()]
    assert lang == ["Minimal", "Minimal", "Significant", "Maximum", "Maximum"]
    z = C.bin_standard(spark.createDataFrame([(3.0,), (3.0,)], "x double"), ["x"]).collect()
    assert [r.x for r in z] == [0.0, 0.0]  # zero std divides by 1


def test_chi2_sf_known_values():
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(chi2_sf(5.991464547107979, 2) - 0.05) < 1e-12
    assert abs(chi2_sf(7.814727903251178, 3) - 0.05) < 1e-12
    assert abs(chi2_sf(2.0, 4) - math.exp(-1.0) * 2.0) < 1e-12


def test_one_hot_and_ordinal_fit_on_train(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "s string")
    test = spark.createDataFrame([(1, "b"), (2, "z")], "id int, s string")
    oh = C.one_hot(test, ["s"], fit=train).orderBy("id").collect()
    assert [(r.s_b, r.s_c) for r in oh] == [(1.0, 0.0), (0.0, 0.0)]
    oe = C.ordinal_encode(test, ["s"], fit=train).orderBy("id").collect()
    assert [r.s for r in oe] == [1, None]


def test_prefix_sums_keep_exact_types(spark):
    """64-bit integers beyond 2**53 and strings with a long common prefix are ordered exactly."""
    ids = [2 ** 60 + i for i in range(64)]
    df = spark.createDataFrame([(i, 1) for i in ids[::-1]], "v long, one int")
    got = {r.v: r.one_before for r in prefix_sums(df, [], "v", ["one"], buckets=5).collect()}
    assert got == {v: i for i, v in enumerate(ids)}
    names = [f"Customer#{i:09d}" for i in range(500)]
    df = spark.createDataFrame([(n, 1, k % 3) for k, n in enumerate(names)] + [(None, 1, None)], "v string, one int, g int")
    out = prefix_sums(df, ["g"], "v", ["one"], buckets=7)
    assert {(r.g, r.v): r.one_before for r in out.collect()} == {
        **{(k % 3, n): k // 3 for k, n in enumerate(names)}, (None, None): 0}
    down = prefix_sums(df.where("g = 0"), [], "v", ["one"], descending=True, buckets=4)
    assert [r.one_before for r in down.orderBy("v").collect()] == list(range(166, -1, -1))


def test_prefix_sums_cut_a_hot_value(spark):
    df = spark.range(3000).selectExpr("7 as v", "id as tie", "1 as one")
    out = prefix_sums(df, [], "v", ["one"], tiebreak=["tie"], buckets=6)
    assert out.where("one_before <> tie").count() == 0


def test_collapse_singletons_broadcasts_no_counts(spark):
    df = spark.range(400).selectExpr("id", "CASE WHEN id < 300 THEN id ELSE 7 END AS dev")
    out = C.collapse_singletons(df, "dev")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.dev for r in out.collect()} == {i: "7" if i == 7 or i >= 300 else "0" for i in range(400)}
