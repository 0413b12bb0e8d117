"""Radix selection against sorting."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.functions import nth
from kestrel.operators import sampling as E


@pytest.mark.parametrize("small", [1, 50, 100_000])
@pytest.mark.parametrize("span", [3, 1 << 20, 1 << 62])
def test_marks_the_first_rows(spark, small, span):
    rng = np.random.default_rng(span % 97)
    rows = [(int(i), ["a", "b", "c", None][rng.integers(0, 4)], int(v) if v % 7 else None)
            for i, v in enumerate(rng.integers(-span, span, 800))]
    df = spark.createDataFrame(rows, "id long, g string, v long").repartition(5)
    limits = {"a": 70, "b": 0, "c": 10_000}
    marked = nth.mark_first(df, F.col("v"), [F.col("id")], spark.createDataFrame(
        list(limits.items()), "g string, __limit long"), ["g"], small=small)
    got = {r["id"]: r["first"] for r in marked.collect()}
    for g, n in limits.items():
        order = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert [got.pop(r[0]) for r in order] == [i < n for i in range(len(order))]
    assert not got


def test_whole_range_of_long(spark):
    values = [-(1 << 63), (1 << 63) - 1, 0, -1, 1, (1 << 62), -(1 << 62), None]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = nth.mark_first(df, F.col("v"), [F.col("v")], spark.createDataFrame([(4,)], "__limit long"), small=1)
    assert sorted(r["v"] for r in got.where("first AND v IS NOT NULL").collect()) == [-(1 << 63), -(1 << 62), -1]


def test_samples_equal_ranks_and_move_nothing(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("label"),
                                  F.repeat(F.lit("x"), 50).alias("wide"))
    for n in (0, 1, 700, 5000, 9000):
        want = E.hash_rank(df, "row_id", 4).where(F.col("pos") < n)
        assert {r[0] for r in E.sample_n(df, n, 4).select("row_id").collect()} == {r[0] for r in want.select("row_id").collect()}
    empty = E.sample_n(df.where("false"), 5, 4)
    assert empty.count() == 0 and empty.columns == df.columns
    plan = E.split_half_by_label(df, "label", "row_id")._jdf.queryExecution().executedPlan().toString()
    wide = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x or "Exchange rangepartitioning" in x or "SinglePartition" in x]
    # only the rows of one bin are exchanged (for their window)
    assert len(wide) <= 1 and "Join" in plan and "SortMergeJoin" not in plan
    split = {r["row_id"]: r["split"] for r in E.split_half_by_label(df, "label", "row_id").collect()}
    for g in range(3):
        ids = [i for i in range(5000) if i % 3 == g]
        assert [split[i] for i in ids] == ["train"] * (len(ids) // 2) + ["test"] * (len(ids) - len(ids) // 2)
