"""Values of many columns looked up at once: broadcast head, shuffled rest."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.functions import coding
from kestrel.operators import binning as C
from kestrel.operators import detectors as L


@pytest.fixture
def rows():
    rng = np.random.default_rng(2)
    pick = lambda n: [None if v == 0 else f"v{v}" for v in rng.zipf(1.5, 1500) % n]
    return list(zip(range(1500), pick(9), pick(400), pick(1000), rng.integers(0, 50, 1500).tolist()))


@pytest.fixture
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, a string, b string, v string, n int").repartition(4)


@pytest.fixture(params=[16 << 20, 2000, 0])
def bound(request, monkeypatch):
    """All, some and none of the values in the broadcast head."""
    monkeypatch.setattr(coding.look_up, "__defaults__", (coding.as_string, request.param))
    return request.param


def test_ordinal_and_appearance_codes(rows, frame, bound):
    got = {r["id"]: r for r in C.ordinal_encode(frame, ["a", "b", "v", "n"], suffix="_c").collect()}
    first = {r["id"]: r for r in C.factor_encode(frame, ["a", "v"], "id").collect()}
    for k, c in enumerate(("a", "b", "v", "n"), 1):
        order = {v: i for i, v in enumerate(sorted({str(r[k]) for r in rows if r[k] is not None}))}
        assert all(got[r[0]][c + "_c"] == (None if r[k] is None else order[str(r[k])]) for r in rows)
        assert all(got[r[0]][c] == r[k] for r in rows)
    for k, c in ((1, "a"), (3, "v")):
        seen = {}
        for r in rows:
            if r[k] is not None:
                seen.setdefault(r[k], len(seen))
        assert all(first[r[0]][c] == seen.get(r[k], -1) for r in rows)


def test_unseen_values_and_rare(spark, rows, frame, bound):
    fit = frame.where("id < 300")
    known = {r[3] for r in rows if r[0] < 300}
    got = {r["id"]: r["v"] for r in C.ordinal_encode(frame, ["v"], fit=fit).collect()}
    assert all((got[r[0]] is None) == (r[3] is None or r[3] not in known) for r in rows)
    rare = {r["id"]: r for r in C.group_rare(frame, ["a", "b"], 0.02, 10).collect()}
    for k, c in ((1, "a"), (2, "b")):
        values = [r[k] for r in rows if r[k] is not None]
        held = len(set(values)) > 10
        for r in rows:
            want = "Rare" if r[k] is not None and held and values.count(r[k]) / len(values) < 0.02 else r[k]
            assert rare[r[0]][c] == want


def test_ecod_is_the_same_for_every_bound(spark, bound):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 3)), 1) * [1, 2, -3]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, p double, q double, r double")
    got = {r["id"]: r["score"] for r in L.ecod(df, ["p", "q", "r"]).collect()}
    total = np.zeros(400)
    for c in x.T:
        left = -np.log([(c <= v).mean() for v in c])
        right = -np.log([(c >= v).mean() for v in c])
        sk = np.sign(((c - c.mean()) ** 3).mean())
        total += np.maximum(left * -np.sign(sk - 1) + right * np.sign(sk + 1), np.maximum(left, right))
    assert np.allclose([got[i] for i in range(400)], total)


def test_one_wide_exchange(frame, monkeypatch):
    monkeypatch.setattr(coding.look_up, "__defaults__", (coding.as_string, 0))
    out = C.ordinal_encode(frame.withColumn("wide", F.lit("x")), ["a", "b", "v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(__rid" in x for x in plan.splitlines()) <= 2
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
