import math
import random

from pyspark.sql import functions as F

from kestrel.operators import joins as K
from kestrel.operators import scoring as I


def test_density_matches_brute_force(spark):
    rows = [(i, ["x", "y"][i % 2], ["p", "q", "r"][i % 3], ["u", "v"][(i // 3) % 2]) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, a string, b string, c string")
    orders = [(0, ["a", "b", "c"]), (1, ["c", "a", "b"])]
    model = I.fit_density(df.where(F.col("row_id") < 20), ["a", "b", "c"], orders, alpha=0.5)
    got = {(r.row_id, r.perm_id, r.col): r.nll for r in
           I.score_nll(df, "row_id", model, orders).collect()}
    train = [r for r in rows if r[0] < 20]
    idx = {"a": 1, "b": 2, "c": 3}
    K_ = {c: len({r[idx[c]] for r in train}) for c in idx}
    for r in rows:
        for oid, cols in orders:
            for p, c in enumerate(cols):
                v = r[idx[c]]
                if p == 0:
                    num = sum(1 for t in train if t[idx[c]] == v)
                    den = len(train)
                else:
                    pc = cols[p - 1]
                    u = r[idx[pc]]
                    num = sum(1 for t in train if t[idx[pc]] == u and t[idx[c]] == v)
                    den = sum(1 for t in train if t[idx[pc]] == u)
                want = -math.log((num + 0.5) / (den + 0.5 * K_[c]))
                assert abs(got[(r[0], oid, c)] - want) < 1e-12


def test_weighted_aggregation_and_mean(spark):
    s = spark.createDataFrame([(1, 0, "a", 1.0), (1, 0, "b", 2.0), (1, 1, "a", 3.0), (1, 1, "b", 4.0)],
                              "row_id long, perm_id int, col string, nll double")
    w = spark.createDataFrame([("a", 1.0)], "col string, weight double")
    per = {r.perm_id: r.score for r in I.aggregate_nll(s, w).collect()}
    assert per == {0: 1.0 * 2 + 2.0, 1: 3.0 * 2 + 4.0}
    mean = I.mean_permutations(I.aggregate_nll(s, w), expected=2).first()
    assert mean.score == 7.0 and mean.n_perms == 2
    assert I.row_scores(s, w, 2).first().score == 7.0


def test_range_lookup_matches_naive(spark):
    rnd = random.Random(3)
    ranges = []
    for i in range(200):
        lo = rnd.uniform(0, 1000)
        width = rnd.choice([0.5, 3.0, 20.0, 400.0, 2000.0])
        ranges.append((lo, lo + width, f"v{i}", i))
    probes = [(i, round(rnd.uniform(-10, 3000), 1)) for i in range(500)]
    probes += [(1000, ranges[0][0]), (1001, ranges[0][1])]  # equal to a bound: strict
    r = spark.createDataFrame(ranges, "lo double, hi double, val string, ord int")
    p = spark.createDataFrame(probes, "id long, x double")
    got = {row.id: row.out for row in K.range_lookup(p, "x", r, "lo", "hi", "val", "out",
                                                     order="ord").collect()}
    for pid, x in probes:
        hits = [(o, v) for lo, hi, v, o in ranges if lo < x < hi]
        assert got[pid] == (min(hits)[1] if hits else "Unknown")


def test_stream_scores_equal_batch_scores(spark):
    from kestrel.plans import q_stream as Q
    from kestrel.session import table
    from kestrel.streaming import scoring as S
    sf = "/root/testdata/sf0.001"
    s = Q.q_stream_scores(spark, sf)
    binner, orders, model = Q.event_model(spark, sf)
    feats = S.stream_features(table(spark, sf, "events"), "ts", "value", binner)
    b = I.row_scores(I.score_nll(feats, "event_id", model, orders), None, len(orders))
    got = {r.event_id: r.score for r in s.collect()}
    want = {r.row_id: r.score for r in b.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_text_nll_all_scores_unlabelled_documents(spark, tmp_path):
    """Fitted on labelled documents with toxic = 0 only; unlabelled documents get a score too."""
    import pytest
    from kestrel.plans import catalog
    docs = [(1, "aa bb aa"), (2, "aa cc"), (3, "bb aa zz"), (4, "aa bb aa"), (5, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.row_id: r for r in catalog.QUERIES["i05_text_nll_all"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4}
    # model: start->aa, aa->bb, bb->aa once each, V = 2
    seen, unseen = -math.log(2 / 3), -math.log(1 / 3)
    assert got[4].score == got[1].score == pytest.approx(seen) and got[4].n_tokens == 3
    assert got[2].score == pytest.approx((seen + unseen) / 2)
    assert got[3].score == pytest.approx((unseen + seen + unseen) / 3)


def test_factored_mean_equals_the_mean_over_orders(spark):
    import itertools

    from kestrel.operators import scoring as S
    rows = [(i, f"a{i % 3}", f"b{i % 5}", None if i % 4 == 0 else f"c{i % 2}") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, a string, b string, c string")
    orders = list(enumerate(map(list, itertools.permutations("abc"))))
    model = S.fit_density(df.where("row_id < 40"), ["a", "b", "c"], orders, 0.5)
    weights = spark.createDataFrame([("a", 2.0), ("c", 0.5)], "col string, weight double")
    for w in (None, weights):
        slow = {r["row_id"]: r["score"] for r in S.mean_permutations(
            S.aggregate_nll(S.score_nll(df, "row_id", model, orders), w)).collect()}
        fast = {r["row_id"]: r["score"] for r in S.mean_scores(df, "row_id", model, orders, w).collect()}
        assert fast.keys() == slow.keys() and all(abs(fast[k] - slow[k]) < 1e-9 for k in slow)


def test_range_lookup_broadcasts_no_table_that_grows(spark):
    r = spark.range(300).selectExpr("id * 10D AS lo", "id * 10D + 25 AS hi", "concat('v', id) AS val", "id AS ord")
    p = spark.range(2000).selectExpr("id", "id * 1.5D AS x")
    out = K.range_lookup(p, "x", r, "lo", "hi", "val", "out", order="ord")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    got = {row.id: row.out for row in out.collect()}
    for i in range(2000):
        want = next((f"v{k}" for k in range(300) if k * 10 < i * 1.5 < k * 10 + 25), "Unknown")
        assert got[i] == want


def test_small_density_tables_are_broadcast(spark):
    df = spark.createDataFrame([(i, i % 3, i % 5, i % 2) for i in range(600)], "row_id long, a int, b int, c int")
    model = I.fit_density(df, ["a", "b", "c"], [(0, ["a", "b", "c"]), (1, ["c", "a", "b"])])
    out = I.score_nll(df, "row_id", model, [(0, ["a", "b", "c"]), (1, ["c", "a", "b"])])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert out.count() == 3600


def test_frequent_words_are_looked_up_without_a_shuffle(spark, monkeypatch):
    """Nearly all tokens follow 'is': they stay where they are, only rare ones are merged; every
    token gets its counts, whether its context and bigram are broadcast, merged or unseen."""
    from collections import Counter

    texts = [f"aa is v{i % 400} is w{i} end{i % 7}" for i in range(600)] + ["zz is new", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    toks = I.token_table(df, "doc_id", "text")
    fit = [t.split() for t in texts[:500]]
    pairs = [p for t in fit for p in zip([""] + t, t)]
    big, ctx, v = Counter(pairs), Counter(p for p, _ in pairs), len({t for _, t in pairs})
    for limit in (0, 400, 3_000, 24_000_000):
        monkeypatch.setattr(I, "FREQUENT_BYTES", limit)
        out = I.token_nll(toks, I.fit_text_model(toks.where("row_id < 500")), 0.5)
        got = {(r.row_id, r.pos): r.nll for r in out.collect()}
        want = {(i, at): -math.log((big[p] + 0.5) / (ctx[p[0]] + 0.5 * v)) for i, t in enumerate(texts)
                for at, p in enumerate(zip([""] + t.split(), t.split()))}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == (limit < 24_000_000)
    monkeypatch.setattr(I, "FREQUENT_BYTES", 400)
    model = I.fit_text_model(toks.where("row_id < 500"))
    many, whole = I._frequent(model[1], ["prev"], "n_ctx", 400)
    assert not whole and "is" in {r.prev for r in many.collect()}
