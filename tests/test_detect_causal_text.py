import math
import random

import numpy as np
from pyspark.sql import functions as F

from kestrel.operators import causal as CA
from kestrel.operators import detectors as L
from kestrel.operators import graph as G
from kestrel.operators import text as D


def test_ecod_matches_numpy(spark):
    rnd = np.random.default_rng(0)
    x = np.round(rnd.exponential(size=(200, 2)), 2)
    x[0] = [9.0, -3.0]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)],
                               "row_id long, a double, b double")
    got = {r.row_id: r.score for r in L.ecod(df, ["a", "b"]).collect()}
    n = len(x)
    total = np.zeros(n)
    for j in range(2):
        col = x[:, j]
        le = np.array([(col <= v).sum() for v in col]) / n
        ge = np.array([(col >= v).sum() for v in col]) / n
        ul, ur = -np.log(le), -np.log(ge)
        m = col.mean()
        sk = np.sign(((col - m) ** 3).mean() / (((col - m) ** 2).mean() ** 1.5))
        us = ul * -np.sign(sk - 1) + ur * np.sign(sk + 1)
        total += np.maximum(us, np.maximum(ul, ur))
    assert all(abs(got[i] - total[i]) < 1e-9 for i in range(n))
    assert max(got, key=got.get) == 0


def test_iforest_ranks_outlier_high(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(500)] + [(999, 8.0, 8.0)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double")
    s = {r.row_id: r.score for r in L.iforest(df, ["a", "b"], n_trees=50, psi=64, seed=3).collect()}
    assert len(s) == 501 and max(s, key=s.get) == 999 and all(0 < v < 1 for v in s.values())


def test_chisq_matches_brute_force(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 2), rnd.randint(0, 3), rnd.randint(0, 1)) for _ in range(500)]
    rows = [(a, (b + a) % 4 if rnd.random() < 0.3 else b, c) for a, b, c in rows]
    df = spark.createDataFrame(rows, "x int, y int, z int")
    t = CA.ci_tests(df, [("x", "y", []), ("x", "y", ["z"])], "chisq").orderBy("test_id").collect()

    def stat(sub):
        xs = sorted({a for a, _ in sub}); ys = sorted({b for _, b in sub})
        n = len(sub); s = 0.0
        for a in xs:
            for b in ys:
                o = sum(1 for p in sub if p == (a, b))
                e = sum(1 for p in sub if p[0] == a) * sum(1 for p in sub if p[1] == b) / n
                s += (o - e) ** 2 / e
        return s, (len(xs) - 1) * (len(ys) - 1)
    s0, d0 = stat([(a, b) for a, b, _ in rows])
    assert abs(t[0].stat - s0) < 1e-9 and t[0].dof == d0
    s1 = d1 = 0
    for zv in (0, 1):
        s_, d_ = stat([(a, b) for a, b, c in rows if c == zv])
        s1 += s_; d1 += d_
    assert abs(t[1].stat - s1) < 1e-9 and t[1].dof == d1
    assert 0 <= t[0].p <= 1


def test_pc_finds_chain_skeleton(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(3000):
        a = rnd.randint(0, 1)
        b = a if rnd.random() < 0.9 else 1 - a
        c = b if rnd.random() < 0.9 else 1 - b
        rows.append((a, b, c))
    df = spark.createDataFrame(rows, "a int, b int, c int")
    edges, seps, _ = CA.pc_skeleton(df, ["a", "b", "c"], 0.01)
    assert edges == {frozenset(("a", "b")), frozenset(("b", "c"))}
    assert seps[frozenset(("a", "c"))] == {"b"}


def test_tfidf_formula(spark):
    docs = [(1, "the cat sat on the mat"), (2, "the dog sat"), (3, "Über café café")]
    df = spark.createDataFrame(docs, "row_id long, text string")
    got = {(r.row_id, r.term): r.tfidf for r in D.tfidf(df, "row_id", ["text"], 300).collect()}
    toks = {i: [w for w in t.lower().split() if len(w) >= 2] for i, t in docs}
    n = len(docs)
    dfreq = {}
    for ws in toks.values():
        for w in set(ws):
            dfreq[w] = dfreq.get(w, 0) + 1
    for i, ws in toks.items():
        v = {w: ws.count(w) * (math.log((1 + n) / (1 + dfreq[w])) + 1) for w in set(ws)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        for w, x in v.items():
            assert abs(got[(i, w)] - x / norm) < 1e-12


def test_diverse_selection_matches_python_greedy(spark):
    import itertools
    nodes = ["a", "b", "c", "d", "e"]
    perms = [list(p) for p in itertools.permutations(nodes)][:60]
    df = spark.createDataFrame([("g", i, p) for i, p in enumerate(perms)],
                               "graph_id string, order_id int, cols array<string>")
    got = [r.order_id for r in G.select_diverse(df, 5, seed=0).orderBy("pick").collect()]
    import hashlib
    cand = sorted(range(len(perms)), key=lambda i: (hashlib.md5(f"0|g|{i}".encode()).hexdigest(), i))

    def fr(a, b):
        return sum(abs(a.index(x) - b.index(x)) for x in a)
    sel = [cand[0]]
    rest = cand[1:]
    while len(sel) < 5:
        best = max(rest, key=lambda c: (min(fr(perms[c], perms[s]) for s in sel), -rest.index(c)))
        sel.append(best)
        rest.remove(best)
    assert got == sel


def test_chisq_matches_spark_ml_chisquaretest(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import ChiSquareTest
    rnd = random.Random(4)
    rows = [(rnd.randint(0, 3), rnd.randint(0, 2)) for _ in range(400)]
    rows = [(a, (a + b) % 3 if rnd.random() < 0.3 else b) for a, b in rows]
    df = spark.createDataFrame(rows, "x int, y int")
    ours = CA.chisq_test(df, "x", "y").first()
    v = VectorAssembler(inputCols=["x"], outputCol="f").transform(df.withColumn("y", F.col("y").cast("double")))
    r = ChiSquareTest.test(v, "f", "y").first()
    assert abs(ours.stat - float(r.statistics[0])) < 1e-9
    assert ours.dof == int(r.degreesOfFreedom[0])
    assert abs(ours.p - float(r.pValues[0])) < 1e-9


def test_validate_factors_requires_json_numbers(spark):
    rows = [(1, '{"factors": {"f": {"possible_values": [0, 1.5, -2]}}, "recommended_focus_factors": ["f"]}'),
            (2, '{"factors": {"f": {"possible_values": [0, "5"]}}, "recommended_focus_factors": ["f"]}'),
            (3, '{"factors": {"f": {"possible_values": [1]}}}'),
            (4, 'not json')]
    df = spark.createDataFrame(rows, "id int, json string")
    got = {r.id: (r.valid, r.reason) for r in D.validate_factors(df).collect()}
    assert got[1] == (True, None)
    assert got[2] == (False, "a possible value is not a number")
    assert got[3] == (False, "no recommended focus")
    assert got[4] == (False, "no factors")
    fenced = spark.createDataFrame([("Sure:\n```json\n{\"a\": 1}\n```",), ("```\n{\"a\": 2}\n```",), ('{"a": 3}',)],
                                   "r string")
    vals = [r.a for r in fenced.select(D.parse_fenced_json(F.col("r"), "a INT").alias("p")).select("p.a").collect()]
    assert vals == [1, 2, 3]


def test_fisherz_partial_correlation(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=2000)
    x = z + rng.normal(scale=0.5, size=2000)
    y = z + rng.normal(scale=0.5, size=2000)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, z)],
                               "x double, y double, z double")
    r0 = CA.fisherz_test(df, "x", "y")
    assert abs(r0["r"] - np.corrcoef(x, y)[0, 1]) < 1e-9 and r0["p"] < 1e-6
    r1 = CA.fisherz_test(df, "x", "y", ["z"])
    rx = x - np.polyval(np.polyfit(z, x, 1), z)
    ry = y - np.polyval(np.polyfit(z, y, 1), z)
    assert abs(r1["r"] - np.corrcoef(rx, ry)[0, 1]) < 1e-6 and r1["p"] > 0.001


def test_term_counts_of_repeated_and_null_rows(spark):
    """Rows with one id are one document, two columns are two; only vocabulary terms are grouped by row."""
    rows = [(1, "aa aa bb", "cc"), (1, "aa dd", None), (None, "bb bb", "aa"), (2, "", "ee")]
    df = spark.createDataFrame(rows, "row_id long, t string, u string")
    bow = D.bag_of_words(df, "row_id", ["t", "u"], 2)
    assert {(r.row_id, r.term): r.tf for r in bow.collect()} == {(1, "aa"): 3, (1, "bb"): 1, (None, "bb"): 2, (None, "aa"): 1}
    assert {r.term: (r.tf_total, r.df) for r in D.vocabulary(df, "row_id", ["t", "u"], 2).collect()} == {"aa": (4, 2), "bb": (3, 2)}
    assert "BroadcastHashJoin" in bow._jdf.queryExecution().executedPlan().toString().split("Aggregate")[-1]


def test_clustering_deals_many_rows(spark, monkeypatch):
    """Rows of one large file are dealt before the fit keeps them."""
    from pyspark.ml.clustering import KMeans

    from kestrel.operators import causal as CA
    seen, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, x: seen.append(x.rdd.getNumPartitions()) or fit(self, x))
    monkeypatch.setattr(CA, "CLUSTER_ROWS", 50, raising=False)
    df = spark.range(0, 400, 1, 1).selectExpr("id AS row_id", "id % 2 * 100 AS a", "id % 2 * 100 AS b")
    got = {(r.row_id % 2, r.cluster) for r in CA.cluster_rows(df, ["a", "b"], 2).collect()}
    assert len(got) == 2 and len({c for _, c in got}) == 2
    assert seen[0] >= 8
