"""Independence tests: tails, nulls, strata, cubes, PC without a depth limit."""
import itertools
import math

import numpy as np
import pytest

from kestrel.functions.exprs import chi2_sf
from kestrel.operators import causal as CA


def test_tail_against_known_values():
    # table values and the normal limit (Wilson-Hilferty) for large degrees of freedom
    for x, k, p in ((3.841458820694124, 1, 0.05), (124.342, 100, 0.05), (18.307, 10, 0.05), (2.0, 4, 2 / math.e)):
        assert chi2_sf(x, k) == pytest.approx(p, abs=1e-5)
    for k in (1500, 1501, 20_000, 100_000):
        for shift in (-3, 0, 3):
            x = k + shift * math.sqrt(2 * k)
            z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
            assert chi2_sf(x, k) == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, abs=2e-4)
    assert chi2_sf(5000, 100) < 1e-300 and chi2_sf(0, 3) == 1.0


def plain_chisq(rows):
    """Statistic and dof of (x, y, stratum) rows by the textbook formula."""
    stat = dof = 0
    for s in {r[2] for r in rows}:
        part = [r for r in rows if r[2] == s]
        xs, ys = sorted({r[0] for r in part}), sorted({r[1] for r in part})
        dof += (len(xs) - 1) * (len(ys) - 1)
        for x, y in itertools.product(xs, ys):
            o = sum(r[0] == x and r[1] == y for r in part)
            e = sum(r[0] == x for r in part) * sum(r[1] == y for r in part) / len(part)
            stat += (o - e) ** 2 / e
    return stat, dof


def test_nulls_and_separator_in_strata(spark):
    rng = np.random.default_rng(0)
    keys = [("a|b", "c"), ("a", "b|c"), (None, "u"), ("u", None), ("u", "u")]
    rows = []
    for _ in range(600):
        k = keys[rng.integers(0, 5)]
        rows.append((["p", "q", None][rng.integers(0, 3)], ["r", "s", "t"][rng.integers(0, 3)], *k))
    df = spark.createDataFrame(rows, "x string, y string, s1 string, s2 string")
    whole = [(x, y, (a, b)) for x, y, a, b in rows if None not in (x, y, a, b)]
    got = CA.chisq_test(df, "x", "y", ["s1", "s2"]).first()
    assert (got.stat, got.dof) == pytest.approx(plain_chisq(whole))
    flat = [(x, y, 0) for x, y, *_ in rows if x is not None]
    got = CA.pairwise_tests(df, ["x", "y"]).first()
    assert (got.stat, got.dof) == pytest.approx(plain_chisq(flat))
    bic = CA.bic_local_scores(df, [("x", ["s1", "s2"])]).first()
    used = [(x, (a, b)) for x, _, a, b in rows if None not in (x, a, b)]
    ll = sum(math.log(sum(v == w for w in used) / sum(v[1] == w[1] for w in used)) for v in used)
    assert bic.ll == pytest.approx(ll)


def test_pc_needs_depth_three(spark):
    """z1..z3 -> x and z1..z3 -> y: x and y separate only given all three."""
    rng = np.random.default_rng(1)
    z = rng.integers(0, 2, (20000, 3))
    noise = rng.random((20000, 2)) < 0.1
    x = (z.sum(1) + noise[:, 0]).astype(int)
    y = ((z * [1, 2, 4]).sum(1) + noise[:, 1]).astype(int)
    df = spark.createDataFrame([tuple(map(int, r)) for r in np.column_stack([z, x, y])], "z1 int, z2 int, z3 int, x int, y int")
    edges, seps, log = CA.pc_skeleton(df, ["z1", "z2", "z3", "x", "y"], 0.01, "gsq")
    assert frozenset(("x", "y")) not in edges and seps[frozenset(("x", "y"))] == {"z1", "z2", "z3"}
    assert max(d for d, *_ in log) >= 3


def test_fisherz_and_gaussian_bic(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=3000)
    b = a + rng.normal(size=3000)
    c = b + rng.normal(size=3000)
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([a, b, c])], "a double, b double, c double")
    edges, seps, _ = CA.pc_skeleton(df, ["a", "b", "c"], 0.001, "fisherz")
    assert edges == {frozenset("ab"), frozenset("bc")} and seps[frozenset("ac")] == {"b"}
    full, none = (r.bic for r in CA.bic_gaussian_scores(df, [("c", ["a", "b"]), ("c", [])]).collect())
    design = np.column_stack([np.ones(3000), a, b])
    var = np.var(c - design @ np.linalg.lstsq(design, c, rcond=None)[0])
    assert full == pytest.approx(-1500 * math.log(var) - math.log(3000) / 2 * 3)
    assert none == pytest.approx(-1500 * math.log(np.var(c)) - math.log(3000) / 2)


def test_orientation_and_related(spark):
    edges = {frozenset(e) for e in (("a", "c"), ("b", "c"), ("c", "d"))}
    got = CA.pc_orient(spark, list("abcd"), edges, {frozenset("ab"): set(), frozenset("ad"): {"c"}, frozenset("bd"): {"c"}})
    arrows = {(r.src, r.dst) for r in got.where("value = -1").collect()}
    assert arrows == {("a", "c"), ("b", "c"), ("c", "d")}
    t = spark.createDataFrame([("a", "b", 0.2), ("a", "c", 0.1), ("b", "c", 0.1)], "x_col string, y_col string, p double")
    top = {(r.factor, r["rank"]): r.other for r in CA.top_related(t, 1).collect()}
    assert top == {("a", 1): "c", ("b", 1): "c", ("c", 1): "a"}


def test_marginals_against_direct_counts(spark):
    """Sums from covers equal counts of the rows, nulls and separators included."""
    from collections import Counter

    from kestrel.operators import marginals
    rng = np.random.default_rng(5)
    values = [None, "a", "b|c", "b"]
    rows = [tuple(values[i] for i in rng.integers(0, 4, 9)) for _ in range(3000)]
    cols = [f"c{i}" for i in range(9)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    m = marginals.Marginals(df, cols)
    sets = [(0,), (1, 4), (2, 3, 8), (0, 5, 6, 7), (1, 4), tuple(range(9)), (0, 8)]
    for asked in (sets[:3], sets):  # the second request finds covers of the first
        got = {i: Counter() for i in range(len(asked))}
        for r in m.counts(asked).collect():
            got[r["set_id"]][tuple(r["key"])] += r["n"]
        assert all(got[i] == Counter(tuple(r[c] for c in s) for r in rows) for i, s in enumerate(asked))
    direct = CA.ci_tests(df, [("c0", "c1", ["c2"]), ("c3", "c4", [])]).orderBy("test_id").collect()
    kept = CA.lattice_tests(m, [("c0", "c1", ["c2"]), ("c3", "c4", [])]).orderBy("test_id").collect()
    for a, b in zip(direct, kept):
        assert a[:4] == b[:4] and a.dof == b.dof and a.stat == pytest.approx(b.stat) and a.p == pytest.approx(b.p)


def test_waves_give_the_sequential_result(spark):
    rng = np.random.default_rng(7)
    x = [rng.integers(0, 2, 4000)]
    for _ in range(6):
        x.append((x[rng.integers(0, len(x))] ^ (rng.random(4000) < 0.15)).astype(int))
    cols = [f"x{i}" for i in range(7)]
    df = spark.createDataFrame([tuple(map(int, r)) for r in np.column_stack(x)], ", ".join(f"{c} int" for c in cols))
    one = CA.pc_skeleton(df, cols, 0.01, "gsq", wave=10_000)
    few = CA.pc_skeleton(df, cols, 0.01, "gsq", wave=12)
    assert one[:2] == few[:2]
    logged = lambda log: sorted((d, a, b, s) for d, a, b, s, _ in log)  # waves log in their own order
    assert logged(one[2]) == logged(few[2])
    assert one[0] and len(one[1]) > 5


def test_forty_columns(spark):
    """Many columns: 780 pairs, tests of a wave only on the driver, covers instead of pairs."""
    rng = np.random.default_rng(9)
    x = [rng.integers(0, 2, 3000) for _ in range(20)]
    x += [(a ^ (rng.random(3000) < 0.1)).astype(int) for a in x]
    cols = [f"x{i}" for i in range(40)]
    df = spark.createDataFrame([tuple(map(int, r)) for r in np.column_stack(x)], ", ".join(f"{c} int" for c in cols))
    edges, _, log = CA.pc_skeleton(df, cols, 1e-6, "gsq", wave=300)
    assert edges == {frozenset((f"x{i}", f"x{i + 20}")) for i in range(20)}
    assert len(log) < 1000


def test_dependent_factors_query(spark):
    from kestrel.plans import q_causal
    rows = q_causal.q_pc_skeleton_dependent(spark, "/root/testdata/sf0.01").collect()
    adjacent = {(r.a, r.b) for r in rows if r.adjacent}
    assert adjacent == {("qty", "offer"), ("disc", "offer"), ("offer", "charge"), ("tax", "charge")}
    graph = {(r.src, r.dst): r.value for r in q_causal.q_pc_dependent(spark, "/root/testdata/sf0.01").collect()}
    for a, b in (("qty", "offer"), ("disc", "offer"), ("offer", "charge"), ("tax", "charge")):
        assert graph[a, b] == -1.0 and graph[b, a] == 1.0
    prices = {(r.a, r.b) for r in q_causal.q_pc_fisherz_prices(spark, "/root/testdata/sf0.01").collect()}
    assert ("l_extendedprice", "net") in prices and ("gross", "net") in prices
