"""F — contingency counts, independence tests and structure learning.

The factor columns are counted once into a cube (one row per observed combination, never
more than the input has rows).  The tables of all conditional-independence tests of a wave are
summed from the smallest marginal counts that hold them (:mod:`kestrel.operators.marginals`),
and the statistics are aggregates of the sums.  A test uses the rows that are complete in its
own columns.  Only the per-test summary of a wave reaches the driver, where PC decides which
edges to drop.

Chi-square: ``sum O^2/E - n`` over observed cells (equal to the Pearson sum over
all cells of a stratum); G-square ``2 sum O ln(O/E)``; per stratum
``dof = (nonzero rows - 1)(nonzero cols - 1)``; tail probabilities from the incomplete
gamma function in :func:`kestrel.functions.exprs.chi2_sf`.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.exprs import chi2_sf, quote_ident
from kestrel.operators.marginals import Marginals
from kestrel.session import cut_lineage


def _v(c: str):
    return F.col(quote_ident(c)).cast("string")


def contingency(df: DataFrame, tests: Sequence[tuple[str, str, Sequence[str]]],
                weight: str | None = None) -> DataFrame:
    """F2 — counts ``(test_id, s_key, x, y, n)`` for many (x, y | S) tests at once.

    ``s_key`` is the array of conditioning values (empty when S is empty); rows with a null
    in x, y or S are left out of that test.  ``weight`` names a count column (a cube)."""
    n = F.col(weight) if weight else F.lit(1).cast("long")
    items = []
    for tid, (x, y, s) in enumerate(tests):
        skey = F.array(*[_v(c) for c in s]) if s else F.array().cast("array<string>")
        whole = F.lit(True)
        for c in (x, y, *s):
            whole = whole & F.col(quote_ident(c)).isNotNull()
        items.append(F.when(whole, F.struct(F.lit(tid).alias("test_id"), skey.alias("s_key"),
                                            _v(x).alias("x"), _v(y).alias("y"))))
    return (df.select(n.alias("w"), F.explode(F.array_compact(F.array(*items))).alias("t"))
            .select("w", "t.*").groupBy("test_id", "s_key", "x", "y").agg(F.sum("w").alias("n")))


def test_statistics(counts: DataFrame, method: str = "chisq") -> DataFrame:
    """F3 — per test: statistic and degrees of freedom summed over strata."""
    k = ["test_id", "s_key"]
    tot = counts.groupBy(*k).agg(F.sum("n").alias("n_s"))
    rows = counts.groupBy(*k, "x").agg(F.sum("n").alias("n_x"))
    cols = counts.groupBy(*k, "y").agg(F.sum("n").alias("n_y"))
    j = counts.join(tot, k).join(rows, k + ["x"]).join(cols, k + ["y"])
    e = F.col("n_x") * F.col("n_y") / F.col("n_s")
    if method == "chisq":
        cell = F.col("n") * F.col("n") / e
    elif method == "gsq":
        cell = 2.0 * F.col("n") * F.ln(F.col("n") / e)
    else:
        raise ValueError(f"unknown test {method!r}")
    per_s = j.groupBy(*k).agg(F.sum(cell).alias("s"), F.max("n_s").alias("n_s"),
                              F.count_distinct("x").alias("r"), F.count_distinct("y").alias("c"))
    stat = F.col("s") - F.col("n_s") if method == "chisq" else F.col("s")
    return per_s.groupBy("test_id").agg(
        F.sum(stat).alias("stat"),
        F.sum((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"))


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper-tail probability per test row (one row per test: tiny)."""
    return pd.Series([1.0 if (d is None or d <= 0) else chi2_sf(max(float(s), 0.0), int(d))
                      for s, d in zip(stat, dof)])


def _tested(counts: DataFrame, tests: Sequence[tuple[str, str, Sequence[str]]], method: str) -> DataFrame:
    """``(test_id, x_col, y_col, s_cols, stat, dof, p)`` of every test from its counts."""
    meta = counts.sparkSession.createDataFrame(
        [(i, x, y, list(s)) for i, (x, y, s) in enumerate(tests)],
        "test_id int, x_col string, y_col string, s_cols array<string>")
    st = test_statistics(counts, method)
    # the test list has one row per test of the call (a wave at most): broadcast
    return (F.broadcast(meta).join(st, "test_id", "left")
            .withColumn("stat", F.coalesce("stat", F.lit(0.0)))
            .withColumn("dof", F.coalesce("dof", F.lit(0)).cast("long"))
            .withColumn("p", chi2_pvalue("stat", "dof")))


def ci_tests(df: DataFrame, tests: Sequence[tuple[str, str, Sequence[str]]],
             method: str = "chisq", weight: str | None = None) -> DataFrame:
    """F3 — ``(test_id, x, y, s, stat, dof, p)`` for every test, one Spark job."""
    return _tested(contingency(df, tests, weight), tests, method)


def lattice_tests(marginals: Marginals, tests: Sequence[tuple[str, str, Sequence[str]]],
                  method: str = "chisq") -> DataFrame:
    """F3 — the same from kept marginal counts.  The counts of all tests are checkpointed: the
    statistics read them four times."""
    return _tested(cut_lineage(marginals.contingency(tests)), tests, method)


def chisq_test(df: DataFrame, x: str, y: str, cond: Sequence[str] = (),
               method: str = "chisq") -> DataFrame:
    """F3 — one (conditional) chi-square or G-square test."""
    return ci_tests(df, [(x, y, list(cond))], method)


def pairwise_tests(df: DataFrame, factors: Sequence[str], method: str = "chisq") -> DataFrame:
    """All unordered factor pairs, unconditional, as one job."""
    tests = [(a, b, []) for a, b in itertools.combinations(factors, 2)]
    return lattice_tests(Marginals(df, factors), tests, method)


def confirm_factors(df: DataFrame, factors: Sequence[str], alpha: float = 0.05,
                    method: str = "chisq", focus: Sequence[str] = ()) -> DataFrame:
    """F5 — a factor independent (p >= alpha) of every other factor is deleted;
    a failed test (no statistic) counts as dependent; fewer than two factors are
    all kept.  Returns ``(factor, kept, n_related, related, min_p, in_focus)``
    with ``related`` sorted by p."""
    spark = df.sparkSession
    if len(factors) < 2:
        return spark.createDataFrame([(f, True, 0, [], None, f in focus) for f in factors],
                                     "factor string, kept boolean, n_related int, "
                                     "related array<string>, min_p double, in_focus boolean")
    t = pairwise_tests(df, factors, method)
    both = (t.select(F.col("x_col").alias("factor"), F.col("y_col").alias("other"), "p", "stat")
            .unionByName(t.select(F.col("y_col").alias("factor"), F.col("x_col").alias("other"),
                                  "p", "stat")))
    dep = F.col("p").isNull() | (F.col("p") < alpha)
    return (both.groupBy("factor").agg(
        F.max(dep.cast("int")).alias("dep"),
        F.sum(dep.cast("int")).cast("int").alias("n_related"),
        F.transform(F.array_sort(F.collect_list(F.when(dep, F.struct(
            F.coalesce("p", F.lit(0.0)).alias("p"), F.col("other").alias("o"))))),
            lambda s: s["o"]).alias("related"),
        F.min("p").alias("min_p"))
        .select("factor", (F.col("dep") == 1).alias("kept"), "n_related", "related", "min_p",
                F.col("factor").isin(list(focus)).alias("in_focus")))


def top_related(tests: DataFrame, k: int = 3) -> DataFrame:
    """F6 — the ``k`` most related factors per factor (smallest p first)."""
    from pyspark.sql.window import Window
    both = (tests.select(F.col("x_col").alias("factor"), F.col("y_col").alias("other"), "p")
            .unionByName(tests.select(F.col("y_col").alias("factor"),
                                      F.col("x_col").alias("other"), "p")))
    w = Window.partitionBy("factor").orderBy("p", "other")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def validate_focus(df: DataFrame, candidates: Sequence[str], min_unique: int = 3) -> DataFrame:
    """F1 — distinct counts of every candidate in one aggregate; a candidate is
    valid with at least ``min_unique`` distinct values; otherwise a reason."""
    spark = df.sparkSession
    present = [c for c in candidates if c in df.columns]
    if present:
        row = df.agg(*[F.count_distinct(quote_ident(c)).alias(f"c{i}")
                       for i, c in enumerate(present)])
        cand = spark.createDataFrame([(i, c) for i, c in enumerate(candidates)],
                                     "pos int, factor string")
        long = row.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("factor"), F.col(f"c{i}").alias("n_unique"))
            for i, c in enumerate(present)])).alias("r")).select("r.*")
        out = cand.join(long, "factor", "left")
    else:
        out = spark.createDataFrame([(i, c, None) for i, c in enumerate(candidates)],
                                    "pos int, factor string, n_unique long")
    reason = (F.when(F.col("n_unique").isNull(), F.concat(F.lit("no column "), F.col("factor")))
              .when(F.col("n_unique") < min_unique, F.concat(
                  F.col("n_unique").cast("string"), F.lit(f" of {min_unique} required values in "),
                  F.col("factor"))))
    return out.select("pos", "factor", "n_unique", reason.isNull().alias("valid"),
                      reason.alias("reason"))


def cluster_entropy(df: DataFrame, cluster: str, focus: Sequence[str]) -> DataFrame:
    """F7 — per cluster: mean over focus factors of the value entropy (natural
    log, 0 when one value); rows sorted best first."""
    items = [F.struct(F.lit(f).alias("f"), _v(f).alias("v")) for f in focus]
    c = (df.select(cluster, F.explode(F.array(*items)).alias("t"))
         .groupBy(cluster, "t.f", "t.v").agg(F.count(F.lit(1)).alias("n")))
    tot = c.groupBy(cluster, "f").agg(F.sum("n").alias("tot"), F.count(F.lit(1)).alias("k"))
    h = (c.join(tot, [cluster, "f"])
         .groupBy(cluster, "f").agg(F.max("k").alias("k"),
                                    (-F.sum(F.col("n") / F.col("tot") * F.ln(F.col("n") / F.col("tot"))))
                                    .alias("h"))
         .withColumn("h", F.when(F.col("k") > 1, F.col("h")).otherwise(F.lit(0.0))))
    return h.groupBy(cluster).agg(F.avg("h").alias("entropy"))


#: Rows of a partition that k-means keeps in memory.
CLUSTER_ROWS = 1_000_000


def cluster_rows(df: DataFrame, cols: Sequence[str], k: int, seed: int = 42,
                 out: str = "cluster") -> DataFrame:
    """F8 — k-means (Spark ML, k-means||) over the factor matrix.  The fit keeps its vectors in
    memory, many times the size of a compressed file: more than ``CLUSTER_ROWS`` rows are dealt to
    partitions of at most about that many first."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=list(cols), outputCol="__features", handleInvalid="keep")
    x = va.transform(df.select("*", *[]).withColumns(
        {c: F.col(quote_ident(c)).cast("double") for c in cols}))
    tasks = -(-x.count() // CLUSTER_ROWS)
    vectors = x.select("__features")
    if tasks > 1:
        vectors = vectors.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism))
    model = KMeans(k=k, seed=seed, featuresCol="__features", predictionCol=out).fit(vectors)
    return model.transform(x).drop("__features")


def cluster_entropy_sample(df: DataFrame, factors: Sequence[str], focus: Sequence[str],
                           n: int, seed: int = 42, key: str = "row_id",
                           min_factors: int = 2, min_rows: int = 50) -> DataFrame:
    """F9 — k = min(F+1, rows//20, 5) clusters, pick the cluster with the highest
    mean focus entropy and sample ``n`` rows of it; fall back to a plain hash
    sample with fewer than ``min_factors`` factors, fewer than ``min_rows`` rows,
    or values the clustering refuses.  Column ``sampling`` says which one it was."""
    from kestrel.operators.sampling import sample_n
    present = [f for f in factors if f in df.columns]
    n_rows = df.count()
    k = max(1, min(len(present) + 1, n_rows // 20, 5))
    if len(present) < min_factors or n_rows < min_rows:
        return sample_n(df, n, seed, key).withColumn("sampling", F.lit("random"))
    try:
        cl = cluster_rows(df, present, k, seed)
    except IllegalArgumentException:  # raised by the clustering for values it cannot use
        return sample_n(df, n, seed, key).withColumn("sampling", F.lit("random"))
    ent = cluster_entropy(cl, "cluster", [f for f in focus if f in df.columns] or present)
    best = ent.orderBy(F.desc("entropy"), "cluster").limit(1).select("cluster")
    rows = cl.join(F.broadcast(best), "cluster", "left_semi").drop("cluster")
    return sample_n(rows, n, seed, key).withColumn("sampling", F.lit("cluster"))


# ----------------------------------------------------------------- PC algorithm
def correlations(df: DataFrame, cols: Sequence[str]) -> tuple[int, dict[tuple[str, str], float]]:
    """Row count and Pearson correlations of all pairs of ``cols`` in one pass (rows complete in
    all of them); a constant column has correlation 0 with every other."""
    x = df.select(*[F.col(quote_ident(c)).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).dropna()
    pairs = list(itertools.combinations(range(len(cols)), 2))
    row = x.agg(F.count(F.lit(1)).alias("n"), *[
        F.coalesce(F.nanvl(F.corr(f"c{i}", f"c{j}"), F.lit(0.0)), F.lit(0.0)).alias(f"r{i}_{j}")
        for i, j in pairs]).first()
    corr = {(c, c): 1.0 for c in cols}
    for i, j in pairs:
        corr[cols[i], cols[j]] = corr[cols[j], cols[i]] = row[f"r{i}_{j}"]
    return row["n"], corr


def partial_fisherz(n: int, corr: dict[tuple[str, str], float], x: str, y: str,
                    cond: Sequence[str] = ()) -> dict:
    """F4 — partial correlation of x and y given ``cond`` from the inverted submatrix, its
    Fisher-Z statistic and two-sided p (1 when the sample is too small for the test)."""
    import numpy as np
    cols = [x, y, *cond]
    inv = np.linalg.pinv(np.array([[corr[a, b] for b in cols] for a in cols]))
    r = -inv[0, 1] / math.sqrt(inv[0, 0] * inv[1, 1])
    r = max(min(float(r), 1 - 1e-12), -1 + 1e-12)
    z = 0.5 * math.log((1 + r) / (1 - r)) * math.sqrt(max(n - len(cond) - 3, 0))
    return {"r": r, "z": z, "p": math.erfc(abs(z) / math.sqrt(2.0))}


def _tester(df: DataFrame, cols: Sequence[str], method: str) -> Callable:
    """A function from a list of tests to their p-values (None: no statistic)."""
    if method == "fisherz":
        n, corr = correlations(df, cols)
        return lambda tests: [partial_fisherz(n, corr, x, y, s)["p"] for x, y, s in tests]
    marginals = Marginals(df, cols)

    def run(tests):
        res = lattice_tests(marginals, tests, method).select("test_id", "p").collect()
        pv = {r.test_id: r.p for r in res}
        return [pv.get(i) for i in range(len(tests))]
    return run


def _subsets(x: str, y: str, adjacent: dict[str, set], depth: int, order: dict[str, int]):
    """Conditioning sets of a pair in the order the sequential algorithm tries them: of the
    neighbours of x, then those of y that are not among the former."""
    of_x = sorted(adjacent[x] - {y}, key=order.__getitem__)
    of_y = sorted(adjacent[y] - {x}, key=order.__getitem__)
    yield from itertools.combinations(of_x, depth)
    known = set(of_x)
    yield from (s for s in itertools.combinations(of_y, depth) if not known.issuperset(s))


def pc_skeleton(df: DataFrame, cols: Sequence[str], alpha: float = 0.05,
                method: str = "chisq", max_depth: int | None = None, wave: int = 2000) -> tuple[set, dict, list]:
    """F10 — stable PC skeleton.  Depth d tests every adjacent pair (x, y) given
    each size-d subset of ``adj(x) \\ {y}`` (then of ``adj(y) \\ {x}``) with the
    adjacency frozen for the whole depth; the first subset with p > alpha
    removes the edge and becomes its separating set.  Tests run in waves: each remaining pair
    gives its next subsets, about ``wave`` tests in all, and a pair that separates gives no more.
    The data is read once, into a count cube (chisq, gsq) or a correlation matrix (fisherz); runs
    until no pair has enough neighbours unless ``max_depth`` is given.  Returns (edges, sepsets,
    log of the tests up to each separation)."""
    p_values = _tester(df, cols, method)
    order = {c: i for i, c in enumerate(cols)}
    adj = {c: set(cols) - {c} for c in cols}
    sepsets: dict = {}
    log: list = []
    depth = 0
    while max_depth is None or depth <= max_depth:
        if not any(len(adj[x]) - 1 >= depth for x in cols):
            break
        frozen = {c: set(v) for c, v in adj.items()}
        pairs = [(x, y) for x in cols for y in sorted(frozen[x], key=order.__getitem__) if order[x] < order[y]]
        waiting = {(x, y): _subsets(x, y, frozen, depth, order) for x, y in pairs}
        while waiting:
            each = max(1, wave // len(waiting))
            tests = [(x, y, list(s)) for (x, y), subsets in waiting.items() for s in itertools.islice(subsets, each)]
            given = {(x, y) for x, y, _ in tests}
            for (x, y, s), p in zip(tests, p_values(tests) if tests else []):
                if (x, y) not in waiting:  # separated earlier in this wave
                    continue
                log.append((depth, x, y, s, p))
                if p is not None and p > alpha:
                    adj[x].discard(y)
                    adj[y].discard(x)
                    sepsets[frozenset((x, y))] = set(s)
                    del waiting[x, y]
            waiting = {pair: subsets for pair, subsets in waiting.items() if pair in given}
        depth += 1
    edges = {frozenset((x, y)) for x in cols for y in adj[x]}
    return edges, sepsets, log


def pc_orient(spark, cols: Sequence[str], edges: set, sepsets: dict,
              graph_id: str = "pc") -> DataFrame:
    """F11 — orientation as DataFrame rules to a fixpoint: v-structures
    ``x -> z <- y`` for unshielded triples with z outside sepset(x, y) (an edge
    already pointing the other way keeps its first orientation), then Meek rules
    R1-R3 until no edge changes.  Output: endpoint form
    ``(graph_id, src, dst, value)`` with -1 tail / 1 arrow per ordered pair."""
    und = spark.createDataFrame([(a, b) for e in edges for a, b in (tuple(e), tuple(e)[::-1])],
                                "a string, b string")
    sep = spark.createDataFrame([(a, b, z) for e, s in sepsets.items() for a, b in
                                 (tuple(e), tuple(e)[::-1]) for z in s],
                                "a string, b string, z string")
    adjn = und
    # unshielded triples x - z - y with x, y not adjacent and z not in sepset(x, y)
    t = (adjn.select(F.col("a").alias("x"), F.col("b").alias("z"))
         .join(adjn.select(F.col("a").alias("z"), F.col("b").alias("y")), "z")
         .where(F.col("x") < F.col("y"))
         .join(adjn.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti")
         .join(sep.select(F.col("a").alias("x"), F.col("b").alias("y"), "z"), ["x", "y", "z"],
               "left_anti"))
    arcs = (t.select(F.col("x").alias("a"), F.col("z").alias("b"))
            .unionByName(t.select(F.col("y").alias("a"), F.col("z").alias("b"))).distinct())
    # conflicts: keep an arc only if the reverse was not also proposed, by name order
    rev = arcs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    arcs = arcs.join(rev, ["a", "b"], "left_anti").unionByName(
        arcs.join(rev, ["a", "b"], "left_semi").where(F.col("a") < F.col("b")))
    directed = cut_lineage(arcs)
    while True:  # each round directs an edge more, so it ends
        undirected = (und.join(directed, ["a", "b"], "left_anti")
                      .join(directed.select(F.col("b").alias("a"), F.col("a").alias("b")),
                            ["a", "b"], "left_anti"))
        # R1: a -> b, b - c, a and c not adjacent  =>  b -> c
        r1 = (directed.select(F.col("a").alias("p"), F.col("b").alias("a"))
              .join(undirected, "a")
              .join(adjn.select(F.col("a").alias("p"), F.col("b").alias("b")), ["p", "b"], "left_anti")
              .where(F.col("p") != F.col("b")).select("a", "b"))
        # R2: a -> c -> b and a - b  =>  a -> b
        r2 = (directed.select("a", F.col("b").alias("c"))
              .join(directed.select(F.col("a").alias("c"), "b"), "c")
              .join(undirected, ["a", "b"], "left_semi").select("a", "b"))
        # R3: a - c -> b, a - d -> b, c and d not adjacent, a - b  =>  a -> b
        cb = undirected.select("a", F.col("b").alias("c")).join(
            directed.select(F.col("a").alias("c"), "b"), "c")
        r3 = (cb.join(cb.select("a", "b", F.col("c").alias("d")), ["a", "b"])
              .where(F.col("c") < F.col("d"))
              .join(adjn.select(F.col("a").alias("c"), F.col("b").alias("d")), ["c", "d"], "left_anti")
              .join(undirected, ["a", "b"], "left_semi").select("a", "b"))
        new = r1.unionByName(r2).unionByName(r3).distinct().join(directed, ["a", "b"], "left_anti")
        new = new.join(new.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"],
                       "left_anti")
        new = cut_lineage(new)
        if new.isEmpty():
            break
        directed = cut_lineage(directed.unionByName(new))
    undirected = (und.join(directed, ["a", "b"], "left_anti")
                  .join(directed.select(F.col("b").alias("a"), F.col("a").alias("b")),
                        ["a", "b"], "left_anti"))
    out = (directed.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(-1.0).alias("value"))
           .unionByName(directed.select(F.col("b").alias("src"), F.col("a").alias("dst"),
                                        F.lit(1.0).alias("value")))
           .unionByName(undirected.select(F.col("a").alias("src"), F.col("b").alias("dst"),
                                          F.lit(-1.0).alias("value"))))
    return out.withColumn("graph_id", F.lit(graph_id)).select("graph_id", "src", "dst", "value")


def pc(df: DataFrame, cols: Sequence[str], alpha: float = 0.05, method: str = "chisq",
       max_depth: int | None = None, graph_id: str = "pc") -> DataFrame:
    """F10 + F11 — PC: skeleton then orientation, endpoint-form edges."""
    edges, seps, _ = pc_skeleton(df, cols, alpha, method, max_depth)
    return pc_orient(df.sparkSession, cols, edges, seps, graph_id)


def bic_local_scores(df: DataFrame, candidates: Sequence[tuple[str, Sequence[str]]]
                     ) -> DataFrame:
    """F12 — discrete BIC local score of ``node | parents`` for many candidates in
    one grouped count: ``sum n ln(n / n_parent) - ln(N)/2 * (r-1) * q`` with r
    the node's observed values and q the observed parent configurations.  Rows with a null in
    the node or its parents are left out of that candidate."""
    marginals = Marginals(df, [c for node, parents in candidates for c in (node, *parents)])
    c = cut_lineage(marginals.contingency([(node, node, list(parents)) for node, parents in candidates])).select(
        F.col("test_id").alias("cand_id"), F.col("s_key").alias("pk"), F.col("x").alias("v"), "n")
    par = c.groupBy("cand_id", "pk").agg(F.sum("n").alias("n_pk"))
    ll = (c.join(par, ["cand_id", "pk"]).groupBy("cand_id").agg(
        F.sum(F.col("n") * F.ln(F.col("n") / F.col("n_pk"))).alias("ll"),
        F.count_distinct("v").alias("r"), F.count_distinct("pk").alias("q"),
        F.sum("n").alias("N")))
    meta = df.sparkSession.createDataFrame(
        [(i, n, list(p)) for i, (n, p) in enumerate(candidates)],
        "cand_id int, node string, parents array<string>")
    return (F.broadcast(meta).join(ll, "cand_id")
            .select("cand_id", "node", "parents", "ll",
                    (F.col("ll") - F.ln(F.col("N")) / 2.0 * (F.col("r") - 1) * F.col("q"))
                    .alias("bic")))


def bic_gaussian_scores(df: DataFrame, candidates: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """F12 — continuous BIC local score from one pass of covariance aggregates:
    ``-N/2 ln(residual variance) - ln(N)/2 * (number of parents + 1)``, the residual being that
    of the least-squares regression of the node on its parents (rows complete in all columns)."""
    import numpy as np
    cols = list(dict.fromkeys(c for node, parents in candidates for c in (node, *parents)))
    x = df.select(*[F.col(quote_ident(c)).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).dropna()
    row = x.agg(F.count(F.lit(1)).alias("n"), *[
        F.covar_pop(f"c{i}", f"c{j}").alias(f"s{i}_{j}")
        for i in range(len(cols)) for j in range(i, len(cols))]).first()
    cov = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(cols))] for i in range(len(cols))])
    n, out = row["n"], []
    for cid, (node, parents) in enumerate(candidates):
        i, p = cols.index(node), [cols.index(c) for c in parents]
        var = cov[i, i]
        if p:
            var = var - cov[i, p] @ np.linalg.pinv(cov[np.ix_(p, p)]) @ cov[p, i]
        score = -n / 2.0 * math.log(max(float(var), 1e-300)) - math.log(n) / 2.0 * (len(p) + 1) if n else None
        out.append((cid, node, list(parents), score))
    return df.sparkSession.createDataFrame(out, "cand_id int, node string, parents array<string>, bic double")


def fisherz_test(df: DataFrame, x: str, y: str, cond: Sequence[str] = ()) -> dict:
    """F4 — Fisher-Z test of one pair given ``cond`` (one pass over the data)."""
    n, corr = correlations(df, list(dict.fromkeys([x, y, *cond])))
    return partial_fisherz(n, corr, x, y, cond)


def normalize_edges(edges: DataFrame) -> DataFrame:
    """F13 — endpoint pairs to ``(from, to, type)``: (-1, 1) directed,
    (-1, -1) undirected, anything else ``undetermined``; one row per pair."""
    g = edges if "graph_id" in edges.columns else edges.withColumn("graph_id", F.lit("g"))
    rev = g.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("src"),
                   F.col("value").alias("rv"))
    j = g.join(rev, ["graph_id", "src", "dst"], "left")
    d = (F.col("value") == -1) & (F.col("rv") == 1)
    keep = d | ((F.col("src") < F.col("dst")) & ~((F.col("value") == 1) & (F.col("rv") == -1)))
    typ = (F.when(d, F.lit("directed"))
           .when((F.col("value") == -1) & (F.col("rv") == -1), F.lit("undirected"))
           .otherwise(F.lit("undetermined")))
    return j.where(keep).select("graph_id", F.col("src").alias("from"), F.col("dst").alias("to"),
                                typ.alias("type"))


def neighbours(edges: DataFrame, focus: Sequence[str]) -> DataFrame:
    """F14 — direct neighbours of each focus node (any edge, either direction)."""
    g = edges if "graph_id" in edges.columns else edges.withColumn("graph_id", F.lit("g"))
    pairs = g.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("neighbour"))
    return (pairs.where(F.col("node").isin(list(focus))).distinct()
            .groupBy("graph_id", "node").agg(F.array_sort(F.collect_set("neighbour")).alias("neighbours")))


def markov_blanket(directed: DataFrame, focus: Sequence[str]) -> DataFrame:
    """F14 (opt-in) — parents, children and spouses (other parents of children)."""
    d = directed if "graph_id" in directed.columns else directed.withColumn("graph_id", F.lit("g"))
    par = d.select("graph_id", F.col("dst").alias("node"), F.col("src").alias("m"))
    chi = d.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("m"))
    sp = (chi.join(d.select("graph_id", F.col("dst").alias("m"), F.col("src").alias("sp")),
                   ["graph_id", "m"]).where(F.col("sp") != F.col("node"))
          .select("graph_id", "node", F.col("sp").alias("m")))
    allm = par.unionByName(chi).unionByName(sp).where(F.col("node").isin(list(focus)))
    return allm.groupBy("graph_id", "node").agg(F.array_sort(F.collect_set("m")).alias("blanket"))


def graph_summary(edges: DataFrame, focus: Sequence[str] = ()) -> DataFrame:
    """F15 — node count, edge count (unordered pairs) and neighbour counts."""
    g = edges if "graph_id" in edges.columns else edges.withColumn("graph_id", F.lit("g"))
    nodes = g.select("graph_id", F.col("src").alias("n")).unionByName(
        g.select("graph_id", F.col("dst").alias("n"))).distinct()
    pairs = g.select("graph_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    s = (nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes"))
         .join(pairs.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges")), "graph_id", "left"))
    if focus:
        nb = neighbours(g, focus).groupBy("graph_id").agg(
            F.map_from_entries(F.collect_list(F.struct("node", F.size("neighbours")))).alias("blanket_sizes"))
        s = s.join(nb, "graph_id", "left")
    return s


def group_stats(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """F16 — count, mean, population std, min, max per group."""
    x = F.col(quote_ident(col)).cast("double")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"),
                               F.stddev_pop(x).alias("std"), F.min(x).alias("min"),
                               F.max(x).alias("max"))
