"""L — data-parallel baseline detectors (semantics from the published papers).

* ECOD: per dimension, left and right empirical tail probabilities over the
  fitted data; ``O = max(U_left, U_right, U_skew)`` per dimension, summed.  ECDFs
  are cumulative counts of distinct values (bucketed prefix sums), joined back.
* PCA: standardized data, covariance from one aggregate pass (d x d), the small
  eigen-solve on the driver, distances as column expressions.
* Isolation forest: each tree draws its own sample of ``psi`` rows (hash
  filter + bounded top-k per tree), trees are grown in parallel with one
  ``applyInPandas`` group per tree (a group holds at most ``psi`` rows), and the
  (bounded) forest is broadcast to a ``mapInPandas`` scorer.
* Random-projection forest: seeded linear + ReLU features as column
  expressions, then the isolation forest.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.coding import look_up, value_counts
from kestrel.functions.exprs import quote_ident
from kestrel.functions.prefix import prefix_sums
from kestrel.session import cut_lineage, unbounded


def _c(n: str):
    return F.col(quote_ident(n)).cast("double")


def ecod(data: DataFrame, cols: Sequence[str], test: DataFrame | None = None,
         out: str = "score") -> DataFrame:
    """L1 — ECOD: adds ``score`` to every row of ``test`` (or of ``data``).  The
    ECDFs are fitted on ``data`` plus ``test`` (as the detector does when
    scoring).  The tails of the values of all columns are looked up together."""
    fit = data if test is None else data.select(*cols).unionByName(test.select(*cols))
    scored = data if test is None else test
    d = cut_lineage(value_counts(fit, cols, _c))
    cum = prefix_sums(d.withColumn("cnt", F.col("n")), ["ci"], "v", ["cnt"]).select("ci", "v", "cnt", "cnt_before")
    # a column's tails are shares of its values that are not null
    st = fit.agg(*[F.signum(F.skewness(_c(c))).alias(f"sk_{i}") for i, c in enumerate(cols)],
                 *[F.count(_c(c)).alias(f"n_{i}") for i, c in enumerate(cols)])
    sk = st.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ci"), F.col(f"sk_{i}").alias("sk"), F.col(f"n_{i}").alias("n"))
                                       for i in range(len(cols))])).alias("s")).select("s.*")
    # per (column, distinct value): -ln F(v) (left tail) and -ln P(X >= v) (right tail);
    # the per-column stats row is one row per column: broadcast
    lookup = (cum.join(F.broadcast(sk), "ci")
              .select("ci", "v", F.col("cnt").alias("count"),
                      (-F.ln((F.col("cnt_before") + F.col("cnt")) / F.col("n"))).alias("ul"),
                      (-F.ln((F.col("n") - F.col("cnt_before")) / F.col("n"))).alias("ur"),
                      F.coalesce(F.nanvl(F.col("sk"), F.lit(0.0)), F.lit(0.0)).alias("sk")))
    uskew = (F.col("ul") * -F.signum(F.col("sk") - 1) + F.col("ur") * F.signum(F.col("sk") + 1))
    o = cut_lineage(lookup.select("ci", "v", F.col("count").alias("n"),
                                  F.greatest(uskew, F.greatest("ul", "ur")).alias("o")))
    res, terms = look_up(scored, cols, o, "o", _c)
    return res.withColumn(out, sum(terms[1:], terms[0])).select(*[c for c in scored.columns if c != out], out)


def pca_score(train: DataFrame, cols: Sequence[str], row_id: str = "row_id",
              test: DataFrame | None = None, n_components: int | None = None) -> DataFrame:
    """L3 — standardized data; components and explained-variance ratios from the
    (d x d) covariance; score = sum over the selected components of
    ``||x - component|| / ratio``.  A non-finite score is retried with the
    smallest-variance components dropped."""
    k = len(cols)
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.avg(_c(c)).alias(f"m_{c}"), F.stddev_pop(_c(c)).alias(f"s_{c}")]
    st = train.agg(*aggs).first()
    mean = np.array([st[f"m_{c}"] for c in cols])
    std = np.array([st[f"s_{c}"] or 1.0 for c in cols])
    std[std == 0] = 1.0
    z = [((_c(c) - float(mean[i])) / float(std[i])) for i, c in enumerate(cols)]
    cov_aggs = [F.avg(z[i] * z[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    cv = train.agg(*cov_aggs).first()
    cov = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = cv[f"c{i}_{j}"]
    n = st["n"]
    cov = cov * n / max(n - 1, 1)  # sample covariance, as the PCA fit uses
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], vecs[:, order]
    ratio = vals / vals.sum()
    m = n_components or k
    while m > 0:
        sel = list(range(k - m, k))
        if all(ratio[s] > 0 and math.isfinite(ratio[s]) for s in sel):
            break
        m -= 1
    sel = list(range(k - m, k)) if m > 0 else [0]
    terms = []
    for s in sel:
        comp = vecs[:, s]
        dist = F.sqrt(sum((z[i] - float(comp[i])) ** 2 for i in range(k)))
        terms.append(dist / float(ratio[s]))
    target = test if test is not None else train
    return target.select(F.col(quote_ident(row_id)).alias("row_id"),
                         sum(terms[1:], terms[0]).alias("score"))


# ----------------------------------------------------------------- isolation forest
def _c_factor(n):
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + 0.5772156649015329) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(pdf: pd.DataFrame, cols: list[str], psi: int, seed: int) -> pd.DataFrame:
    """One isolation tree from its (<= psi rows) sample: random feature, random
    split between min and max, until height ceil(log2(psi)) or one row."""
    tree_id = int(pdf["tree_id"].iloc[0])
    rng = np.random.default_rng(seed * 100_003 + tree_id)
    x = pdf[cols].to_numpy(dtype=float)
    limit = int(math.ceil(math.log2(max(psi, 2))))
    nodes = []  # (node, feature, threshold, left, right, size)

    def build(idx, depth):
        nid = len(nodes)
        nodes.append(None)
        sub = x[idx]
        if depth >= limit or len(idx) <= 1:
            nodes[nid] = (nid, -1, 0.0, -1, -1, len(idx))
            return nid
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        feats = np.flatnonzero(hi > lo)
        if len(feats) == 0:
            nodes[nid] = (nid, -1, 0.0, -1, -1, len(idx))
            return nid
        f = int(rng.choice(feats))
        thr = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < thr]
        right = idx[sub[:, f] >= thr]
        nodes[nid] = (nid, f, thr, -2, -2, len(idx))
        lnode = build(left, depth + 1)
        rnode = build(right, depth + 1)
        nodes[nid] = (nid, f, thr, lnode, rnode, len(idx))
        return nid

    build(np.arange(len(x)), 0)
    arr = np.array(nodes, dtype=object)
    return pd.DataFrame({"tree_id": tree_id, "node": arr[:, 0].astype(int),
                         "feature": arr[:, 1].astype(int), "threshold": arr[:, 2].astype(float),
                         "left": arr[:, 3].astype(int), "right": arr[:, 4].astype(int),
                         "size": arr[:, 5].astype(int)})


def iforest_fit(train: DataFrame, cols: Sequence[str], n_trees: int = 100, psi: int = 256,
                seed: int = 0, row_id: str = "row_id", n: int | None = None) -> DataFrame:
    """L4 (fit) — ``(tree_id, node, feature, threshold, left, right, size)``.

    Each tree's sample: a row is a candidate of every tree with the rate ``3 psi / n``.  The gaps
    between a row's trees are geometric, so one hash decides for nearly every row that it is no
    candidate at all, and only the others draw again.  Of the expected 3 psi candidates of
    a tree the ``psi`` of smallest hash are kept (a window over a few hundred rows per tree).
    The sample (trees x psi rows) is materialized once with a reliable checkpoint; trees grow
    in parallel, one ``applyInPandas`` group each."""
    from pyspark.sql.window import Window
    cols = list(cols)
    n = train.count() if n is None else n
    psi_eff = min(psi, n)
    rate = min(1.0, 3.0 * psi_eff / max(n, 1))
    x = train.select(F.col(quote_ident(row_id)).alias("row_id"), *[_c(c).alias(c) for c in cols])

    def gap(k, miss):  # trees passed over before the next one, from the k-th hash of the row
        u = (F.xxhash64(F.lit(seed), k, F.col("row_id")).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") + 0.5) / float(1 << 53)
        return F.floor(F.least(F.ln(u) / F.lit(miss), F.lit(float(n_trees)))).cast("int")
    while True:
        miss = math.log1p(-rate) if rate < 1.0 else float("-inf")
        some = x.withColumn("__first", gap(F.lit(0), miss)).where(F.col("__first") < n_trees)
        trees = F.aggregate(
            F.sequence(F.lit(1), F.lit(n_trees)), F.array("__first"),
            lambda t, k: F.when(F.element_at(t, -1) + 1 >= n_trees, t).otherwise(
                F.concat(t, F.array(F.element_at(t, -1) + 1 + gap(k, miss)))))
        cand = some.withColumn("tree_id", F.explode(F.filter(trees, lambda t: t < n_trees))).withColumn(
            "__h", F.xxhash64(F.lit(seed + 1), F.col("tree_id"), F.col("row_id")))
        w = Window.partitionBy("tree_id").orderBy("__h", "row_id")
        samp = cut_lineage(cand.withColumn("__r", F.row_number().over(w))
                           .where(F.col("__r") <= psi_eff).drop("__r", "__h", "__first"))
        counts = samp.groupBy("tree_id").count().collect()
        if (len(counts) == n_trees and min(r["count"] for r in counts) >= psi_eff) or rate >= 1.0:
            break
        rate = min(1.0, rate * 2)
    schema = ("tree_id int, node int, feature int, threshold double, left int, right int, "
              "size int")
    return (samp.select(F.col("tree_id").cast("int"), *cols)
            .groupBy("tree_id").applyInPandas(lambda pdf: _grow(pdf, cols, psi_eff, seed), schema))


def iforest_score(forest: DataFrame, test: DataFrame, cols: Sequence[str], psi: int = 256,
                  row_id: str = "row_id") -> DataFrame:
    """L4 (score) — ``2 ** (-E[h(x)] / c(psi))`` with path length ``depth +
    c(leaf size)``.  The forest (trees x at most 2**(log2(psi)+1) nodes) is
    collected once and broadcast; scoring runs vectorized per Arrow batch."""
    cols = list(cols)
    pf = forest.toPandas().sort_values(["tree_id", "node"])
    max_nodes = int(pf["node"].max()) + 1
    tree_ids = sorted(pf["tree_id"].unique())
    T_ = len(tree_ids)
    tid = {t: i for i, t in enumerate(tree_ids)}
    feat = np.full((T_, max_nodes), -1, dtype=np.int64)
    thr = np.zeros((T_, max_nodes))
    left = np.full((T_, max_nodes), -1, dtype=np.int64)
    right = np.full((T_, max_nodes), -1, dtype=np.int64)
    size = np.zeros((T_, max_nodes))
    for r in pf.itertuples(index=False):
        i = tid[r.tree_id]
        feat[i, r.node], thr[i, r.node] = r.feature, r.threshold
        left[i, r.node], right[i, r.node], size[i, r.node] = r.left, r.right, r.size
    # a leaf leads to itself, so that all rows walk the same number of steps without a mask
    leaf = feat < 0
    depth, levels = np.zeros((T_, max_nodes)), 0
    for i in range(T_):
        for node in range(max_nodes):  # children come after their parent
            if feat[i, node] >= 0:
                depth[i, [left[i, node], right[i, node]]] = depth[i, node] + 1
        levels = max(levels, int(depth[i].max()))
    own = np.broadcast_to(np.arange(max_nodes), feat.shape)
    start = (np.arange(T_) * max_nodes)[:, None]
    child = np.stack([np.where(leaf, own, left) + start, np.where(leaf, own, right) + start], axis=-1)
    path = depth + np.where(leaf, _c_factor(size.ravel()).reshape(size.shape), 0.0)
    bc = test.sparkSession.sparkContext.broadcast((
        np.where(leaf, 0, feat).astype(np.int32).ravel(), np.where(leaf, np.inf, thr).ravel(),
        child.astype(np.int32).ravel(), path.ravel(), start.ravel().astype(np.int32)))
    cpsi = float(_c_factor(np.array([psi]))[0]) if psi > 1 else 1.0

    def score(it):
        f, th, ch, lengths, first = bc.value
        block = max(1, 200_000 // len(first))  # rows whose walk stays in the processor's cache
        for pdf in it:
            x = np.ascontiguousarray(pdf[cols].to_numpy(dtype=float))
            total = np.empty(len(x))
            for at in range(0, len(x), block):
                part = x[at:at + block].ravel()
                rows = (np.arange(len(part) // len(cols), dtype=np.int32) * len(cols))[:, None]
                idx = np.broadcast_to(first, (len(rows), len(first))).copy()
                for _ in range(levels):
                    less = part.take(rows + f.take(idx)) < th.take(idx)
                    idx = ch.take(2 * idx + ~less)
                total[at:at + block] = lengths.take(idx).sum(axis=1)
            yield pd.DataFrame({"row_id": pdf["row_id"].to_numpy(),
                                "score": np.power(2.0, -(total / len(first)) / cpsi)})
    x = test.select(F.col(quote_ident(row_id)).alias("row_id"), *[_c(c).alias(c) for c in cols])
    par = test.sparkSession.sparkContext.defaultParallelism
    if x.rdd.getNumPartitions() < par:  # Python-side work: use every core
        x = x.repartition(par)
    rid_type = dict(x.dtypes)["row_id"]
    return x.mapInPandas(score, f"row_id {rid_type}, score double")


def iforest(train: DataFrame, cols: Sequence[str], test: DataFrame | None = None,
            n_trees: int = 100, psi: int = 256, seed: int = 0, row_id: str = "row_id"
            ) -> DataFrame:
    """L4 — fit on ``train``, score ``test`` (or ``train``)."""
    n = train.count()
    forest = iforest_fit(train, cols, n_trees, psi, seed, row_id, n)
    return iforest_score(forest, test if test is not None else train, cols, min(psi, max(n, 1)), row_id)


def random_projection(df: DataFrame, cols: Sequence[str], n_features: int = 8, seed: int = 0,
                      prefix: str = "rp") -> tuple[DataFrame, list[str]]:
    """L5 — untrained random representation: ReLU(x W + b) with seeded Gaussian
    weights, as column expressions."""
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(len(cols), n_features))
    b = rng.normal(size=n_features)
    names = [f"{prefix}{j}" for j in range(n_features)]
    feats = [F.greatest(F.lit(0.0), sum((_c(c) * float(w[i, j]) for i, c in enumerate(cols)),
                                        F.lit(float(b[j])))).alias(names[j])
             for j in range(n_features)]
    return df.select("*", *feats), names


def random_rep_iforest(train: DataFrame, cols: Sequence[str], test: DataFrame | None = None,
                       n_features: int = 8, n_trees: int = 100, psi: int = 256, seed: int = 0,
                       row_id: str = "row_id") -> DataFrame:
    """L5 — isolation forest on random ReLU projections."""
    tr, names = random_projection(train, cols, n_features, seed)
    te = random_projection(test, cols, n_features, seed)[0] if test is not None else None
    return iforest(tr, names, te, n_trees, psi, seed, row_id)


def run_benchmark(datasets: dict[str, Callable[[], tuple[DataFrame, DataFrame, list[str]]]],
                  detectors: dict[str, Callable], evaluate: Callable) -> DataFrame | None:
    """L6 — every detector on every dataset (and its splits).  Metrics rows carry the dataset,
    the method, the seconds of fitting and scoring (the scores are written before they are
    evaluated) and status ``ok``; a detector that fails has one row with its error as status."""
    out = None
    for dname, make in datasets.items():
        scored_input, labels, cols = make()
        for mname, det in detectors.items():
            t0 = time.time()
            try:
                scores = cut_lineage(det(scored_input, cols))
                seconds = round(time.time() - t0, 3)
                m = evaluate(scores.join(unbounded(labels), "row_id")).withColumn("status", F.lit("ok"))
            except Exception as error:  # noqa: BLE001 - any failure of a user's detector is a result
                seconds = round(time.time() - t0, 3)
                m = labels.sparkSession.createDataFrame(
                    [(f"{type(error).__name__}: {str(error)[:200]}",)], "status string")
            m = m.withColumns({"dataset": F.lit(dname), "method": F.lit(mname), "seconds": F.lit(seconds)})
            out = m if out is None else out.unionByName(m, allowMissingColumns=True)
    return out
