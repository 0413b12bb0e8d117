"""Queries for the baseline detectors (L1-L6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import binning as C
from kestrel.operators import detectors as L
from kestrel.operators import metrics as J
from kestrel.operators import neighbors as N
from kestrel.operators import sampling as E
from kestrel.operators.sweep import Method, run_sweep
from kestrel.functions.exprs import hash_num
from kestrel.plans import prepare as P
from kestrel.plans.registry import register
from kestrel.session import table
from kestrel.sources.io import scratch_path

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _li(spark, sf_dir):
    # lineitem has no unique key in the given data: the hash of the whole row labels it, so
    # samples and scores do not depend on how files are split
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.xxhash64(*li.columns).alias("row_id"), *LI_NUM)


def _long_sql(cols):
    return " UNION ALL ".join(f"SELECT row_id, '{c}' AS c, {c} AS v FROM x" for c in cols)


_ECOD_SQL = f"""
WITH x AS (SELECT * FROM lineitem),
n AS (SELECT count(*) AS n FROM x),
sk AS (SELECT {", ".join(f"coalesce(sign(skewness({c})), 0) AS sk_{c}" for c in LI_NUM)} FROM x),
e AS (SELECT x.*, {", ".join(
    f"count(*) OVER (ORDER BY {c} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS le_{c}, "
    f"count(*) OVER (ORDER BY {c} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ge_{c}"
    for c in LI_NUM)} FROM x),
u AS (SELECT e.*, {", ".join(
    f"greatest(-ln(le_{c} / n) * -sign(sk_{c} - 1) + -ln(ge_{c} / n) * sign(sk_{c} + 1), "
    f"greatest(-ln(le_{c} / n), -ln(ge_{c} / n))) AS o_{c}" for c in LI_NUM)} FROM e, n, sk)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {", ".join(LI_NUM)},
       round({" + ".join(f"o_{c}" for c in LI_NUM)}, 6) AS score FROM u"""


@register("l01_ecod", _ECOD_SQL)
def q_ecod(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                 "l_suppkey", *LI_NUM)
    return L.ecod(li, LI_NUM).withColumn("score", F.round("score", 6))


def _cust(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"),
                                                   "c_acctbal", "c_nationkey")


@register("l03_pca_score")
def q_pca(spark, sf_dir):
    return L.pca_score(_li(spark, sf_dir), LI_NUM)


@register("l04_iforest")
def q_iforest(spark, sf_dir):
    return L.iforest(_li(spark, sf_dir), LI_NUM, n_trees=100, psi=256, seed=0)


@register("l05_random_rep_iforest")
def q_rp_iforest(spark, sf_dir):
    return L.random_rep_iforest(_cust(spark, sf_dir), ["c_acctbal", "c_nationkey"],
                                n_features=8, n_trees=100, psi=256, seed=0)


@register("l06_run_benchmark")
def q_run_benchmark(spark, sf_dir):
    """Detectors x market-segment datasets on customer, evaluated with J1-J3."""
    cols = ["c_acctbal", "c_nationkey"]
    base = table(spark, sf_dir, "customer")
    labels = base.select(F.col("c_custkey").alias("row_id"),
                         (F.col("c_acctbal") < 0).cast("int").alias("label"))

    def make(seg):
        return lambda: (base.where(F.col("c_mktsegment") == seg).select(
            F.col("c_custkey").alias("row_id"), *cols), labels, cols)
    segs = sorted(r[0] for r in base.select("c_mktsegment").distinct().collect())
    detectors = {
        "zscore": lambda df, cs: C.standardize(df, cs).select(
            "row_id", sum((F.abs(F.col(c)) for c in cs[1:]), F.abs(F.col(cs[0]))).alias("score")),
        "ecod": lambda df, cs: L.ecod(df, cs).select("row_id", "score"),
        "pca": lambda df, cs: L.pca_score(df, cs),
        "iforest": lambda df, cs: L.iforest(df, cs, n_trees=100, psi=256, seed=1),
    }
    return L.run_benchmark({s: make(s) for s in segs}, detectors,
                           lambda s: J.evaluate(s, "score", "label", "row_id"))


def _region_sweep(spark, sf_dir, methods):
    """Methods on two semi-supervised splits of the customers of every region; in debt is label 1."""
    customers = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("row_id"), (F.col("c_acctbal") < 0).cast("int").alias("label"), "n_regionkey",
        "c_acctbal", "n_name", "c_mktsegment")
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()  # one row per dataset
    datasets = {r.r_name: customers.where(F.col("n_regionkey") == r.r_regionkey).drop("n_regionkey") for r in regions}

    def split(rows, s):
        keyed = rows.withColumn("__order", hash_num(s, F.col("row_id")))
        return E.split_semi_supervised(keyed, "label", "__order").drop("__order")
    return run_sweep(spark, datasets, (0, 1), methods, split,
                     lambda rows, encoding: P.encode_features(rows, "row_id", encoding), scratch_path(spark, "sweep"))


ECOD_METHOD = Method(lambda model, train, test, cols: L.ecod(train, cols, test))


@register("l06_sweep")
def q_sweep(spark, sf_dir):
    """Three detectors x five regions x two splits, each with its own input encoding."""
    methods = {
        "ecod": ECOD_METHOD,
        "pca": Method(lambda model, train, test, cols: L.pca_score(train, cols, test=test), encoding="one_hot"),
        "iforest": Method(lambda forest, train, test, cols: L.iforest_score(forest, test, cols),
                          lambda train, cols: L.iforest_fit(train, cols, n_trees=50), "one_hot"),
    }
    return _region_sweep(spark, sf_dir, methods)


_SWEEP_DIMS = ["a", "b", "c"]


@register("l06_sweep_ecod", f"""
WITH base AS (SELECT c_custkey AS row_id, r_name AS dataset, CAST(c_acctbal < 0 AS INTEGER) AS label,
                     c_acctbal AS a, n_name AS b, c_mktsegment AS c
              FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT row_id, dataset, label, a, dense_rank() OVER (PARTITION BY dataset ORDER BY b) AS b,
             dense_rank() OVER (PARTITION BY dataset ORDER BY c) AS c FROM base),
st AS (SELECT dataset, count(*) AS n, {", ".join(f"coalesce(sign(skewness({d})), 0) AS s_{d}" for d in _SWEEP_DIMS)}
       FROM x GROUP BY dataset),
t AS (SELECT x.*, {", ".join(
    f"-ln(count(*) OVER (PARTITION BY dataset ORDER BY {d} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
    f"/ CAST(count(*) OVER (PARTITION BY dataset) AS DOUBLE)) AS l_{d}, "
    f"-ln(count(*) OVER (PARTITION BY dataset ORDER BY {d} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
    f"/ CAST(count(*) OVER (PARTITION BY dataset) AS DOUBLE)) AS r_{d}" for d in _SWEEP_DIMS)} FROM x),
sc AS (SELECT row_id, t.dataset, label, round({" + ".join(
    f"greatest(l_{d} * -sign(s_{d} - 1) + r_{d} * sign(s_{d} + 1), l_{d}, r_{d})" for d in _SWEEP_DIMS)}, 9) AS score
       FROM t JOIN st ON t.dataset = st.dataset),
o AS (SELECT sc.*, s.range AS split, row_number() OVER (PARTITION BY dataset, s.range, label ORDER BY
             ('0x' || substr(md5(concat_ws('|', CAST(s.range AS VARCHAR), CAST(row_id AS VARCHAR))), 1, 15))::BIGINT) AS rn,
             count(*) OVER (PARTITION BY dataset, s.range, label) AS cnt FROM sc, range(2) s),
test AS (SELECT * FROM o WHERE label = 1 OR rn > floor(cnt / 2)),
rk AS (SELECT *, (rank() OVER (PARTITION BY dataset, split ORDER BY score)
                  + (count(*) OVER (PARTITION BY dataset, split, score) - 1) / 2.0) AS r FROM test)
SELECT dataset, CAST(split AS INTEGER) AS split, 'ecod' AS method, 'ordinal' AS encoding, 'ok' AS status,
       round((sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0)
             / (sum(label) * sum(1 - label)), 6) AS auc
FROM rk GROUP BY dataset, split""")
def q_sweep_ecod(spark, sf_dir):
    """The sweep with ECOD alone: its area under the ROC curve in every run."""
    rounded = Method(lambda model, train, test, cols: L.ecod(train, cols, test).withColumn("score", F.round("score", 9)))
    out = _region_sweep(spark, sf_dir, {"ecod": rounded}).where("metric = 'AUC-ROC'")
    return out.select("dataset", "split", "method", "encoding", "status", F.round("value", 6).alias("auc"))


_KNN_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
d AS (SELECT a.vec_id, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2
      FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id),
r AS (SELECT vec_id, d2, row_number() OVER (PARTITION BY vec_id ORDER BY d2) AS k FROM d)
SELECT vec_id, round(sqrt(d2), 6) AS score FROM r WHERE k = 5
"""


@register("l02_knn_score", _KNN_SQL)
def q_knn(spark, sf_dir):
    """Every embedding with the distance to its fifth nearest neighbour."""
    return N.knn_score(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 5) \
        .select("vec_id", F.round("score", 6).alias("score"))
