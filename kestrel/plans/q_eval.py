"""Queries for evaluation operators (J1-J13) on detector scores over ``customer``.

Binding: row = customer, ``dataset`` = region name, ``split`` = market segment,
``label`` = negative account balance.  Methods:

* ``zscore``        |standardized balance| (continuous, few ties),
* ``nation_rarity`` minus the nation's customer count (heavy ties at the cut),
* ``broken``        like ``zscore`` but NaN for balances above 9990 (J6 guard).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import binning as C
from kestrel.operators import metrics as J
from kestrel.plans import bindings as BD
from kestrel.plans.registry import register
from kestrel.session import table

METHODS = ["zscore", "nation_rarity", "broken"]


def scored_customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal",
                                                "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    base = (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
            .join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("c_custkey").alias("row_id"), F.col("r_name").alias("dataset"),
                    F.col("c_mktsegment").alias("split"), "c_nationkey", "c_acctbal",
                    (F.col("c_acctbal") < 0).cast("int").alias("label")))
    z = C.standardize(base.select("row_id", "c_acctbal"), ["c_acctbal"]).select(
        "row_id", F.abs("c_acctbal").alias("z"))
    nat = base.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("nat_n"))
    s = base.join(z, "row_id").join(nat, "c_nationkey")
    return s.select("row_id", "dataset", "split", "label", F.explode(F.array(
        F.struct(F.lit("zscore").alias("method"), F.col("z").alias("score")),
        F.struct(F.lit("nation_rarity").alias("method"), (-F.col("nat_n")).cast("double").alias("score")),
        F.struct(F.lit("broken").alias("method"),
                 F.when(F.col("c_acctbal") > 9990, F.lit(float("nan"))).otherwise(F.col("z"))
                 .alias("score")))).alias("m")).select(
        "row_id", "dataset", "split", "label", "m.method", "m.score")


SCORED_SQL = """
WITH base AS (
  SELECT c_custkey AS row_id, r_name AS dataset, c_mktsegment AS split, c_nationkey, c_acctbal,
         CAST(c_acctbal < 0 AS INTEGER) AS label
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
st AS (SELECT avg(c_acctbal) m, stddev_pop(c_acctbal) s FROM base),
nat AS (SELECT c_nationkey, count(*) AS nat_n FROM base GROUP BY 1),
z AS (SELECT b.*, abs((c_acctbal - m) / CASE WHEN s = 0 THEN 1 ELSE s END) AS z, nat_n
      FROM base b JOIN nat USING (c_nationkey), st)
SELECT row_id, dataset, split, label, 'zscore' AS method, z AS score FROM z
UNION ALL SELECT row_id, dataset, split, label, 'nation_rarity', CAST(-nat_n AS DOUBLE) FROM z
UNION ALL SELECT row_id, dataset, split, label, 'broken',
                 CASE WHEN c_acctbal > 9990 THEN CAST('NaN' AS DOUBLE) ELSE z END FROM z
"""

BY = ["dataset", "split", "method"]


def valid_scores(scores, by):
    """Scores of the groups without an invalid one (J6)."""
    inv = J._invalid_groups(scores, "score", by)
    return scores.join(inv, by).where(F.col("__invalid") == 0).drop("__invalid")


_VALID_SQL = f"""
scored AS ({SCORED_SQL}),
inv AS (SELECT dataset, split, method, max(CAST(isnan(score) OR isinf(score) AS INTEGER)) AS invalid
        FROM scored GROUP BY ALL),
valid AS (SELECT s.* FROM scored s JOIN inv USING (dataset, split, method) WHERE invalid = 0),
d AS (SELECT dataset, split, method, score, sum(label) AS pos, sum(1 - label) AS neg
      FROM valid GROUP BY ALL)"""

AUC_SQL = f"""
WITH {_VALID_SQL},
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY dataset, split, method ORDER BY score
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM d)
SELECT dataset, split, method, round(sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)), 9) AS auc_roc
FROM c GROUP BY ALL"""

AP_SQL = f"""
WITH {_VALID_SQL},
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM d
      WINDOW w AS (PARTITION BY dataset, split, method ORDER BY score DESC
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT dataset, split, method, round(sum(pos * tp / (tp + fp)) / sum(pos), 9) AS auc_pr
FROM c GROUP BY ALL"""

PRED_SQL = f"""
WITH {_VALID_SQL},
r AS (SELECT v.*, row_number() OVER (PARTITION BY dataset, split, method ORDER BY score DESC,
               md5(concat_ws('|', '0', CAST(row_id AS VARCHAR))), row_id) AS rn,
             sum(label) OVER (PARTITION BY dataset, split, method) AS k FROM valid v),
p AS (SELECT *, CAST(rn <= k AS INTEGER) AS predicted FROM r)"""

PRF_SQL = f"""
{PRED_SQL},
a AS (SELECT dataset, split, method, sum(predicted * label) AS tp, sum(predicted) AS n_pred,
             sum(label) AS n_pos FROM p GROUP BY ALL),
b AS (SELECT dataset, split, method,
             CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
             CASE WHEN n_pos > 0 THEN tp / n_pos ELSE 0.0 END AS recall FROM a)
SELECT dataset, split, method, round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                  ELSE 0.0 END, 9) AS f1 FROM b"""

EVAL_SQL = f"""
WITH {_VALID_SQL},
auc AS (SELECT dataset, split, method, sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)) AS v
        FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY dataset, split, method ORDER BY score
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM d) GROUP BY ALL),
ap AS (SELECT dataset, split, method, sum(pos * tp / (tp + fp)) / sum(pos) AS v
       FROM (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM d
             WINDOW w AS (PARTITION BY dataset, split, method ORDER BY score DESC
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY ALL),
r AS (SELECT v.*, row_number() OVER (PARTITION BY dataset, split, method ORDER BY score DESC,
               md5(concat_ws('|', '0', CAST(row_id AS VARCHAR))), row_id) AS rn,
             sum(label) OVER (PARTITION BY dataset, split, method) AS k FROM valid v),
pr AS (SELECT dataset, split, method,
              CASE WHEN sum(CAST(rn <= k AS INTEGER)) > 0
                   THEN sum(CAST(rn <= k AS INTEGER) * label) / sum(CAST(rn <= k AS INTEGER)) ELSE 0.0 END AS p,
              CASE WHEN sum(label) > 0 THEN sum(CAST(rn <= k AS INTEGER) * label) / sum(label) ELSE 0.0 END AS r
       FROM r GROUP BY ALL),
wide AS (SELECT i.dataset, i.split, i.method, i.invalid, auc.v AS auc, ap.v AS ap, pr.p, pr.r,
                CASE WHEN pr.p + pr.r > 0 THEN 2 * pr.p * pr.r / (pr.p + pr.r) ELSE 0.0 END AS f1
         FROM inv i LEFT JOIN auc USING (dataset, split, method) LEFT JOIN ap USING (dataset, split, method)
              LEFT JOIN pr USING (dataset, split, method)),
long AS (SELECT dataset, split, method, invalid, 'AUC-ROC' AS metric, auc AS value FROM wide
         UNION ALL SELECT dataset, split, method, invalid, 'AUC-PR', ap FROM wide
         UNION ALL SELECT dataset, split, method, invalid, 'F1', f1 FROM wide
         UNION ALL SELECT dataset, split, method, invalid, 'P', p FROM wide
         UNION ALL SELECT dataset, split, method, invalid, 'R', r FROM wide)
SELECT dataset, split, method, metric, CASE WHEN invalid = 1 THEN 0.0 ELSE value END AS value FROM long"""


def _round(df, cols, n=9):
    for c in cols:
        df = df.withColumn(c, F.round(c, n))
    return df


@register("j01_auc_roc", AUC_SQL)
def q_auc(spark, sf_dir):
    s = scored_customers(spark, sf_dir)
    inv = J._invalid_groups(s, "score", BY)
    valid = s.join(inv, BY).where(F.col("__invalid") == 0)
    return _round(J.auc_roc(valid, "score", "label", BY), ["auc_roc"])


@register("j02_average_precision", AP_SQL)
def q_ap(spark, sf_dir):
    s = scored_customers(spark, sf_dir)
    inv = J._invalid_groups(s, "score", BY)
    valid = s.join(inv, BY).where(F.col("__invalid") == 0)
    return _round(J.average_precision(valid, "score", "label", BY), ["auc_pr"])


@register("j03_prf_at_k", PRF_SQL)
def q_prf(spark, sf_dir):
    s = scored_customers(spark, sf_dir)
    inv = J._invalid_groups(s, "score", BY)
    valid = s.join(inv, BY).where(F.col("__invalid") == 0).drop("__invalid")
    return _round(J.prf_at_k(valid, "score", "label", "row_id", BY, seed=0),
                  ["precision", "recall", "f1"])


def metrics_table(spark, sf_dir):
    return J.evaluate(scored_customers(spark, sf_dir), "score", "label", "row_id", BY, seed=0)


@register("j06_evaluate_guarded", f"SELECT dataset, split, method, metric, round(value, 9) AS value FROM ({EVAL_SQL})")
def q_evaluate(spark, sf_dir):
    return _round(metrics_table(spark, sf_dir), ["value"])


@register("j04_top_anomalies", f"""
WITH s AS ({SCORED_SQL}),
v AS (SELECT method, row_id, round(score, 9) AS score FROM s
      WHERE method NOT IN (SELECT method FROM s WHERE isnan(score) OR isinf(score))),
t AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, row_id) AS rank FROM v)
SELECT t.method, c.c_custkey AS row_id, c.c_name, c.c_acctbal, t.score,
       CAST(c.c_acctbal < 0 AS INTEGER) AS label, CAST(t.rank AS INTEGER) AS rank
FROM customer c JOIN t ON c.c_custkey = t.row_id WHERE t.rank <= 10""")
def q_top(spark, sf_dir):
    s = valid_scores(scored_customers(spark, sf_dir), ["method"]).select(
        "method", "row_id", F.round("score", 9).alias("score"))
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_id"), "c_name", "c_acctbal",
        (F.col("c_acctbal") < 0).cast("int").alias("label"))
    return J.top_anomalies(s, rows, "row_id", 10, ["method"])


@register("j05_misclassified", f"""
{PRED_SQL}
SELECT dataset, split, method, row_id, score, label,
       CASE WHEN label = 1 THEN 'FN' ELSE 'FP' END AS kind
FROM p WHERE predicted <> label AND method = 'nation_rarity'""")
def q_misclassified(spark, sf_dir):
    s = scored_customers(spark, sf_dir).where(F.col("method") == "nation_rarity")
    return J.misclassified(s, "score", "label", "row_id", BY, seed=0)


@register("j05_misclassified_all", f"""
{PRED_SQL}
SELECT dataset, split, method, row_id, score, label,
       CASE WHEN label = 1 THEN 'FN' ELSE 'FP' END AS kind
FROM p WHERE predicted <> label""")
def q_misclassified_all(spark, sf_dir):
    """Like ``j05_misclassified``, for every method; groups with an invalid score go (J6)."""
    return J.misclassified(valid_scores(scored_customers(spark, sf_dir), BY), "score", "label", "row_id", BY, seed=0)


@register("j07_rank_methods", f"""
WITH m AS ({EVAL_SQL}),
a AS (SELECT dataset, split, method, metric, round(value, 9) AS value FROM m)
SELECT *, CAST(row_number() OVER (PARTITION BY dataset, split, metric ORDER BY value DESC, method)
               AS INTEGER) AS rank FROM a""")
def q_rank(spark, sf_dir):
    m = _round(metrics_table(spark, sf_dir), ["value"])
    return J.rank_methods(m, ["dataset", "split", "metric"], "method")


@register("j08_aggregate_splits", f"""
WITH m AS ({EVAL_SQL}),
n AS (SELECT dataset, count(DISTINCT split) AS n FROM m GROUP BY 1),
g AS (SELECT dataset, method, metric, avg(value) AS mean, stddev_pop(value) AS std,
             count(DISTINCT split) AS n_splits FROM m GROUP BY ALL)
SELECT dataset, method, metric, round(mean, 9) AS mean, round(std, 9) AS std, n_splits
FROM g JOIN n USING (dataset) WHERE n_splits = n""")
def q_aggregate_splits(spark, sf_dir):
    m = metrics_table(spark, sf_dir)
    out = J.aggregate_splits(m, ["dataset", "method", "metric"], "split", scope=["dataset"])
    return _round(out, ["mean", "std"])


# method names as a results directory would carry them (relabelling of computed rows)
RENAMES = {"zscore": "density_zscore_lora", "nation_rarity": "rdp", "broken": "ecod_normalized"}


def _renamed(m):
    expr = F.col("method")
    for a, b in RENAMES.items():
        expr = F.when(F.col("method") == a, F.lit(b)).otherwise(expr)
    return m.withColumn("method", expr)


_RENAME_SQL = "CASE method " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RENAMES.items()) + " END"


@register("j09_filter_methods", f"""
WITH m AS (SELECT dataset, split, {_RENAME_SQL} AS method, metric, round(value, 9) AS value FROM ({EVAL_SQL}))
SELECT dataset, split, CASE WHEN method LIKE '%density%' THEN replace(method, '_lora', '') ELSE method END AS method,
       metric, value
FROM m WHERE method NOT LIKE 'raw%' AND method <> 'rdp'""")
def q_filter_methods(spark, sf_dir):
    m = _renamed(_round(metrics_table(spark, sf_dir), ["value"]))
    return J.filter_methods(m, "method", scope=["dataset", "split", "metric"])


@register("j10_results_matrix", f"""
WITH m AS ({EVAL_SQL}),
per AS (SELECT dataset, method, avg(value) AS v FROM m WHERE metric = 'AUC-ROC' GROUP BY ALL),
mat AS (SELECT dataset, {", ".join(f"max(CASE WHEN method = '{x}' THEN v END) AS {x}" for x in METHODS)}
        FROM per GROUP BY dataset),
u AS (SELECT * FROM mat UNION ALL
      SELECT 'avg', {", ".join(f"avg({x})" for x in METHODS)} FROM mat)
SELECT dataset, {", ".join(f"round({x}, 3) AS {x}" for x in METHODS)} FROM u""")
def q_results_matrix(spark, sf_dir):
    return J.results_matrix(metrics_table(spark, sf_dir), "AUC-ROC", METHODS)


@register("j10_std_matrix", f"""
WITH m AS ({EVAL_SQL}),
per AS (SELECT dataset, method, stddev_pop(value) AS v FROM m WHERE metric = 'AUC-ROC' GROUP BY ALL),
mat AS (SELECT dataset, {", ".join(f"max(CASE WHEN method = '{x}' THEN v END) AS {x}" for x in METHODS)}
        FROM per GROUP BY dataset),
acr AS (SELECT method, split, avg(value) AS mv FROM m WHERE metric = 'AUC-ROC' GROUP BY ALL),
av AS (SELECT 'avg' AS dataset, {", ".join(f"stddev_pop(CASE WHEN method = '{x}' THEN mv END) AS {x}" for x in METHODS)}
       FROM acr),
u AS (SELECT * FROM mat UNION ALL SELECT * FROM av)
SELECT dataset, {", ".join(f"round(coalesce({x}, 0.0), 3) AS {x}" for x in METHODS)} FROM u""")
def q_std_matrix(spark, sf_dir):
    return J.std_matrix(metrics_table(spark, sf_dir), "AUC-ROC", METHODS)


_SPLIT_FEATS = ["o_orderstatus", "c_mktsegment", "n_name", "month", "weekday"]


def _split_mixed(spark, sf_dir):
    from kestrel.operators import sampling as E
    m = BD.mixed_table(spark, sf_dir).select("row_id", "label", *_SPLIT_FEATS)
    return E.split_half_by_label(m, "label", "row_id")


_SPLIT_SQL = f"""
WITH m AS ({BD.MIXED_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS pos,
             count(*) OVER (PARTITION BY label) AS cnt FROM m),
s AS (SELECT *, CASE WHEN pos < floor(cnt / 2) THEN 'train' ELSE 'test' END AS split,
             md5(concat_ws('|', {", ".join(_SPLIT_FEATS)})) AS h FROM r)"""


@register("j11_remove_overlap", f"""
{_SPLIT_SQL}
SELECT row_id, label FROM s WHERE split = 'test'
  AND h NOT IN (SELECT h FROM s WHERE split = 'train')""")
def q_remove_overlap(spark, sf_dir):
    s = _split_mixed(spark, sf_dir)
    train = s.where(F.col("split") == "train")
    test = s.where(F.col("split") == "test")
    return J.remove_overlap(train, test, _SPLIT_FEATS).select("row_id", "label")


@register("j13_profile", f"""
{_SPLIT_SQL}
SELECT split, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_anomalies,
       round(sum(label) * 100.0 / count(*), 6) AS pct_anomalies, 5 AS n_features
FROM s GROUP BY split""")
def q_profile(spark, sf_dir):
    s = _split_mixed(spark, sf_dir)
    return J.profile(s.drop("row_id"), "label", by=["split"])
