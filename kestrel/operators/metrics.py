"""J — ranking metrics and result tables.

Scores are grouped to distinct score values first (a hot score value is one row),
cumulated with the bucketed prefix sum, and combined per group ``by`` (method,
split, dataset ...).  No metric sorts all rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.exprs import quote_ident
from pyspark.sql.window import Window

from kestrel.functions.exprs import hash_key, hash_num
from kestrel.functions.prefix import prefix_sums
from kestrel.session import cut_lineage

METRIC_NAMES = ["AUC-ROC", "AUC-PR", "F1", "P", "R"]


def _distinct_scores(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, score).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum(1 - F.col(label).cast("long")).alias("neg"))


def _invalid_groups(df: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    """J6 — groups with a NaN or infinite score."""
    s = F.col(score).cast("double")
    bad = F.isnan(s) | (F.abs(s) == F.lit(float("inf")))
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.max(bad.cast("int")).alias("__invalid"))


def _cumulated(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Distinct scores per group with counts of strictly higher scores
    (``pos_before``, ``neg_before``) and the group totals ``P``/``N``.  One
    bucketed prefix sum serves AUC-ROC, AUC-PR and the F1 cut."""
    d = _distinct_scores(df, score, label, by)
    c = prefix_sums(d, by, score, ["pos", "neg"], descending=True)
    g = c.groupBy(*by) if by else c.groupBy()
    tot = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    # totals: one row per group, broadcast by AQE if small
    return c.join(tot, by, "inner") if by else c.crossJoin(F.broadcast(tot))


def _auc_expr() -> Column:
    below = F.col("N") - F.col("neg_before") - F.col("neg")
    return F.try_divide(F.sum(F.col("pos") * (below + 0.5 * F.col("neg"))),
                        (F.max("P") * F.max("N")).cast("double"))


def _ap_expr() -> Column:
    tp = F.col("pos_before") + F.col("pos")
    fp = F.col("neg_before") + F.col("neg")
    return F.try_divide(F.sum(F.col("pos") * tp / (tp + fp)), F.max("P").cast("double"))


def guard_scores(df: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """J6 — per group, whether any score is NaN or infinite (then every metric of
    the group is 0, see :func:`evaluate`)."""
    return _invalid_groups(df, score, list(by)).withColumn(
        "invalid", F.col("__invalid") == 1).drop("__invalid")


def auc_roc(df: DataFrame, score: str = "score", label: str = "label",
            by: Sequence[str] = ()) -> DataFrame:
    """J1 — Mann-Whitney AUC with tied scores sharing rank: each positive counts
    the negatives below its score plus half of the tied negatives."""
    by = list(by)
    c = _cumulated(df, score, label, by)
    g = c.groupBy(*by) if by else c.groupBy()
    return g.agg(_auc_expr().alias("auc_roc"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label",
                      by: Sequence[str] = ()) -> DataFrame:
    """J2 — step-wise average precision over distinct thresholds (high to low):
    sum of (recall increase) x (precision at the threshold)."""
    by = list(by)
    c = _cumulated(df, score, label, by)
    g = c.groupBy(*by) if by else c.groupBy()
    return g.agg(_ap_expr().alias("auc_pr"))


def _group_summary(c: DataFrame, score: str, by: list[str]) -> DataFrame:
    """One aggregation over the cumulated distinct scores per group: AUC-ROC,
    AUC-PR, true positives of score groups entirely inside the top k = P, and
    the cut (score straddling k, and how many of its rows are still taken)."""
    cnt_before = F.col("pos_before") + F.col("neg_before")
    cnt = F.col("pos") + F.col("neg")
    inside = cnt_before + cnt <= F.col("P")
    straddle = (cnt_before < F.col("P")) & (cnt_before + cnt > F.col("P"))
    return c.groupBy(*by).agg(
        F.max("P").alias("P"),
        _auc_expr().alias("auc_roc"), _ap_expr().alias("auc_pr"),
        F.sum(F.when(inside, F.col("pos")).otherwise(0)).alias("tp_full"),
        F.max(F.when(straddle, F.struct(F.col(score).alias("s"),
                                        (F.col("P") - cnt_before).alias("m")))).alias("__cut"))


def _tp_at_k(df: DataFrame, summary: DataFrame, score: str, label: str, row_id: str,
             by: list[str], seed) -> DataFrame:
    """True positives among the top k = P rows per group.  Score groups entirely
    above the cut count all their positives; only the rows tied *at* the cut are
    ordered by ``md5(seed|row_id)`` (bucketed prefix sum on the hash)."""
    # the summary is one row per group and is read several times below:
    # materialize it once (reliable checkpoint) instead of re-running its plan
    summary = cut_lineage(summary)
    cut = summary.where(F.col("__cut").isNotNull()).select(
        *by, F.col("__cut.s").alias("__cs"), F.col("__cut.m").alias("__m"))
    # at most one cut row per group
    ties = (df.join(cut, by, "inner").where(F.col(score) == F.col("__cs"))
            .withColumn("__h", hash_num(seed, F.col(row_id)))
            .withColumn("__hs", hash_key(seed, F.col(row_id)))
            .withColumn("__one", F.lit(1)))
    ties = prefix_sums(ties, by, "__h", ["__one"], tiebreak=["__hs", row_id])
    tp_tie = (ties.where(F.col("__one_before") < F.col("__m"))
              .groupBy(*by).agg(F.sum(F.col(label).cast("long")).alias("tp_tie")))
    return (summary.join(tp_tie, by, "left")
            .withColumn("tp", F.col("tp_full") + F.coalesce(F.col("tp_tie"), F.lit(0)))
            .drop("tp_tie", "__cut"))


def _prf(tp: DataFrame, by: list[str], keep: Sequence[str] = ()) -> DataFrame:
    prec = F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(0.0)
    return tp.select(*by, *keep, prec.alias("precision"), prec.alias("recall")).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") > 0,
                     2 * F.col("precision") * F.col("recall")
                     / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def predict_top_k(df: DataFrame, score: str = "score", label: str = "label",
                  row_id: str = "row_id", by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """J3 helper — flag the ``k`` (= number of true anomalies) highest scores per
    group as predicted anomalies; ties at the cut broken by ``md5(seed|row_id)``.

    Rows are decided by comparing their score with the group's cut score; only
    the rows tied at the cut are ordered (bucketed prefix sum on the hash)."""
    by = list(by)
    whole = not by
    if whole:  # one group: a constant key keeps the joins below outer joins
        df = df.withColumn("__all", F.lit(0))
        by = ["__all"]
    c = _cumulated(df, score, label, by)
    cnt_before = F.col("pos_before") + F.col("neg_before")
    cut = (c.where((cnt_before < F.col("P")) & (cnt_before + F.col("pos") + F.col("neg")
                                                >= F.col("P")))
           .select(*by, F.col(score).alias("__cut"), (F.col("P") - cnt_before).alias("__m")))
    cut = cut_lineage(cut)  # one row per group, read by both branches below
    rows = df.join(cut, by, "left")
    above = rows.where(F.col("__cut").isNull() | (F.col(score) != F.col("__cut"))).withColumn(
        "predicted", F.when(F.col(score) > F.col("__cut"), 1).otherwise(0))
    ties = (rows.where(F.col(score) == F.col("__cut"))
            .withColumn("__h", hash_num(seed, F.col(row_id)))
            .withColumn("__hs", hash_key(seed, F.col(row_id)))
            .withColumn("__one", F.lit(1)))
    ties = prefix_sums(ties, by, "__h", ["__one"], tiebreak=["__hs", row_id])
    ties = ties.withColumn("predicted", F.when(F.col("__one_before") < F.col("__m"), 1)
                           .otherwise(0)).drop("__h", "__hs", "__one", "__one_before")
    out = above.unionByName(ties).drop("__cut", "__m")
    return out.drop("__all") if whole else out


def prf_at_k(df: DataFrame, score: str = "score", label: str = "label",
             row_id: str = "row_id", by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """J3 — precision, recall and F1 at k = number of true anomalies (so P = R);
    0 on a zero division."""
    by = list(by)
    whole = not by
    if whole:
        df = df.withColumn("__all", F.lit(0))
        by = ["__all"]
    summ = _group_summary(_cumulated(df, score, label, by), score, by)
    out = _prf(_tp_at_k(df, summ, score, label, row_id, by, seed), by)
    return out.drop("__all") if whole else out


def evaluate(df: DataFrame, score: str = "score", label: str = "label",
             row_id: str = "row_id", by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """J1+J2+J3+J6 — long table ``(by..., metric, value)``; a group with a NaN or
    infinite score gets 0 for every metric.  One distinct-score cumulation feeds
    all metrics."""
    by = list(by)
    whole = not by
    if whole:
        df = df.withColumn("__all", F.lit(0))
        by = ["__all"]
    inv = _invalid_groups(df, score, by)
    valid = df.join(inv.where(F.col("__invalid") == 0).select(*by), by, "left_semi")
    summ = _group_summary(_cumulated(valid, score, label, by), score, by)
    tp = _tp_at_k(valid, summ, score, label, row_id, by, seed)
    wide = inv.join(_prf(tp, by, keep=["auc_roc", "auc_pr"]), by, "left")
    vals = {"AUC-ROC": "auc_roc", "AUC-PR": "auc_pr", "F1": "f1", "P": "precision",
            "R": "recall"}
    out = wide.select(*by, "__invalid", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value"))
        for m, c in vals.items()])).alias("m"))
    out = out.select(*by, "m.metric", F.when(F.col("__invalid") == 1, F.lit(0.0))
                     .otherwise(F.col("m.value")).alias("value"))
    return out.drop("__all") if whole else out


def top_anomalies(scores: DataFrame, rows: DataFrame, row_id: str = "row_id",
                  k: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """J4 — the ``k`` highest scores (ties by ``row_id``) joined to their rows, for each group of
    the ``by`` columns of ``scores``.  ``orderBy().limit()`` plans a TakeOrderedAndProject:
    per-partition top-k then a k-row merge, never a full sort; the k rows are broadcast to the
    join.  With ``by`` the rank filter becomes a group limit below the shuffle, so that a task
    sends at most ``k`` rows of a group, however many the group has."""
    if by:
        w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(row_id))
        return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).join(rows, row_id)
    top = scores.orderBy(F.desc("score"), F.asc(row_id)).limit(k)
    joined = rows.join(F.broadcast(top), row_id, "inner")
    # rank over the k joined rows only (k is the feature's own limit)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.asc(row_id))
    return joined.withColumn("rank", F.row_number().over(w))


def misclassified(df: DataFrame, score: str = "score", label: str = "label",
                  row_id: str = "row_id", by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """J5 — false negatives and false positives under the top-k prediction."""
    p = predict_top_k(df, score, label, row_id, by, seed)
    return (p.where(F.col("predicted") != F.col(label))
            .select(*by, row_id, score, label,
                    F.when(F.col(label) == 1, F.lit("FN")).otherwise(F.lit("FP")).alias("kind")))


def rank_methods(metrics: DataFrame, keys: Sequence[str] = ("metric",),
                 order_col: str = "method") -> DataFrame:
    """J7 — rank per metric (and other keys), best value first; ties by
    ``order_col`` (listing order).  One partition per key group."""
    w = Window.partitionBy(*keys).orderBy(F.desc("value"), F.asc(order_col))
    return metrics.withColumn("rank", F.row_number().over(w))


def aggregate_splits(metrics: DataFrame, keys: Sequence[str] = ("method", "metric"),
                     split: str = "split", scope: Sequence[str] = ()) -> DataFrame:
    """J8 — mean and population std over splits; a method missing in any split
    (of its ``scope``, e.g. dataset) is removed."""
    keys = list(keys)
    scope = list(scope)
    n = (metrics.groupBy(*scope) if scope else metrics.groupBy()).agg(
        F.count_distinct(split).alias("__n"))
    g = metrics.groupBy(*scope, *[k for k in keys if k not in scope]).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.count_distinct(split).alias("n_splits"))
    j = g.join(n, scope, "inner") if scope else g.crossJoin(F.broadcast(n))
    return j.where(F.col("n_splits") == F.col("__n")).drop("__n")


def filter_methods(metrics: DataFrame, method: str = "method", scope: Sequence[str] = (),
                   only_normalized: bool = False, only_ordinal: bool = False,
                   model_marker: str = "density") -> DataFrame:
    """J9 — drop ``raw*`` and ``rdp``; methods whose name lacks ``model_marker``
    are baselines and can be restricted to ``normalized`` / ``ordinal``
    variants; a model result named ``*_lora*`` is used (renamed without
    ``_lora``) only when the plain one is absent."""
    m = F.col(method)
    out = metrics.where(~m.startswith("raw") & (m != "rdp"))
    baseline = ~m.contains(model_marker)
    if only_normalized:
        out = out.where(~baseline | m.contains("normalized"))
    if only_ordinal:
        out = out.where(~baseline | m.contains("ordinal"))
    plain = out.select(*scope, F.col(method).alias("__plain")).distinct()
    lora = out.where(~baseline & m.contains("_lora")).withColumn(
        "__plain", F.regexp_replace(m, "_lora", ""))
    lora_kept = lora.join(plain, [*scope, "__plain"], "left_anti").withColumn(
        method, F.col("__plain")).drop("__plain")
    rest = out.where(baseline | ~m.contains("_lora"))
    return rest.unionByName(lora_kept)


def results_matrix(metrics: DataFrame, metric: str, methods: Sequence[str],
                   dataset: str = "dataset", split: str = "split") -> DataFrame:
    """J10 — dataset x method matrix of the mean over splits, plus an ``avg`` row
    (mean over datasets), rounded to 3; the method list names the output columns."""
    m = metrics.where(F.col("metric") == metric)
    per = m.groupBy(dataset, "method").agg(F.avg("value").alias("v"))
    mat = per.groupBy(dataset).pivot("method", list(methods)).agg(F.first("v"))
    avg = mat.agg(*[F.avg(F.col(f"`{x}`")).alias(x) for x in methods]).select(
        F.lit("avg").alias(dataset), *methods)
    out = mat.unionByName(avg)
    return out.select(dataset, *[F.round(F.col(f"`{x}`"), 3).alias(x) for x in methods])


def std_matrix(metrics: DataFrame, metric: str, methods: Sequence[str],
               dataset: str = "dataset", split: str = "split") -> DataFrame:
    """J10 (std) — population std over splits per dataset; the ``avg`` row is the
    std over splits of the across-dataset mean."""
    m = metrics.where(F.col("metric") == metric)
    per = m.groupBy(dataset, "method").agg(F.stddev_pop("value").alias("v"))
    mat = per.groupBy(dataset).pivot("method", list(methods)).agg(F.first("v"))
    across = m.groupBy("method", split).agg(F.avg("value").alias("mv"))
    avg_std = (across.groupBy().pivot("method", list(methods)).agg(F.stddev_pop("mv"))
               .select(F.lit("avg").alias(dataset), *methods))
    out = mat.unionByName(avg_std)
    return out.select(dataset, *[F.round(F.coalesce(F.col(f"`{x}`"), F.lit(0.0)), 3).alias(x)
                                 for x in methods])


def row_hash(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Append ``__rh``, a 128-bit digest of the values as a JSON list: a null is not an empty
    string, and no text runs over into its neighbour."""
    cols = list(cols or df.columns)
    return df.withColumn("__rh", F.md5(F.to_json(F.array(*[F.col(quote_ident(c)).cast("string") for c in cols]))))


def overlap(a: DataFrame, b: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """J11 — rows of ``a`` whose row hash also occurs in ``b``."""
    cols = list(cols or a.columns)
    ha = row_hash(a, cols)
    hb = row_hash(b, cols).select("__rh").distinct()
    return ha.join(hb, "__rh", "left_semi").drop("__rh")


def remove_overlap(train: DataFrame, test: DataFrame, cols: Sequence[str] | None = None
                   ) -> DataFrame:
    """J11 — test rows whose hash does not occur in train."""
    cols = list(cols or test.columns)
    return (row_hash(test, cols).join(row_hash(train, cols).select("__rh"), "__rh", "left_anti")
            .drop("__rh"))


def check_no_overlap(train: DataFrame, test: DataFrame, cols: Sequence[str] | None = None
                     ) -> DataFrame:
    """J11 — a one-row table ``n_overlap``; evaluating it raises when > 0."""
    n = overlap(test, train, cols).agg(F.count(F.lit(1)).alias("n_overlap"))
    return n.withColumn("n_overlap", F.when(F.col("n_overlap") > 0, F.raise_error(
        F.lit("train and test overlap"))).otherwise(F.col("n_overlap")))


def run_key(cfg: dict) -> str:
    """J12 — run name from parameters, keys sorted (the runs of a sweep, L6)."""
    return "_".join(f"{k}{cfg[k]}" for k in sorted(cfg))


def profile(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """J13 — rows, anomalies, anomaly percent and feature count per group."""
    n_features = len([c for c in df.columns if c != label and c not in by])
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum(F.col(label).cast("long")).alias("n_anomalies")).select(
        *by, "n_rows", "n_anomalies",
        F.round(F.col("n_anomalies") * 100.0 / F.col("n_rows"), 6).alias("pct_anomalies"),
        F.lit(n_features).alias("n_features"))
