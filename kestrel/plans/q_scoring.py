"""Queries for the density model and NLL algebra (I1-I13).

Model and scoring run on the standard-binned mixed table (orders x customer x
nation) with three hash permutations; the SQL oracles extend the flagship's CTE
chain.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import binning as C
from kestrel.operators import orders as H
from kestrel.operators import scoring as I
from kestrel.operators import text as D
from kestrel.plans import bindings as BD
from kestrel.plans.catalog import _density_sql, _mixed_weights
from kestrel.plans.registry import register
from kestrel.session import table

FEATS = BD.MIXED_FEATURES


def _setup(spark, sf_dir):
    df = BD.mixed_table(spark, sf_dir)
    binned = C.normalize(df.select("row_id", "label", *FEATS), "standard", cols=BD.MIXED_NUMERIC)
    perms = I.orders_list(H.permutations(spark, FEATS, 3, seed=0))
    return binned, perms


def _nll(spark, sf_dir):
    binned, perms = _setup(spark, sf_dir)
    model = I.fit_density(binned.where("label = 0"), FEATS, perms, 1.0)
    return I.score_nll(binned, "row_id", model, perms), perms


@register("i01_melt", f"""
WITH m AS ({BD.MIXED_SQL})
SELECT row_id, col, value FROM (
  SELECT row_id, o_orderstatus, c_mktsegment, n_name, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
         CAST(c_acctbal AS VARCHAR) AS c_acctbal, month, weekday FROM m)
UNPIVOT INCLUDE NULLS (value FOR col IN ({", ".join(FEATS)}))""")
def q_melt(spark, sf_dir):
    return I.melt(BD.mixed_table(spark, sf_dir), "row_id", FEATS)


@register("i02_fit_density", _density_sql("SELECT prev_col, prev_value, col, value, n FROM counts"))
def q_fit(spark, sf_dir):
    binned, perms = _setup(spark, sf_dir)
    return I.fit_density(binned.where("label = 0"), FEATS, perms, 1.0).counts


@register("i03_score_nll", _density_sql(
    "SELECT row_id, CAST(perm_id AS INTEGER) AS perm_id, col, round(nll, 9) AS nll FROM nll"))
def q_score(spark, sf_dir):
    nll, _ = _nll(spark, sf_dir)
    return nll.select("row_id", "perm_id", "col", F.round("nll", 9).alias("nll"))


_CONTRAST_TAIL = """
, train_a AS (SELECT * FROM wp WHERE label = 1),
counts_a AS (SELECT prev_col, prev_value, col, value, count(DISTINCT row_id) AS n FROM train_a GROUP BY ALL),
ctx_a AS (SELECT prev_col, prev_value, col, count(DISTINCT row_id) AS n_ctx FROM train_a GROUP BY ALL),
cards_a AS (SELECT col, count(DISTINCT value) AS k FROM melted WHERE label = 1 GROUP BY col),
nll_a AS (
  SELECT w.row_id, w.perm_id, w.col,
         -ln((coalesce(c.n, 0) + 1.0) / (coalesce(x.n_ctx, 0) + 1.0 * coalesce(k.k, 0))) AS nll
  FROM wp w
  LEFT JOIN counts_a c USING (prev_col, prev_value, col, value)
  LEFT JOIN ctx_a x USING (prev_col, prev_value, col)
  LEFT JOIN cards_a k USING (col))
SELECT a.row_id, CAST(a.perm_id AS INTEGER) AS perm_id, a.col, round(a.nll - b.nll, 9) AS nll
FROM nll a JOIN nll_a b USING (row_id, perm_id, col)"""


@register("i04_score_contrast", _density_sql(_CONTRAST_TAIL))
def q_contrast(spark, sf_dir):
    binned, perms = _setup(spark, sf_dir)
    mn = I.fit_density(binned.where("label = 0"), FEATS, perms, 1.0)
    ma = I.fit_density(binned.where("label = 1"), FEATS, perms, 1.0)
    s = I.score_contrast(binned, "row_id", mn, ma, perms)
    return s.select("row_id", "perm_id", "col", F.round("nll", 9).alias("nll"))


@register("i06_aggregate_nll", _density_sql("""
SELECT row_id, CAST(perm_id AS INTEGER) AS perm_id, round(sum(nll * (coalesce(weight, 0) + 1)), 9) AS score
FROM nll LEFT JOIN weights USING (col) GROUP BY ALL"""))
def q_aggregate(spark, sf_dir):
    nll, _ = _nll(spark, sf_dir)
    return I.aggregate_nll(nll, _mixed_weights(spark)).withColumn("score", F.round("score", 9))


@register("i07_feature_scores", _density_sql("""
SELECT row_id, CAST(perm_id AS INTEGER) AS perm_id, col, round(nll * (coalesce(weight, 0) + 1), 9) AS nll
FROM nll LEFT JOIN weights USING (col)"""))
def q_feature_scores(spark, sf_dir):
    nll, _ = _nll(spark, sf_dir)
    return I.feature_scores(nll, _mixed_weights(spark)).withColumn("nll", F.round("nll", 9))


@register("i08_total_nll", _density_sql("""
SELECT row_id, CAST(perm_id AS INTEGER) AS perm_id, round(sum(nll), 9) AS score FROM nll GROUP BY ALL"""))
def q_total(spark, sf_dir):
    nll, _ = _nll(spark, sf_dir)
    return I.total_nll(nll).withColumn("score", F.round("score", 9))


@register("i10_mean_permutations", _density_sql("""
, per AS (SELECT row_id, perm_id, sum(nll * (coalesce(weight, 0) + 1)) AS s
          FROM nll LEFT JOIN weights USING (col) GROUP BY ALL)
SELECT row_id, round(avg(s), 9) AS score, count(DISTINCT perm_id) AS n_perms FROM per GROUP BY row_id"""))
def q_mean_perms(spark, sf_dir):
    nll, _ = _nll(spark, sf_dir)
    per = I.aggregate_nll(nll, _mixed_weights(spark))
    return I.mean_permutations(per, expected=3).withColumn("score", F.round("score", 9))


@register("i11_eval_summary", _density_sql("""
, j AS (SELECT s.row_id, s.score, m.label FROM scores s JOIN (SELECT row_id, label FROM base) m USING (row_id)),
d AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM j GROUP BY score),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM d)
SELECT (SELECT count(*) FROM j) AS n, round((SELECT avg(score) FROM j), 9) AS mean_all,
       round((SELECT avg(score) FROM j WHERE label = 0), 9) AS mean_normal,
       round((SELECT avg(score) FROM j WHERE label = 1), 9) AS mean_anomaly,
       round(sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)), 9) AS auc_roc FROM c"""))
def q_eval_summary(spark, sf_dir):
    nll, perms = _nll(spark, sf_dir)
    scores = I.row_scores(nll, _mixed_weights(spark), len(perms))
    labels = BD.mixed_table(spark, sf_dir).select("row_id", "label")
    out = I.eval_summary(scores, labels)
    return out.select("n", *[F.round(c, 9).alias(c) for c in ["mean_all", "mean_normal", "mean_anomaly", "auc_roc"]])


def _labeled_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return d.join(lab, "doc_id")


_TOKENS_SQL = """
ld AS (SELECT d.doc_id, d.text, l.toxic FROM documents d JOIN labels l USING (doc_id)),
tl AS (SELECT doc_id, toxic, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS t FROM ld),
tk AS (SELECT doc_id, toxic, i - 1 AS pos, t[i] AS token, CASE WHEN i = 1 THEN '' ELSE t[i - 1] END AS prev
       FROM (SELECT doc_id, toxic, t, generate_subscripts(t, 1) AS i FROM tl)),
big AS (SELECT prev, token, count(*) AS n FROM tk WHERE toxic = 0 GROUP BY ALL),
ctx AS (SELECT prev, count(*) AS n_ctx FROM tk WHERE toxic = 0 GROUP BY ALL),
voc AS (SELECT count(DISTINCT token) AS V FROM tk WHERE toxic = 0),
tn AS (SELECT tk.doc_id, tk.pos, -ln((coalesce(big.n, 0) + 1.0) / (coalesce(ctx.n_ctx, 0) + 1.0 * V)) AS nll
       FROM tk LEFT JOIN big USING (prev, token) LEFT JOIN ctx USING (prev), voc)"""


@register("i05_text_nll", f"""
WITH {_TOKENS_SQL}
SELECT doc_id AS row_id, round(avg(nll), 9) AS score, count(*) AS n_tokens FROM tn GROUP BY doc_id""")
def q_text_nll(spark, sf_dir):
    ld = _labeled_docs(spark, sf_dir)
    toks = I.token_table(ld, "doc_id", "text", extra=["toxic"])
    model = I.fit_text_model(toks.where("toxic = 0"))
    return I.score_text_nll(toks, model, 1.0).withColumn("score", F.round("score", 9))


@register("i05_text_nll_all", """
WITH tl AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS t FROM documents),
tk AS (SELECT doc_id, t[i] AS token, CASE WHEN i = 1 THEN '' ELSE t[i - 1] END AS prev
       FROM (SELECT doc_id, t, generate_subscripts(t, 1) AS i FROM tl)),
fit AS (SELECT prev, token FROM tk JOIN labels USING (doc_id) WHERE toxic = 0),
big AS (SELECT prev, token, count(*) AS n FROM fit GROUP BY ALL),
ctx AS (SELECT prev, count(*) AS n_ctx FROM fit GROUP BY ALL),
voc AS (SELECT count(DISTINCT token) AS V FROM fit)
SELECT doc_id AS row_id, round(avg(-ln((coalesce(n, 0) + 1.0) / (coalesce(n_ctx, 0) + 1.0 * V))), 9) AS score,
       count(*) AS n_tokens
FROM tk LEFT JOIN big USING (prev, token) LEFT JOIN ctx USING (prev), voc GROUP BY doc_id""")
def q_text_nll_all(spark, sf_dir):
    """Fitted on the labelled documents with toxic = 0 like ``i05_text_nll``; every document
    with a token is scored, labelled or not."""
    train = I.token_table(_labeled_docs(spark, sf_dir).where("toxic = 0"), "doc_id", "text")
    toks = I.token_table(table(spark, sf_dir, "documents"), "doc_id", "text")
    return I.score_text_nll(toks, I.fit_text_model(train), 1.0).withColumn("score", F.round("score", 9))


def _serialized(spark, sf_dir):
    m = BD.mixed_table(spark, sf_dir)
    perms = I.orders_list(H.permutations(spark, FEATS, 1, seed=8))
    return m, perms, D.serialize_rows(m, "row_id", perms, FEATS)


@register("i09_attribute_tokens", f"""
WITH m AS ({BD.MIXED_SQL}),
cols AS (SELECT unnest({FEATS!r}) AS col),
p AS (SELECT col, row_number() OVER (ORDER BY md5(concat_ws('|', '8', '0', col)), col) AS pos FROM cols),
v AS (SELECT row_id, label, col, coalesce(nullif(trim(value), ''), 'None') AS value
      FROM (SELECT row_id, label, o_orderstatus, c_mktsegment, n_name, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
                   CAST(c_acctbal AS VARCHAR) AS c_acctbal, month, weekday FROM m)
      UNPIVOT INCLUDE NULLS (value FOR col IN ({", ".join(FEATS)}))),
vs AS (SELECT v.*, p.pos AS cpos, 2 AS name_len, len(regexp_extract_all(value, '\\S+')) AS vlen FROM v JOIN p USING (col)),
sp AS (SELECT row_id, col, coalesce(sum(name_len + vlen + 1) OVER (PARTITION BY row_id ORDER BY cpos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, name_len, vlen FROM vs),
spans AS (SELECT row_id, col, off + name_len - 1 AS s, off + name_len + vlen AS e FROM sp),
ser AS (SELECT row_id, label, string_agg(' ' || col || ' is ' || value || ' ', ',' ORDER BY cpos) AS text
        FROM vs GROUP BY row_id, label),
tk AS (SELECT row_id, label, i - 1 AS pos, t[i] AS token, CASE WHEN i = 1 THEN '' ELSE t[i - 1] END AS prev
       FROM (SELECT row_id, label, regexp_extract_all(text, '\\S+') AS t,
                    generate_subscripts(regexp_extract_all(text, '\\S+'), 1) AS i FROM ser)),
big AS (SELECT prev, token, count(*) AS n FROM tk WHERE label = 0 GROUP BY ALL),
ctx AS (SELECT prev, count(*) AS n_ctx FROM tk WHERE label = 0 GROUP BY ALL),
voc AS (SELECT count(DISTINCT token) AS V FROM tk WHERE label = 0),
tn AS (SELECT tk.row_id, tk.pos, -ln((coalesce(big.n, 0) + 1.0) / (coalesce(ctx.n_ctx, 0) + 1.0 * V)) AS nll
       FROM tk LEFT JOIN big USING (prev, token) LEFT JOIN ctx USING (prev), voc)
SELECT spans.row_id, 0 AS perm_id, spans.col, round(sum(nll), 9) AS nll
FROM tn JOIN spans ON tn.row_id = spans.row_id AND tn.pos >= spans.s AND tn.pos < spans.e
GROUP BY ALL""")
def q_attribute(spark, sf_dir):
    m, perms, ser = _serialized(spark, sf_dir)
    ser = ser.join(m.select("row_id", "label"), "row_id")
    toks = I.token_table(ser.withColumnRenamed("order_id", "perm_id"), "row_id", "text",
                         pattern=r"\S+", lower=False, extra=["perm_id", "label"])
    model = I.fit_text_model(toks.where("label = 0"))
    tn = I.token_nll(toks, model, 1.0, ["row_id", "perm_id"])
    spans = I.value_spans(m, "row_id", perms, FEATS)
    out = I.attribute_tokens(tn, spans)
    return out.withColumn("nll", F.round("nll", 9))


@register("i12_score_with", f"""
WITH m AS ({BD.MIXED_SQL}),
cols AS (SELECT unnest({FEATS!r}) AS col),
p AS (SELECT col, row_number() OVER (ORDER BY md5(concat_ws('|', '8', '0', col)), col) AS pos FROM cols),
v AS (SELECT row_id, label, col, coalesce(nullif(trim(value), ''), 'None') AS value
      FROM (SELECT row_id, label, o_orderstatus, c_mktsegment, n_name, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
                   CAST(c_acctbal AS VARCHAR) AS c_acctbal, month, weekday FROM m)
      UNPIVOT INCLUDE NULLS (value FOR col IN ({", ".join(FEATS)}))),
vs AS (SELECT v.*, p.pos AS cpos, 2 AS name_len, len(regexp_extract_all(value, '\\S+')) AS vlen FROM v JOIN p USING (col)),
sp AS (SELECT row_id, col, coalesce(sum(name_len + vlen + 1) OVER (PARTITION BY row_id ORDER BY cpos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, name_len, vlen FROM vs),
spans AS (SELECT row_id, col, off + name_len - 1 AS s, off + name_len + vlen AS e FROM sp),
ser AS (SELECT row_id, label, string_agg(' ' || col || ' is ' || value || ' ', ',' ORDER BY cpos) AS text
        FROM vs GROUP BY row_id, label),
tk AS (SELECT row_id, i - 1 AS pos, t[i] AS token
       FROM (SELECT row_id, regexp_extract_all(text, '\\S+') AS t,
                    generate_subscripts(regexp_extract_all(text, '\\S+'), 1) AS i FROM ser)),
tn AS (SELECT row_id, pos, ln(1 + length(token)) AS nll FROM tk)
SELECT spans.row_id, CAST(0 AS INTEGER) AS perm_id, spans.col, round(sum(nll), 9) AS nll
FROM tn JOIN spans ON tn.row_id = spans.row_id AND tn.pos >= spans.s AND tn.pos < spans.e
GROUP BY ALL""")
def q_score_with(spark, sf_dir):
    """A user batch scorer (here: token surprisal ln(1 + token length) over the
    serialized rows) applied with mapInPandas, then attributed to columns."""
    import numpy as np
    import pandas as pd
    m, perms, ser = _serialized(spark, sf_dir)

    def scorer(pdf):
        rows = []
        for rid, perm, text in zip(pdf["row_id"], pdf["order_id"], pdf["text"]):
            for i, tok in enumerate(text.split()):
                rows.append((int(rid), int(perm), i, float(np.log1p(len(tok)))))
        return pd.DataFrame(rows, columns=["row_id", "perm_id", "pos", "nll"])
    tn = I.score_with(ser, scorer)
    out = I.attribute_tokens(tn, I.value_spans(m, "row_id", perms, FEATS))
    return out.select("row_id", F.col("perm_id").cast("int"), "col", F.round("nll", 9).alias("nll"))


_EMB_SQL = """
e AS (SELECT vec_id, label, embedding AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * x))) AS nrm FROM e),
ux AS (SELECT vec_id, label, i, CAST(v[i] AS DOUBLE) / nrm AS x FROM (SELECT *, generate_subscripts(v, 1) AS i FROM u))"""


@register("i13_pairwise_cosine", f"""
WITH {_EMB_SQL},
per AS (SELECT label, i, sum(x) AS s FROM ux GROUP BY ALL),
sq AS (SELECT label, sum(s * s) AS ss FROM per GROUP BY label),
n AS (SELECT label, count(*) AS n FROM e GROUP BY label)
SELECT label, n, CASE WHEN n > 1 THEN round((ss - n) / (n * (n - 1)), 9) END AS mean_cosine
FROM sq JOIN n USING (label)""")
def q_pairwise_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = I.pairwise_cosine(e, "embedding", "label")
    return out.withColumn("mean_cosine", F.round("mean_cosine", 9))


@register("i13_centroid_distance", """
WITH e AS (SELECT vec_id, label, embedding AS v FROM embeddings),
x AS (SELECT vec_id, label, i, CAST(v[i] AS DOUBLE) AS x FROM (SELECT *, generate_subscripts(v, 1) AS i FROM e)),
c AS (SELECT i, avg(x) AS c FROM x WHERE label <> 9 GROUP BY i),
d AS (SELECT vec_id, sum((x - c) * (x - c)) AS d2 FROM x JOIN c USING (i) WHERE label = 9 GROUP BY vec_id)
SELECT round(avg(d2), 6) AS mean_sq_distance, count(*) AS n_anomalies FROM d""")
def q_centroid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = I.centroid_distance(e, "embedding", F.col("label") == 9)
    return out.withColumn("mean_sq_distance", F.round("mean_sq_distance", 6))
