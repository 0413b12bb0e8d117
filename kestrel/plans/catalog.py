"""Registered queries (one per operator) and their DuckDB oracle SQL.

Every query reads the driver tables of ``sf_dir`` (or data Spark derives from
them) over whole tables; literal catalogues (factors, graphs, weights) appear
identically as ``VALUES`` in the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrel.operators import orders as ords
from kestrel.plans import bindings as B
from kestrel.plans import density

from kestrel.plans.registry import QUERIES, SQL, register, sql_values as _values  # noqa: E402,F401


FACTORS_VALUES = _values(B.MIXED_FACTORS, ["name", "description", "possible_values",
                                           "annotation_criteria", "column_based"])
FEATURES_VALUES = _values([(c,) for c in B.MIXED_FEATURES], ["col"])


# --------------------------------------------------------------------------- flagship
def _mixed_weights(spark: SparkSession) -> DataFrame:
    return ords.weights_by_factors(B.mixed_factors(spark),
                                   ords.columns_table(spark, B.MIXED_FEATURES))


@register("density_top20")
def q_density_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: standard binning, 3 permutations, count density fitted on normal
    rows, factor-membership weights, mean over permutations, top 20."""
    df = B.mixed_table(spark, sf_dir)
    return density.top_density_anomalies(
        df, "row_id", "label", B.MIXED_FEATURES, k=20, n_perms=3, seed=0, alpha=1.0,
        weights=_mixed_weights(spark), method="standard")


def _density_sql(scored_tail: str) -> str:
    cats = ", ".join(B.MIXED_CATEGORICAL)
    return f"""
WITH base AS ({B.MIXED_SQL}),
st AS (SELECT avg(o_totalprice) m1, stddev_pop(o_totalprice) s1,
              avg(c_acctbal) m2, stddev_pop(c_acctbal) s2 FROM base),
binned AS (
  SELECT row_id, label, {cats},
    CAST(round_even((o_totalprice - m1) / CASE WHEN s1 = 0 OR s1 IS NULL THEN 1 ELSE s1 END, 1) + 0.0
         AS VARCHAR) AS o_totalprice,
    CAST(round_even((c_acctbal - m2) / CASE WHEN s2 = 0 OR s2 IS NULL THEN 1 ELSE s2 END, 1) + 0.0
         AS VARCHAR) AS c_acctbal
  FROM base, st),
cols AS (SELECT * FROM {FEATURES_VALUES}),
perms AS (
  SELECT p.range AS perm_id, c.col,
         row_number() OVER (PARTITION BY p.range
                            ORDER BY md5(concat_ws('|', '0', CAST(p.range AS VARCHAR), c.col)), c.col) - 1 AS pos
  FROM range(3) p, cols c),
melted AS (
  SELECT row_id, label, col, coalesce(value, 'None') AS value FROM binned
  UNPIVOT INCLUDE NULLS (value FOR col IN ({", ".join(B.MIXED_FEATURES)}))),
rec AS (SELECT m.row_id, m.label, p.perm_id, p.pos, m.col, m.value
        FROM melted m JOIN perms p USING (col)),
wp AS (SELECT r.*, coalesce(pr.col, '') AS prev_col, coalesce(pr.value, '') AS prev_value
       FROM rec r LEFT JOIN rec pr
         ON pr.row_id = r.row_id AND pr.perm_id = r.perm_id AND pr.pos = r.pos - 1),
train AS (SELECT * FROM wp WHERE label = 0),
counts AS (SELECT prev_col, prev_value, col, value, count(DISTINCT row_id) AS n
           FROM train GROUP BY ALL),
ctx AS (SELECT prev_col, prev_value, col, count(DISTINCT row_id) AS n_ctx
        FROM train GROUP BY ALL),
cards AS (SELECT col, count(DISTINCT value) AS k FROM melted WHERE label = 0 GROUP BY col),
nll AS (
  SELECT w.row_id, w.perm_id, w.col,
         -ln((coalesce(c.n, 0) + 1.0) / (coalesce(x.n_ctx, 0) + 1.0 * coalesce(k.k, 0))) AS nll
  FROM wp w
  LEFT JOIN counts c USING (prev_col, prev_value, col, value)
  LEFT JOIN ctx x USING (prev_col, prev_value, col)
  LEFT JOIN cards k USING (col)),
fac AS (SELECT * FROM {FACTORS_VALUES}),
members AS (SELECT col, count(*) AS n
            FROM (SELECT DISTINCT name, trim(unnest(column_based)) AS col FROM fac) GROUP BY col),
weights AS (SELECT c.col, CAST(coalesce(m.n, 0) AS DOUBLE) AS weight
            FROM cols c LEFT JOIN members m USING (col)),
scores AS (
  SELECT row_id, sum(nll * (coalesce(weight, 0) + 1)) / 3.0 AS score
  FROM nll LEFT JOIN weights USING (col) GROUP BY row_id)
{scored_tail}
"""


SQL["density_top20"] = _density_sql("""
, top AS (SELECT row_id, round(score, 6) AS score FROM scores
          ORDER BY round(score, 6) DESC, row_id LIMIT 20)
SELECT b.*, t.score,
       CAST(row_number() OVER (ORDER BY t.score DESC, t.row_id) AS INTEGER) AS rank
FROM base b JOIN top t USING (row_id)
""")


# the stage catalogues register themselves on import
from kestrel.plans import q_prep, q_eval, q_graph, q_causal, q_text, q_detect  # noqa: E402,F401
from kestrel.plans import q_scoring  # noqa: E402,F401
from kestrel.plans import q_io  # noqa: E402,F401
from kestrel.plans import q_annotate  # noqa: E402,F401
from kestrel.plans import q_stream  # noqa: E402,F401
from kestrel.plans import q_compose  # noqa: E402,F401
