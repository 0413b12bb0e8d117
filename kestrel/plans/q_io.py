"""Queries for sources and sinks (A1-A10): data derived from the tables is written
with the library's writers into a scratch folder under the checkpoint directory
and read back with its readers."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from kestrel.operators import graph as G
from kestrel.operators import orders as H
from kestrel.plans import bindings as BD
from kestrel.plans import q_eval as QE
from kestrel.plans import q_graph as QG
from kestrel.plans import q_text as QT
from kestrel.plans.registry import register
from kestrel.session import table
from kestrel.sources import io as A

CUSTOMER_SCHEMA = ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
                   "c_mktsegment string")


@register("a01_read_table_parquet", "SELECT * FROM customer")
def q_read_parquet(spark, sf_dir):
    return A.read_table(spark, os.path.join(sf_dir, "customer.parquet"))


@register("a01_read_table_csv", "SELECT * FROM customer")
def q_read_csv(spark, sf_dir):
    path = A.scratch_path(spark, "customer-csv")
    A.write_table(table(spark, sf_dir, "customer"), path, fmt="csv")
    return A.read_table(spark, path, CUSTOMER_SCHEMA, fmt="csv")


def _factors_with_columns(spark, sf_dir):
    return QT.factors_from_data(spark, sf_dir).withColumn("column_based", F.array("name"))


@register("a02_read_factors", f"""
WITH f AS ({BD.LINEITEM_FACTORS_SQL})
{" UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS name, '{c.replace('_', ' ')} of the line item' AS description, "
    f"(SELECT list(DISTINCT {c} ORDER BY {c}) FROM f) AS possible_values, "
    f"'read from the {c} column' AS annotation_criteria, ['{c}'] AS column_based"
    for i, c in enumerate(BD.FACTOR_COLS))}""")
def q_read_factors(spark, sf_dir):
    fac = _factors_with_columns(spark, sf_dir)
    path = A.scratch_path(spark, "factors-json")
    A.write_json_doc(spark, A.factors_json(fac, F.array(F.lit("qty_bucket"))), fac, path)
    factors, _focus = A.read_factors(spark, path)
    return factors.withColumn("pos", F.col("pos").cast("int"))


@register("a03_read_edges", f"""
SELECT graph_id, src, dst, value FROM ({BD.NATION_EDGES_SQL})""")
def q_read_edges(spark, sf_dir):
    e = BD.nation_graph_edges(spark, sf_dir)
    path = A.scratch_path(spark, "edges-json")
    A.write_json_doc(spark, A.edges_json(e), e, path, by="graph_id")
    return A.read_edges(spark, path).select("graph_id", "src", "dst", "value")


@register("a03_read_causal_order", f"""
SELECT graph_id, "order" AS nodes FROM ({QG.SQL["h03_topo_sort"]})""")
def q_read_causal_order(spark, sf_dir):
    """Weighted graph files (an edge weighs its source's balance) with their causal orders, read back."""
    inv, d = QG._involved(spark, sf_dir)
    balance = BD.nation_ranks(spark, sf_dir).select(F.col("n_name").alias("src"), F.col("bal").alias("weight"))
    e = d.join(balance, "src").join(G.topo_sort(inv, d), "graph_id")
    path = A.scratch_path(spark, "weighted-json")
    A.write_json_doc(spark, A.edges_json(e, "weight", F.first("order")), e, path, by="graph_id")
    return A.read_causal_order(spark, path)


@register("a04_read_orders", f"WITH {QG._EXPAND_SQL} SELECT CAST(order_id AS INTEGER) AS order_id, cols FROM ex")
def q_read_orders(spark, sf_dir):
    o = QG.expanded_orders(spark, sf_dir)
    path = A.scratch_path(spark, "orders-json")
    A.write_json_doc(spark, A.orders_json(o), o, path)
    return A.read_orders(spark, path)


@register("a05_read_weights", f"WITH {QG._SEGMENT_FACTORS_SQL} SELECT col, weight FROM wf")
def q_read_weights(spark, sf_dir):
    w = QG.segment_weights(spark, sf_dir)
    path = A.scratch_path(spark, "weights-json")
    A.write_json_doc(spark, A.weights_json(w), w, path)
    return A.read_weights(spark, path)


@register("a07_write_json_metrics",
          f"SELECT dataset, split, method, metric, round(value, 9) AS value FROM ({QE.EVAL_SQL})")
def q_write_json(spark, sf_dir):
    m = QE.metrics_table(spark, sf_dir).withColumn("value", F.round("value", 9))
    path = A.scratch_path(spark, "metrics-json")
    m.write.mode("overwrite").json(path)
    return spark.read.schema("dataset string, split string, method string, metric string, "
                             "value double").json(path)


@register("a08_write_predicted_anomalies", f"""
WITH s AS ({QE.SCORED_SQL}),
v AS (SELECT * FROM s WHERE method NOT IN (SELECT method FROM s WHERE isnan(score) OR isinf(score))),
k AS (SELECT method, sum(label) AS k FROM v GROUP BY method),
r AS (SELECT v.*, row_number() OVER (PARTITION BY method ORDER BY score DESC,
             md5(concat_ws('|', '0', CAST(row_id AS VARCHAR))), row_id) AS rank FROM v)
SELECT r.method, r.row_id, round(r.score, 9) AS score, r.label, CAST(r.rank AS INTEGER) AS rank,
       c.c_name, c.c_acctbal
FROM r JOIN k USING (method) JOIN customer c ON c.c_custkey = r.row_id WHERE r.rank <= k.k""")
def q_write_pred(spark, sf_dir):
    s = QE.valid_scores(QE.scored_customers(spark, sf_dir), ["method"])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), "c_name",
                                                   "c_acctbal")
    path = A.scratch_path(spark, "predicted")
    A.write_predicted_anomalies(s.select("method", "row_id", "score", "label"), rows, path)
    out = spark.read.parquet(path)
    return out.select("method", "row_id", F.round("score", 9).alias("score"), "label",
                      F.col("rank").cast("int").alias("rank"), "c_name", "c_acctbal")


@register("a09_columns", """
SELECT CAST(ordinal_position - 1 AS INTEGER) AS pos, column_name AS col
FROM information_schema.columns WHERE table_name = 'customer'""")
def q_columns(spark, sf_dir):
    return A.columns(table(spark, sf_dir, "customer"))


@register("a10_array_to_columns", "SELECT vec_id, " + ", ".join(
    f"embedding[{i + 1}] AS {n}" for i, n in enumerate(
        [chr(65 + i) for i in range(26)] + [chr(65 + a) + chr(65 + b) for a in range(26) for b in range(26)])
    if i < 64) + " FROM embeddings")
def q_array_to_columns(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return A.array_to_columns(e, "embedding", n=64, keep=["vec_id"])
