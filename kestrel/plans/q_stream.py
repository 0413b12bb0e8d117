"""Streaming query: events scored as they arrive, with a density model fitted on
the static events table (stream-static joins, per-micro-batch aggregation)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from kestrel.operators import orders as H
from kestrel.operators import scoring as I
from kestrel.plans.registry import register
from kestrel.session import table
from kestrel.sources.io import scratch_path
from kestrel.streaming import scoring as S

EVENTS_SCHEMA = ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
                 "props string")


def event_model(spark, sf_dir, n_perms: int = 2):
    static = table(spark, sf_dir, "events")
    binner = S.fixed_equal_width(static, "value", 10)
    feats = S.stream_features(static, "ts", "value", binner)
    orders = I.orders_list(H.permutations(spark, list(S.EVENT_FEATURES), n_perms, seed=6))
    model = I.fit_density(feats, list(S.EVENT_FEATURES), orders, 1.0)
    return binner, orders, model


@register("s01_stream_event_scores", """
WITH st AS (SELECT min(value) AS mn, max(value) AS mx FROM events),
f AS (SELECT event_id AS row_id, event_type, dayname(ts) AS weekday,
             CAST(CAST(least(greatest(floor((value - mn) / CASE WHEN mx - mn = 0 THEN 1.0 ELSE mx - mn END * 10), 0), 9) AS INTEGER) AS VARCHAR) AS value_bin
      FROM events, st),
cols AS (SELECT unnest(['event_type', 'weekday', 'value_bin']) AS col),
perms AS (SELECT p.range AS perm_id, col,
                 row_number() OVER (PARTITION BY p.range ORDER BY md5(concat_ws('|', '6', CAST(p.range AS VARCHAR), col)), col) - 1 AS pos
          FROM range(2) p, cols),
melted AS (SELECT row_id, col, coalesce(value, 'None') AS value FROM f
           UNPIVOT INCLUDE NULLS (value FOR col IN (event_type, weekday, value_bin))),
rec AS (SELECT m.row_id, p.perm_id, p.pos, m.col, m.value FROM melted m JOIN perms p USING (col)),
wp AS (SELECT r.*, coalesce(pr.col, '') AS prev_col, coalesce(pr.value, '') AS prev_value
       FROM rec r LEFT JOIN rec pr ON pr.row_id = r.row_id AND pr.perm_id = r.perm_id AND pr.pos = r.pos - 1),
counts AS (SELECT prev_col, prev_value, col, value, count(DISTINCT row_id) AS n FROM wp GROUP BY ALL),
ctx AS (SELECT prev_col, prev_value, col, count(DISTINCT row_id) AS n_ctx FROM wp GROUP BY ALL),
cards AS (SELECT col, count(DISTINCT value) AS k FROM melted GROUP BY col),
nll AS (SELECT w.row_id, -ln((coalesce(c.n, 0) + 1.0) / (coalesce(x.n_ctx, 0) + 1.0 * coalesce(k.k, 0))) AS nll
        FROM wp w LEFT JOIN counts c USING (prev_col, prev_value, col, value)
        LEFT JOIN ctx x USING (prev_col, prev_value, col) LEFT JOIN cards k USING (col))
SELECT row_id AS event_id, round(sum(nll) / 2.0, 9) AS score FROM nll GROUP BY row_id""")
def q_stream_scores(spark, sf_dir):
    binner, orders, model = event_model(spark, sf_dir)
    stream = S.read_stream(spark, os.path.join(sf_dir, "events.parquet"), EVENTS_SCHEMA)
    feats = S.stream_features(stream, "ts", "value", binner)
    out = scratch_path(spark, "stream-scores")
    S.run_stream_scores(feats, "event_id", model, orders, out, scratch_path(spark, "stream-ckpt"))
    return spark.read.parquet(out).select(F.col("row_id").alias("event_id"),
                                          F.round("score", 9).alias("score"))
