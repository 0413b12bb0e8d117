"""Queries for text operators (D1-D12) over ``documents``, ``customer``,
``conversations``, ``events`` and the lineitem factor columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import orders as H
from kestrel.operators import text as D
from kestrel.plans import bindings as BD
from kestrel.plans.registry import register
from kestrel.session import table

TOK = "'[\\p{L}\\p{N}_]{2,}'"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text", "lang",
                                                    "source")


@register("d01_join_text", """
SELECT doc_id AS row_id, concat_ws(' ', text, lang, source) AS joined FROM documents""")
def q_join_text(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("row_id", D.join_text(["text", "lang", "source"]).alias("joined"))


_VOCAB_SQL = f"""
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {TOK})) AS term FROM documents),
vocab AS (SELECT term, count(*) AS tf_total, count(DISTINCT doc_id) AS df FROM toks
          GROUP BY term ORDER BY tf_total DESC, term LIMIT 300),
tf AS (SELECT doc_id AS row_id, term, count(*) AS tf FROM toks WHERE term IN (SELECT term FROM vocab)
       GROUP BY ALL)"""


@register("d02_bag_of_words", f"WITH {_VOCAB_SQL} SELECT row_id, term, tf FROM tf")
def q_bow(spark, sf_dir):
    return D.bag_of_words(_docs(spark, sf_dir), "row_id", ["text"], 300)


@register("d03_tfidf", f"""
WITH {_VOCAB_SQL},
n AS (SELECT count(*) AS n_docs FROM documents),
w AS (SELECT row_id, term, tf * (ln((1.0 + n_docs) / (1.0 + df)) + 1.0) AS v FROM tf JOIN vocab USING (term), n),
nm AS (SELECT row_id, sqrt(sum(v * v)) AS norm FROM w GROUP BY row_id)
SELECT row_id, term, round(v / norm, 9) AS tfidf FROM w JOIN nm USING (row_id)""")
def q_tfidf(spark, sf_dir):
    t = D.tfidf(_docs(spark, sf_dir), "row_id", ["text"], 300)
    return t.withColumn("tfidf", F.round("tfidf", 9))


@register("d04_mean_word_vectors")
def q_word_vectors(spark, sf_dir):
    """Word vectors fitted on the conversation texts (Spark ML Word2Vec, a large vocabulary by
    the same method in parts), then averaged per conversation turn."""
    conv = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text")
    return D.mean_word_vectors(conv, "row_id", ["text"], D.fit_word_vectors(conv, ["text"], 16, min_count=1), 16)


_CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_FMT_SQL = ("concat_ws(chr(10), 'c_custkey is ' || CAST(c_custkey AS VARCHAR), 'c_name is ' || c_name, "
            "'c_nationkey is ' || CAST(c_nationkey AS VARCHAR), 'c_acctbal is ' || printf('%.2f', c_acctbal), "
            "'c_mktsegment is ' || c_mktsegment)")


@register("d05_format_sample", f"SELECT c_custkey, {_FMT_SQL} AS sample FROM customer")
def q_format_sample(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(*_CUST_COLS)
    return D.format_sample(c, _CUST_COLS).select("c_custkey", "sample")


@register("d06_samples_text", f"""
WITH s AS (SELECT c_custkey, {_FMT_SQL} AS sample,
                  md5(concat_ws('|', '4', CAST(c_custkey AS VARCHAR))) AS h FROM customer
           ORDER BY h, c_custkey LIMIT 8),
r AS (SELECT *, row_number() OVER (ORDER BY h, c_custkey) AS i FROM s)
SELECT string_agg('### Sample ' || CAST(i AS VARCHAR) || chr(10) || sample || chr(10) || chr(10), '' ORDER BY i)
       AS text FROM r""")
def q_samples_text(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(*_CUST_COLS)
    return D.samples_text(c, 8, seed=4, key="c_custkey", cols=_CUST_COLS)


@register("d07_serialize_rows", f"""
WITH m AS ({BD.MIXED_SQL}),
cols AS (SELECT unnest(['o_orderstatus', 'c_mktsegment', 'n_name', 'o_totalprice', 'c_acctbal', 'month', 'weekday']) AS col),
p AS (SELECT CAST(r.range AS INTEGER) AS order_id, col,
             row_number() OVER (PARTITION BY r.range ORDER BY md5(concat_ws('|', '2', CAST(r.range AS VARCHAR), col)), col) AS pos
      FROM range(2) r, cols),
v AS (SELECT row_id, col, coalesce(nullif(trim(CAST(value AS VARCHAR)), ''), 'None') AS value
      FROM (SELECT row_id, o_orderstatus, c_mktsegment, n_name, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
                   CAST(c_acctbal AS VARCHAR) AS c_acctbal, month, weekday FROM m)
      UNPIVOT INCLUDE NULLS (value FOR col IN (o_orderstatus, c_mktsegment, n_name, o_totalprice, c_acctbal, month, weekday)))
SELECT row_id, order_id, string_agg(' ' || col || ' is ' || value || ' ', ',' ORDER BY pos) AS text
FROM v JOIN p USING (col) GROUP BY row_id, order_id""")
def q_serialize(spark, sf_dir):
    m = BD.mixed_table(spark, sf_dir)
    perms = H.permutations(spark, BD.MIXED_FEATURES, 2, seed=2)
    return D.serialize_rows(m, "row_id", perms, BD.MIXED_FEATURES)


@register("d08_truncate_tokens", """
WITH t AS (SELECT doc_id, text, source, regexp_extract_all(text, '\\S+') AS toks,
                  regexp_extract_all(source, '\\S+') AS stoks FROM documents)
SELECT doc_id, CASE WHEN len(toks) + 2 >= 50 THEN array_to_string(toks[1:48], ' ') ELSE text END AS text,
       CASE WHEN len(stoks) + 2 >= 128 THEN array_to_string(stoks[1:126], ' ') ELSE source END AS source
FROM t""")
def q_truncate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return D.truncate_tokens(d, {"text": 50}, default=128, cols=["text", "source"])


_TEMPLATE = "Order $o_orderkey placed by a ${c_mktsegment} customer is $o_orderstatus; review: $task."


@register("d09_render_prompts", """
SELECT o_orderkey, 'Order ' || CAST(o_orderkey AS VARCHAR) || ' placed by a ' || c_mktsegment ||
       ' customer is ' || o_orderstatus || '; review: anomaly check.' AS prompt
FROM orders JOIN customer ON o_custkey = c_custkey""")
def q_render(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"),
                                            F.col("o_custkey") == F.col("c_custkey"))
    r = D.render_prompts(o.select("o_orderkey", "c_mktsegment", "o_orderstatus"), _TEMPLATE,
                         {"task": "anomaly check"})
    return r.select("o_orderkey", "prompt")


def factors_from_data(spark, sf_dir):
    """A factor catalogue read off the lineitem factor columns: the possible
    values of each factor are its distinct values in the data."""
    f = BD.lineitem_factors(spark, sf_dir)
    arrs = f.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in BD.FACTOR_COLS])
    return arrs.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("name"),
                 F.lit(f"{c.replace('_', ' ')} of the line item").alias("description"),
                 F.col(c).alias("possible_values"),
                 F.lit(f"read from the {c} column").alias("annotation_criteria"))
        for i, c in enumerate(BD.FACTOR_COLS)])))


@register("d10_factor_summary", f"""
WITH f AS ({BD.LINEITEM_FACTORS_SQL}),
v AS ({" UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS name, '{c.replace('_', ' ')} of the line item' AS description, "
    f"(SELECT list(DISTINCT {c} ORDER BY {c}) FROM f) AS pv, 'read from the {c} column' AS crit"
    for i, c in enumerate(BD.FACTOR_COLS))})
SELECT string_agg(CAST(pos + 1 AS VARCHAR) || ') ' || name || ': ' || description || chr(10) ||
  '  values: ' || array_to_string(list_transform(pv, lambda x: CAST(x AS VARCHAR)), ', ') || chr(10) ||
  '  how to annotate: ' || crit, chr(10) || chr(10) ORDER BY pos) AS summary FROM v""")
def q_factor_summary(spark, sf_dir):
    return D.factor_summary(factors_from_data(spark, sf_dir))


def _responses(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.when(F.col("event_type") == "click",
                                        F.concat(F.lit("Here you go:\n```json\n"), F.col("props"), F.lit("\n```")))
                     .when(F.col("event_type") == "view", F.concat(F.lit("```\n"), F.col("props"), F.lit("\n```")))
                     .when(F.col("event_type") == "purchase", F.concat(F.lit("{broken "), F.col("props")))
                     .otherwise(F.col("props")).alias("response"))


@register("d11_parse_fenced_json", """
WITH r AS (SELECT event_id, CASE event_type
             WHEN 'click' THEN 'Here you go:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```'
             WHEN 'view' THEN '```' || chr(10) || props || chr(10) || '```'
             WHEN 'purchase' THEN '{broken ' || props ELSE props END AS response, event_type, props FROM events)
SELECT event_id, CASE WHEN event_type = 'purchase' THEN NULL
                      ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM r""")
def q_parse_json(spark, sf_dir):
    r = _responses(spark, sf_dir)
    return r.select("event_id", D.parse_fenced_json(F.col("response"), "k INT")["k"].alias("k"))


_D12_SQL = '\nWITH r AS (SELECT event_id, json_extract_string(props, \'$.k\') AS k, event_type FROM events),\nresp AS (SELECT event_id, CASE\n    WHEN event_type = \'view\' THEN \'```json\' || chr(10) || \'{"factors": {"f": {"possible_values": ["low", \' || k || \']}}, "recommended_focus_factors": ["f"]}\' || chr(10) || \'```\'\n    WHEN event_type = \'error\' THEN \'{"factors": {"f": {"possible_values": [\' || k || \']}}}\'\n    ELSE \'```json\' || chr(10) || \'{"factors": {"f": {"possible_values": [0, \' || k || \']}}, "recommended_focus_factors": ["f"]}\' || chr(10) || \'```\'\n  END AS response FROM r),\njs AS (SELECT event_id, trim(CASE WHEN contains(response, \'```json\') THEN regexp_extract(response, \'(?s)```json(.*?)(```|$)\', 1)\n                                  WHEN contains(response, \'```\') THEN regexp_extract(response, \'(?s)```(.*?)(```|$)\', 1)\n                                  ELSE response END) AS j FROM resp),\nv AS (SELECT event_id, CASE WHEN NOT json_valid(j) OR json_extract(j, \'$.factors\') IS NULL THEN \'no factors\'\n                            WHEN json_extract(j, \'$.recommended_focus_factors\') IS NULL THEN \'no recommended focus\'\n                            WHEN NOT list_bool_and(list_transform(json_extract(j, \'$.factors.*.possible_values\'),\n                                   lambda x: regexp_full_match(CAST(x AS VARCHAR), \'\\[\\s*(-?(0|[1-9][0-9]*)(\\.[0-9]+)?([eE][+-]?[0-9]+)?\\s*(,\\s*-?(0|[1-9][0-9]*)(\\.[0-9]+)?([eE][+-]?[0-9]+)?\\s*)*)?\\]\'))) THEN \'a possible value is not a number\'\n                       END AS reason FROM js)\nSELECT event_id, reason IS NULL AS valid, reason FROM v'


@register("d12_validate_factors", _D12_SQL)
def q_validate(spark, sf_dir):
    """Proposals built from event rows: click -> numeric values, view -> a word
    among the values, error -> no focus list."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    resp = ev.select("event_id", F.when(F.col("event_type") == "view", F.concat(
        F.lit('```json\n{"factors": {"f": {"possible_values": ["low", '), k, F.lit(']}}, '
                                                                              '"recommended_focus_factors": ["f"]}\n```')))
        .when(F.col("event_type") == "error", F.concat(
            F.lit('{"factors": {"f": {"possible_values": ['), k, F.lit(']}}}')))
        .otherwise(F.concat(F.lit('```json\n{"factors": {"f": {"possible_values": [0, '), k,
                            F.lit(']}}, "recommended_focus_factors": ["f"]}\n```'))).alias("response"))
    parsed = resp.select("event_id", D.extract_json_text(F.col("response")).alias("json"))
    return D.validate_factors(parsed, "json").select("event_id", "valid", "reason")
