"""Queries for preparation operators: B (recode), C (binning), E (sampling), K (joins).

Stand-in inputs derived from the driver tables only reshape their rows into the
schema an operator expects (for example a nullable copy of a column); the
operator itself then runs on the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import binning as C
from kestrel.operators import joins as K
from kestrel.operators import recode as R
from kestrel.operators import sampling as E
from kestrel.operators import scoring as I
from kestrel.operators import orders as H
from kestrel.plans import bindings as BD
from kestrel.plans.registry import register
from kestrel.session import table

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _t(spark, sf_dir, name):
    return table(spark, sf_dir, name)


# ------------------------------------------------------------------ B: recodes
def _blank_customer(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(
        "c_custkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"),
        F.when(F.col("c_acctbal") < 0, F.lit("  ")).otherwise(F.col("c_name")).alias("name"))


_BLANK_CUSTOMER_SQL = """SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment,
  CASE WHEN c_acctbal < 0 THEN '  ' ELSE c_name END AS name FROM customer"""


@register("b01_fill_unknown", f"""
WITH s AS ({_BLANK_CUSTOMER_SQL})
SELECT c_custkey,
  CASE WHEN segment IS NULL OR regexp_matches(segment, '^\\s*$') THEN 'unknown' ELSE segment END AS segment,
  CASE WHEN name IS NULL OR regexp_matches(name, '^\\s*$') THEN 'unknown' ELSE name END AS name
FROM s""")
def q_fill_unknown(spark, sf_dir):
    return R.fill_unknown(_blank_customer(spark, sf_dir))


@register("b02_fill_defaults", f"""
WITH s AS ({_BLANK_CUSTOMER_SQL})
SELECT c_custkey, coalesce(segment, 'Not Specified') AS segment, name FROM s""")
def q_fill_defaults(spark, sf_dir):
    return R.fill_defaults(_blank_customer(spark, sf_dir), {"segment": "Not Specified"})


@register("b03_impute_mean", """
WITH s AS (SELECT l_orderkey, l_linenumber,
                  CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_discount END AS l_discount
           FROM lineitem),
m AS (SELECT avg(l_discount) AS m FROM s)
SELECT l_orderkey, l_linenumber, round(coalesce(l_discount, m), 9) AS l_discount FROM s, m""")
def q_impute_mean(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "R", F.lit(None)).otherwise(F.col("l_discount"))
        .alias("l_discount"))
    out = R.impute_mean(li, ["l_discount"])
    return out.withColumn("l_discount", F.round("l_discount", 9))


PRIORITY_WORDS = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium"}


@register("b04_recode", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high'
  WHEN '3-MEDIUM' THEN 'medium' END AS priority_word FROM orders""")
def q_recode(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return R.recode(o, "o_orderpriority", PRIORITY_WORDS, "priority_word").drop("o_orderpriority")


@register("b05_replace_values", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high'
  WHEN '3-MEDIUM' THEN 'medium' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def q_replace_values(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return R.replace_values(o, "o_orderpriority", PRIORITY_WORDS)


@register("b06_encode_label", """
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN ' Yes'
                                   WHEN o_orderstatus = 'O' THEN 'no'
                                   WHEN o_totalprice > 300000 THEN '2' ELSE 'TRUE' END AS raw
           FROM orders)
SELECT o_orderkey, CASE WHEN lower(trim(raw)) IN ('yes', 'true', '1') THEN 1
                        WHEN lower(trim(raw)) IN ('no', 'false', '0') THEN 0
                        ELSE CAST(trunc(TRY_CAST(raw AS DOUBLE)) AS INTEGER) END AS label
FROM s""")
def q_encode_label(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", " Yes")
        .when(F.col("o_orderstatus") == "O", "no")
        .when(F.col("o_totalprice") > 300000, "2").otherwise("TRUE").alias("raw"))
    return R.encode_label(o, "raw", "label").drop("raw")


@register("b07_verbalize_columns", """
SELECT c_custkey AS "c custkey", c_name AS "c name", c_nationkey AS "c nationkey",
       c_acctbal AS "c acctbal", c_mktsegment AS "c mktsegment" FROM customer""")
def q_verbalize_columns(spark, sf_dir):
    return R.verbalize_columns(_t(spark, sf_dir, "customer"), style="underscore")


@register("b08_anonymize", """
SELECT c_custkey, c_nationkey AS A, c_acctbal AS B,
       CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS C FROM customer""")
def q_anonymize(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal",
                                             "c_mktsegment")
    return R.anonymize(c, keep=["c_custkey"])


@register("b09_drop_move", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
       l_linestatus, l_returnflag FROM lineitem""")
def q_drop_move(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return R.move_last(R.drop_cols(li, ["l_tax"], contains=["date"]), "l_returnflag")


@register("b10_filter_normal", f"""
SELECT row_id, label FROM ({BD.MIXED_SQL}) WHERE label = 0""")
def q_filter_normal(spark, sf_dir):
    return R.filter_normal(BD.mixed_table(spark, sf_dir)).select("row_id", "label")


@register("b11_calendar_features", """
SELECT event_id, monthname(ts) AS month_purchase, dayname(ts) AS weekday_purchase FROM events""")
def q_calendar(spark, sf_dir):
    return R.calendar_features(_t(spark, sf_dir, "events").select("event_id", "ts"), "ts").drop("ts")


@register("b12_combine_date_parts", """
WITH s AS (SELECT o_orderkey, month(o_orderdate) AS m,
                  7 * (CAST(ceil(day(o_orderdate) / 7) AS INTEGER) - 1) + isodow(o_orderdate) AS d,
                  o_orderstatus, o_totalprice FROM orders)
SELECT o_orderkey, CAST(m AS VARCHAR) || '-' || CAST(d AS VARCHAR) AS accident_date,
       CASE WHEN o_orderstatus = 'P' THEN 'unknown'
            ELSE CAST(CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN 13 ELSE m END
                      AS VARCHAR) || '-' || CAST(d AS VARCHAR) END AS claim_date
FROM s""")
def q_combine_dates(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    week = F.ceil(F.dayofmonth("o_orderdate") / 7).cast("string")
    s = o.select(
        "o_orderkey", F.date_format("o_orderdate", "MMM").alias("Month"),
        week.alias("WeekOfMonth"), F.date_format("o_orderdate", "EEEE").alias("DayOfWeek"),
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000), F.lit("0"))
        .otherwise(F.date_format("o_orderdate", "MMM")).alias("MonthClaimed"),
        week.alias("WeekOfMonthClaimed"),
        F.when(F.col("o_orderstatus") == "P", F.lit("0"))
        .otherwise(F.date_format("o_orderdate", "EEEE")).alias("DayOfWeekClaimed"))
    s = R.combine_date_parts(s, "Month", "WeekOfMonth", "DayOfWeek", "accident_date")
    return R.combine_date_parts(s, "MonthClaimed", "WeekOfMonthClaimed", "DayOfWeekClaimed",
                                "claim_date", unknown_on_zero=True)


def _raw_codes(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return ev.select("event_id", F.when(F.col("event_type") == "click", F.concat(F.lit(" "), k, F.lit(" ")))
                     .when(F.col("event_type") == "view", F.concat(k, F.lit(".0")))
                     .when(F.col("event_type") == "error", F.lit("unknown"))
                     .when(F.col("event_type") == "purchase", F.lit(""))
                     .otherwise(k).alias("raw"))


@register("b13_coerce_int", """
WITH s AS (SELECT event_id, CASE event_type WHEN 'click' THEN ' ' || json_extract_string(props, '$.k') || ' '
                                 WHEN 'view' THEN json_extract_string(props, '$.k') || '.0'
                                 WHEN 'error' THEN 'unknown' WHEN 'purchase' THEN ''
                                 ELSE json_extract_string(props, '$.k') END AS raw FROM events)
SELECT event_id, CASE WHEN regexp_full_match(trim(raw), '[+-]?[0-9]+')
                      THEN CAST(trim(raw) AS INTEGER) END AS code FROM s""")
def q_coerce_int(spark, sf_dir):
    s = _raw_codes(spark, sf_dir)
    return s.select("event_id", R.coerce_int(s, "raw").alias("code"))


B14_FACTORS = [("qty_bucket", [-1, 0, 1, 2, 3, 4]), ("disc_bucket", list(range(0, 11))),
               ("new_factor", [1, 2])]


@register("b14_fill_missing_codes", f"""
WITH f AS ({BD.LINEITEM_FACTORS_SQL}),
s AS (SELECT row_id, CASE WHEN returnflag = 2 THEN NULL ELSE qty_bucket END AS qty_bucket,
             CASE WHEN ship_month IN (1, 2) THEN NULL ELSE disc_bucket END AS disc_bucket FROM f)
SELECT row_id, coalesce(qty_bucket, -1) AS qty_bucket, coalesce(disc_bucket, 0) AS disc_bucket,
       0 AS new_factor,
       (coalesce(qty_bucket, -1) = -1 AND coalesce(disc_bucket, 0) = 0) AS all_missing
FROM s""")
def q_fill_missing_codes(spark, sf_dir):
    f = BD.lineitem_factors(spark, sf_dir)
    s = f.select("row_id", F.when(F.col("returnflag") == 2, F.lit(None)).otherwise(
        F.col("qty_bucket")).alias("qty_bucket"),
        F.when(F.col("ship_month").isin(1, 2), F.lit(None)).otherwise(
        F.col("disc_bucket")).alias("disc_bucket"))
    filled = R.fill_missing_codes(s, B14_FACTORS)
    return R.all_missing(filled, B14_FACTORS)


@register("b16_drop_constant", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem""")
def q_drop_constant(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag",
                                              F.lit("x").alias("const_col"), "l_quantity")
    return R.drop_constant(li)


@register("b17_clean_text", """
SELECT page_id, regexp_replace(replace(html, '<br />', ''), '^\\s+|\\s+$', '', 'g') AS html
FROM pages""")
def q_clean_text(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    return p.select("page_id", R.clean_text("html").alias("html"))


# ------------------------------------------------------------------ C: binning
def _suffix_sql(p: str) -> str:
    return (f"'the ' || CAST({p} AS VARCHAR) || CASE WHEN {p} % 100 BETWEEN 10 AND 20 THEN 'th' "
            f"WHEN {p} % 10 = 1 THEN 'st' WHEN {p} % 10 = 2 THEN 'nd' WHEN {p} % 10 = 3 THEN 'rd' "
            f"ELSE 'th' END || ' percentile'")


def _li(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LI_NUM)


@register("c01_bin_quantile", f"""
WITH r AS (SELECT l_orderkey, l_linenumber,
  {", ".join(f"CAST(floor(rank() OVER (ORDER BY {c}) / count(*) OVER () * 100) AS BIGINT) AS {c}"
             for c in LI_NUM)}
  FROM lineitem)
SELECT l_orderkey, l_linenumber, {", ".join(f"{_suffix_sql(c)} AS {c}" for c in LI_NUM)} FROM r""")
def q_bin_quantile(spark, sf_dir):
    return C.bin_quantile(_li(spark, sf_dir), LI_NUM)


@register("c02_ordinal_encode", """
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS p_type,
       CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand FROM part""")
def q_ordinal_encode(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    return C.ordinal_encode(p, ["p_type", "p_brand"])


@register("c03_factor_encode", """
WITH f AS (SELECT o_orderpriority, min(o_orderkey) AS first_pos FROM orders GROUP BY 1),
c AS (SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY first_pos) - 1 AS INTEGER) AS code FROM f)
SELECT o_orderkey, code AS o_orderpriority FROM orders JOIN c USING (o_orderpriority)""")
def q_factor_encode(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return C.factor_encode(o, ["o_orderpriority"], "o_orderkey")


def _ew_sql(nb: int) -> str:
    parts = []
    for c in LI_NUM:
        scaled = (f"CASE WHEN nu_{c} > 1 THEN ({c} - mn_{c}) / (mx_{c} - mn_{c}) * {float(nb)} "
                  f"ELSE {c} END")
        if 10 % nb == 0:
            parts.append(f"round_even(round_even({scaled}, 0) / 10.0, 1) + 0.0 AS {c}")
        else:
            parts.append(f"round_even(round_even({scaled}, 0) / 100.0, 2) + 0.0 AS {c}")
    stats = ", ".join(f"min({c}) mn_{c}, max({c}) mx_{c}, count(DISTINCT {c}) nu_{c}" for c in LI_NUM)
    return f"""WITH st AS (SELECT {stats} FROM lineitem)
SELECT l_orderkey, l_linenumber, {", ".join(parts)} FROM lineitem, st"""


@register("c04_bin_equal_width_10", _ew_sql(10))
def q_equal_width_10(spark, sf_dir):
    return C.bin_equal_width(_li(spark, sf_dir), LI_NUM, 10)


@register("c04_bin_equal_width_7", _ew_sql(7))
def q_equal_width_7(spark, sf_dir):
    return C.bin_equal_width(_li(spark, sf_dir), LI_NUM, 7)


@register("c05_bin_standard", f"""
WITH st AS (SELECT {", ".join(f"avg({c}) m_{c}, stddev_pop({c}) s_{c}" for c in LI_NUM)} FROM lineitem)
SELECT l_orderkey, l_linenumber, {", ".join(
    f"round_even(({c} - m_{c}) / CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1 ELSE s_{c} END, 1) + 0.0 AS {c}"
    for c in LI_NUM)} FROM lineitem, st""")
def q_bin_standard(spark, sf_dir):
    return C.bin_standard(_li(spark, sf_dir), LI_NUM)


_WORDS_SQL = "[" + ", ".join(f"'{w}'" for w in C.LANGUAGE_WORDS) + "]"


@register("c06_bin_language", f"""
WITH st AS (SELECT {", ".join(f"min({c}) mn_{c}, max({c}) mx_{c}" for c in LI_NUM)} FROM lineitem)
SELECT l_orderkey, l_linenumber, {", ".join(
    f"list_element({_WORDS_SQL}, least(CAST(floor(({c} - mn_{c}) / (mx_{c} - mn_{c}) * 10.0) AS INTEGER), 9) + 1) AS {c}"
    for c in LI_NUM)} FROM lineitem, st""")
def q_bin_language(spark, sf_dir):
    return C.bin_language(_li(spark, sf_dir), LI_NUM)


@register("c07_normalize_quantile_customer", f"""
WITH r AS (SELECT c_custkey, c_mktsegment,
             CAST(floor(rank() OVER (ORDER BY c_acctbal) / count(*) OVER () * 100) AS BIGINT) AS p
           FROM customer)
SELECT c_custkey, c_mktsegment, {_suffix_sql("p")} AS c_acctbal FROM r""")
def q_normalize(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return C.normalize(c, "quantile", cols=["c_acctbal"])


@register("c08_standardize", """
WITH st AS (SELECT avg(c_acctbal) m, stddev_pop(c_acctbal) s FROM customer)
SELECT c_custkey, round((c_acctbal - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 9) AS c_acctbal
FROM customer, st""")
def q_standardize(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return C.standardize(c, ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 9))


@register("c09_group_rare", """
WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) AS supp FROM lineitem),
c AS (SELECT supp, count(*) AS n FROM s GROUP BY supp),
t AS (SELECT sum(n) AS tot, count(*) AS k FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN k > 10 AND n / tot < 0.01 THEN 'Rare' ELSE supp END AS supp
FROM s JOIN c USING (supp), t""")
def q_group_rare(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber",
                                              F.col("l_suppkey").cast("string").alias("supp"))
    return C.group_rare(li, ["supp"], tol=0.01, min_categories=10)


@register("c10_one_hot", """
SELECT c_custkey,
  CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS c_mktsegment_BUILDING,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS c_mktsegment_FURNITURE,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS c_mktsegment_HOUSEHOLD,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS c_mktsegment_MACHINERY
FROM customer""")
def q_one_hot(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return C.one_hot(c, ["c_mktsegment"])


@register("c11_collapse_singletons", """
WITH s AS (SELECT l_orderkey, l_linenumber,
                  CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS device FROM lineitem),
c AS (SELECT device, count(*) AS n FROM s GROUP BY device)
SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN '0' ELSE device END AS device
FROM s JOIN c USING (device)""")
def q_collapse_singletons(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"))
        .alias("device"))
    return C.collapse_singletons(li, "device")


@register("c13_bin_floor", """
SELECT event_id, CAST(least(greatest(floor(value * 10 / 100.0), 0), 9) AS INTEGER) AS value_bin
FROM events""")
def q_bin_floor(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    return ev.select("event_id", C.bin_floor("value", 100.0, 10).alias("value_bin"))


# ------------------------------------------------------------------ E: sampling
def _orders(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@register("e01_sample_n", """
SELECT o_orderkey, o_orderstatus FROM orders
ORDER BY md5(concat_ws('|', '7', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 100""")
def q_sample_n(spark, sf_dir):
    return E.sample_n(_orders(spark, sf_dir).select("o_orderkey", "o_orderstatus"), 100, 7,
                      "o_orderkey")


@register("e01_sample_n_distributed", """
SELECT l_orderkey * 10 + l_linenumber AS row_id FROM lineitem
ORDER BY md5(concat_ws('|', '3', CAST(l_orderkey * 10 + l_linenumber AS VARCHAR))), 1 LIMIT 12000""")
def q_sample_n_big(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"))
    return E.sample_n(li, 12000, 3, "row_id")


@register("e02_shuffle", """
SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws('|', '5', CAST(o_orderkey AS VARCHAR))),
                                      o_orderkey) - 1 AS position FROM orders""")
def q_shuffle(spark, sf_dir):
    return E.shuffle(_orders(spark, sf_dir).select("o_orderkey"), 5, "o_orderkey")


@register("e03_downsample_class", """
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'
UNION ALL
(SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'
 ORDER BY md5(concat_ws('|', '1', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 500)""")
def q_downsample_class(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    return E.downsample_class(o, "o_orderstatus", "F", 500, 1, "o_orderkey")


@register("e04_downsample_ratio", f"""
WITH m AS ({BD.MIXED_SQL}),
k AS (SELECT row_id, label FROM m WHERE label = 1),
o AS (SELECT row_id, label, row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(row_id AS VARCHAR))), row_id) - 1 AS pos
      FROM m WHERE label <> 1)
SELECT * FROM k UNION ALL
SELECT row_id, label FROM o WHERE pos < (SELECT floor(count(*) * 5 / 95) FROM k)""")
def q_downsample_ratio(spark, sf_dir):
    m = BD.mixed_table(spark, sf_dir).select("row_id", "label")
    return E.downsample_ratio(m, "label", 1, 42, "row_id")


SOURCE_GROUPS = [[f"src{i}" for i in range(g * 5, g * 5 + 5)] for g in range(4)]


@register("e05_subsample_one_vs_rest", f"""
WITH g AS (SELECT doc_id, CASE WHEN source IN ({", ".join(f"'{s}'" for s in SOURCE_GROUPS[0])})
                          THEN 0 ELSE 1 END AS label FROM documents),
nn AS (SELECT count(*) AS nn FROM g WHERE label = 0),
q AS (SELECT CASE WHEN 285 > nn THEN nn ELSE 285 END AS qn,
             CASE WHEN 285 > nn THEN floor(0.05 * nn / 0.95) ELSE 15 END AS qa FROM nn),
r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label
         ORDER BY md5(concat_ws('|', '9', CAST(doc_id AS VARCHAR))), doc_id) - 1 AS pos FROM g)
SELECT doc_id, label FROM r, q WHERE (label = 0 AND pos < qn) OR (label = 1 AND pos < qa)""")
def q_subsample(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "source")
    return E.subsample_one_vs_rest(d, "source", SOURCE_GROUPS, 0, 300, 9, "doc_id").select(
        "doc_id", "label")


@register("e06_split_half_by_label", f"""
WITH m AS ({BD.MIXED_SQL}),
r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS pos,
             count(*) OVER (PARTITION BY label) AS cnt FROM m)
SELECT row_id, label, CASE WHEN pos < floor(cnt / 2) THEN 'train' ELSE 'test' END AS split FROM r""")
def q_split_half(spark, sf_dir):
    m = BD.mixed_table(spark, sf_dir).select("row_id", "label")
    return E.split_half_by_label(m, "label", "row_id")


@register("e07_split_semi_supervised", f"""
WITH m AS ({BD.MIXED_SQL}),
r AS (SELECT row_id, label, row_number() OVER (ORDER BY row_id) - 1 AS pos,
             count(*) OVER () AS cnt FROM m WHERE label = 0)
SELECT row_id, label, CASE WHEN pos < floor(cnt * 0.5) THEN 'train' ELSE 'test' END AS split FROM r
UNION ALL SELECT row_id, label, 'test' FROM m WHERE label <> 0""")
def q_split_semi(spark, sf_dir):
    m = BD.mixed_table(spark, sf_dir).select("row_id", "label")
    return E.split_semi_supervised(m, "label", "row_id", 0.5)


@register("e08_augment", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, 0 AS label FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, 1 FROM supplier""")
def q_augment(spark, sf_dir):
    base = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                                                F.lit(0).alias("label"))
    synth = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    return E.augment(base, synth, "label", 1)


@register("e09_ratio_batches", f"""
WITH m AS ({BD.MIXED_SQL}),
r AS (SELECT row_id, CASE WHEN label = 1 THEN 1 ELSE 0 END AS cls FROM m),
h AS (SELECT row_id, cls, row_number() OVER (PARTITION BY cls
        ORDER BY md5(concat_ws('|', '0', CAST(row_id AS VARCHAR))), row_id) - 1 AS gpos FROM r),
p AS (SELECT row_id, cls, gpos % 2 AS replica, gpos // 2 AS pos FROM h),
c AS (SELECT replica, CAST(sum(1 - cls) AS BIGINT) AS nn, CAST(sum(cls) AS BIGINT) AS na FROM p GROUP BY replica),
pl AS (SELECT replica, nn, na, (nn < 12 OR na < 4) AS fb,
              CAST(greatest(ceil(nn / 12.0), ceil(na / 4.0)) AS BIGINT) AS cycles FROM c),
slots AS (
  SELECT pl.replica, 0 AS cls, t.j % pl.nn AS pos, t.j // 12 AS batch_id, t.j % 12 AS slot
  FROM pl, LATERAL range(0, pl.cycles * 12) t(j) WHERE NOT pl.fb
  UNION ALL
  SELECT pl.replica, 1, t.j % pl.na, t.j // 4, t.j % 4 + 12
  FROM pl, LATERAL range(0, pl.cycles * 4) t(j) WHERE NOT pl.fb
  UNION ALL
  SELECT pl.replica, 0, t.j, t.j // 16, t.j % 16 FROM pl, LATERAL range(0, pl.nn) t(j) WHERE pl.fb
  UNION ALL
  SELECT pl.replica, 1, t.j, (t.j + pl.nn) // 16, (t.j + pl.nn) % 16
  FROM pl, LATERAL range(0, pl.na) t(j) WHERE pl.fb)
SELECT CAST(s.replica AS INTEGER) AS replica, CAST(s.batch_id AS BIGINT) AS batch_id,
       CAST(s.slot AS INTEGER) AS slot, p.row_id
FROM slots s JOIN p ON p.replica = s.replica AND p.cls = s.cls AND p.pos = s.pos""")
def q_ratio_batches(spark, sf_dir):
    m = BD.mixed_table(spark, sf_dir).select("row_id", "label")
    return E.plan_ratio_batches(m, "label", 16, 0.25, seed=0, key="row_id", replicas=2)


# ------------------------------------------------------------------ K: joins
def _part_ranges(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select((F.col("p_size") * 9000.0).alias("lo"),
                    (F.col("p_size") * 9000.0 + F.col("p_retailprice") * 5).alias("hi"),
                    F.col("p_brand").alias("brand"), "p_partkey")


_RANGES_SQL = """SELECT p_size * 9000.0 AS lo, p_size * 9000.0 + p_retailprice * 5 AS hi,
                        p_brand AS brand, p_partkey FROM part"""


@register("k01_range_lookup", f"""
WITH r AS ({_RANGES_SQL}),
h AS (SELECT o_orderkey, arg_min(brand, p_partkey) AS brand
      FROM orders JOIN r ON r.lo < o_totalprice AND r.hi > o_totalprice GROUP BY o_orderkey)
SELECT o_orderkey, coalesce(h.brand, 'Unknown') AS ip_country
FROM orders LEFT JOIN h USING (o_orderkey)""")
def q_range_lookup(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_orderkey", "o_totalprice")
    out = K.range_lookup(o, "o_totalprice", _part_ranges(spark, sf_dir), "lo", "hi", "brand",
                         "ip_country", order="p_partkey")
    return out.select("o_orderkey", "ip_country")


@register("k03_hconcat", """
SELECT o_orderkey, o_totalprice, n_lines FROM orders
JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) USING (o_orderkey)""")
def q_hconcat(spark, sf_dir):
    a = _orders(spark, sf_dir).select("o_orderkey", "o_totalprice")
    b = (_t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
         .agg(F.count(F.lit(1)).alias("n_lines")))
    return K.hconcat(a, b, "o_orderkey")


@register("k04_semi_anti", """
SELECT c_custkey, 'with_orders' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL
SELECT c_custkey, 'without_orders' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def q_semi_anti(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey")
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return (c.join(o, "c_custkey", "left_semi").withColumn("kind", F.lit("with_orders"))
            .unionByName(c.join(o, "c_custkey", "left_anti").withColumn("kind", F.lit("without_orders"))))


@register("k06_intersect_except", """
(SELECT c_nationkey AS nationkey, 'both' AS kind FROM customer
 INTERSECT SELECT s_nationkey, 'both' FROM supplier)
UNION ALL
(SELECT c_nationkey, 'customer_only' FROM customer EXCEPT SELECT s_nationkey, 'customer_only' FROM supplier)""")
def q_intersect_except(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return (c.intersect(s).withColumn("kind", F.lit("both"))
            .unionByName(c.subtract(s).withColumn("kind", F.lit("customer_only"))))


@register("k09_rows_x_permutations", f"""
WITH m AS ({BD.MIXED_SQL})
SELECT p.range AS perm_id, count(*) * {len(BD.MIXED_FEATURES)} AS n_records
FROM m, range(4) p GROUP BY 1""")
def q_rows_x_perms(spark, sf_dir):
    m = BD.mixed_table(spark, sf_dir)
    perms = I.orders_list(H.permutations(spark, BD.MIXED_FEATURES, 4, 0))
    rec = I.order_records(m, "row_id", perms)
    return rec.groupBy(F.col("perm_id").cast("long").alias("perm_id")).agg(
        F.count(F.lit(1)).alias("n_records"))



