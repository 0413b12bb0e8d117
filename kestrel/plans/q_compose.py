"""Queries for the composite preparation chains (B18-B20) and C12."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.plans import bindings as BD
from kestrel.plans import prepare as P
from kestrel.plans import q_prep as QP
from kestrel.plans.registry import register
from kestrel.session import table


def _transactions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("user_id"),
                    F.date_format(F.date_sub("o_orderdate", 30), "yyyy-MM-dd HH:mm:ss").alias("signup_time"),
                    F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("purchase_time"),
                    F.col("o_custkey").cast("string").alias("device_id"),
                    F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("browser"),
                    F.col("o_totalprice").alias("ip_address"),
                    (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("class"))


@register("b18_prepare_ecommerce", f"""
WITH r AS ({QP._RANGES_SQL}),
h AS (SELECT o_orderkey, arg_min(brand, p_partkey) AS brand
      FROM orders JOIN r ON r.lo < o_totalprice AND r.hi > o_totalprice GROUP BY o_orderkey),
d AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
dv AS (SELECT o.o_orderkey, CASE WHEN n = 1 THEN '0' ELSE CAST(o.o_custkey AS VARCHAR) END AS dev
       FROM orders o JOIN d USING (o_custkey)),
codes AS (SELECT dev, CAST(dense_rank() OVER (ORDER BY dev) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT dev FROM dv))
SELECT o.o_orderpriority AS source, o.o_orderstatus AS browser, coalesce(h.brand, 'Unknown') AS "IP country",
       monthname(o.o_orderdate) AS "month purchase", dayname(o.o_orderdate) AS "weekday purchase",
       codes.code AS "device id",
       CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'Yes' ELSE 'No' END AS class
FROM orders o LEFT JOIN h USING (o_orderkey) JOIN dv USING (o_orderkey) JOIN codes USING (dev)""")
def q_ecommerce(spark, sf_dir):
    ranges = QP._part_ranges(spark, sf_dir)
    return P.prepare_ecommerce(_transactions(spark, sf_dir), ranges, "lo", "hi", "brand",
                               range_order="p_partkey")


CLAIM_REPLACEMENTS = {"Age": {"0": "Unknown"}, "AgeOfVehicle": {"more than 7": "more than 7 years"}}
CLAIM_RENAMES = {"Make": "the make of the vehicle", "FraudFound": "fraud found"}


def _claims(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"),
                                            F.col("o_custkey") == F.col("c_custkey"))
    week = F.ceil(F.dayofmonth("o_orderdate") / 7).cast("string")
    return o.select(
        F.date_format("o_orderdate", "MMM").alias("Month"), week.alias("WeekOfMonth"),
        F.date_format("o_orderdate", "EEEE").alias("DayOfWeek"),
        F.date_format("o_orderdate", "MMM").alias("MonthClaimed"), week.alias("WeekOfMonthClaimed"),
        F.when(F.col("o_orderstatus") == "P", "0").otherwise(F.date_format("o_orderdate", "EEEE"))
        .alias("DayOfWeekClaimed"),
        F.col("c_mktsegment").alias("Make"), F.col("o_orderstatus").alias("AccidentArea"),
        F.when(F.col("c_nationkey") == 0, "0").otherwise(F.col("c_nationkey").cast("string")).alias("Age"),
        F.when(F.col("o_totalprice") > 300000, "more than 7").otherwise("new").alias("AgeOfVehicle"),
        F.col("o_orderkey").cast("string").alias("PolicyNumber"),
        F.col("o_custkey").cast("string").alias("RepNumber"), F.year("o_orderdate").cast("string").alias("Year"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Yes").otherwise("No").alias("FraudFound"))


@register("b19_prepare_claims", """
WITH o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT
  CAST(month(o_orderdate) AS VARCHAR) || '-' ||
    CAST(7 * (CAST(ceil(day(o_orderdate) / 7) AS INTEGER) - 1) + isodow(o_orderdate) AS VARCHAR) AS "the date when the accident happened",
  CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE CAST(month(o_orderdate) AS VARCHAR) || '-' ||
    CAST(7 * (CAST(ceil(day(o_orderdate) / 7) AS INTEGER) - 1) + isodow(o_orderdate) AS VARCHAR) END
    AS "the date when the insurance claim was filed",
  c_mktsegment AS "the make of the vehicle", o_orderstatus AS "accident area",
  CASE WHEN c_nationkey = 0 THEN 'Unknown' ELSE CAST(c_nationkey AS VARCHAR) END AS age,
  CASE WHEN o_totalprice > 300000 THEN 'more than 7 years' ELSE 'new' END AS "age of vehicle",
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Yes' ELSE 'No' END AS "fraud found"
  FROM o),
k AS (SELECT *, ('0x' || substr(md5(concat_ws('|', '0', "the date when the accident happened",
          "the date when the insurance claim was filed", "the make of the vehicle", "accident area", age,
          "age of vehicle", "fraud found")), 1, 15))::BIGINT AS ord,
          md5(concat_ws('|', "the date when the accident happened", "the date when the insurance claim was filed",
          "the make of the vehicle", "accident area", age, "age of vehicle", "fraud found")) AS rh FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY "fraud found" ORDER BY ord) - 1 AS rn,
             count(*) OVER (PARTITION BY "fraud found") AS cnt FROM k),
s AS (SELECT *, CASE WHEN rn < floor(cnt / 2) THEN 'train' ELSE 'test' END AS part FROM r)
SELECT "the date when the accident happened", "the date when the insurance claim was filed",
       "the make of the vehicle", "accident area", age, "age of vehicle", "fraud found", part
FROM s WHERE part = 'train' OR rh NOT IN (SELECT rh FROM s WHERE part = 'train')""")
def q_claims(spark, sf_dir):
    train, test = P.prepare_claims(_claims(spark, sf_dir), CLAIM_REPLACEMENTS,
                                   ["PolicyNumber", "RepNumber", "Year"], CLAIM_RENAMES)
    return (train.withColumn("part", F.lit("train"))
            .unionByName(test.withColumn("part", F.lit("test"))))


POSTING_DEFAULTS = {"lang": "Unknown", "source": "Not Specified", "text": "NaN"}


@register("b20_prepare_postings", """
WITH p AS (SELECT doc_id, text, nullif(lang, 'de') AS lang, source,
                  coalesce(CAST(toxic AS VARCHAR), 'unlabelled') AS fraudulent
           FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY fraudulent ORDER BY doc_id) - 1 AS rn,
             count(*) OVER (PARTITION BY fraudulent) AS cnt FROM p),
s AS (SELECT *, CASE WHEN rn < floor(cnt / 2) THEN 'train' ELSE 'test' END AS part FROM r)
SELECT CASE WHEN lower(trim(fraudulent)) IN ('yes', 'true', '1') THEN 1
            WHEN lower(trim(fraudulent)) IN ('no', 'false', '0') THEN 0
            ELSE CAST(trunc(TRY_CAST(fraudulent AS DOUBLE)) AS INTEGER) END AS label,
       coalesce(text, 'NaN') AS text, coalesce(lang, 'Unknown') AS lang, coalesce(source, 'Not Specified') AS source,
       row_number() OVER (PARTITION BY part ORDER BY md5(concat_ws('|', '0', CAST(doc_id AS VARCHAR))), doc_id) - 1
         AS position, part
FROM s""")
def q_postings(spark, sf_dir):
    from kestrel.operators import sampling as E
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    posts = d.select("doc_id", "text", F.expr("nullif(lang, 'de')").alias("lang"), "source",
                     F.coalesce(F.col("toxic").cast("string"), F.lit("unlabelled")).alias("fraudulent"))
    split = E.split_half_by_label(posts, "fraudulent", "doc_id")
    tr, te = P.prepare_postings(split.where("split = 'train'").drop("split"),
                                split.where("split = 'test'").drop("split"), POSTING_DEFAULTS,
                                "doc_id", "fraudulent", seed=0)
    return (tr.withColumn("part", F.lit("train")).withColumnRenamed("fraudulent", "label")
            .unionByName(te.withColumn("part", F.lit("test"))))


_C12_CATS = ["o_orderstatus", "c_mktsegment", "n_name", "month", "weekday"]
_C12_OH = " || ".join(
    f"list_transform(list_slice((SELECT cs FROM c_{c}), 2, 1000), lambda v: CASE WHEN {c} = v THEN 1.0 ELSE 0.0 END)"
    for c in _C12_CATS)


@register("c12_feature_matrix", f"""
WITH m AS ({BD.MIXED_SQL}),
st AS (SELECT avg(o_totalprice) m1, stddev_pop(o_totalprice) s1, avg(c_acctbal) m2, stddev_pop(c_acctbal) s2 FROM m),
{", ".join(f"c_{c} AS (SELECT list(DISTINCT {c} ORDER BY {c}) AS cs FROM m)" for c in _C12_CATS)}
SELECT row_id, list_transform(
  [(o_totalprice - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, (c_acctbal - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END]
  || {_C12_OH}, lambda x: round(x, 9)) AS features
FROM m, st""")
def q_feature_matrix(spark, sf_dir):
    m = BD.mixed_table(spark, sf_dir).drop("label")
    out = P.to_feature_matrix(m, "row_id", method="one_hot", normalize=True)
    return out.withColumn("features", F.transform("features", lambda x: F.round(x, 9)))


@register("c12_feature_matrix_text")
def q_feature_matrix_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return P.to_feature_matrix(d, "doc_id", method="ordinal", text_encoding="tfidf",
                               text_cols=["text"])


@register("c12_feature_matrix_vectors")
def q_feature_matrix_vectors(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "role", "text")
    return P.to_feature_matrix(d, "row_id", method="one_hot", text_encoding="word2vec",
                               text_cols=["text"], vector_size=16, min_count=1)
