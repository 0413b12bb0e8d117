"""Queries for the annotation pipeline (G1-G7) over the mixed table and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import annotate as G
from kestrel.operators import causal as CA
from kestrel.plans import bindings as BD
from kestrel.plans import q_text as QT
from kestrel.plans.registry import register
from kestrel.session import table

FACTORS = [(n, p) for n, _, p, _, _ in BD.MIXED_FACTORS]
FEATS = BD.MIXED_FEATURES

# Keyword rules of the built-in deterministic annotator for the
# mixed-table factors (first matching pattern wins; no match leaves it missing).
RULES = {
    "customer_profile": [(r"c_mktsegment is (BUILDING|AUTOMOBILE)", 2), (r"c_acctbal is -", 0),
                         (r"c_mktsegment is ", 1)],
    "order_value": [(r"o_orderstatus is F", 2), (r"o_orderstatus is O", 1)],
    "timing": [(r"weekday is (Saturday|Sunday)", 1), (r"month is December", 1)],
}
FAIL_FIRST = r"n_name is NATION_1\b"


def _sample_sql(alias="m"):
    return ("concat_ws(chr(10), " + ", ".join(
        f"'{c} is ' || " + (f"printf('%.2f', {alias}.{c})" if c in BD.MIXED_NUMERIC else f"{alias}.{c}")
        for c in FEATS) + ")")


def _rule_sql(factor, text="t"):
    parts = " ".join(f"WHEN regexp_matches({text}, '{p}') THEN {v}" for p, v in RULES[factor])
    return f"CASE {parts} END"


_G1_SQL = f"""
WITH m AS ({BD.MIXED_SQL}),
s AS (SELECT row_id, {_sample_sql()} AS t FROM m),
a AS (SELECT row_id, {", ".join(f"{_rule_sql(f)} AS {f}" for f, _ in FACTORS)} FROM s)
SELECT row_id, {", ".join(f"CAST(coalesce({f}, 0) AS INTEGER) AS {f}" for f, _ in FACTORS)} FROM a"""


@register("g01_annotate", _G1_SQL)
def q_annotate(spark, sf_dir):
    m = BD.mixed_table(spark, sf_dir)
    ann = G.keyword_annotator(RULES, fail_first=FAIL_FIRST)
    return G.annotate(m, "row_id", FACTORS, ann, FEATS, batch_size=30)


LI_RULES_SQL = """CASE WHEN l_quantity > 40 THEN 2 WHEN l_quantity > 20 THEN 1 ELSE 0 END AS bulk,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned"""


@register("g02_annotate_by_rules", f"""
SELECT l_orderkey, l_linenumber, {LI_RULES_SQL} FROM lineitem""")
def q_rules(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rules = {"bulk": F.when(F.col("l_quantity") > 40, 2).when(F.col("l_quantity") > 20, 1).otherwise(0),
             "returned": F.when(F.col("l_returnflag") == "R", 1).otherwise(0)}
    return G.annotate_by_rules(li, rules, keep=["l_orderkey", "l_linenumber"])


def _size_rule():
    return {"size": F.least(F.floor(F.col("o_totalprice") / 100000), F.lit(4))}


@register("g03_annotate_new", f"""
WITH m AS ({BD.MIXED_SQL}),
s AS (SELECT row_id, {_sample_sql()} AS t, o_totalprice FROM m),
a AS (SELECT row_id, CAST(least(floor(o_totalprice / 100000), 4) AS INTEGER) AS size,
             {_rule_sql("timing")} AS timing FROM s)
SELECT row_id, size, CAST(coalesce(timing, 0) AS INTEGER) AS timing FROM a""")
def q_annotate_new(spark, sf_dir):
    m = BD.mixed_table(spark, sf_dir)
    existing = G.annotate_by_rules(m, _size_rule(), keep=["row_id"])
    ann = G.keyword_annotator({"timing": RULES["timing"]})
    return G.annotate_new(m, existing, [("size", [0, 1, 2, 3, 4]), ("timing", [0, 1])], ann,
                          cols=FEATS)


@register("g04_merge_annotations", """
SELECT o_orderkey AS row_id, o_orderstatus, CAST(least(floor(o_totalprice / 100000), 4) AS INTEGER) AS size,
       -1 AS urgency FROM orders""")
def q_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    df = o.select(F.col("o_orderkey").alias("row_id"), "o_orderstatus",
                  F.lit(99).alias("size"))  # an older annotation to be replaced
    ann = G.annotate_by_rules(o.withColumnRenamed("o_orderkey", "row_id"), _size_rule(), keep=["row_id"])
    return G.merge_annotations(df, ann, [("size", [0, 1, 2, 3, 4]), ("urgency", [-1, 0, 1])])


_KNOWN_SQL = "SELECT p_type AS name FROM part GROUP BY 1 HAVING min(p_size) <= 1"
_REVIEWED_SQL = "SELECT p_type AS name FROM part GROUP BY 1 HAVING max(p_size) >= 50"
_FOCUS_SQL = "SELECT p_type AS name FROM part GROUP BY 1 HAVING avg(p_retailprice) > 1400"


@register("g05_diff_factors", f"""
WITH k AS ({_KNOWN_SQL}), r AS ({_REVIEWED_SQL}), f AS ({_FOCUS_SQL})
SELECT 'new' AS kind, name FROM r WHERE name NOT IN (SELECT name FROM k)
UNION ALL SELECT 'kept', name FROM r WHERE name IN (SELECT name FROM k)
UNION ALL SELECT 'deleted', name FROM k WHERE name NOT IN (SELECT name FROM r)
UNION ALL SELECT 'focus', name FROM f WHERE name IN (SELECT name FROM r)""")
def q_diff(spark, sf_dir):
    """Part types as factors: known are those sold in the smallest size, reviewed those sold in
    the largest, in focus the expensive ones."""
    types = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(
        F.min("p_size").alias("least"), F.max("p_size").alias("most"), F.avg("p_retailprice").alias("price"))
    d = G.diff_factors(types.where("most >= 50").select("name"), types.where("least <= 1").select("name"),
                       types.where("price > 1400").select(F.col("name").alias("factor_name")))
    out = None
    for kind, frame in d.items():
        part = frame.select(F.lit(kind).alias("kind"), "name")
        out = part if out is None else out.unionByName(part)
    return out


@register("g06_run_rounds")
def q_rounds(spark, sf_dir):
    """Three proposal rounds over the order factors; annotation by reading the
    factor columns (rule annotator), confirmation by chi-square, focus validation,
    PC for the graph."""
    return _rounds(spark, BD.order_factors(spark, sf_dir), [
        (1, ["status", "priority", "size"], ["size"]),
        (2, ["status", "priority", "size", "month"], ["size", "month"]),
        (3, ["priority", "size", "month", "dow3"], ["month"])])


@register("g06_run_rounds_dependent")
def q_rounds_dependent(spark, sf_dir):
    """Three rounds over factors of orders that partly depend on each other (price steps, calendar
    parts); the priority is deleted in the first round and proposed again in the third."""
    price, day = F.col("o_totalprice"), F.col("o_orderdate")
    base = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.least(F.floor(price / 100000), F.lit(4)).cast("int").alias("size"),
        F.when(price < 120000, 0).when(price < 260000, 1).otherwise(2).alias("tier"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("priority"),
        F.month(day).alias("month"), F.quarter(day).alias("quarter"), F.pmod(F.dayofweek(day), F.lit(3)).alias("dow3"))
    return _rounds(spark, base, [
        (1, ["size", "tier", "priority"], ["size", "tier"]),
        (2, ["size", "tier", "month", "quarter"], ["size", "month"]),
        (3, ["size", "tier", "month", "quarter", "priority", "dow3"], ["month", "quarter"])])


def _rounds(spark, base, plan):
    names = sorted({n for _, part, _ in plan for n in part})
    doms = base.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in names]).first()
    proposals = spark.createDataFrame(
        [(r, n, list(doms[n]), n in foc) for r, names, foc in plan for n in names],
        "round int, name string, possible_values array<int>, focus boolean")

    def annotate_round(df, new):
        return G.annotate_by_rules(df, {n: F.col(n) for n, _ in new}, keep=["row_id"])

    def confirm(ann, names):
        c = CA.confirm_factors(ann, names, 0.05)
        return {r["factor"] for r in c.where("kept").select("factor").collect()}

    def validate(ann, names):
        if not names:
            return []
        v = CA.validate_focus(ann, names, 3)
        return [r["factor"] for r in v.where("valid").collect()]

    def learn(ann, names):
        edges, _, _ = CA.pc_skeleton(ann, names, 0.05, "chisq")
        return len(edges)
    return G.run_rounds(base, proposals, annotate_round, confirm, validate, learn, max_rounds=5)
