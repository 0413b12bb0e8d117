"""Queries for statistics and structure-learning operators (F1-F16).

Factors are the discrete columns derived from ``lineitem`` (see
:func:`kestrel.plans.bindings.lineitem_factors`); graph post-processing uses the
data-derived nation graph.
"""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from kestrel.operators import causal as CA
from kestrel.operators import graph as G
from kestrel.plans import bindings as BD
from kestrel.plans import q_graph as QG
from kestrel.plans.registry import register, sql_values
from kestrel.session import table

FC = BD.FACTOR_COLS
ALPHA = 0.05
PAIRS = list(itertools.combinations(FC, 2))


def erfc_sql(z2: str) -> str:
    """erfc(sqrt(z2)) in DuckDB: power series below 4, continued fraction from there on."""
    series = (f"1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), "
              f"lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * exp((n + 0.5) * ln({z2}) - lgamma(n + 1)) / (2 * n + 1)))")
    fraction = (f"exp(-({z2})) / sqrt(pi() * ({z2})) / list_reduce(list_transform(range(0, 101), "
                f"lambda n: CASE WHEN n = 0 THEN 1.0 ELSE (101.0 - n) END), lambda f, n: 1 + n / (2 * ({z2})) / f)")
    return f"(CASE WHEN ({z2}) <= 0 THEN 1.0 WHEN ({z2}) < 4 THEN {series} ELSE {fraction} END)"


def chi2_tail_sql(stat: str, dof: str) -> str:
    """Chi-square tail for whole dof in DuckDB, from the Poisson sum (even dof) or erfc plus a
    half-integer sum (odd dof), every term in logs; 1 without degrees of freedom."""
    h = f"(greatest({stat}, 0.0) / 2.0)"
    even = (f"list_sum(list_transform(range(0, CAST({dof} // 2 AS BIGINT)), "
            f"lambda i: exp(-{h} + i * ln({h}) - lgamma(i + 1))))")
    odd = (f"{erfc_sql(h)} + coalesce(list_sum(list_transform(range(1, CAST(({dof} + 1) // 2 AS BIGINT)), "
           f"lambda i: exp(-{h} + (i - 0.5) * ln({h}) - lgamma(i + 0.5)))), 0.0)")
    return (f"(CASE WHEN {dof} <= 0 OR {h} <= 0 THEN 1.0 WHEN {dof} % 2 = 0 THEN {even} ELSE {odd} END)")


@register("f01_validate_focus", f"""
WITH f AS ({BD.LINEITEM_FACTORS_SQL}),
c AS (SELECT * FROM (VALUES (0, 'returnflag'), (1, 'linestatus'), (2, 'qty_bucket'), (3, 'missing_factor'))
      AS t(pos, factor)),
n AS (SELECT 'returnflag' AS factor, count(DISTINCT returnflag) AS n_unique FROM f
      UNION ALL SELECT 'linestatus', count(DISTINCT linestatus) FROM f
      UNION ALL SELECT 'qty_bucket', count(DISTINCT qty_bucket) FROM f)
SELECT CAST(pos AS INTEGER) AS pos, factor, n_unique,
       n_unique IS NOT NULL AND n_unique >= 3 AS valid,
       CASE WHEN n_unique IS NULL THEN 'no column ' || factor
            WHEN n_unique < 3 THEN CAST(n_unique AS VARCHAR) || ' of 3 required values in ' || factor
       END AS reason
FROM c LEFT JOIN n USING (factor)""")
def q_validate_focus(spark, sf_dir):
    f = BD.lineitem_factors(spark, sf_dir)
    return CA.validate_focus(f, ["returnflag", "linestatus", "qty_bucket", "missing_factor"], 3)


CONT_TESTS = [("returnflag", "linestatus", []), ("qty_bucket", "disc_bucket", ["linestatus"])]


@register("f02_contingency", f"""
WITH f AS ({BD.LINEITEM_FACTORS_SQL})
SELECT 0 AS test_id, '' AS s_key, CAST(returnflag AS VARCHAR) AS x, CAST(linestatus AS VARCHAR) AS y,
       count(*) AS n FROM f GROUP BY ALL
UNION ALL
SELECT 1, CAST(linestatus AS VARCHAR), CAST(qty_bucket AS VARCHAR), CAST(disc_bucket AS VARCHAR),
       count(*) FROM f GROUP BY ALL""")
def q_contingency(spark, sf_dir):
    c = CA.contingency(BD.lineitem_factors(spark, sf_dir), CONT_TESTS)
    return c.withColumn("s_key", F.array_join("s_key", "|"))


def _stat_sql(tests, method: str) -> str:
    parts = []
    for tid, (x, y, s) in enumerate(tests):
        sk = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in s) if s else "''"
        parts.append(f"SELECT {tid} AS test_id, '{x}' AS x_col, '{y}' AS y_col, {sk} AS s_key, "
                     f"CAST({x} AS VARCHAR) AS x, CAST({y} AS VARCHAR) AS y FROM f")
    cell = "n * n / e" if method == "chisq" else "2.0 * n * ln(n / e)"
    stat = "s - n_s" if method == "chisq" else "s"
    return f"""
WITH f AS ({BD.LINEITEM_FACTORS_SQL}),
t AS ({" UNION ALL ".join(parts)}),
c AS (SELECT test_id, x_col, y_col, s_key, x, y, count(*) AS n FROM t GROUP BY ALL),
j AS (SELECT *, sum(n) OVER (PARTITION BY test_id, s_key) AS n_s,
             sum(n) OVER (PARTITION BY test_id, s_key, x) AS n_x,
             sum(n) OVER (PARTITION BY test_id, s_key, y) AS n_y FROM c),
ps AS (SELECT test_id, x_col, y_col, s_key, sum({cell}) AS s,
              max(n_s) AS n_s, count(DISTINCT x) AS r, count(DISTINCT y) AS cc
       FROM (SELECT *, n_x * n_y / n_s AS e FROM j) GROUP BY ALL),
st AS (SELECT test_id, x_col, y_col, sum({stat}) AS stat, sum((r - 1) * (cc - 1)) AS dof
       FROM ps GROUP BY ALL),
pv AS (SELECT *, {chi2_tail_sql("stat", "dof")} AS p FROM st)"""


@register("f03_chisq_pairs", _stat_sql([(a, b, []) for a, b in PAIRS], "chisq") + """
SELECT CAST(test_id AS INTEGER) AS test_id, x_col, y_col, round(stat, 6) AS stat,
       CAST(dof AS BIGINT) AS dof, round(p, 9) AS p, p < 0.05 AS dependent FROM pv""")
def q_chisq_pairs(spark, sf_dir):
    t = CA.pairwise_tests(BD.lineitem_factors(spark, sf_dir), FC, "chisq")
    return t.select("test_id", "x_col", "y_col", F.round("stat", 6).alias("stat"), "dof",
                    F.round("p", 9).alias("p"), (F.col("p") < ALPHA).alias("dependent"))


GSQ_TESTS = [("qty_bucket", "disc_bucket", ["ship_dow3"]), ("returnflag", "ship_month", ["linestatus"]),
             ("linestatus", "ship_dow3", ["returnflag", "qty_bucket"])]


@register("f03_gsq_conditional", _stat_sql(GSQ_TESTS, "gsq") + """
SELECT CAST(test_id AS INTEGER) AS test_id, x_col, y_col, round(stat, 6) AS stat,
       CAST(dof AS BIGINT) AS dof, round(p, 9) AS p, p < 0.05 AS dependent FROM pv""")
def q_gsq(spark, sf_dir):
    t = CA.ci_tests(BD.lineitem_factors(spark, sf_dir), GSQ_TESTS, "gsq")
    return t.select("test_id", "x_col", "y_col", F.round("stat", 6).alias("stat"), "dof",
                    F.round("p", 9).alias("p"), (F.col("p") < ALPHA).alias("dependent"))


@register("f05_confirm_factors", _stat_sql([(a, b, []) for a, b in PAIRS], "chisq") + """,
dep AS (SELECT x_col, y_col, p < 0.05 AS d FROM pv),
bth AS (SELECT x_col AS factor, d FROM dep UNION ALL SELECT y_col, d FROM dep)
SELECT factor, bool_or(d) AS kept, CAST(sum(CAST(d AS INTEGER)) AS INTEGER) AS n_related,
       factor IN ('qty_bucket', 'returnflag') AS in_focus
FROM bth GROUP BY factor""")
def q_confirm(spark, sf_dir):
    c = CA.confirm_factors(BD.lineitem_factors(spark, sf_dir), FC, ALPHA, "chisq",
                           focus=["qty_bucket", "returnflag"])
    return c.select("factor", "kept", "n_related", "in_focus")


@register("f06_top_related", _stat_sql([(a, b, []) for a, b in PAIRS], "chisq") + """,
bth AS (SELECT x_col AS factor, y_col AS other, p FROM pv UNION ALL SELECT y_col, x_col, p FROM pv)
SELECT factor, other, round(p, 9) AS p, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY p, other) AS rank FROM bth) WHERE rank <= 3""")
def q_top_related(spark, sf_dir):
    t = CA.pairwise_tests(BD.lineitem_factors(spark, sf_dir), FC, "chisq")
    return CA.top_related(t, 3).withColumn("p", F.round("p", 9))


@register("f07_cluster_entropy", f"""
WITH f AS ({BD.LINEITEM_FACTORS_SQL}),
t AS (SELECT returnflag, 'qty_bucket' AS fn, CAST(qty_bucket AS VARCHAR) AS v FROM f
      UNION ALL SELECT returnflag, 'disc_bucket', CAST(disc_bucket AS VARCHAR) FROM f),
c AS (SELECT returnflag, fn, v, count(*) AS n FROM t GROUP BY ALL),
h AS (SELECT returnflag, fn, CASE WHEN count(*) > 1 THEN -sum(n / tot * ln(n / tot)) ELSE 0.0 END AS h
      FROM (SELECT *, sum(n) OVER (PARTITION BY returnflag, fn) AS tot FROM c) GROUP BY ALL)
SELECT returnflag, round(avg(h), 9) AS entropy FROM h GROUP BY returnflag""")
def q_cluster_entropy(spark, sf_dir):
    e = CA.cluster_entropy(BD.lineitem_factors(spark, sf_dir), "returnflag",
                           ["qty_bucket", "disc_bucket"])
    return e.withColumn("entropy", F.round("entropy", 9))


@register("f08_cluster_rows")
def q_cluster_rows(spark, sf_dir):
    f = BD.lineitem_factors(spark, sf_dir)
    return CA.cluster_rows(f, FC, k=5, seed=42).select("row_id", "cluster")


@register("f09_cluster_entropy_sample")
def q_cluster_sample(spark, sf_dir):
    f = BD.lineitem_factors(spark, sf_dir)
    return CA.cluster_entropy_sample(f, FC, ["qty_bucket", "disc_bucket"], 8, seed=42)


@register("f10_pc_skeleton")
def q_pc_skeleton(spark, sf_dir):
    f = BD.lineitem_factors(spark, sf_dir)
    edges, seps, _ = CA.pc_skeleton(f, FC, ALPHA, "chisq")
    rows = [(min(e), max(e), sorted(seps.get(e, []))) for e in edges]
    return spark.createDataFrame(rows or [], "a string, b string, sepset array<string>")


@register("f11_pc_orient")
def q_pc(spark, sf_dir):
    f = BD.lineitem_factors(spark, sf_dir)
    return CA.pc(f, FC, ALPHA, "chisq")


@register("f10_pc_dependent")
def q_pc_skeleton_dependent(spark, sf_dir):
    """PC skeleton, with separating sets of the removed pairs, over factors that depend on each other."""
    cols = BD.DEPENDENT_COLS
    edges, seps, _ = CA.pc_skeleton(BD.dependent_factors(spark, sf_dir), cols, 0.001, "gsq")
    rows = [(a, b, frozenset((a, b)) in edges, sorted(seps.get(frozenset((a, b)), [])))
            for a, b in itertools.combinations(cols, 2)]
    return spark.createDataFrame(rows, "a string, b string, adjacent boolean, sepset array<string>")


@register("f11_pc_dependent")
def q_pc_dependent(spark, sf_dir):
    """Oriented graph over factors that depend on each other."""
    return CA.pc(BD.dependent_factors(spark, sf_dir), BD.DEPENDENT_COLS, 0.001, "gsq")


@register("f12_bic_gaussian", """
WITH c AS (SELECT count(*) AS n, var_pop(l_extendedprice) AS vp, var_pop(l_quantity) AS vq,
                  covar_pop(l_extendedprice, l_quantity) AS cpq FROM lineitem)
SELECT 0 AS cand_id, round(-n / 2.0 * ln(vp) - ln(n) / 2.0, 3) AS bic FROM c UNION ALL
SELECT 1, round(-n / 2.0 * ln(vp - cpq * cpq / vq) - ln(n), 3) FROM c""")
def q_bic_gaussian(spark, sf_dir):
    b = CA.bic_gaussian_scores(table(spark, sf_dir, "lineitem"),
                               [("l_extendedprice", []), ("l_extendedprice", ["l_quantity"])])
    return b.select("cand_id", F.round("bic", 3).alias("bic"))


@register("f10_pc_fisherz")
def q_pc_fisherz(spark, sf_dir):
    """PC skeleton over the numeric lineitem columns by partial correlations (one pass)."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    edges, seps, _ = CA.pc_skeleton(table(spark, sf_dir, "lineitem"), cols, ALPHA, "fisherz")
    return spark.createDataFrame([(min(e), max(e)) for e in edges], "a string, b string")


@register("f10_pc_fisherz_prices")
def q_pc_fisherz_prices(spark, sf_dir):
    """PC skeleton by partial correlations over prices that are made from each other."""
    li = table(spark, sf_dir, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    df = li.select("l_extendedprice", "l_discount", "l_tax", net.alias("net"),
                   (net * (1 + F.col("l_tax"))).alias("gross"))
    edges, seps, _ = CA.pc_skeleton(df, df.columns, 0.001, "fisherz")
    return spark.createDataFrame([(min(e), max(e)) for e in edges], "a string, b string")


BIC_CANDS = [("returnflag", []), ("returnflag", ["linestatus"]),
             ("qty_bucket", ["disc_bucket", "ship_dow3"])]


@register("f12_bic_local_scores", f"""
WITH f AS ({BD.LINEITEM_FACTORS_SQL}),
t AS (SELECT 0 AS cand_id, '' AS pk, CAST(returnflag AS VARCHAR) AS v FROM f
      UNION ALL SELECT 1, CAST(linestatus AS VARCHAR), CAST(returnflag AS VARCHAR) FROM f
      UNION ALL SELECT 2, CAST(disc_bucket AS VARCHAR) || '|' || CAST(ship_dow3 AS VARCHAR),
                       CAST(qty_bucket AS VARCHAR) FROM f),
c AS (SELECT cand_id, pk, v, count(*) AS n FROM t GROUP BY ALL),
j AS (SELECT *, sum(n) OVER (PARTITION BY cand_id, pk) AS n_pk FROM c),
l AS (SELECT cand_id, sum(n * ln(n / n_pk)) AS ll, count(DISTINCT v) AS r, count(DISTINCT pk) AS q,
             sum(n) AS nn FROM j GROUP BY cand_id)
SELECT CAST(cand_id AS INTEGER) AS cand_id, round(ll, 6) AS ll,
       round(ll - ln(nn) / 2.0 * (r - 1) * q, 6) AS bic FROM l""")
def q_bic(spark, sf_dir):
    b = CA.bic_local_scores(BD.lineitem_factors(spark, sf_dir), BIC_CANDS)
    return b.select("cand_id", F.round("ll", 6).alias("ll"), F.round("bic", 6).alias("bic"))


_Z_SQL = "0.5 * ln((1 + r) / (1 - r)) * sqrt(n - {} - 3)"


@register("f04_fisherz", f"""
WITH c AS (SELECT count(*) AS n, corr(l_extendedprice, l_quantity) AS pq, corr(l_extendedprice, l_discount) AS pd,
                  corr(l_quantity, l_discount) AS qd FROM lineitem),
t AS (SELECT 'order0' AS test, n, pq AS r FROM c UNION ALL
      SELECT 'order1', n, (pd - pq * qd) / sqrt((1 - pq * pq) * (1 - qd * qd)) FROM c),
z AS (SELECT test, r, CASE WHEN test = 'order0' THEN {_Z_SQL.format(0)} ELSE {_Z_SQL.format(1)} END AS z FROM t)
SELECT test, round(r, 9) AS r, round(z, 6) AS z, round({erfc_sql("(z * z / 2)")}, 9) AS p FROM z""")
def q_fisherz(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    r0 = CA.fisherz_test(li, "l_extendedprice", "l_quantity")
    r1 = CA.fisherz_test(li, "l_extendedprice", "l_discount", ["l_quantity"])
    return spark.createDataFrame([("order0", r0["r"], r0["z"], r0["p"]),
                                  ("order1", r1["r"], r1["z"], r1["p"])],
                                 "test string, r double, z double, p double").select(
        "test", F.round("r", 9).alias("r"), F.round("z", 6).alias("z"), F.round("p", 9).alias("p"))


_NATION_EDGES = f"SELECT * FROM ({BD.NATION_EDGES_SQL})"


@register("f13_normalize_edges", f"""
WITH g AS ({_NATION_EDGES}),
j AS (SELECT a.graph_id, a.src, a.dst, a.value, b.value AS rv FROM g a LEFT JOIN g b
      ON a.graph_id = b.graph_id AND a.src = b.dst AND a.dst = b.src)
SELECT graph_id, src AS "from", dst AS "to",
       CASE WHEN value = -1 AND rv = 1 THEN 'directed' WHEN value = -1 AND rv = -1 THEN 'undirected'
            ELSE 'undetermined' END AS type
FROM j WHERE (value = -1 AND rv = 1) OR (src < dst AND NOT (value = 1 AND rv = -1))""")
def q_normalize_edges(spark, sf_dir):
    return CA.normalize_edges(BD.nation_graph_edges(spark, sf_dir))


def _focus(spark, sf_dir):
    # focus nodes: the rank-1 nation of every region (derived from the data)
    return [r.n_name for r in BD.nation_ranks(spark, sf_dir).where("rk = 1").select("n_name").collect()]


@register("f14_neighbours", f"""
WITH g AS ({_NATION_EDGES}), r AS ({BD.NATION_RANKS_SQL})
SELECT graph_id, src AS node, list(DISTINCT dst ORDER BY dst) AS neighbours
FROM g WHERE src IN (SELECT n_name FROM r WHERE rk = 1) GROUP BY ALL""")
def q_neighbours(spark, sf_dir):
    return CA.neighbours(BD.nation_graph_edges(spark, sf_dir), _focus(spark, sf_dir))


@register("f14_markov_blanket", f"""
WITH {QG._DIRECTED_SQL},
r AS ({BD.NATION_RANKS_SQL}),
f AS (SELECT n_name AS node FROM r WHERE rk = 1),
m AS (SELECT d.graph_id, d.dst AS node, d.src AS m FROM d JOIN f ON d.dst = f.node
      UNION SELECT d.graph_id, d.src, d.dst FROM d JOIN f ON d.src = f.node
      UNION SELECT c.graph_id, c.src, p.src FROM d c JOIN f ON c.src = f.node
            JOIN d p ON p.graph_id = c.graph_id AND p.dst = c.dst AND p.src <> c.src)
SELECT graph_id, node, list(DISTINCT m ORDER BY m) AS blanket FROM m GROUP BY ALL""")
def q_blanket(spark, sf_dir):
    nodes, d = BD.nation_graph_nodes(spark, sf_dir), G.infer_directed(BD.nation_graph_edges(spark, sf_dir))
    return CA.markov_blanket(d, _focus(spark, sf_dir))


@register("f15_graph_summary", f"""
WITH g AS ({_NATION_EDGES}),
n AS (SELECT graph_id, count(DISTINCT x) AS n_nodes FROM (SELECT graph_id, src AS x FROM g UNION ALL SELECT graph_id, dst FROM g) GROUP BY 1),
e AS (SELECT graph_id, count(*) AS n_edges FROM (SELECT DISTINCT graph_id, least(src, dst), greatest(src, dst) FROM g) GROUP BY 1)
SELECT graph_id, n_nodes, n_edges FROM n JOIN e USING (graph_id)""")
def q_graph_summary(spark, sf_dir):
    return CA.graph_summary(BD.nation_graph_edges(spark, sf_dir))


@register("f16_group_stats", """
SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 9) AS mean, round(stddev_pop(l_quantity), 9) AS std,
       min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY 1""")
def q_group_stats(spark, sf_dir):
    s = CA.group_stats(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    return s.withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 9))
