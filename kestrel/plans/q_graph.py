"""Queries for graph, order and weight operators (H1-H18).

The graph is derived from the data (nations chained by customer balance, see
:func:`kestrel.plans.bindings.nation_graph_edges`); factor orders are derived
from the ``region`` rows; factor-edge weights are aggregates of the mixed table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import graph as G
from kestrel.operators import orders as H

from kestrel.plans import bindings as BD
from kestrel.plans.registry import SQL, register, sql_values
from kestrel.session import table

FACTOR_NAMES = [f[0] for f in BD.MIXED_FACTORS]
FAC_SQL = sql_values(BD.MIXED_FACTORS, ["name", "description", "possible_values",
                                        "annotation_criteria", "column_based"])


def _graph(spark, sf_dir):
    edges = BD.nation_graph_edges(spark, sf_dir)
    nodes = BD.nation_graph_nodes(spark, sf_dir)
    return nodes, G.infer_directed(edges)


_DIRECTED_SQL = f"""
  e AS ({BD.NATION_EDGES_SQL}),
  g AS (SELECT graph_id, src, dst, max(value) AS value FROM e GROUP BY ALL),
  d AS (SELECT a.graph_id, a.src, a.dst FROM g a JOIN g b
        ON a.graph_id = b.graph_id AND a.src = b.dst AND a.dst = b.src
        WHERE abs(a.value + 1) <= 1e-9 AND abs(b.value - 1) <= 1e-9 AND a.src <> a.dst)"""


@register("h01_infer_directed", f"WITH {_DIRECTED_SQL} SELECT * FROM d")
def q_infer(spark, sf_dir):
    return G.infer_directed(BD.nation_graph_edges(spark, sf_dir))


@register("h02_find_cycle")
def q_find_cycle(spark, sf_dir):
    nodes, d = _graph(spark, sf_dir)
    return G.find_cycle(nodes, d)


def _involved(spark, sf_dir):
    nodes, d = _graph(spark, sf_dir)
    return G.involved_nodes(d), d


@register("h03_topo_sort")
def q_topo_sort(spark, sf_dir):
    inv, d = _involved(spark, sf_dir)
    return G.topo_sort(inv, d)


@register("h04_topo_levels", f"""
WITH RECURSIVE {_DIRECTED_SQL},
reach(graph_id, a, b) AS (
  SELECT graph_id, src, dst FROM d
  UNION SELECT r.graph_id, r.a, d.dst FROM reach r JOIN d ON d.graph_id = r.graph_id AND d.src = r.b),
cyc AS (SELECT DISTINCT graph_id, a AS v FROM reach WHERE a = b),
blocked AS (SELECT graph_id, v AS node FROM cyc
            UNION SELECT r.graph_id, r.b FROM reach r JOIN cyc c ON c.graph_id = r.graph_id AND c.v = r.a),
n AS (SELECT g.graph_id, n_name AS node FROM (VALUES ('dag'), ('cyclic')) AS g(graph_id), nation),
free AS (SELECT * FROM n EXCEPT SELECT * FROM blocked),
p(graph_id, node, len) AS (
  SELECT graph_id, node, 0 FROM free WHERE NOT EXISTS (
    SELECT 1 FROM d WHERE d.graph_id = free.graph_id AND d.dst = free.node)
  UNION ALL
  SELECT p.graph_id, d.dst, p.len + 1 FROM p JOIN d ON d.graph_id = p.graph_id AND d.src = p.node
  JOIN free f ON f.graph_id = d.graph_id AND f.node = d.dst)
SELECT graph_id, node, CAST(max(len) AS INTEGER) AS level FROM p GROUP BY ALL
UNION ALL SELECT graph_id, node, NULL FROM blocked""")
def q_topo_levels(spark, sf_dir):
    nodes, d = _graph(spark, sf_dir)
    return G.topo_levels(nodes, d)


def sampled_orders(spark, sf_dir, max_orders=200, attempts=10_000, seed=0):
    """Sampled orders of every graph; the cyclic one has none."""
    inv, d = _involved(spark, sf_dir)
    return G.sample_topo_orders(inv, d, max_orders, attempts, seed)


@register("h05_sample_topo_orders")
def q_sample_topo(spark, sf_dir):
    return sampled_orders(spark, sf_dir)


@register("h06_topo_sorts_all")
def q_topo_all(spark, sf_dir):
    inv, d = _involved(spark, sf_dir)
    return G.topo_sorts_all(inv, d, 50)


def _region_orders(spark, sf_dir):
    r = BD.nation_ranks(spark, sf_dir)
    return r.groupBy("n_regionkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(-F.col("bal"), F.col("n_name")))),
                    lambda s: s["n_name"]).alias("by_balance"),
        F.array_sort(F.collect_list("n_name")).alias("by_name"))


@register("h07_footrule", f"""
WITH r AS ({BD.NATION_RANKS_SQL}),
nm AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS rn FROM r)
SELECT n_regionkey, CAST(sum(abs(rk - rn)) AS DOUBLE) AS footrule FROM nm GROUP BY n_regionkey""")
def q_footrule(spark, sf_dir):
    o = _region_orders(spark, sf_dir)
    return G.footrule(o, "by_balance", "by_name").select("n_regionkey", "footrule")


@register("h08_select_diverse")
def q_select_diverse(spark, sf_dir):
    return G.select_diverse(sampled_orders(spark, sf_dir, 200, 2000), 20, seed=0)


def _node_weights(spark, sf_dir):
    """Per graph and node: number of directed edges touching the node."""
    nodes, d = _graph(spark, sf_dir)
    touch = (d.select("graph_id", F.col("src").alias("col"))
             .unionAll(d.select("graph_id", F.col("dst").alias("col")))
             .groupBy("graph_id", "col").agg(F.count(F.lit(1)).alias("n")))
    return (nodes.select("graph_id", F.col("node").alias("col")).join(touch, ["graph_id", "col"], "left")
            .select("graph_id", "col", F.coalesce("n", F.lit(0)).cast("double").alias("weight")))


@register("h09_excluded_nodes", f"""
WITH {_DIRECTED_SQL},
n AS (SELECT g.graph_id, n_name AS node FROM (VALUES ('dag'), ('cyclic')) AS g(graph_id), nation),
w AS (SELECT graph_id, node AS col, (SELECT count(*) FROM d WHERE d.graph_id = n.graph_id
                                     AND (src = node OR dst = node)) AS weight FROM n)
SELECT * FROM n EXCEPT (SELECT graph_id, src FROM d UNION SELECT graph_id, dst FROM d)
UNION SELECT graph_id, col FROM w WHERE weight = 0""")
def q_excluded(spark, sf_dir):
    nodes, d = _graph(spark, sf_dir)
    return G.excluded_nodes(nodes, d, _node_weights(spark, sf_dir))


def _chain_orders(spark, sf_dir):
    """Per region the chained nations (ranks 1-4) as an order; order_id = region."""
    r = BD.nation_ranks(spark, sf_dir).where(F.col("rk") <= 4)
    return r.groupBy(F.col("n_regionkey").alias("order_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rk", "n_name"))),
                    lambda s: s["n_name"]).alias("cols"))


def _rank5(spark, sf_dir):
    return BD.nation_ranks(spark, sf_dir).where(F.col("rk") == 5).select(
        F.col("n_name").alias("node"))


_CHAIN_SQL = f"""
r AS ({BD.NATION_RANKS_SQL}),
o AS (SELECT n_regionkey AS order_id, list(n_name ORDER BY rk) AS cols FROM r WHERE rk <= 4 GROUP BY 1),
x AS (SELECT list(n_name ORDER BY n_name) AS ex FROM r WHERE rk = 5)"""


@register("h10_insert_front", f"""
WITH {_CHAIN_SQL}
SELECT order_id, list_concat(list_filter(ex, lambda n: NOT list_contains(cols, n)), cols) AS cols FROM o, x""")
def q_insert_front(spark, sf_dir):
    return H.insert_nodes(_chain_orders(spark, sf_dir), _rank5(spark, sf_dir), "front")


@register("h10_insert_back", f"""
WITH {_CHAIN_SQL}
SELECT order_id, list_concat(cols, list_filter(ex, lambda n: NOT list_contains(cols, n))) AS cols FROM o, x""")
def q_insert_back(spark, sf_dir):
    return H.insert_nodes(_chain_orders(spark, sf_dir), _rank5(spark, sf_dir), "back")


@register("h10_insert_random")
def q_insert_random(spark, sf_dir):
    return H.insert_nodes(_chain_orders(spark, sf_dir), _rank5(spark, sf_dir), "random", seed=3)


def factor_orders(spark, sf_dir):
    """One factor order per region row: factors sorted by ``md5(r_name|factor)``."""
    names = F.array(*[F.lit(n) for n in FACTOR_NAMES])
    reg = table(spark, sf_dir, "region")
    return reg.select(F.col("r_regionkey").alias("order_id"), F.transform(F.array_sort(
        F.transform(names, lambda n: F.struct(F.md5(F.concat_ws("|", F.col("r_name"), n)).alias("k"),
                                              n.alias("n")))), lambda s: s["n"]).alias("cols"))


_EXPAND_SQL = f"""
fac AS (SELECT * FROM {FAC_SQL}),
fo AS (SELECT r_regionkey AS order_id, f.name,
              row_number() OVER (PARTITION BY r_regionkey ORDER BY md5(concat_ws('|', r_name, f.name)), f.name) - 1 AS pos
       FROM region, fac f),
cs AS (SELECT fo.order_id, fo.pos, c.col,
              md5(concat_ws('|', '0', CAST(fo.order_id AS VARCHAR), CAST(fo.pos AS VARCHAR), c.col)) AS k
       FROM fo JOIN (SELECT name, unnest(column_based) AS col FROM fac) c USING (name)),
rk AS (SELECT *, row_number() OVER (PARTITION BY order_id, col ORDER BY pos, k) AS rn FROM cs),
ex AS (SELECT order_id, list(col ORDER BY pos, k, col) AS cols FROM rk WHERE rn = 1 GROUP BY order_id)"""


def expanded_orders(spark, sf_dir):
    return H.expand_orders(factor_orders(spark, sf_dir), BD.mixed_factors(spark), seed=0)


@register("h11_expand_orders", f"WITH {_EXPAND_SQL} SELECT order_id, cols FROM ex")
def q_expand(spark, sf_dir):
    return expanded_orders(spark, sf_dir)


@register("h12_expand_causal_order")
def q_expand_causal(spark, sf_dir):
    cols = BD.MIXED_FEATURES + ["label"]
    return H.expand_causal_order(factor_orders(spark, sf_dir), BD.mixed_factors(spark), cols,
                                 seed=0)


@register("h13_pick_order", f"""
WITH {_EXPAND_SQL}
SELECT arg_min(order_id, md5(concat_ws('|', '5', CAST(order_id AS VARCHAR)))) AS order_id,
       arg_min(cols, md5(concat_ws('|', '5', CAST(order_id AS VARCHAR)))) AS cols FROM ex""")
def q_pick(spark, sf_dir):
    return H.pick_order(expanded_orders(spark, sf_dir), seed=5)


_MEMBERS_SQL = f"""
fac AS (SELECT * FROM {FAC_SQL}),
cols AS (SELECT DISTINCT col FROM (SELECT unnest(column_based) AS col FROM fac)),
members AS (SELECT col, count(*) AS n
            FROM (SELECT DISTINCT name, trim(unnest(column_based)) AS col FROM fac) GROUP BY col),
wf AS (SELECT c.col, CAST(coalesce(m.n, 0) AS DOUBLE) AS weight FROM cols c LEFT JOIN members m USING (col))"""


#: Factor catalogue read off the data: a market segment is a factor whose columns are the
#: nations with a customer of that segment in debt.
_SEGMENT_FACTORS_SQL = """
fac AS (SELECT c_mktsegment AS name, list(DISTINCT n_name) AS column_based FROM customer
        JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < -900 GROUP BY 1),
members AS (SELECT col, count(*) AS n FROM (SELECT DISTINCT name, unnest(column_based) AS col FROM fac) GROUP BY col),
wf AS (SELECT n_name AS col, CAST(coalesce(m.n, 0) AS DOUBLE) AS weight FROM nation LEFT JOIN members m ON col = n_name)"""


def segment_factors(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal < -900").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("c_mktsegment").alias("name")).agg(F.collect_set("n_name").alias("column_based"))


def segment_weights(spark, sf_dir):
    columns = table(spark, sf_dir, "nation").select(F.col("n_name").alias("col"))
    return H.weights_by_factors(segment_factors(spark, sf_dir), columns)


@register("h14_weights_by_factors", f"WITH {_SEGMENT_FACTORS_SQL} SELECT col, weight FROM wf")
def q_weights_factors(spark, sf_dir):
    return segment_weights(spark, sf_dir)


def factor_edges(spark, sf_dir):
    """Weighted factor edges whose weights are statistics of the mixed table."""
    m = BD.mixed_table(spark, sf_dir)
    st = m.agg(F.round(F.corr("c_acctbal", "o_totalprice"), 6).alias("w1"),
               F.round(F.avg("label"), 6).alias("w2"),
               F.round(-F.stddev_pop("c_acctbal") / 10000, 6).alias("w3"))
    return st.select(F.explode(F.array(
        F.struct(F.lit("customer_profile").alias("src"), F.lit("order_value").alias("dst"),
                 F.col("w1").alias("weight")),
        F.struct(F.lit("order_value").alias("src"), F.lit("timing").alias("dst"),
                 F.col("w2").alias("weight")),
        F.struct(F.lit("timing").alias("src"), F.lit("customer_profile").alias("dst"),
                 F.col("w3").alias("weight")))).alias("e")).select("e.*")


_GRAPHW_SQL = f"""
m AS ({BD.MIXED_SQL}),
st AS (SELECT round(corr(c_acctbal, o_totalprice), 6) AS w1, round(avg(label), 6) AS w2,
              round(-stddev_pop(c_acctbal) / 10000, 6) AS w3 FROM m),
ed AS (SELECT 'customer_profile' AS src, 'order_value' AS dst, w1 AS weight FROM st
       UNION ALL SELECT 'order_value', 'timing', w2 FROM st
       UNION ALL SELECT 'timing', 'customer_profile', w3 FROM st),
fac2 AS (SELECT * FROM {FAC_SQL}),
cf AS (SELECT DISTINCT name AS factor, unnest(column_based) AS col FROM fac2),
ext AS (SELECT cf.col, ed.dst AS other, ed.weight FROM cf JOIN ed ON cf.factor = ed.src
        UNION ALL SELECT cf.col, ed.src, ed.weight FROM cf JOIN ed ON cf.factor = ed.dst),
ext2 AS (SELECT * FROM ext WHERE NOT EXISTS
         (SELECT 1 FROM cf WHERE cf.col = ext.col AND cf.factor = ext.other)),
wg AS (SELECT c.col, coalesce(sum(abs(weight)), 0.0) AS weight
       FROM (SELECT DISTINCT col FROM cf) c LEFT JOIN ext2 USING (col) GROUP BY c.col)"""


@register("h15_weights_by_graph", f"WITH {_GRAPHW_SQL} SELECT col, round(weight, 9) AS weight FROM wg")
def q_weights_graph(spark, sf_dir):
    w = H.weights_by_graph(factor_edges(spark, sf_dir), BD.mixed_factors(spark))
    return w.withColumn("weight", F.round("weight", 9))


@register("h16_blend_weights", f"""
WITH {_MEMBERS_SQL}, {_GRAPHW_SQL},
sets AS (SELECT 'f' AS set_id, col, weight FROM wf UNION ALL SELECT 'g', col, weight FROM wg),
tot AS (SELECT set_id, sum(weight) AS t FROM sets GROUP BY 1),
al AS (SELECT * FROM (VALUES ('f', 0.3), ('g', 0.7)) AS a(set_id, alpha))
SELECT col, round(sum(alpha * weight / t), 9) AS weight
FROM sets JOIN tot USING (set_id) JOIN al USING (set_id) GROUP BY col""")
def q_blend(spark, sf_dir):
    wf = H.weights_by_factors(BD.mixed_factors(spark), H.columns_table(spark, BD.MIXED_FEATURES))
    wg = H.weights_by_graph(factor_edges(spark, sf_dir), BD.mixed_factors(spark))
    sets = (wf.withColumn("set_id", F.lit("f"))
            .unionByName(wg.withColumn("set_id", F.lit("g"))))
    out = H.blend_weights(sets, {"f": 0.3, "g": 0.7})
    return out.withColumn("weight", F.round("weight", 9))


@register("h17_resolve_order", f"WITH {_EXPAND_SQL} SELECT order_id, cols FROM ex")
def q_resolve(spark, sf_dir):
    ex = expanded_orders(spark, sf_dir)
    # tokens as a model would write them: upper case, table prefix dropped
    toks = ex.withColumn("cols", F.transform("cols", lambda c: F.upper(
        F.regexp_replace(c, "^[a-z]_", ""))))
    return H.resolve_order(toks, BD.MIXED_FEATURES)


@register("h18_permutations", f"""
WITH cols AS (SELECT * FROM {sql_values([(c,) for c in BD.MIXED_FEATURES], ["col"])})
SELECT CAST(p.range AS INTEGER) AS order_id,
       list(col ORDER BY md5(concat_ws('|', '11', CAST(p.range AS VARCHAR), col)), col) AS cols
FROM range(5) p, cols GROUP BY p.range""")
def q_permutations(spark, sf_dir):
    # the column list is the schema of the mixed table (read from the data source)
    cols = [c for c in BD.mixed_table(spark, sf_dir).columns if c not in ("row_id", "label")]
    return H.permutations(spark, cols, 5, seed=11)





@register("bench_topo_diverse")
def q_bench_topo_diverse(spark, sf_dir):
    """10,000 randomized Kahn attempts on the nation DAG, then 200 diverse orders."""
    return G.select_diverse(sampled_orders(spark, sf_dir, 1000, 10_000), 200, seed=0)


# H3 oracle: lexicographic Kahn as a recursive CTE (smallest ready node per step;
# a step without a ready node marks a cycle and gives an empty order)
SQL["h03_topo_sort"] = f"""
WITH RECURSIVE {_DIRECTED_SQL},
inv AS (SELECT DISTINCT graph_id, src AS node FROM d UNION SELECT DISTINCT graph_id, dst FROM d),
gs AS (SELECT DISTINCT graph_id FROM inv),
k(graph_id, step, placed) AS (
  SELECT graph_id, 0, []::VARCHAR[] FROM gs
  UNION ALL
  SELECT k.graph_id, k.step + 1, list_append(k.placed, (
      SELECT min(i.node) FROM inv i WHERE i.graph_id = k.graph_id
        AND NOT list_contains(k.placed, i.node)
        AND NOT EXISTS (SELECT 1 FROM d WHERE d.graph_id = k.graph_id AND d.dst = i.node
                        AND NOT list_contains(k.placed, d.src))))
  FROM k WHERE k.step < (SELECT count(*) FROM inv WHERE inv.graph_id = k.graph_id)
    AND len(list_filter(k.placed, lambda x: x IS NULL)) = 0),
fin AS (SELECT graph_id, arg_max(placed, step) AS placed FROM k GROUP BY graph_id)
SELECT graph_id, CASE WHEN len(list_filter(placed, lambda x: x IS NULL)) > 0 OR len(placed) < (SELECT count(*) FROM inv WHERE inv.graph_id = fin.graph_id)
                      THEN []::VARCHAR[] ELSE placed END AS "order" FROM fin"""


# H10 (random) oracle: the hash shuffle and the sequential hash-positioned
# insertion as a recursive CTE
SQL["h10_insert_random"] = f"""
WITH RECURSIVE {_CHAIN_SQL},
it AS (SELECT o.order_id, o.cols, u.x,
              row_number() OVER (PARTITION BY o.order_id
                                 ORDER BY md5(concat_ws('|', '3', 'shuffle', CAST(o.order_id AS VARCHAR), u.x)), u.x) AS i
       FROM o, x, (SELECT unnest(ex) AS x FROM x) u WHERE NOT list_contains(o.cols, u.x)),
ins(order_id, i, acc) AS (
  SELECT order_id, 0, cols FROM o
  UNION ALL
  SELECT ins.order_id, ins.i + 1,
         list_concat(list_slice(ins.acc, 1, p.pos), [p.x], list_slice(ins.acc, p.pos + 1, len(ins.acc)))
  FROM ins JOIN (SELECT it.order_id, it.i, it.x FROM it) it2 ON it2.order_id = ins.order_id AND it2.i = ins.i + 1,
       LATERAL (SELECT it2.x AS x,
                ('0x' || substr(md5(concat_ws('|', '3', CAST(ins.order_id AS VARCHAR), it2.x)), 1, 15))::BIGINT
                  % (len(ins.acc) + 1) AS pos) p)
SELECT CAST(order_id AS INTEGER) AS order_id, arg_max(acc, i) AS cols FROM ins GROUP BY order_id"""

_ALL_COLS = BD.MIXED_FEATURES + ["label"]
# H12 oracle: factor expansion, then the missing table columns inserted in table
# order at hash positions
SQL["h12_expand_causal_order"] = f"""
WITH RECURSIVE {_EXPAND_SQL},
ac AS (SELECT * FROM (VALUES {", ".join(f"({i + 1}, '{c}')" for i, c in enumerate(_ALL_COLS))}) AS t(ci, c)),
it AS (SELECT ex.order_id, ac.c AS x, row_number() OVER (PARTITION BY ex.order_id ORDER BY ac.ci) AS i
       FROM ex, ac WHERE NOT list_contains(ex.cols, ac.c)),
ins(order_id, i, acc) AS (
  SELECT order_id, 0, cols FROM ex
  UNION ALL
  SELECT ins.order_id, ins.i + 1,
         list_concat(list_slice(ins.acc, 1, p.pos), [p.x], list_slice(ins.acc, p.pos + 1, len(ins.acc)))
  FROM ins JOIN it ON it.order_id = ins.order_id AND it.i = ins.i + 1,
       LATERAL (SELECT it.x AS x,
                ('0x' || substr(md5(concat_ws('|', '0', CAST(ins.order_id AS VARCHAR), it.x)), 1, 15))::BIGINT
                  % (len(ins.acc) + 1) AS pos) p)
SELECT CAST(order_id AS INTEGER) AS order_id, arg_max(acc, i) AS cols FROM ins GROUP BY order_id"""

# H2 oracle: transitive closure; the core is every node reachable from a cycle
# and reaching a cycle; the path walks smallest core successors until a repeat
SQL["h02_find_cycle"] = f"""
WITH RECURSIVE {_DIRECTED_SQL},
dd AS (SELECT DISTINCT graph_id, src, dst FROM d),
reach(graph_id, a, b) AS (
  SELECT graph_id, src, dst FROM dd
  UNION SELECT r.graph_id, r.a, dd.dst FROM reach r JOIN dd ON dd.graph_id = r.graph_id AND dd.src = r.b),
cyc AS (SELECT DISTINCT graph_id, a AS v FROM reach WHERE a = b),
gn AS (SELECT g.graph_id, n.n_name AS node FROM (VALUES ('dag'), ('cyclic')) AS g(graph_id), nation n),
core AS (SELECT gn.graph_id, gn.node FROM gn
  WHERE EXISTS (SELECT 1 FROM cyc c WHERE c.graph_id = gn.graph_id AND (c.v = gn.node OR EXISTS (
                  SELECT 1 FROM reach r WHERE r.graph_id = gn.graph_id AND r.a = c.v AND r.b = gn.node)))
    AND EXISTS (SELECT 1 FROM cyc c WHERE c.graph_id = gn.graph_id AND (c.v = gn.node OR EXISTS (
                  SELECT 1 FROM reach r WHERE r.graph_id = gn.graph_id AND r.a = gn.node AND r.b = c.v)))),
succ AS (SELECT a.graph_id, a.node AS src, min(dd.dst) AS nx FROM core a
         JOIN dd ON dd.graph_id = a.graph_id AND dd.src = a.node
         JOIN core b ON b.graph_id = dd.graph_id AND b.node = dd.dst GROUP BY ALL),
walk(graph_id, step, path) AS (
  SELECT graph_id, 0, [min(node)] FROM core GROUP BY graph_id
  UNION ALL
  SELECT w.graph_id, w.step + 1, list_append(w.path, s.nx) FROM walk w
  JOIN succ s ON s.graph_id = w.graph_id AND s.src = w.path[len(w.path)]
  WHERE NOT list_contains(list_slice(w.path, 1, len(w.path) - 1), w.path[len(w.path)])),
fin AS (SELECT graph_id, arg_max(path, step) AS path FROM walk GROUP BY graph_id),
cl AS (SELECT graph_id, list(node ORDER BY node) AS core FROM core GROUP BY graph_id)
SELECT g.graph_id, cl.core IS NOT NULL AS has_cycle, coalesce(cl.core, []::VARCHAR[]) AS core,
       CASE WHEN fin.path IS NULL THEN []::VARCHAR[]
            ELSE list_slice(fin.path, list_position(fin.path, fin.path[len(fin.path)]), len(fin.path)) END AS cycle
FROM (VALUES ('dag'), ('cyclic')) AS g(graph_id) LEFT JOIN cl USING (graph_id) LEFT JOIN fin USING (graph_id)"""

# H6 oracle: level-wise prefix expansion keeping the 50 smallest prefixes per
# step (a window inside the recursive term), complete orders numbered in order
SQL["h06_topo_sorts_all"] = f"""
WITH RECURSIVE {_DIRECTED_SQL},
inv AS (SELECT DISTINCT graph_id, src AS node FROM d UNION SELECT DISTINCT graph_id, dst FROM d),
n AS (SELECT graph_id, count(*) AS nn FROM inv GROUP BY graph_id),
pre(graph_id, step, cols) AS (
  SELECT graph_id, 0, []::VARCHAR[] FROM n
  UNION ALL
  SELECT graph_id, step, cols FROM (
    SELECT p.graph_id, p.step + 1 AS step, list_append(p.cols, i.node) AS cols,
           row_number() OVER (PARTITION BY p.graph_id ORDER BY list_append(p.cols, i.node)) AS rn
    FROM pre p JOIN inv i ON i.graph_id = p.graph_id
    WHERE NOT list_contains(p.cols, i.node)
      AND NOT EXISTS (SELECT 1 FROM d WHERE d.graph_id = p.graph_id AND d.dst = i.node
                      AND NOT list_contains(p.cols, d.src))) WHERE rn <= 50)
SELECT pre.graph_id, CAST(row_number() OVER (PARTITION BY pre.graph_id ORDER BY cols) - 1 AS INTEGER) AS order_id, cols
FROM pre JOIN n ON n.graph_id = pre.graph_id WHERE len(cols) = n.nn"""
