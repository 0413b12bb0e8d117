"""Roles bound to the driver tables (TPC-H-like Parquet).

Each function reads the given tables and derives the table a role needs; no
rows are invented, so the work of every query grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import table

MIXED_CATEGORICAL = ["o_orderstatus", "c_mktsegment", "n_name", "month", "weekday"]
MIXED_NUMERIC = ["o_totalprice", "c_acctbal"]
MIXED_FEATURES = ["o_orderstatus", "c_mktsegment", "n_name", "o_totalprice", "c_acctbal",
                  "month", "weekday"]


def mixed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed-type table with a label: orders x customer x nation.

    ``row_id = o_orderkey``; ``label = 1`` for ``1-URGENT`` orders.  ``nation``
    has a fixed 25 rows (broadcast is bounded); ``customer`` grows with the data
    and is left to AQE's size check.
    """
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal",
                                                "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("o_orderkey").alias("row_id"), "o_orderstatus", "c_mktsegment",
                    "n_name", "o_totalprice", "c_acctbal",
                    F.date_format("o_orderdate", "MMMM").alias("month"),
                    F.date_format("o_orderdate", "EEEE").alias("weekday"),
                    (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("label")))


MIXED_SQL = """
  SELECT o_orderkey AS row_id, o_orderstatus, c_mktsegment, n_name, o_totalprice, c_acctbal,
         monthname(o_orderdate) AS month, dayname(o_orderdate) AS weekday,
         CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS label
  FROM orders JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey
"""

# The literal factor catalogue used with the mixed table
# (name, description, possible_values, annotation_criteria, column_based).
MIXED_FACTORS = [
    ("customer_profile", "segment, balance and country of the customer", [0, 1, 2],
     "0 low, 1 medium, 2 high standing", ["c_mktsegment", "c_acctbal", "n_name"]),
    ("order_value", "size and state of the order", [0, 1, 2],
     "0 small, 1 medium, 2 large", ["o_totalprice", "o_orderstatus"]),
    ("timing", "when the order was placed and its state", [0, 1],
     "0 regular, 1 unusual", ["month", "weekday", "o_orderstatus"]),
]

FACTORS_SCHEMA = ("name string, description string, possible_values array<int>, "
                  "annotation_criteria string, column_based array<string>")


def mixed_factors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MIXED_FACTORS, FACTORS_SCHEMA)


def lineitem_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discrete factor matrix from lineitem: returnflag code, linestatus code,
    quantity bucket, discount bucket, ship month (``row_id`` = order, line)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1)
        .otherwise(2).alias("returnflag"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("linestatus"),
        F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)).cast("int").alias("qty_bucket"),
        F.floor(F.col("l_discount") * 20).cast("int").alias("disc_bucket"),
        F.month("l_shipdate").alias("ship_month"),
        F.pmod(F.dayofweek("l_shipdate"), F.lit(3)).alias("ship_dow3"))


LINEITEM_FACTORS_SQL = """
  SELECT l_orderkey * 10 + l_linenumber AS row_id,
         CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS returnflag,
         CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS linestatus,
         CAST(least(floor(l_quantity / 10), 4) AS INTEGER) AS qty_bucket,
         CAST(floor(l_discount * 20) AS INTEGER) AS disc_bucket,
         CAST(month(l_shipdate) AS INTEGER) AS ship_month,
         CAST((dayofweek(l_shipdate) + 1) % 3 AS INTEGER) AS ship_dow3
  FROM lineitem
"""

DEPENDENT_COLS = ["qty", "disc", "tax", "offer", "charge", "mode"]


def dependent_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of lineitem that depend on each other: thirds of quantity, discount and tax, an
    offer made from quantity and discount, a charge made from offer and tax (each off by one in
    some rows, chosen by the row's hash), and the line status, which depends on none of them."""
    li = table(spark, sf_dir, "lineitem")
    h = F.xxhash64(*li.columns)
    third = lambda c, low, high: F.when(F.col(c) < low, 0).when(F.col(c) < high, 1).otherwise(2)
    off = lambda k: F.when(F.pmod(F.shiftright(h, k), F.lit(10)) == 0, 1).otherwise(0)
    qty, disc, tax = third("l_quantity", 17, 34), third("l_discount", 0.035, 0.07), third("l_tax", 0.025, 0.055)
    out = li.select(qty.alias("qty"), disc.alias("disc"), tax.alias("tax"), (qty + disc + off(3)).alias("offer"),
                    off(17).alias("__off"), F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("mode"))
    return out.withColumn("charge", F.col("offer") + F.col("tax") + F.col("__off")).select(*DEPENDENT_COLS)


FACTOR_COLS = ["returnflag", "linestatus", "qty_bucket", "disc_bucket", "ship_month",
               "ship_dow3"]


# ------------------------------------------------------------------ graph role
def nation_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations ranked inside their region by total customer balance (desc)."""
    from pyspark.sql.window import Window
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.sum("c_acctbal").alias("bal"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    j = n.join(c, n.n_nationkey == c.c_nationkey, "left").select(
        "n_name", "n_regionkey", F.coalesce("bal", F.lit(0.0)).alias("bal"))
    # 5 nations per region: the window partitions are fixed-size
    w = Window.partitionBy("n_regionkey").orderBy(F.desc("bal"), "n_name")
    return j.withColumn("rk", F.row_number().over(w))


def nation_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint-form graph over nations, derived from customer balances.

    Graph ``dag``: inside each region the nation ranked i points to rank i+1
    (i = 1..3; rank 5 stays unconnected); rank-1 nations of consecutive regions
    are joined by an undirected pair (-1/-1).  Graph ``cyclic``: the same plus a
    back edge rank 4 -> rank 1 in region 0.  The ranking is read once: one row
    per region with its ranked nations, from which every edge is generated."""
    from pyspark.sql.window import Window
    r = nation_ranks(spark, sf_dir)
    per = r.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("rk", "n_name"))), lambda x: x["n_name"]).alias("ns"))
    # 5 regions: a window over the region rows is fixed-size
    per = per.withColumn("next_top", F.lead(F.element_at("ns", 1)).over(
        Window.partitionBy(F.lit(0)).orderBy("n_regionkey")))

    def pair(a, b, v_ab, v_ba, gid):
        return [F.struct(F.lit(gid).alias("graph_id"), a.alias("src"), b.alias("dst"),
                         F.lit(v_ab).alias("value")),
                F.struct(F.lit(gid).alias("graph_id"), b.alias("src"), a.alias("dst"),
                         F.lit(v_ba).alias("value"))]
    items = []
    for gid in ("dag", "cyclic"):
        for i in (1, 2, 3):
            items += pair(F.element_at("ns", i), F.element_at("ns", i + 1), -1.0, 1.0, gid)
        items += pair(F.element_at("ns", 1), F.col("next_top"), -1.0, -1.0, gid)
    back = pair(F.element_at("ns", 4), F.element_at("ns", 1), -1.0, 1.0, "cyclic")
    e = per.select("n_regionkey", F.explode(F.array(*items)).alias("e")).unionByName(
        per.where(F.col("n_regionkey") == 0).select("n_regionkey",
                                                   F.explode(F.array(*back)).alias("e")))
    return (e.select("e.*").where(F.col("src").isNotNull() & F.col("dst").isNotNull()))


def nation_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.explode(F.array(F.lit("dag"), F.lit("cyclic"))).alias("graph_id"),
                    F.col("n_name").alias("node"))


NATION_RANKS_SQL = """
  SELECT n_name, n_regionkey, coalesce(bal, 0.0) AS bal,
         row_number() OVER (PARTITION BY n_regionkey ORDER BY coalesce(bal, 0.0) DESC, n_name) AS rk
  FROM nation LEFT JOIN (SELECT c_nationkey, sum(c_acctbal) AS bal FROM customer GROUP BY 1)
       ON n_nationkey = c_nationkey
"""

NATION_EDGES_SQL = f"""
  WITH r AS ({NATION_RANKS_SQL}),
  chain AS (SELECT x.n_name AS a, y.n_name AS b FROM r x JOIN r y
            ON x.n_regionkey = y.n_regionkey AND y.rk = x.rk + 1 AND x.rk <= 3),
  und AS (SELECT x.n_name AS a, y.n_name AS b FROM r x JOIN r y
          ON y.n_regionkey = x.n_regionkey + 1 AND x.rk = 1 AND y.rk = 1),
  back AS (SELECT x.n_name AS a, y.n_name AS b FROM r x, r y
           WHERE x.n_regionkey = 0 AND x.rk = 4 AND y.n_regionkey = 0 AND y.rk = 1),
  dag AS (SELECT a AS src, b AS dst, CAST(-1.0 AS DOUBLE) AS value FROM chain
          UNION ALL SELECT b, a, CAST(1.0 AS DOUBLE) FROM chain
          UNION ALL SELECT a, b, CAST(-1.0 AS DOUBLE) FROM und UNION ALL SELECT b, a, CAST(-1.0 AS DOUBLE) FROM und)
  SELECT 'dag' AS graph_id, * FROM dag
  UNION ALL SELECT 'cyclic', * FROM dag
  UNION ALL SELECT 'cyclic', a, b, CAST(-1.0 AS DOUBLE) FROM back UNION ALL SELECT 'cyclic', b, a, CAST(1.0 AS DOUBLE) FROM back
"""


def order_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discrete factor matrix keyed by the (unique) order key."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"),
                    F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
                    .otherwise(2).alias("status"),
                    (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("priority"),
                    F.least(F.floor(F.col("o_totalprice") / 100000), F.lit(4)).cast("int").alias("size"),
                    F.month("o_orderdate").alias("month"),
                    F.pmod(F.dayofweek("o_orderdate"), F.lit(3)).alias("dow3"))


ORDER_FACTOR_COLS = ["status", "priority", "size", "month", "dow3"]
