"""H1-H9 — causal-graph tables to topological orders.

Graph tables carry a ``graph_id`` so that many graphs are processed at once:

* ``edges(graph_id, src, dst, value)`` — endpoint form, one row per ordered pair
  (``-1`` tail, ``1`` arrow); an optional ``edge_pos`` orders duplicates;
* ``directed(graph_id, src, dst)`` — inferred directed edges;
* ``nodes(graph_id, node)``.

Kahn's algorithm on one graph is a per-graph Catalyst ``aggregate`` over its node
array (factor graphs are small: the node array of one graph lives in one row),
parallel over graphs and over random attempts.  Very large graphs use the
iterative peeling of :func:`topo_levels` instead, which is a DataFrame loop.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.session import cut_lineage, ensure_checkpoint_dir

EPS = 1e-9


def infer_directed(edges: DataFrame) -> DataFrame:
    """H1 — ``A -> B`` when value(A,B) = -1 and value(B,A) = 1 (within 1e-9); the
    last duplicate of an ordered pair (by ``edge_pos``) wins."""
    e = edges
    if "graph_id" not in e.columns:
        e = e.withColumn("graph_id", F.lit("g"))
    if "edge_pos" in e.columns:
        e = e.groupBy("graph_id", "src", "dst").agg(
            F.max_by(F.col("value").cast("double"), F.col("edge_pos")).alias("value"))
    else:
        e = e.groupBy("graph_id", "src", "dst").agg(
            F.max(F.col("value").cast("double")).alias("value"))
    rev = e.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("src"),
                   F.col("value").alias("rvalue"))
    j = e.join(rev, ["graph_id", "src", "dst"])
    return (j.where((F.abs(F.col("value") + 1.0) <= EPS) & (F.abs(F.col("rvalue") - 1.0) <= EPS)
                    & (F.col("src") != F.col("dst")))
            .select("graph_id", "src", "dst"))


def involved_nodes(directed: DataFrame) -> DataFrame:
    """Nodes that take part in at least one directed edge."""
    return (directed.select("graph_id", F.col("src").alias("node"))
            .unionByName(directed.select("graph_id", F.col("dst").alias("node"))).distinct())


def graph_rows(nodes: DataFrame, directed: DataFrame) -> DataFrame:
    """One row per graph: sorted node array and a map node -> predecessors."""
    n = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    preds = (directed.distinct().groupBy("graph_id", "dst").agg(
        F.array_sort(F.collect_set("src")).alias("ps"))
        .groupBy("graph_id").agg(F.map_from_entries(F.collect_list(
            F.struct("dst", "ps"))).alias("preds")))
    return (n.join(preds, "graph_id", "left")
            .withColumn("preds", F.coalesce(
                F.col("preds"), F.create_map().cast("map<string,array<string>>"))))


def _ready(acc: Column, preds: Column):
    """Predicate: node not placed yet and all its predecessors placed."""
    def f(x):
        ps = F.coalesce(F.element_at(preds, x), F.array().cast("array<string>"))
        return (~F.array_contains(acc, x)) & F.forall(ps, lambda p: F.array_contains(acc, p))
    return f


def _kahn(nodes: Column, preds: Column, key=None) -> Column:
    """Kahn order as one expression; ``key(acc, x)`` ranks available nodes (the
    smallest is placed next; default: the node name).  Returns an empty array when
    the graph has a cycle (a step finds no available node)."""
    def step(acc, _):
        cand = F.filter(nodes, _ready(acc, preds))
        if key is None:
            nxt = F.array_min(cand)
        else:
            nxt = F.array_min(F.transform(cand, lambda x: F.struct(key(acc, x).alias("k"),
                                                                   x.alias("n"))))["n"]
        return F.concat(acc, F.array(nxt))
    order = F.aggregate(F.sequence(F.lit(1), F.size(nodes)), F.array().cast("array<string>"),
                        step)
    return F.when(F.size(nodes) == 0, F.array().cast("array<string>")).when(
        F.exists(order, lambda x: x.isNull()), F.array().cast("array<string>")).otherwise(order)


def topo_sort(nodes: DataFrame, directed: DataFrame) -> DataFrame:
    """H3 — deterministic topological order per graph (smallest available node
    first); an empty array when the graph has a cycle."""
    g = graph_rows(nodes, directed)
    return g.select("graph_id", _kahn(F.col("nodes"), F.col("preds")).alias("order"))


def sample_topo_orders(nodes: DataFrame, directed: DataFrame, max_orders: int,
                       attempts: int, seed=0) -> DataFrame:
    """H5 — randomized Kahn runs: attempt ``a`` places, at every step, the
    available node with the smallest ``md5(seed|a|step|node)``.  Invalid runs
    (cycles) are dropped; of the distinct orders the first ``max_orders`` by
    attempt index are kept (as a sequential sampler would find them) and returned
    sorted.  Attempts run in parallel (a distributed ``range``)."""
    # one row per graph, read by every attempt: materialize it once
    g = cut_lineage(graph_rows(nodes, directed))
    spark = nodes.sparkSession
    att = spark.range(attempts).select(F.col("id").alias("attempt"))
    key = (lambda acc, x: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("attempt").cast("string"),
                                            F.size(acc).cast("string"), x)))
    # one row per graph (metadata-sized) joined to every attempt
    runs = att.crossJoin(F.broadcast(g)).select(
        "graph_id", "attempt", _kahn(F.col("nodes"), F.col("preds"), key).alias("cols"))
    valid = runs.where(F.size("cols") > 0)
    firsts = valid.groupBy("graph_id", "cols").agg(F.min("attempt").alias("first_attempt"))
    from pyspark.sql.window import Window
    # one row per distinct order: a graph holds at most `attempts` of them (the
    # operator's own parameter), so ranking inside the graph partition is bounded
    w = Window.partitionBy("graph_id").orderBy("first_attempt")
    kept = firsts.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max_orders)
    # at most max_orders rows per graph remain
    w2 = Window.partitionBy("graph_id").orderBy("cols")
    return kept.select("graph_id", (F.row_number().over(w2) - 1).cast("int").alias("order_id"),
                       "cols")


def topo_sorts_all(nodes: DataFrame, directed: DataFrame, max_orders: int) -> DataFrame:
    """H6 — the lexicographically first ``max_orders`` topological orders, by
    level-wise prefix expansion: each step extends every kept prefix by each
    available node and keeps the ``max_orders`` smallest prefixes per graph
    (exact: every prefix of a DAG extends to a full order)."""
    from pyspark.sql.window import Window
    g = graph_rows(nodes, directed)
    prefixes = g.select("graph_id", "nodes", "preds",
                        F.array().cast("array<string>").alias("cols"))
    n_max = g.agg(F.max(F.size("nodes")).alias("m")).first()["m"] or 0
    w = Window.partitionBy("graph_id").orderBy("cols")
    for i in range(n_max):
        nxt = prefixes.select("graph_id", "nodes", "preds", "cols", F.explode_outer(F.filter(
            F.col("nodes"), _ready(F.col("cols"), F.col("preds")))).alias("x"))
        done = F.size("cols") >= F.size("nodes")
        prefixes = (nxt.where(F.col("x").isNotNull() | done)
                    .select("graph_id", "nodes", "preds",
                            F.when(F.col("x").isNull(), F.col("cols"))
                            .otherwise(F.concat("cols", F.array("x"))).alias("cols"))
                    .withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max_orders)
                    .drop("__r"))
        if i % 8 == 7:
            prefixes = cut_lineage(prefixes)
    full = prefixes.where(F.size("cols") == F.size("nodes"))
    return full.select("graph_id", (F.row_number().over(w) - 1).cast("int").alias("order_id"),
                       "cols")


def footrule_expr(a: Column, b: Column) -> Column:
    """Spearman footrule of two orders; 0 when their node sets differ."""
    same = (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0)
    s = F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + F.abs(
        F.array_position(a, x) - F.array_position(b, x)))
    return F.when(same, s.cast("double")).otherwise(F.lit(0.0))


def footrule(pairs: DataFrame, a: str = "cols_a", b: str = "cols_b") -> DataFrame:
    """H7 — footrule distance for each row holding two orders."""
    return pairs.withColumn("footrule", footrule_expr(F.col(a), F.col(b)))


def _greedy_k_center(pdf, max_orders: int):
    """Gonzalez k-center on one graph's (bounded) candidate set, numpy-vectorized:
    each round updates every candidate's distance to the newest pick only."""
    import numpy as np
    import pandas as pd
    pdf = pdf.sort_values("__pos").reset_index(drop=True)
    n = len(pdf)
    if n <= max_orders:
        return pd.DataFrame({"graph_id": pdf["graph_id"], "order_id": pdf["order_id"],
                             "cols": pdf["cols"], "pick": np.arange(n, dtype="int32")})
    orders = [list(c) for c in pdf["cols"]]
    nodes = sorted(set(orders[0]))
    if any(sorted(o) != nodes for o in orders):  # H7: distance 0 throughout, earliest first
        return pdf[["graph_id", "order_id", "cols"]][:max_orders].assign(
            pick=np.arange(max_orders, dtype="int32"))
    idx = {v: i for i, v in enumerate(nodes)}
    pos = np.empty((n, len(nodes)), dtype=np.int64)
    for r, o in enumerate(orders):
        for p_, v in enumerate(o):
            pos[r, idx[v]] = p_
    picked = np.full(n, -1, dtype=np.int64)
    picked[0] = 0
    dist = np.abs(pos - pos[0]).sum(axis=1).astype(float)
    dist[0] = -1.0
    for r in range(1, max_orders):
        b = int(np.argmax(dist))  # first maximum = earliest candidate
        picked[b] = r
        dist = np.minimum(dist, np.abs(pos - pos[b]).sum(axis=1))
        dist[picked >= 0] = -1.0
    keep = picked >= 0
    return pd.DataFrame({"graph_id": pdf["graph_id"][keep], "order_id": pdf["order_id"][keep],
                         "cols": pdf["cols"][keep], "pick": picked[keep].astype("int32")})


def select_diverse(orders: DataFrame, max_orders: int, seed=0,
                   max_candidates: int | None = None) -> DataFrame:
    """H8 — greedy farthest-point (Gonzalez k-center) selection under the
    footrule, per graph, over all its orders (``max_candidates`` limits them to those
    with the smallest hash; no limit by default).  The first pick is the smallest
    hash; every round picks the candidate with the largest distance to the picked
    set (ties: the earliest candidate) and updates distances with the newest pick
    only.  A graph with at most ``max_orders`` orders keeps all of them.

    The greedy rounds are sequential by nature: one ``applyInPandas`` group per graph holds
    its orders as one integer matrix, and graphs run in parallel.
    Returns ``(graph_id, order_id, cols, pick)``."""
    if "graph_id" not in orders.columns:
        orders = orders.withColumn("graph_id", F.lit("g"))
    from kestrel.functions.exprs import hash_key
    from kestrel.functions.prefix import prefix_sums
    keyed = orders.withColumn("__hs", hash_key(seed, F.col("graph_id"), F.col("order_id")))
    ranked = prefix_sums(keyed.withColumn("__one", F.lit(1)), ["graph_id"], "__hs", ["__one"],
                         tiebreak=["order_id"])
    cand = ranked.select("graph_id", "order_id", "cols", F.col("__one_before").alias("__pos"))
    if max_candidates is not None:
        cand = cand.where(F.col("__pos") < max(max_candidates, max_orders))
    schema = "graph_id string, order_id int, cols array<string>, pick int"
    return cand.groupBy("graph_id").applyInPandas(
        lambda pdf: _greedy_k_center(pdf, max_orders), schema)


def excluded_nodes(nodes: DataFrame, directed: DataFrame, weights: DataFrame | None = None
                   ) -> DataFrame:
    """H9 — graph nodes without a directed edge, plus zero-weight columns
    (``weights(col, weight)``, for every graph, or with a ``graph_id`` for that graph),
    distinct per graph."""
    out = nodes.join(involved_nodes(directed), ["graph_id", "node"], "left_anti")
    if weights is not None:
        zero = weights.where(F.abs(F.col("weight").cast("double")) <= EPS).withColumnRenamed("col", "node")
        if "graph_id" not in weights.columns:
            zero = nodes.select("graph_id").distinct().crossJoin(zero)
        out = out.unionByName(zero.select("graph_id", "node"))
    return out.distinct()


def topo_levels(nodes: DataFrame, directed: DataFrame) -> DataFrame:
    """H4 — longest-path level of every node by iterative peeling: a node gets
    level ``k`` when all its predecessors have levels below ``k``.  Each round is
    one DataFrame step over what remains; its layer is written once and all layers are
    read together at the end.  Runs until a round finds no node, however long the
    longest path; nodes left then lie on or behind a cycle (level null)."""
    spark = nodes.sparkSession
    e = cut_lineage(directed.select("graph_id", "src", "dst").distinct())
    remaining = cut_lineage(nodes.select("graph_id", "node").distinct())
    path = f"{ensure_checkpoint_dir(spark)}/levels-{uuid.uuid4().hex}"
    schema = remaining.withColumn("level", F.lit(0)).schema
    k = 0
    while True:
        has_pred = (e.join(remaining.select("graph_id", F.col("node").alias("src")),
                           ["graph_id", "src"], "left_semi")
                    .select("graph_id", F.col("dst").alias("node")).distinct())
        layer = cut_lineage(remaining.join(has_pred, ["graph_id", "node"], "left_anti"))
        if layer.isEmpty():
            break
        layer.withColumn("level", F.lit(k)).write.mode("append").parquet(path)
        remaining = cut_lineage(remaining.join(layer, ["graph_id", "node"], "left_anti"))
        k += 1
    blocked = remaining.withColumn("level", F.lit(None).cast("int"))
    return blocked if k == 0 else spark.read.schema(schema).parquet(path).unionByName(blocked)


def find_cycle(nodes: DataFrame, directed: DataFrame) -> DataFrame:
    """H2 — per graph: whether it has a cycle, the cycle core (nodes left after
    peeling sources and sinks) and one concrete cycle path found by walking, from
    the smallest core node, to the smallest core successor until a node repeats."""
    lv = topo_levels(nodes, directed)
    core = lv.where(F.col("level").isNull()).select("graph_id", "node")
    # peel sinks: drop core nodes without an out-edge inside the core, repeatedly
    e = directed.select("graph_id", "src", "dst").distinct()
    while True:
        ce = (e.join(core.select("graph_id", F.col("node").alias("src")), ["graph_id", "src"],
                     "left_semi")
              .join(core.select("graph_id", F.col("node").alias("dst")), ["graph_id", "dst"],
                    "left_semi"))
        keep = ce.select("graph_id", F.col("src").alias("node")).distinct()
        new_core = cut_lineage(core.join(keep, ["graph_id", "node"], "left_semi"))
        if new_core.count() == core.count():
            break
        core = new_core
    ce = cut_lineage(ce)
    succ = ce.groupBy("graph_id", "src").agg(F.array_min(F.collect_set("dst")).alias("nx"))
    g = (core.groupBy("graph_id").agg(F.array_sort(F.collect_set("node")).alias("core"))
         .join(succ.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(
             F.struct("src", "nx"))).alias("succ")), "graph_id", "left"))

    def step(acc, _):
        last = F.element_at(acc, -1)
        nxt = F.element_at(F.col("succ"), last)
        return F.when(F.array_contains(F.slice(acc, 1, F.size(acc) - 1), last), acc).otherwise(
            F.concat(acc, F.array(nxt)))
    walk = F.aggregate(F.sequence(F.lit(1), F.size("core") + 1),
                       F.array(F.element_at("core", 1)), step)
    last = F.element_at(walk, -1)
    start = F.array_position(walk, last)
    path = F.slice(walk, start, F.size(walk) - start + 1)
    all_graphs = nodes.select("graph_id").distinct()
    return (all_graphs.join(g, "graph_id", "left")
            .select("graph_id", F.col("core").isNotNull().alias("has_cycle"),
                    F.coalesce("core", F.array().cast("array<string>")).alias("core"),
                    F.when(F.col("core").isNotNull(), path)
                    .otherwise(F.array().cast("array<string>")).alias("cycle")))
